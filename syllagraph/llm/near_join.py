"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide.

1. Each text gets a key of its n-gram set, and MinHash bands whose number and size follow from the threshold and the
   recall asked for. Texts with the same set are one node with a count of copies.
2. Rows meet on band hashes. No pairs are made: in each bucket every node is tied to the bucket's smallest node (first
   within salted parts of the bucket), and the connected components of those ties are the candidate groups.
3. Nodes of a candidate group meet once more with their texts, and every pair is decided on the full sets inside the
   task. Groups beyond a bound are cut into blocks and pairs of blocks, so no task holds more than two blocks.
4. Classes are the connected components of the links that held. Copies are never expanded: counts carry them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import connected_components

#: Most bands; the chance that a pair at the threshold shares none of them is at most 1 - RECALL.
MOST_BANDS = 24
RECALL = 0.9999
#: Bounds of a block: nodes, and n-grams in all of them. A group is cut into up to MANY_BLOCKS smaller blocks first, so
#: that its pairs of blocks spread over as many tasks.
BLOCK_NODES = 1200
SMALL_BLOCK_NODES = 256
MANY_BLOCKS = 24
BLOCK_GRAMS = 1_500_000
#: Parts of a bucket that find their smallest node apart.
BUCKET_PARTS = 16
CACHE_ENTRIES = 300_000


def bands_for(threshold: float, recall: float = RECALL, most: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows): the longest bands for which at most `most` of them reach the recall at the threshold."""
    best = (most, 1)
    for rows in range(1, 33):
        need = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if need > most:
            break
        best = (need, rows)
    return best


class Grams:
    """Sorted distinct 64-bit hashes of a text's word n-grams. A text of fewer words is one gram; one of none has none."""

    def __init__(self, n: int):
        self.n, self.known = n, {}
        self.factors = np.random.default_rng(11).integers(1, 2**63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def word(self, w: str) -> int:
        h = xxhash.xxh64_intdigest(w.encode())
        if len(self.known) >= CACHE_ENTRIES:
            self.known.clear()
        self.known[w] = h
        return h

    def of(self, text: str) -> np.ndarray:
        words = text.split() if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f") else [w for w in BLANKS.split(text) if w]
        known = self.known
        hashes = np.array([h if (h := known.get(w)) is not None else self.word(w) for w in words], dtype=np.uint64)
        m = len(hashes) - self.n + 1
        if not len(hashes):
            return hashes
        if m < 1:
            return np.array([xxhash.xxh64_intdigest(hashes.tobytes())], dtype=np.uint64)
        with np.errstate(over="ignore"):
            mixed = sum((hashes[i : i + m] * f for i, f in enumerate(self.factors)), np.zeros(m, dtype=np.uint64))
            mixed ^= mixed >> np.uint64(31)
            mixed *= np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


BLANKS = re.compile(common.NOT_WORD)


class Bands:
    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(7)
        self.shape = (bands, rows)
        self.a = rng.integers(1, 2**63, size=bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, size=bands * rows, dtype=np.uint64)

    def of(self, grams: np.ndarray) -> list[int]:
        least = np.full(len(self.a), np.uint64(2**64 - 1))
        with np.errstate(over="ignore"):
            for lo in range(0, len(grams), 4096):
                least = np.minimum(least, (grams[lo : lo + 4096, None] * self.a + self.b).min(axis=0))
        least = least.reshape(self.shape)
        return [xxhash.xxh64_intdigest(row.tobytes(), seed=k) - (1 << 63) for k, row in enumerate(least)]


def signatures(docs: DataFrame, n: int, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (hash of the text), key (of the n-gram set; null without n-grams), grams (their number), bands."""
    schema = "doc_id long, h long, key binary, grams long, bands array<long>"
    arrow = docs.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, band = Grams(n), Bands(bands, rows)
        for batch in stream:
            keys, sizes, out = [], [], []
            for text in batch.column(2):
                own = grams.of(text.as_py())
                keys.append(xxhash.xxh128_digest(own.tobytes()) if len(own) else None)
                sizes.append(len(own))
                out.append(band.of(own) if len(own) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(out, arrow.field("bands").type)], schema=arrow)

    rows_ = common.texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("h"), "text")
    return common.saved(rows_.mapInArrow(run, schema), "near-signatures")


def candidate_groups(nodes: DataFrame) -> DataFrame:
    """(node, root): nodes that share a band, in groups. nodes: (key, bands)."""
    rows = nodes.select("key", F.posexplode("bands").alias("k", "value")).select("key", F.xxhash64("k", "value").alias("bucket"), F.pmod(F.hash("key"), F.lit(BUCKET_PARTS)).alias("part"))
    near = rows.withColumn("hub", F.min("key").over(Window.partitionBy("bucket", "part")))
    spokes = near.filter("key <> hub").select(F.col("key").alias("b"), F.col("hub").alias("a"))
    hubs = near.filter("key = hub").select("bucket", "key").withColumn("hub", F.min("key").over(Window.partitionBy("bucket")))
    rims = hubs.filter("key <> hub").select(F.col("key").alias("b"), F.col("hub").alias("a"))
    return connected_components(spokes.union(rims))


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets, by products of slices of the 0/1 matrices."""
    n, m = len(left), len(right)
    out = np.zeros((n, m), dtype=np.float32)
    sizes_l, sizes_r = [len(x) for x in left], [len(x) for x in right]
    if not sum(sizes_l) or not sum(sizes_r):
        return out
    flat_l, flat_r = np.concatenate(left), np.concatenate(right)
    common_grams = np.intersect1d(np.unique(flat_l), np.unique(flat_r), assume_unique=True)
    if not len(common_grams):
        return out
    rows_l, rows_r = np.repeat(np.arange(n), sizes_l), np.repeat(np.arange(m), sizes_r)

    def placed(flat, rows):
        at = np.searchsorted(common_grams, flat)
        at[at == len(common_grams)] = 0
        own = common_grams[at] == flat
        at, rows = at[own], rows[own]
        order = np.argsort(at, kind="stable")
        return at[order], rows[order]

    at_l, rows_l = placed(flat_l, rows_l)
    at_r, rows_r = placed(flat_r, rows_r)
    count_l = np.bincount(at_l, minlength=len(common_grams))
    count_r = np.bincount(at_r, minlength=len(common_grams))
    pairs = count_l * count_r
    dense = pairs > n * m / 16  # grams that many sets share go through matrix products, the others pair by pair
    ends_l, ends_r = np.cumsum(count_l), np.cumsum(count_r)
    rare = np.flatnonzero(~dense)
    step = 2_000_000
    weight = np.cumsum(pairs[rare])
    lo = 0
    while lo < len(rare):
        hi = max(lo + 1, int(np.searchsorted(weight, (weight[lo - 1] if lo else 0) + step, side="right")))
        own = rare[lo:hi]
        cl, cr = count_l[own], count_r[own]
        block = np.repeat(np.arange(len(own)), cl * cr)
        inside = np.arange(len(block)) - np.repeat(np.cumsum(cl * cr) - cl * cr, cl * cr)
        x = rows_l[(ends_l - count_l)[own][block] + inside // cr[block]]
        y = rows_r[(ends_r - count_r)[own][block] + inside % cr[block]]
        out += np.bincount(x * m + y, minlength=n * m).reshape(n, m)
        lo = hi
    frequent = np.flatnonzero(dense)
    for lo in range(0, len(frequent), 2048):
        own = np.full(len(common_grams), -1)
        own[frequent[lo : lo + 2048]] = np.arange(len(frequent[lo : lo + 2048]))
        a, b = np.zeros((n, 2048), dtype=np.float32), np.zeros((m, 2048), dtype=np.float32)
        use = own[at_l] >= 0
        a[rows_l[use], own[at_l][use]] = 1
        use = own[at_r] >= 0
        b[rows_r[use], own[at_r][use]] = 1
        out += a @ b.T
    return out


def find_root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def links_of(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    both = shared(left, right).astype(np.float64)
    union = np.array([len(x) for x in left], dtype=float)[:, None] + np.array([len(x) for x in right], dtype=float)[None, :] - both
    return both >= threshold * union - 1e-9


def verified(groups: DataFrame, n: int, threshold: float) -> DataFrame:
    """key, links (documents linked by other sets), root, split for each node of each block pair.

    groups: (part, i, j, block, key, copies, text), part being a candidate group. In block pair (i, i) all pairs of the
    block are decided, in (i, j) those across.
    """
    schema = "key binary, links long, root binary, split boolean"
    arrow = groups.sparkSession.createDataFrame([], schema).toArrow().schema
    # the block pairs of a group are numbered and dealt to tasks in turn, from a task that the group's hash picks
    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = F.expr("i * (2 * blocks - i + 1) div 2 + j - i")
    rows = groups.repartitionById(tasks, F.pmod(F.hash("part") + number, F.lit(tasks)).cast("int")).sortWithinPartitions("part", "i", "j")
    rows = rows.select("part", "i", "j", "blocks", "block", "key", "copies", "text")

    def decide(rows: list[tuple], grams: Grams) -> pa.RecordBatch:
        (_, i, j, blocks, *_), seen = rows[0], {}
        for *_, block, key, copies, text in rows:
            seen.setdefault(key, (block, copies, text))
        keys = sorted(seen, key=lambda k: (seen[k][0], k))
        sets = [grams.of(seen[k][2]) for k in keys]
        copies = np.array([seen[k][1] for k in keys])
        cut = sum(seen[k][0] == i for k in keys)
        if i == j:
            linked = links_of(sets, sets, threshold)
            np.fill_diagonal(linked, False)
            counts, pairs = linked @ copies, np.argwhere(np.triu(linked))
        else:
            linked = links_of(sets[:cut], sets[cut:], threshold)
            counts = np.concatenate([linked @ copies[cut:], linked.T @ copies[:cut]])
            pairs = np.argwhere(linked) + [0, cut]
        parent = list(range(len(keys)))
        for a, b in pairs.tolist():
            x, y = find_root(parent, a), find_root(parent, b)
            parent[max(x, y)] = min(x, y)
        roots = [keys[find_root(parent, k)] for k in range(len(keys))]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(counts.astype(np.int64)), pa.array(roots, pa.binary()), pa.array([blocks > 1] * len(keys))], schema=arrow)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, held, now = Grams(n), [], None
        for batch in stream:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                if row[:3] != now and held:
                    yield decide(held, grams)
                    held = []
                now = row[:3]
                held.append(row)
        if held:
            yield decide(held, grams)

    return rows.mapInArrow(run, schema)


def jaccard_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", block_nodes: int = BLOCK_NODES, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """doc_id, h, class_id, class_h, n_links of every row; h is the hash of the text, class_id and class_h those of the
    class's first row by doc_id and h (a null doc_id first)."""
    common.bounded_batches(docs.sparkSession)
    bands, rows = bands_for(threshold, recall)
    signed = signatures(docs, n, bands, rows, id_col, text_col)
    some = signed.filter("key IS NOT NULL")
    nodes = common.saved(some.groupBy("key").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("grams").alias("grams")), "near-nodes")
    groups = candidate_groups(nodes.select("key", "bands")).withColumnRenamed("node", "key").withColumnRenamed("root", "part")
    members = common.saved(nodes.select("key", "first", "copies", "grams").join(groups, "key"), "near-members")
    bounded = F.ceil(F.greatest(F.count("*") / block_nodes, F.sum("grams") / block_grams))
    spread = F.least(F.ceil(F.count("*") / SMALL_BLOCK_NODES), F.lit(MANY_BLOCKS))
    blocks = F.greatest(bounded, spread).cast("int")
    sizes = members.groupBy("part").agg(blocks.alias("blocks"))
    placed = members.join(sizes, "part").select("part", "key", "copies", F.col("first.doc_id").alias("doc_id"), F.col("first.h").alias("h"), "blocks", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"))
    own = common.texts(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    known = own.join(placed, own["doc_id"].eqNullSafe(placed["doc_id"]) & (own["h"] == placed["h"])).select("part", "key", "copies", "blocks", "block", "text")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    meets = known.withColumn("other", other).select("part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "blocks", "block", "key", "copies", "text")
    # block pairs that tied a node to the same root are one row, and small tables few files
    decided = verified(meets, n, threshold).groupBy("key", "root", "split").agg(F.sum("links").alias("links"))
    links = common.saved(decided, "near-links")

    whole = links.filter(~F.col("split")).select("key", "root")
    across = links.filter("split AND key <> root").select(F.col("root").alias("a"), F.col("key").alias("b"))
    merged = connected_components(across).select(F.col("node").alias("key"), F.col("root").alias("far"))
    roots = links.filter("split").select("key").distinct().join(merged, "key", "left").select("key", F.coalesce("far", "key").alias("root"))
    counts = links.groupBy("key").agg(F.sum("links").alias("links"))
    of = common.saved(members.select("key", "first").join(whole.union(roots), "key").join(counts, "key"), "near-classes")
    heads = common.saved(of.groupBy("root").agg(F.min("first").alias("head")), "near-heads")
    classes = common.saved(of.join(heads, "root").select("key", "head", "links"), "near-classes")

    result = nodes.select("key", "first", "copies").join(classes, "key", "left").select("key", F.coalesce("head", "first").alias("head"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # saved, so that both sides of the join are plain exchanges: one with very many copies of a set can then be split
    result = common.saved(result.filter("n_links > 0"), "near-result")
    linked = some.select("doc_id", "h", "key").join(result, "key", "left")
    own_head = F.struct("doc_id", "h")
    linked = linked.select("doc_id", "h", F.coalesce("head", own_head).alias("head"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    empty = signed.filter("key IS NULL").select("doc_id", "h", own_head.alias("head"), F.lit(0).cast("long").alias("n_links"))
    return linked.union(empty).select("doc_id", "h", F.col("head.doc_id").alias("class_id"), F.col("head.h").alias("class_h"), "n_links")


def jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id (smallest doc_id of its class), n_links (rows whose n-gram sets have a
    Jaccard similarity of at least the threshold to its own, copies included, itself not).

    Words are runs without ASCII white space, case kept. A null or empty text, or one without words, has no n-grams, links
    to nothing and is its own class; a text of fewer than n words is one n-gram. Repeated rows link to each other. An
    empty table gives no rows; other columns are ignored.
    """
    return jaccard_classes(docs, n, threshold, recall, id_col, text_col).select("doc_id", "class_id", "n_links")


def one_per_class(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are the first of their class by doc_id and the hash of the text, all their columns as they were,
    whatever their names. Rows with the same id and text stay or go together; a null id comes first; texts without words
    are classes of their own and stay; an empty table stays empty."""
    gone = jaccard_classes(docs, n, threshold, recall, id_col, text_col).filter("NOT (doc_id <=> class_id AND h <=> class_h)").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    text = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(F.col("_id")) & (text == F.col("_h")), "left_anti")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, string_split_regex(trim(coalesce(text, ''), E' \t\n\x0b\f\r'), '[ \t-\r]+') AS ws FROM documents
), grams AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE ws[1] <> '') AS x
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams AS a JOIN grams AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN sizes AS s ON s.doc_id = x JOIN sizes AS t ON t.doc_id = y WHERE c >= 0.8 * (s.n + t.n - c)
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach AS r JOIN links AS l ON l.x = r.y
)
SELECT d.doc_id, (SELECT min(y) FROM reach WHERE reach.x = d.doc_id) AS class_id,
       (SELECT count(*) FROM links WHERE links.x = d.doc_id) AS n_links
FROM documents AS d
"""
