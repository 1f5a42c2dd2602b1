"""Alignment of two tokenizers over a corpus: which of their tokens overlap, how often, and how each document shares in it.

Tasks that read texts encode them, cut both token sequences where they end together, and keep which pair of ids is linked in
which document. Those pair-document records leave a task as runs: sorted by pair (ids of the second side first), cut by the
second side's low bits into parts and compressed. Pairs are counted by k-way heap merges of the runs' indexes, as many levels
of them as there are runs; each level takes the second side's ids in order, so the highest count of an id is known as soon as
its pairs are through. Counts then go back to the runs of their part, whose records add them up by document.

A task holds one block of a merge, or the counts of one part and one run: both are bounded by the vocabularies and the size
of a run. A pair or id that a third of all links hold is one entry per run, so it makes no task larger.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .token_count import SPLIT, byte_letters

#: Parts by the second side's ids, and links of a run: a run is closed by the text that reaches them.
PARTS = 16
RUN_LINKS = 4_000_000
#: Runs merged by one task, about, and pairs of a block that it writes.
FAN_IN = 64
BLOCK_PAIRS = 1 << 17
#: Text characters that are laid out together inside a task.
BATCH_CHARS = 1 << 20

SEPARATORS = (b",", b"|", b";", b"")
COMMA, SIDE, GROUP, END = range(4)

RUN_SCHEMA = "run long, idx int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, part int, first long, pairs binary, records binary"
ARROW_RUN = pa.schema([("run", pa.int64()), ("idx", pa.int32()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("part", pa.int32()), ("first", pa.int64()), ("pairs", pa.binary()), ("records", pa.binary())])


class Vocabularies:
    """Both encoders, the bytes of their ids and the texts of ids between separators."""

    def __init__(self, bytes_path: str, pieces_path: str):
        with open(bytes_path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec["pre_tokenizer"] or {}
        letters = {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"] for t in spec["added_tokens"] if t.get("special")}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        first = min((spec["model"]["vocab"][m] for m in merged), default=0)
        if spec["normalizer"] is not None or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or [spec["model"]["vocab"][m] for m in merged] != [*range(first, first + len(merged))]:
            raise ValueError("only byte-level vocabularies whose ids follow their merges, without a normaliser and with the usual split, are aligned")
        self.first = tiktoken.Encoding("first", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        self.size_a, self.size_b = max(ranks.values()) + 1, self.second.get_piece_size()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.second.id_to_piece, range(self.size_b)))]
        self.long_a, self.long_b = np.zeros(self.size_a, np.int64), np.array([len(x) for x in self.bytes_b])
        for token, i in ranks.items():
            self.long_a[i] = len(token)
        width = f"S{len(str(max(self.size_a, self.size_b))) + 1}"
        self.texts = np.array([str(i).encode() + s for size in (self.size_a, self.size_b) for i in range(size) for s in SEPARATORS], dtype=width)

    def ids(self, text: str, pieces: list[int]) -> tuple[np.ndarray, list[int]] | None:
        """Ids of both sides; None for an empty text, or one that either side doesn't give back."""
        if not text:
            return None
        whole = f" {text}"
        tokens = self.first.encode_ordinary(whole)
        raw = whole.encode()
        if b"".join(map(self.bytes_b.__getitem__, pieces)) != raw or self.first.decode_bytes(tokens) != raw:
            return None
        return tokens, pieces


@lru_cache(maxsize=1)
def vocabularies(bytes_path: str, pieces_path: str) -> Vocabularies:
    return Vocabularies(bytes_path, pieces_path)


class Layout:
    """Both token sequences of several texts end to end, each text given back whole by both sides."""

    def __init__(self, v: Vocabularies, both: list[tuple[list[int], list[int]]]):
        self.n_a, self.n_b = (np.array([len(x[side]) for x in both]) for side in (0, 1))
        a, b = (np.concatenate([np.array(x[side], dtype=np.int64) for x in both]) for side in (0, 1))
        ends_a, ends_b = np.cumsum(v.long_a[a]), np.cumsum(v.long_b[b])
        stop = np.zeros((2, ends_a[-1]), bool)
        stop[0, ends_a - 1] = stop[1, ends_b - 1] = True
        # a link is a stretch of bytes between two places where either side ends
        ends = np.flatnonzero(stop[0] | stop[1])
        stop_a, stop_b = stop[0, ends], stop[1, ends]
        together = stop_a & stop_b
        group = np.cumsum(together) - together
        self.pairs = b[np.cumsum(stop_b) - stop_b] * v.size_a + a[np.cumsum(stop_a) - stop_a]
        last = np.cumsum(self.n_a) - 1
        bounds = np.searchsorted(ends, ends_a[last] - 1) + 1
        self.n_links = np.diff(bounds, prepend=0)
        self.n_groups = np.diff(np.cumsum(together)[bounds - 1], prepend=0)
        group_a, group_b = group[stop_a], group[stop_b]
        in_a, in_b = np.cumsum(np.bincount(group_a)), np.cumsum(np.bincount(group_b))
        code_a, code_b = a * 4, (b + v.size_a) * 4
        code_a[in_a - 1] += SIDE
        code_b[in_b - 1] += GROUP
        code_b[np.cumsum(self.n_b) - 1] += END - GROUP
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.concatenate([[0], in_b])[group_a]] = code_a
        codes[np.arange(len(b)) + in_a[group_b]] = code_b
        hi = np.cumsum(self.n_a + self.n_b)
        self.digests = [hashlib.sha256(v.texts[codes[lo:up]].tobytes().translate(None, b"\0")).hexdigest() for lo, up in zip([0, *hi[:-1].tolist()], hi.tolist(), strict=True)]


def pack(*columns: np.ndarray) -> bytes:
    """Whole numbers of equally long columns, compressed; the first is in order and kept by its steps."""
    first = np.diff(columns[0], prepend=columns[0][:1] * 0)
    parts = [np.asarray(c, dtype="<i8") for c in (first, *columns[1:])]
    narrow = [c.astype(next(t for t in ("<u1", "<u2", "<u4", "<i8") if not len(c) or (c.min() >= 0 and c.max() <= np.iinfo(t).max))) for c in parts]
    head = bytes([len(narrow), *(c.itemsize for c in narrow)])
    return zstandard.compress(head + b"".join(c.tobytes() for c in narrow), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    sizes = list(raw[1 : 1 + raw[0]])
    n, at, out = (len(raw) - 1 - len(sizes)) // sum(sizes), 1 + len(sizes), []
    for s in sizes:
        out.append(np.frombuffer(raw, {1: "<u1", 2: "<u2", 4: "<u4", 8: "<i8"}[s], n, at).astype(np.int64))
        at += s * n
    return [np.cumsum(out[0]), *out[1:]]


class Run:
    """Links of consecutive texts of a task, until they are enough."""

    def __init__(self, number: int):
        self.number, self.texts, self.links = number, 0, 0
        self.pairs: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []

    def add(self, layout: Layout) -> None:
        self.pairs.append(layout.pairs)
        self.owners.append(np.repeat(np.arange(self.texts, self.texts + len(layout.n_links)), layout.n_links))
        self.texts += len(layout.n_links)
        self.links += len(layout.pairs)

    def parts(self, size_a: int) -> Iterator[tuple[int, int, bytes, bytes]]:
        """part, first pair, index (pair, links, records of it) and records (text, links in it) of each part that has any."""
        pairs = np.concatenate(self.pairs)
        part = pairs // size_a % PARTS
        owners = np.concatenate(self.owners)
        for p in range(PARTS):
            own = part == p
            if not own.any():
                continue
            records, links = np.unique(pairs[own] * self.texts + owners[own], return_counts=True)
            pair, at, held = np.unique(records // self.texts, return_index=True, return_counts=True)
            yield p, int(pair[0]), pack(pair, np.add.reduceat(links, at), held), pack(np.arange(len(records)), records % self.texts, links)


def pieces_of(rows: list[tuple], batch_chars: int) -> Iterator[list[tuple]]:
    """Rows (doc_id, text) in lists of bounded characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size >= batch_chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def encoded_runs(docs: DataFrame, bytes_path: str, pieces_path: str, id_col: str, text_col: str) -> DataFrame:
    """Two kinds of rows of RUN_SCHEMA: documents (part is null) and parts of runs (idx is null). A document without tokens has
    no run."""

    def run(stream):
        v = vocabularies(bytes_path, pieces_path)
        base, number = TaskContext.get().partitionId() << 32, 0
        now = Run(base)

        def close(r: Run) -> pa.RecordBatch:
            rows = list(r.parts(v.size_a))
            none = [None] * len(rows)
            return table(run=[r.number] * len(rows), idx=none, doc_id=none, n_a=none, n_b=none, n_groups=none, n_links=none, groups_sha256=none, part=[x[0] for x in rows], first=[x[1] for x in rows], pairs=[x[2] for x in rows], records=[x[3] for x in rows])

        for ids, values in common.batches(stream):
            for rows in pieces_of(list(zip(ids, values, strict=True)), BATCH_CHARS):
                pieces = v.second.encode([t for _, t in rows], num_threads=1)
                both = [v.ids(t, p) for (_, t), p in zip(rows, pieces, strict=True)]
                good = [x for x in both if x]
                layout = Layout(v, good) if good else None
                places = iter(range(now.texts, now.texts + len(good)))
                idx = [next(places) if x else None for x in both]
                at = np.array([i for i, x in enumerate(both) if x], dtype=np.int64)

                def spread(column: np.ndarray, n: int = len(rows), at: np.ndarray = at) -> np.ndarray:
                    out = np.zeros(n, np.int64)
                    out[at] = column
                    return out

                counts = {c: spread(getattr(layout, c)) if layout else [0] * len(rows) for c in ("n_a", "n_b", "n_groups", "n_links")}
                digests = iter(layout.digests if layout else ())
                none = [None] * len(rows)
                yield table(run=[now.number if x else None for x in both], idx=idx, doc_id=[i for i, _ in rows], **counts, groups_sha256=[next(digests) if x else "" for x in both], part=none, first=none, pairs=none, records=none)
                if layout:
                    now.add(layout)
                if now.links >= RUN_LINKS:
                    yield close(now)
                    number += 1
                    now = Run(base + number)
        if now.links:
            yield close(now)

    return common.texts(docs, id_col, text_col).mapInArrow(run, RUN_SCHEMA)


def table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in ARROW_RUN], schema=ARROW_RUN)


def merged(blocks: Iterable[tuple[int, bytes]], size_a: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of an id of the second side and their links, id after id. blocks: first pair and index of sorted runs, or of
    pieces of them, in the order of their first pairs; those that the current id hasn't reached aren't opened."""
    blocks = iter(blocks)
    waiting = next(blocks, None)
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    opened = 0
    while heap or waiting:
        now = min(heap[0][0] if heap else waiting[0] // size_a, waiting[0] // size_a if waiting else heap[0][0])
        while waiting and waiting[0] // size_a == now:
            pairs, links = unpack(waiting[1])[:2]
            heapq.heappush(heap, (now, opened, pairs, links))
            opened += 1
            waiting = next(blocks, None)
        own = []
        while heap and heap[0][0] == now:
            _, order, pairs, links = heapq.heappop(heap)
            cut = int(np.searchsorted(pairs, (now + 1) * size_a))
            own.append((pairs[:cut], links[:cut]))
            if cut < len(pairs):
                heapq.heappush(heap, (int(pairs[cut]) // size_a, order, pairs[cut:], links[cut:]))
        pairs, links = (np.concatenate([x[i] for x in own]) for i in (0, 1))
        order = np.argsort(pairs, kind="stable")
        pairs, at = np.unique(pairs[order], return_index=True)
        yield pairs, np.add.reduceat(links[order], at)


def counted_pairs(runs: DataFrame, n_runs: int, size_a: int) -> DataFrame:
    """part, first, pairs: blocks of (pair, links, whether no pair of its second id has more) over all runs, in order."""

    def run(stream):
        rows = ((p, g, f, x) for batch in stream for p, g, f, x in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
        for (part, group), own in groupby(rows, key=lambda r: r[:2]):
            held, n = [], 0
            for pairs, links in merged((r[2:] for r in own), size_a):
                held.append((pairs, links, links == links.max()))
                n += len(pairs)
                if n >= BLOCK_PAIRS:
                    yield written(part, group, held)
                    held, n = [], 0
            if held:
                yield written(part, group, held)

    def written(part: int, group: int, held: list[tuple]) -> pa.RecordBatch:
        pairs, links, best = (np.concatenate([x[i] for x in held]) for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([group], pa.int64()), pa.array([int(pairs[0])]), pa.array([pack(pairs, links, best)])], names=["part", "run", "first", "pairs"])

    rows, n = runs.select("part", "run", "first", "pairs"), n_runs
    while True:
        groups = -(-n // FAN_IN)
        dealt = rows.select("part", F.pmod(F.xxhash64("run"), F.lit(groups)).cast("long").alias("group"), "first", "pairs")
        ordered = dealt.repartition("part", "group").sortWithinPartitions("part", "group", "first")
        rows, n = common.saved(ordered.mapInArrow(run, "part int, run long, first long, pairs binary"), "pair-counts"), groups
        if n <= 1:
            return rows


def contributions(runs: DataFrame, counts: DataFrame, n_runs: int) -> DataFrame:
    """run, idx, n_best, count_sum: what each part of each run adds to its documents."""
    groups = max(-(-n_runs // FAN_IN), 1)
    rows = runs.select("part", F.pmod(F.xxhash64("run"), F.lit(groups)).cast("long").alias("group"), F.lit(1).alias("kind"), "run", "first", "pairs", "records")
    whole = counts.select("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")).alias("group"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("run"), "first", "pairs", F.lit(None).cast("binary").alias("records"))
    dealt = whole.union(rows).repartition("part", "group").sortWithinPartitions("part", "group", "kind", "first")

    def run(stream):
        rows = (r for batch in stream for r in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5, 6)), strict=True))
        for _, own in groupby(rows, key=lambda r: r[:2]):
            blocks, known = [], None
            for _, _, kind, number, pairs, records in own:
                if kind == 0:
                    blocks.append(unpack(pairs))
                    continue
                if known is None:
                    known = [np.concatenate([b[i] for b in blocks]) for i in range(3)]
                pair, _, held = unpack(pairs)
                _, text, links = unpack(records)
                at = np.repeat(np.searchsorted(known[0], pair), held)
                texts, place = np.unique(text, return_inverse=True)
                total, best = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                np.add.at(total, place, links * known[1][at])
                np.add.at(best, place, links * known[2][at])
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(texts), pa.int64()), pa.array(texts.astype(np.int32)), pa.array(best), pa.array(total)], names=["run", "idx", "n_best", "count_sum"])

    return dealt.mapInArrow(run, "run long, idx int, n_best long, count_sum long")


def align_tokenizers(docs: DataFrame, bytes_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    bytes_path: a byte-level BPE .json file, whose side encodes a space and the text; pieces_path: a SentencePiece model, which
    adds that space itself; both present on every executor. A row has no tokens (zeros and '') if its text is null or empty,
    or if the tokens of either side don't spell a space and the text. Repeated rows count each and give repeated results; a
    null id is kept; no rows give no rows; other columns are ignored. Sums are 64 bits.
    """
    v = Vocabularies(bytes_path, pieces_path)
    both = common.saved(encoded_runs(docs, bytes_path, pieces_path, id_col, text_col), "token-runs")
    runs, rows = both.filter("part IS NOT NULL"), both.filter("part IS NULL")
    n_runs = runs.select("run").distinct().count()
    counts = counted_pairs(runs, n_runs, v.size_a)
    shares = contributions(runs, counts, n_runs).groupBy("run", "idx").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("run", "idx", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(shares, ["run", "idx"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
