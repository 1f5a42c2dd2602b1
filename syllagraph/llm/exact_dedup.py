"""Exact deduplication over an extendible-hash index kept in the shared folder. DataFrame operations only.

1. Keys: rows per 64-bit hash of the text, written to the shared folder.
2. Directory: starts at the depth that the number of rows asks for; each doubling splits the overfull buckets alone, until
   every bucket holds at most BUCKET_ROWS rows or one key. A bucket is a prefix of the hash, so buckets in order are key ranges.
3. Owners: consecutive buckets by their cumulative rows. Each row is sent to its bucket's owner task, which chains the rows
   of equal hashes in the order of their whole texts, byte by byte, and writes one file for each of its buckets.
4. A key with more rows than a bucket holds is cut into parts with owners of their own. Each part makes groups as above; the
   parts' groups, one row for each text, are then joined by whole texts, and the rows learn their group's outcome.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Rows that a bucket holds before it splits. The directory has at most 4 n / BUCKET_ROWS cells of two longs for n rows of evenly
#: spread hashes, about 16 million for 100 TB of documents of 3 KB; it and the table of cut keys (n / BUCKET_ROWS rows at most)
#: are what is broadcast. A larger table wants a larger bucket_rows.
BUCKET_ROWS = 8192
#: Most owner tasks, so that one shuffle stays manageable; an owner then has more buckets.
MOST_OWNERS = 20_000
#: Deepest directory: all bits of the hash but the sign.
MAX_DEPTH = 63


def cell(depth: int) -> Column:
    """The first `depth` bits of the hash as a number."""
    return F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")


def directory_of(keys: DataFrame, n_rows: int, capacity: int) -> tuple[DataFrame, int]:
    """(depth, prefix, rows) of all buckets, and the global depth. keys: (h, n, parts)."""
    depth = max(0, int(math.log2(max(1.0, n_rows / capacity))))

    def level(part: DataFrame, at: int) -> DataFrame:
        return part.groupBy(cell(at).alias("prefix")).agg(F.sum("n").alias("rows"), F.count("*").alias("keys"))

    full = (F.col("rows") > capacity) & (F.col("keys") > 1)
    level_now = saved(level(keys, depth), "dedup-level")
    leaves: DataFrame | None = None
    while True:
        done = (level_now.filter(~full) if depth < MAX_DEPTH else level_now).select(F.lit(depth).alias("depth"), "prefix", "rows")
        leaves = done if leaves is None else leaves.union(done)
        if depth == MAX_DEPTH or level_now.filter(full).isEmpty():
            return leaves, depth
        over = level_now.filter(full).select("prefix")
        # an overfull bucket splits in two: the keys of the overfull ones alone are counted at the next depth
        level_now = saved(level(keys.withColumn("prefix", cell(depth)).join(over, "prefix", "left_semi"), depth + 1), "dedup-level")
        depth += 1


def buckets_of(leaves: DataFrame, n_rows: int, capacity: int) -> tuple[DataFrame, int]:
    """(depth, prefix, rows, bucket, owner) and the number of owners: buckets are numbered in key order, and owners are
    consecutive buckets of about equal numbers of rows."""
    owners = max(1, min(MOST_OWNERS, math.ceil(n_rows / capacity)))
    order = Window.orderBy(F.expr(f"shiftleft(prefix, {MAX_DEPTH} - depth)"), "depth")
    before = F.coalesce(F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    owner = F.least(F.floor(before * F.lit(owners) / F.lit(max(1, n_rows))), F.lit(owners - 1)).cast("int")
    return leaves.select("*", F.row_number().over(order).cast("long").alias("bucket"), owner.alias("owner")), owners


def cells_of(buckets: DataFrame, depth: int) -> DataFrame:
    """(cell, bucket, owner) for each cell of the doubled directory; several cells may share a bucket."""
    low = F.expr(f"shiftleft(prefix, {depth} - depth)")
    return buckets.select(F.explode(F.sequence(low, low + F.expr(f"shiftleft(1L, {depth} - depth)") - 1)).alias("cell"), "bucket", "owner")


def index_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, bucket_rows: int = BUCKET_ROWS, hash_of: Callable[[Column], Column] = F.xxhash64) -> tuple[DataFrame, DataFrame]:
    """The index's files and its directory.

    Index: doc_id, bucket, owner, h, part, parts, place (of the text in the chain of its hash and part), first (the row that
    its part keeps), keep_id, group_size (of the part's group), text_sha256, text and carried (of first rows, where they are
    asked for or the key has several parts). One file for each bucket and part of a key.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    carried = F.struct(F.col(text_col).isNull().alias("_no_text"), *[F.col(c) for c in carry or []])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), hash_of(text).alias("h"), carried.alias("carried"), F.monotonically_increasing_id().alias("n"))
    parts = F.ceil(F.col("n") / bucket_rows).cast("long")
    keys = saved(rows.groupBy("h").agg(F.count("*").alias("n")).withColumn("parts", parts), "dedup-keys")
    n_rows = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    leaves, depth = directory_of(keys, n_rows, bucket_rows)
    buckets, owners = buckets_of(leaves, n_rows, bucket_rows)
    directory = saved(buckets, "dedup-directory")

    cut = keys.filter("parts > 1").select("h", "parts")
    dealt = rows.join(F.broadcast(cut), "h", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod("n", "parts")).withColumn("cell", cell(depth)).drop("n")
    dealt = dealt.join(F.broadcast(cells_of(directory, depth)), "cell").withColumn("owner", F.pmod(F.col("owner") + F.col("part"), F.lit(owners)).cast("int"))
    owned = dealt.repartitionById(owners, F.col("owner"))

    key = ["owner", "bucket", "h", "part"]
    chain = Window.partitionBy(*key, "text").orderBy(F.col("doc_id").desc_nulls_last())
    whole = chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.col("first")
    keep = first & ((F.col("parts") > 1) | F.lit(carry is not None))
    owned = owned.select("*", F.first("doc_id").over(whole).alias("keep_id"), F.count("*").over(whole).alias("group_size"), (F.row_number().over(chain) == 1).alias("first"), F.dense_rank().over(Window.partitionBy(*key).orderBy("text")).alias("place"))
    index = owned.select("doc_id", "bucket", "owner", "h", "part", "parts", "place", "first", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256"), F.when(keep, F.col("text")).alias("text"), F.when(first, F.col("carried")).alias("carried"))
    return saved(index, "dedup-index", "bucket"), directory


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, **bounds) -> DataFrame:
    """The index's rows with keep_id, group_size and kept of whole groups."""
    index, _ = index_of(docs, id_col, text_col, carry, **bounds)
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "text", "carried"]
    alone = index.filter("parts = 1").withColumn("kept", F.col("first")).select(*out)
    cut = index.filter("parts > 1")
    if cut.isEmpty():
        return alone
    same = Window.partitionBy("h", "text")
    wins = F.row_number().over(same.orderBy(F.col("keep_id").desc_nulls_last(), "part")) == 1
    groups = cut.filter("first").select("h", "part", "place", F.max("keep_id").over(same).alias("best_id"), F.sum("group_size").over(same).alias("size"), wins.alias("wins"))
    rows = cut.join(groups, ["h", "part", "place"]).withColumn("kept", F.col("first") & F.col("wins")).withColumn("keep_id", F.col("best_id")).withColumn("group_size", F.col("size"))
    return alone.union(rows.select(*out))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when all their bytes are. The row with the largest doc_id of a group is kept, a null doc_id counting
    as the smallest; of repeated rows with that doc_id one is kept. A null text is an empty text, and empty texts are
    equal. An empty table gives no rows; other columns are ignored.
    """
    return grouped(docs, id_col, text_col, **bounds).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns as they were, whatever their names; a null text stays
    null (of null and empty texts, which are equal, the row with the largest id stays). An empty table stays empty."""
    carry = [c for c in docs.columns if c != text_col]
    found = grouped(docs, id_col, text_col, carry, **bounds).filter("kept")
    text = F.when(~F.col("carried._no_text"), F.col("text"))
    return found.select(*[text.alias(c) if c == text_col else F.col("carried")[c].alias(c) for c in docs.columns])


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) AS d
"""
