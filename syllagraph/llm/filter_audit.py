"""How five document filters interact: which one removes what, in every order they may be applied.

A document that fails the filters of a mask survives a subset of filters if the two have none in common. Its survival word
has one bit per subset (32 of them), so the positional popcounts of many words are the survivors of every subset, and every
figure of every order is a difference of two of them. Words are counted by carry-save adders inside tasks; what is shuffled
are 32 counts per part and label.
"""

from __future__ import annotations

import hashlib
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: The filter that looks at other documents: an equal text with a smaller doc_id.
COPY = FILTERS.index("E")

CAPITALS = bytes(range(0x41, 0x5B))
NOT_CAPITALS = bytes(b for b in range(256) if b not in CAPITALS)
TRAILING = bytes(range(0x80, 0xC0))
MARKS = b"#$%&*|"

#: Survival word by mask of failed filters: bit s is set if the document survives subset s.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & m) for m in range(SUBSETS)], dtype=np.uint32)


def own_mask(text: bytes) -> int:
    """Failed filters among those that look at the text alone. bytes.split() parts at the contract's six characters."""
    words = text.split()
    few = len(words) < 50
    repeated = 100 * len(set(words)) < 65 * len(words)
    capitals = 100 * len(text.translate(None, NOT_CAPITALS)) > 5 * len(text.translate(None, TRAILING))
    marked = len(text.translate(None, MARKS)) < len(text)
    return few | repeated << 1 | capitals << 2 | marked << 3


def features(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """doc_id, part, mask of A to D and digest of the text of every row."""
    empty = F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), empty).alias("part"), F.coalesce(F.col(text_col), empty).cast("binary").alias("text"))

    def run(stream):
        for batch in stream:
            values = batch.column(2)
            for lo, hi in common.slices(pc.binary_length(values).to_pylist()):
                masks, keys = [], []
                for text in values.slice(lo, hi - lo).to_pylist():
                    masks.append(own_mask(text))
                    keys.append(hashlib.sha256(text).digest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(masks, pa.int32()), pa.array(keys, pa.binary())], names=["doc_id", "part", "mask", "text_key"])

    return rows.mapInArrow(run, "doc_id long, part string, mask int, text_key binary")


def weighted_masks(rows: DataFrame) -> DataFrame:
    """part, good, toxic, mask of A to E, n. Rows of one text differ in E only: of each text those with the smallest doc_id
    pass it. Rows are added up by document, then by text, part and label, before a text's parts are looked at together."""
    label = ["part", "good", "toxic"]
    by_doc = rows.groupBy("doc_id", "text_key", "mask", *label).agg(F.count("*").alias("n"))
    known = F.col("doc_id").isNotNull()
    by_text = by_doc.groupBy("text_key", "mask", *label).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_null"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("low")
    )
    first = by_text.groupBy("text_key").agg(F.min("low.doc_id").alias("first"))
    heads = by_text.join(first, "text_key").withColumn("passing", F.col("n_null") + F.when(F.col("low.doc_id") == F.col("first"), F.col("low.n")).otherwise(0))
    two = F.array(F.struct(F.col("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + (1 << COPY)).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
    return heads.select(*label, F.explode(two).alias("w")).filter("w.n > 0").select(*label, "w.mask", "w.n")


def carry_save(levels: list[np.ndarray]) -> list[int]:
    """Count of each bit over words; those of level i count 2^i times. Full adders turn three words of a level into one and a
    carry word of the next, until each level has two at most; only those few are read bit by bit."""
    levels, counts, i = list(levels), [0] * SUBSETS, 0
    while i < len(levels):
        words = levels[i]
        while len(words) > 2:
            third = len(words) // 3
            a, b, c, rest = words[:third], words[third : 2 * third], words[2 * third : 3 * third], words[3 * third :]
            odd = a ^ b
            if i + 1 == len(levels):
                levels.append(np.empty(0, np.uint32))
            levels[i + 1] = np.concatenate([levels[i + 1], (a & b) | (c & odd)])
            words = np.concatenate([odd ^ c, rest])
        for w in words.tolist():
            for s in range(SUBSETS):
                counts[s] += (w >> s & 1) << i
        i += 1
    return counts


def survivors(masks: DataFrame) -> DataFrame:
    """part, subset, n, good, toxic: documents that survive each subset of filters, and how many of them are good and toxic.
    Tasks count the words of each of their batches; the counts are added up by part and subset."""

    def run(stream):
        for batch in stream:
            keys = [batch.column(i).to_pylist() for i in range(3)]
            words, n = WORDS[batch.column(3).to_numpy()], batch.column(4).to_numpy()
            place: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*keys, strict=True)):
                place.setdefault(key, []).append(i)
            for (part, good, toxic), at in place.items():
                own, times = words[at], n[at]
                alive = np.array(carry_save([own[times >> k & 1 == 1] for k in range(int(times.max()).bit_length())]), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([part] * SUBSETS), pa.array(np.arange(SUBSETS, dtype=np.int32)), *(pa.array(alive * k) for k in (1, good, toxic))], names=["part", "subset", "n", "good", "toxic"])

    counted = masks.mapInArrow(run, "part string, subset int, n long, good long, toxic long")
    return counted.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def step_table(spark) -> DataFrame:
    """row, filter_order, step, before, bit and weights of all orders: fixed by the number of filters. before: the subset
    applied earlier; weights: by subset without the filter, in how many orders exactly that subset stands before it."""
    size, orders = len(FILTERS), list(permutations(range(len(FILTERS))))
    weights = [[0] * SUBSETS for _ in range(size)]
    rows = []
    for order in orders:
        before = 0
        for step, f in enumerate(order, 1):
            weights[f][before] += 1
            rows.append((len(rows), "".join(FILTERS[g] for g in order), step, before, 1 << f, weights[f]))
            before |= 1 << f
    return spark.createDataFrame(rows, "row int, filter_order string, step int, before int, bit int, weights array<int>")


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley.

    A null text is empty, a null part the empty string. A row without doc_id is no copy and makes none. Repeated rows count each;
    rows of one doc_id and text pass filter E together. A document is good (toxic) if any of its labels says so; one without
    labels is neither. No documents: no rows. Other columns are ignored.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    rows = features(docs, id_col, text_col, part_col).join(marked, "doc_id", "left").fillna(0, ["good", "toxic"])
    alive = survivors(weighted_masks(rows))
    parts = alive.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("alive"))
    # as many steps as the orders of five filters have, whatever the tables hold
    steps = F.explode(F.sequence(F.lit(0), F.lit(factorial(len(FILTERS)) * len(FILTERS) - 1)))
    rows = parts.select("part", "alive", steps.alias("row")).join(F.broadcast(step_table(docs.sparkSession)), "row")
    at = lambda i, c="n": F.get(F.col("alive"), i)[c]
    every, before, bit = F.lit(SUBSETS - 1), F.col("before"), F.col("bit")
    lost = lambda s, c="n": at(s, c) - at(s.bitwiseOR(bit), c)
    shapley = F.aggregate(F.sequence(F.lit(0), every), F.lit(0).cast("long"), lambda sum_, s: sum_ + F.get("weights", s) * lost(s))
    return rows.select(
        "part", "filter_order", "step", at(before.bitwiseOR(bit)).alias("kept"), lost(before).alias("removed"), (lost(F.lit(0)) - lost(before)).alias("redundant"),
        lost(every - bit).alias("unique_fails"), lost(before, "good").alias("good_lost"), lost(before, "toxic").alias("toxic_lost"), shapley.alias("shapley"),
    )


SQL = r"""
WITH doc AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), label AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM doc AS d LEFT JOIN label AS l ON l.doc_id = d.doc_id
), per AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, mask
), letter AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(f, bit)
), step AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, s.step, CASE s.step WHEN 1 THEN 0 WHEN 2 THEN a.bit WHEN 3 THEN a.bit + b.bit WHEN 4 THEN a.bit + b.bit + c.bit ELSE 31 - e.bit END AS before,
    CASE s.step WHEN 1 THEN a.bit WHEN 2 THEN b.bit WHEN 3 THEN c.bit WHEN 4 THEN d.bit ELSE e.bit END AS bit
  FROM letter AS a JOIN letter AS b ON b.f <> a.f JOIN letter AS c ON c.f NOT IN (a.f, b.f) JOIN letter AS d ON d.f NOT IN (a.f, b.f, c.f) JOIN letter AS e ON e.f NOT IN (a.f, b.f, c.f, d.f)
  CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS s(step)
), figure AS (
  SELECT part, filter_order, step, bit,
    CAST(sum(CASE WHEN mask & (before + bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM per CROSS JOIN step GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM figure"""
