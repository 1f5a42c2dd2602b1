"""Shared helpers: whole-text batches for Arrow maps, and tables written to the cluster's shared folder."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from syllagraph import storage

#: Texts handled together inside one task; a batch ends when either bound is reached.
BATCH_ROWS = 2000
BATCH_CHARS = 4_000_000
#: Bytes of an Arrow batch of texts, of which an executor and its Python workers hold several at a time.
ARROW_BYTES = 2 << 20

#: Word bound of the contracts: everything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
NOT_WORD = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id long and text string of every row; a null text is empty. Other columns are left behind, so none can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def bounded_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session end at ARROW_BYTES (a longer row stands alone), as lazy results are only
    planned when they are read; a smaller bound of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", spark.conf.get(name).lower()).groups()
    now = int(size) << 10 * " kmgtp".index(unit or " ")
    if not 0 < now <= ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def slices(lengths: Iterable[int]) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive rows of these lengths, within both bounds of a batch (a longer row stands alone)."""
    lo = held = i = 0
    for i, n in enumerate(lengths, 1):
        held += n
        if held >= BATCH_CHARS or i - lo >= BATCH_ROWS:
            yield lo, i
            lo, held = i, 0
    if i > lo:
        yield lo, i


def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(doc_ids, texts) in lists of bounded size, in the order of the rows."""
    for batch in stream:
        ids, values = batch.column(0).to_pylist(), batch.column(1)
        for lo, hi in slices(pc.binary_length(values).to_pylist()):
            yield ids[lo:hi], values.slice(lo, hi - lo).to_pylist()


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list, list[str]], dict[str, list]]], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One output row or several for each document. make() runs once a task and returns the function for a batch."""
    frame = texts(docs, id_col, text_col)
    arrow = docs.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(stream):
        handle = make()
        for ids, values in batches(stream):
            out = handle(ids, values)
            yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return frame.mapInArrow(run, schema)


def saved(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the session's shared folder: survives lost executors and cuts the lineage. by: a column of
    whose values each has files of its own."""
    return storage.saved(df, name, by)


def sample_of(docs: DataFrame, rows: int, text_col: str = "text") -> DataFrame:
    """Different texts of about `rows` rows (all if there are fewer), by a hash of the text; only ever used to fit a model.
    A text with many copies counts once, so no group of copies can fill the sample."""
    key = F.xxhash64(F.col(text_col))
    n, span = docs.count(), 1 << 30
    some = docs if n <= rows else docs.filter(F.pmod(key, F.lit(span)) < int(span * rows / n))
    return some.dropDuplicates([text_col])


def fair_share(rows: DataFrame, most: int, shares: dict[int, int]) -> DataFrame:
    """At most `most` of rows (hash, kind, ...), of equal hashes one; every kind has its share of them, in the order of the
    hashes, and what a kind can't fill goes to the others by their shares."""
    share = F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("kind"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("hash"))
    ranked = rows.dropDuplicates(["hash"]).withColumn("rank", rank).filter(F.col("rank") <= most)
    return ranked.orderBy(F.ceil(F.col("rank") / share), "kind", "hash").limit(most)
