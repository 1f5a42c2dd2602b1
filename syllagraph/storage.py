"""Tables in the folder that all executors share: cut lineages, survive lost executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The folder of this process's tables inside the shared one.
RUN = f"run-{uuid.uuid4().hex}"
#: Names of its bucketed tables in the session's catalog.
BUCKETED: list[str] = []
#: Spark deletes a query's shuffle files when it has ended.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch.
BATCH = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """This run's folder below spark.checkpoint.dir of the session. Where that is unset, as in tests, and the session is one
    local process, a temporary folder is set; on a cluster one machine's folder would lose the others' files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return os.path.join(found, RUN)


def saved(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table of this run. by: a column of whose values each has files of its own."""
    path = os.path.join(shared_folder(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    writer = df.write if by is None else df.write.partitionBy(by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each write inside go when it has ended; what it made lies in a table by then."""
    before = spark.conf.get(FREE, None)
    spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE) if before is None else spark.conf.set(FREE, before)


def lean(df: DataFrame, name: str) -> DataFrame:
    """df as a table of this run that leaves no shuffle files behind."""
    path = os.path.join(shared_folder(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    with freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table of this run that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        assert RUN in folder
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches end at BATCH bytes, as lazy results are only planned when they are read; a smaller
    bound of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", spark.conf.get(name).lower()).groups()
    if not 0 < int(size) << 10 * " kmgtp".index(unit or " ") <= BATCH:
        spark.conf.set(name, str(BATCH))


class Rounds:
    """The tables of a loop's rounds in one folder, which one scan reads at the end."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}"), 0

    def add(self, df: DataFrame) -> DataFrame:
        """df as the next round's table."""
        path, self.n, self.schema = os.path.join(self.path, f"round={self.n}"), self.n + 1, df.schema
        with freed(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def rows(self) -> DataFrame:
        """The rows of all rounds."""
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)


def bucketed(df: DataFrame, name: str, *keys: str, order: tuple[str, ...] = ()) -> DataFrame:
    """df as a table of this run in buckets by keys, as many as shuffles have partitions: a join on them leaves it in place.
    order: columns by which the rows of a bucket are sorted; where a bucket is one file, a join on these doesn't sort again."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.format("parquet").option("compression", "zstd").option("path", os.path.join(shared_folder(spark), table)).bucketBy(n, keys[0], *keys[1:])
    with freed(spark):
        (writer.sortBy(order[0], *order[1:]) if order else writer).saveAsTable(table)
    BUCKETED.append(table)
    return spark.table(table)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df as bucketed() writes it in one file per bucket."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def cleanup(spark: SparkSession) -> None:
    """Deletes this run's tables. Results that read them and aren't written yet are lost with them."""
    while BUCKETED:
        spark.sql(f"DROP TABLE IF EXISTS {BUCKETED.pop()}")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
