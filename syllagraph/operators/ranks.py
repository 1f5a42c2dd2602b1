"""Places inside groups without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syllagraph.storage import lean

#: Bits that monotonically_increasing_id leaves for the rows of a partition.
ROW_BITS = 33


def by_range(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """rows in consecutive partitions by (group, order), each in order: a large group lies in several."""
    return rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)


def ranked(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """rows with name: their place (from 1) in their group by an order.

    A row's place is its place in its partition of the ranges plus the group's rows in earlier ones. Only the groups' slices are counted: at
    most one row per group and one per partition. Rows of equal order have any order among them.
    """
    ids = "__at"
    held = lean(by_range(rows, group, order).withColumn(ids, F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(ids, ROW_BITS).alias("__part")
    slices = held.groupBy(group, part).agg(F.min(ids).alias("__first"), F.count("*").alias("__rows"))
    earlier = F.sum("__rows").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    slices = slices.select(group, "__part", (F.coalesce(earlier, F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    return held.withColumn("__part", part).join(slices, [group, "__part"]).withColumn(name, F.col(ids) + F.col("__shift")).drop(ids, "__part", "__shift")
