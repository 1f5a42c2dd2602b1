"""Frames that the registered queries share, out of the relational tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syllagraph.operators import keys, local, loops, metrics, schedule, summary
from syllagraph.sources import tables
from syllagraph.storage import bucketed, dealt, discard, lean

#: Courses of the largest curriculum up to which all rows of a curriculum lie in one bucket.
WHOLE = 100_000


class Frames:
    """Each frame is built at first use; those that loops or several branches read are saved once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def largest(self) -> int:
        return tables.largest(self.lines)

    @cached_property
    def lines(self) -> DataFrame:
        return lean(tables.numbered_lines(self.spark, self.sf_dir), "lines")

    @property
    def whole(self) -> bool:
        """Whether tables lie in buckets by curriculum, so that what is joined or grouped inside curricula stays in place."""
        return self.largest <= WHOLE

    @property
    def small(self) -> bool:
        """Whether every curriculum can be a row."""
        return self.largest <= local.SMALL

    def table(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """df as a table. by: the column by which a curriculum's rows are sorted and mostly joined."""
        if not self.whole:
            return lean(df, name)
        # joins on more than the curriculum leave the buckets in place and as they are sorted; lazy results are planned later, so this stays
        self.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        self.spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        return bucketed(dealt(df, "curriculum_id"), name, "curriculum_id", order=("curriculum_id", by) if by else ())

    @cached_property
    def course(self) -> DataFrame:
        rows = tables.gathered_courses(self.lines, tables.course_parts(self.spark, self.sf_dir)) if self.whole else tables.courses(self.spark, self.sf_dir)
        found = self.table(rows, "courses", "course_id").withColumn("plan_pos", F.col("course_id"))
        discard(self.lines)
        return found

    @cached_property
    def curriculum(self) -> DataFrame:
        if "course" not in self.__dict__:
            return tables.curricula(self.spark, self.sf_dir)
        return self.table(tables.curricula(self.spark, self.sf_dir, self.course), "curricula")

    @cached_property
    def vertices(self) -> DataFrame:
        return self.course.select("curriculum_id", F.col("course_id").alias("vertex"))

    @cached_property
    def edges(self) -> DataFrame:
        """By course id, kinds prereq, coreq, strict."""
        return self.table(tables.listed_edges(self.course), "edges", "src")

    @cached_property
    def key_edges(self) -> DataFrame:
        """By course key, kinds prereq and coreq; strict edges are corequisites after the listed ones."""
        ids = self.course.select("curriculum_id", "course_id", "course_key")
        kind = F.when(F.col("kind") == "prereq", "prereq").otherwise("coreq")
        rows = self.edges.withColumn("ord", F.struct((F.col("kind") == "strict").alias("strict"), "ord")).withColumn("kind", kind)
        rows = rows.groupBy("curriculum_id", "src", "dst", "kind").agg(F.min("ord").alias("ord"))
        rows = rows.join(ids.select("curriculum_id", F.col("course_id").alias("src"), F.col("course_key").alias("a")), ["curriculum_id", "src"]).join(ids.select("curriculum_id", F.col("course_id").alias("dst"), F.col("course_key").alias("b")), ["curriculum_id", "dst"])
        return self.table(rows.select("curriculum_id", F.col("a").alias("src"), F.col("b").alias("dst"), "kind", "ord"), "key_edges", "dst")

    @cached_property
    def texts(self) -> DataFrame:
        return tables.curriculum_texts(self.course, self.curriculum)

    @cached_property
    def listed(self) -> DataFrame:
        """Courses with their requisite texts."""
        return tables.requisite_texts(self.course)

    @cached_property
    def required(self) -> DataFrame:
        return keys.resolved(keys.requisite_items(self.listed), self.course)

    @cached_property
    def plan(self) -> DataFrame:
        """Courses with the four metrics and longest_to."""
        found = metrics.course_metrics(self.vertices, self.edges, numbers=True, small=self.small).withColumnRenamed("vertex", "course_id")
        return self.table(self.course.join(found, ["curriculum_id", "course_id"]), "plan", "course_key")

    @property
    def metrics(self) -> DataFrame:
        return self.plan.select("curriculum_id", "course_id", "delay", "blocking", "complexity", "centrality", "longest_to")

    @cached_property
    def delays(self) -> DataFrame:
        if "plan" in self.__dict__:  # the same columns and more
            return self.plan
        found = metrics.delay_and_centrality(self.vertices, self.edges, numbers=True, small=self.small).withColumnRenamed("vertex", "course_id")
        return self.table(self.course.join(found, ["curriculum_id", "course_id"]), "delays", "course_key")

    @cached_property
    def critical(self) -> DataFrame:
        """curriculum_id, length, path: a longest way through the requisites, by course key."""
        steps = loops.longest_paths(loops.sweep(self.vertices, self.edges, "f")).withColumnRenamed("vertex", "course_id")
        return summary.critical_paths(steps.join(self.course.select("curriculum_id", "course_id", "course_key"), ["curriculum_id", "course_id"]))

    @cached_property
    def longest(self) -> DataFrame:
        best = summary.best_prereq(self.key_edges, self.delays)
        return summary.longest_path(summary.traced(summary.max_delay_courses(self.delays), best, self.small), self.course)

    @cached_property
    def steps(self) -> DataFrame:
        return self.table(summary.grouped_path(self.longest, self.key_edges), "steps")

    @cached_property
    def priorities(self) -> DataFrame:
        return self.ranked.drop("credits")

    @cached_property
    def ranked(self) -> DataFrame:
        """The same with credits. No edge turns back, so every course has its delay."""
        return schedule.chain_priority(self.delays, self.key_edges, None, "credits")

    @cached_property
    def groups(self) -> DataFrame:
        return schedule.with_group(self.course.select("curriculum_id", "course_key"), self.shared)

    @cached_property
    def shared(self) -> DataFrame:
        """The groups of more than one course, a row per course."""
        return self.table(schedule.shared_groups(self.key_edges, self.small), "groups", "course_key")

    @cached_property
    def schedule(self) -> DataFrame:
        return self.table(schedule.term_schedule(self.course, self.key_edges, self.ranked, self.shared, self.curriculum), "schedule", "course_key")
