"""Whole batches out of curriculum texts: from files to metrics, summaries, schedules, documents and an error table."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syllagraph.functions import fields
from syllagraph.operators import keys, loops, metrics, report, schedule, summary
from syllagraph.sources import files
from syllagraph.storage import saved


def joined_lists(rows: DataFrame) -> DataFrame:
    """One row per Course ID with the requisite texts of all its rows, in order. A row without prefix or number has no
    course but still adds its lists."""
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", c))), lambda x: x[c]), ";").alias(c)
    return rows.groupBy("curriculum_id", "course_id").agg(*[text(c) for c in keys.LISTS.values()])


class Batch:
    """All results for texts (curriculum_id, value); a text that can't be used is a row of errors and of nothing else."""

    def __init__(self, texts: DataFrame, target: float = schedule.TARGET):
        self.texts, self.target = texts, target

    @classmethod
    def of_files(cls, spark: SparkSession, paths: str | list[str], target: float = schedule.TARGET) -> Batch:
        return cls(files.read_texts(spark, paths), target)

    @cached_property
    def bad_texts(self) -> DataFrame:
        return saved(files.file_errors(self.texts), "errors")

    @cached_property
    def curriculum(self) -> DataFrame:
        return files.metadata(self.texts.filter("value IS NOT NULL")).join(self.bad_texts, "curriculum_id", "left_anti")

    @cached_property
    def rows(self) -> DataFrame:
        return saved(files.course_rows(self.texts).join(self.bad_texts, "curriculum_id", "left_anti"), "rows")

    @cached_property
    def all_courses(self) -> DataFrame:
        return saved(keys.with_storage_keys(keys.merged_rows(self.rows)), "courses")

    @cached_property
    def required(self) -> DataFrame:
        return saved(keys.resolved(keys.requisite_items(joined_lists(self.rows)), self.all_courses), "required")

    @cached_property
    def all_edges(self) -> DataFrame:
        return saved(keys.edges_of(self.required, self.all_courses), "edges")

    @cached_property
    def cyclic(self) -> DataFrame:
        return saved(loops.cyclic_curricula(self.all_edges), "cyclic")

    @cached_property
    def courses(self) -> DataFrame:
        return self.all_courses.join(self.cyclic, "curriculum_id", "left_anti")

    @cached_property
    def edges(self) -> DataFrame:
        return self.all_edges.join(self.cyclic, "curriculum_id", "left_anti")

    @cached_property
    def metrics(self) -> DataFrame:
        vertices = self.courses.select("curriculum_id", F.col("course_key").alias("vertex"))
        return saved(metrics.course_metrics(vertices, self.edges).withColumnRenamed("vertex", "course_key"), "metrics")

    @cached_property
    def errors(self) -> DataFrame:
        """curriculum_id, stage, message: bad texts, cycles, counts beyond 64 bits."""
        return self.bad_texts.union(metrics.graph_errors(self.cyclic, self.metrics))

    @cached_property
    def plan(self) -> DataFrame:
        return self.courses.join(self.metrics, ["curriculum_id", "course_key"])

    @cached_property
    def summary(self) -> DataFrame:
        rows = self.plan.join(self.curriculum.select("curriculum_id", "system_type"), "curriculum_id")
        value = fields.scaled(F.col("complexity"), fields.is_quarter(F.col("system_type")))
        totals = rows.groupBy("curriculum_id").agg(F.round(F.sum(value), 1).alias("scaled_total"))
        return summary.curriculum_summary(self.plan).join(totals, "curriculum_id")

    @cached_property
    def steps(self) -> DataFrame:
        """curriculum_id, path, steps: the longest-delay path and its grouped form."""
        ends = summary.max_delay_courses(self.plan)
        path = saved(summary.longest_path(summary.traced(ends, summary.best_prereq(self.edges, self.plan)), self.plan), "path")
        return path.join(summary.grouped_path(path, self.edges), "curriculum_id")

    @cached_property
    def schedule(self) -> DataFrame:
        priorities = schedule.chain_priority(self.courses, self.edges, self.plan)
        groups = schedule.coreq_groups(self.courses, self.edges)
        return saved(schedule.term_schedule(self.courses, self.edges, priorities, groups, self.curriculum, self.target), "schedule")

    def metric_rows(self) -> DataFrame:
        return summary.export_rows(self.courses, self.required, self.metrics, self.curriculum)

    @cached_property
    def warnings(self) -> DataFrame:
        """curriculum_id, course_key, kind, required_key, message: requisites of the plans' courses that no course has."""
        return keys.missing_requisites(self.required.join(self.cyclic, "curriculum_id", "left_anti"), self.courses)

    @cached_property
    def critical_paths(self) -> DataFrame:
        """curriculum_id, length, path: a longest way through each curriculum's requisites."""
        numbers = loops.numbered(self.courses.select("curriculum_id", F.col("course_key").alias("vertex")))
        swept = loops.sweep(numbers.select("curriculum_id", F.col("place").alias("vertex")), loops.by_place(self.edges, numbers), "f")
        steps = loops.longest_paths(swept).withColumnRenamed("vertex", "at")
        return summary.critical_paths(steps.join(numbers.select("curriculum_id", F.col("place").alias("at"), F.col("vertex").alias("course_key")), ["curriculum_id", "at"]))

    def metric_files(self) -> DataFrame:
        """curriculum_id, file_name, body."""
        name = F.concat(F.replace(F.col("curriculum_id").cast("string"), F.lit("/"), F.lit("_")), F.lit("_w_metrics.csv"))
        return summary.export_text(self.metric_rows(), self.summary, self.steps, self.curriculum).select("curriculum_id", name.alias("file_name"), "body")

    def totals(self) -> DataFrame:
        """curriculum_id, total: scaled complexity, as report.compare_totals takes it."""
        return self.summary.select("curriculum_id", F.col("scaled_total").alias("total"))

    def edge_documents(self) -> DataFrame:
        """curriculum_id, edges_json."""
        return report.plan_edges_json(self.edges, self.courses)

    def write(self, path: str) -> None:
        """A metrics file and a report of every curriculum, in one folder."""
        files.write_documents(self.metric_files().select("file_name", "body").union(self.reports().select("file_name", "body")), path)

    def reports(self) -> DataFrame:
        """curriculum_id, file_name, body."""
        header = report.report_header(self.curriculum, self.courses, self.summary, self.steps, self.schedule)
        diagram = report.mermaid_terms(self.plan, report.between(self.edges, self.schedule), self.schedule, self.curriculum, schedule.TERMS)
        return report.report_markdown(header, report.report_terms(self.schedule, self.courses), report.metrics_ranked(self.plan), diagram)
