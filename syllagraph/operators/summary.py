"""Curriculum summaries, longest-delay paths and export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from syllagraph.functions.fields import number_text, scaled
from syllagraph.storage import bucketed, dealt, lean

from . import local


def ordered_list(order: str, value: str | Column, sep: str) -> Column:
    """The group's values in an order, joined."""
    value = F.col(value) if isinstance(value, str) else value
    return F.array_join(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))["v"], sep)


def curriculum_summary(rows: DataFrame) -> DataFrame:
    """Per curriculum of plan rows (curriculum_id, plan_pos, course_key, delay, complexity, centrality): totals and the
    first course in the plan with the highest centrality and the longest delay; no course where all are 0."""
    first = lambda c: F.max_by("course_key", F.struct(F.col(c), -F.col("plan_pos")))
    named = lambda c: F.when(F.max(c) > 0, first(c)).otherwise("")
    return rows.groupBy("curriculum_id").agg(
        F.sum("complexity").alias("total_complexity"),
        F.max("centrality").alias("highest_centrality"), named("centrality").alias("highest_centrality_course"),
        F.max("delay").alias("longest_delay"), named("delay").alias("longest_delay_course"),
    )


def max_delay_courses(rows: DataFrame) -> DataFrame:
    """The rows whose delay is their curriculum's longest."""
    return rows.withColumn("longest", F.max("delay").over(Window.partitionBy("curriculum_id"))).filter("delay = longest").drop("longest")


def best_prereq(edges: DataFrame, delays: DataFrame) -> DataFrame:
    """curriculum_id, course_key, best: the prerequisite with the longest delay, the last listed of equal ones."""
    pre = edges.filter("kind = 'prereq'").join(delays.select("curriculum_id", F.col("course_key").alias("src"), "delay"), ["curriculum_id", "src"])
    return pre.groupBy("curriculum_id", F.col("dst").alias("course_key")).agg(F.max_by("src", F.struct("delay", "ord")).alias("best"))


def traced(ends: DataFrame, best: DataFrame, small: bool = False) -> DataFrame:
    """curriculum_id, course_key, path: from a course without prerequisites along best ones to each end course. Curricula of few
    courses are a row each; small: all are known to be so."""
    return local.parted(local.traced, walked, small, ends.select("curriculum_id", "course_key"), best)


def walked(ends: DataFrame, best: DataFrame) -> DataFrame:
    """The same of large curricula: every round each open row steps one course back, so there are as many rows as ends at all
    times."""
    open_, done = ends.select("curriculum_id", "course_key", F.col("course_key").alias("head"), F.array("course_key").alias("path")), None
    on = ("curriculum_id", "head")
    step = bucketed(dealt(best.select("curriculum_id", F.col("course_key").alias("head"), "best"), *on), "best", *on)
    while True:
        seen = Observation()
        rows = lean(open_.join(step, list(on), "left").observe(seen, F.count("best").alias("open")), "traced")
        over = rows.filter("best IS NULL").select("curriculum_id", "course_key", "path")
        done = over if done is None else done.union(over)
        open_ = rows.filter("best IS NOT NULL AND NOT array_contains(path, best)").select("curriculum_id", "course_key", F.col("best").alias("head"), F.array_prepend("path", F.col("best")).alias("path"))
        if not seen.get["open"]:
            return done


def longest_path(paths: DataFrame, positions: DataFrame) -> DataFrame:
    """curriculum_id, path: the longest of the traced paths, the one of the first course in the plan of equal ones."""
    rows = paths.join(positions.select("curriculum_id", "course_key", "plan_pos"), ["curriculum_id", "course_key"])
    return rows.groupBy("curriculum_id").agg(F.max_by("path", F.struct(F.size("path").alias("n"), -F.col("plan_pos"))).alias("path"))


def critical_paths(steps: DataFrame) -> DataFrame:
    """curriculum_id, length, path of a longest way through each curriculum's requisites; steps: curriculum_id, place,
    course_key. Its length is the longest delay, which the traced path may miss."""
    return steps.groupBy("curriculum_id").agg(F.count("*").alias("length"), F.sort_array(F.collect_list(F.struct("place", "course_key")))["course_key"].alias("path"))


def grouped_path(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """curriculum_id, steps: each course of a path with its corequisites as one step (A+B), each course once.

    A step has the course, those it requires along, and courses of the path that require it along; sorted, then the
    course itself changes places with the first."""
    co = edges.filter("kind = 'coreq'")
    asked = co.groupBy("curriculum_id", F.col("dst").alias("course_key")).agg(F.collect_set("src").alias("asks"))
    asking = co.groupBy("curriculum_id", F.col("src").alias("course_key")).agg(F.collect_set("dst").alias("asked_by"))
    rows = paths.select("curriculum_id", "path", F.posexplode("path").alias("pos", "course_key")).join(asked, ["curriculum_id", "course_key"], "left").join(asking, ["curriculum_id", "course_key"], "left")
    none = F.array().cast("array<string>")
    near = F.struct("pos", F.col("course_key").alias("c"), F.array_union(F.coalesce("asks", none), F.array_intersect(F.coalesce("asked_by", none), F.col("path"))).alias("near"))
    per = rows.groupBy("curriculum_id").agg(F.sort_array(F.collect_list(near)).alias("walk"))
    start = F.struct(none.alias("seen"), none.alias("steps"))

    def step(a: Column, x: Column) -> Column:
        group = F.sort_array(F.array_union(F.array(x["c"]), F.array_except(x["near"], a["seen"])))
        swap = F.transform(group, lambda c: F.when(c == x["c"], group[0]).when(c == group[0], x["c"]).otherwise(c))
        text = F.when(F.size(group) > 1, F.concat(F.lit("("), F.array_join(swap, "+"), F.lit(")"))).otherwise(x["c"])
        return F.when(F.array_contains(a["seen"], x["c"]), a).otherwise(F.struct(F.array_union(a["seen"], group).alias("seen"), F.array_append(a["steps"], text).alias("steps")))

    return per.select("curriculum_id", F.aggregate("walk", start, step, lambda a: a["steps"]).alias("steps"))


def back_to_ids(required: DataFrame, courses: DataFrame) -> DataFrame:
    """curriculum_id, course_key and its three lists as Course IDs joined by semicolons; a key without a course stays."""
    ids = courses.select("curriculum_id", F.col("course_key").alias("required_key"), F.col("course_id").cast("string").alias("id"))
    rows = required.join(ids, ["curriculum_id", "required_key"], "left").withColumn("id", F.coalesce("id", "required_key"))
    pair = lambda k: F.array_join(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("ord", "id"))))["id"], ";")
    return rows.groupBy("curriculum_id", "course_key").agg(pair("prereq").alias("prereq_ids"), pair("coreq").alias("coreq_ids"), pair("strict").alias("strict_ids"))


def export_rows(courses: DataFrame, required: DataFrame, metrics: DataFrame, curriculum: DataFrame) -> DataFrame:
    """One row per course in the order and with the texts of the metrics file. courses has course_id, plan_pos,
    canonical_name; a curriculum without a record counts as semester."""
    on = ["curriculum_id", "course_key"]
    rows = courses.join(back_to_ids(required, courses), on, "left").join(metrics, on, "left").join(with_defaults(curriculum).select("curriculum_id", "institution", F.contains(F.lower("system_type"), F.lit("quarter")).alias("quarter")), "curriculum_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    id_text = F.col("course_id").cast("string")
    sort = F.coalesce(F.when(id_text.rlike(r"^\+?[0-9]+$"), id_text.try_cast("bigint")), F.lit(0)).cast("bigint")
    place = F.row_number().over(Window.partitionBy("curriculum_id").orderBy(sort, "plan_pos"))
    text = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        "curriculum_id", place.cast("bigint").alias("place"), id_text.alias("course_id"), "name", "prefix", "number", text("prereq_ids").alias("prereq_ids"), text("coreq_ids").alias("coreq_ids"), text("strict_ids").alias("strict_ids"),
        number_text(F.col("credits")).alias("credits"), text("institution").alias("institution"), text("canonical_name").alias("canonical_name"),
        F.format_string("%.1f", scaled(zero("complexity"), F.coalesce("quarter", F.lit(False)))).alias("complexity"), zero("blocking").alias("blocking"), zero("delay").alias("delay"), zero("centrality").alias("centrality"),
    )


def with_defaults(curriculum: DataFrame) -> DataFrame:
    """curriculum with what a missing degree stands for: type BS, semesters, no code; a missing institution is the school, if
    the table has one."""
    school = F.col("school") if "school" in curriculum.columns else F.lit(None).cast("string")
    usual = {"degree_type": F.lit("BS"), "system_type": F.lit("semester"), "cip_code": F.lit(""), "institution": F.coalesce(school, F.lit("")), "name": F.lit("")}
    return curriculum.select(*[F.coalesce(F.col(c), usual[c]).alias(c) if c in usual else F.col(c) for c in curriculum.columns])


COLUMNS = "Course ID,Course Name,Prefix,Number,Prerequisites,Corequisites,Strict-Corequisites,Credit Hours,Institution,Canonical Name,Complexity,Blocking,Delay,Centrality"


def export_text(rows: DataFrame, summary: DataFrame, steps: DataFrame, curriculum: DataFrame) -> DataFrame:
    """curriculum_id, body: each curriculum's metrics file. summary has scaled_total."""
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    line = F.concat_ws(",", "course_id", "name", *[quoted(c) for c in ("prefix", "number", "prereq_ids", "coreq_ids", "strict_ids")], "credits", quoted("institution"), quoted("canonical_name"), "complexity", *[F.col(c).cast("string") for c in ("blocking", "delay", "centrality")])
    body = rows.groupBy("curriculum_id").agg(ordered_list("place", line, "\n").alias("lines"))
    joined = with_defaults(body.join(curriculum, "curriculum_id", "left")).join(summary, "curriculum_id").join(steps, "curriculum_id", "left")
    head = F.concat_ws(
        "\n", F.concat(F.lit("Curriculum,"), F.col("name")), F.concat(F.lit("Institution,"), F.col("institution")), F.concat(F.lit("Degree Type,"), quoted("degree_type")),
        F.concat(F.lit("System Type,"), F.col("system_type")), F.concat(F.lit("CIP,"), quoted("cip_code")), F.concat(F.lit("Total Structural Complexity,"), F.format_string("%.1f", "scaled_total")),
        F.concat(F.lit("Longest Delay,"), F.col("longest_delay").cast("string"), F.when(F.size("steps") > 0, F.concat(F.lit(","), F.array_join("steps", "->"))).otherwise("")),
        F.concat(F.lit("Highest Centrality Course,"), quoted("highest_centrality_course"), F.lit(","), F.col("highest_centrality").cast("string")), F.lit("Courses"), F.lit(COLUMNS),
    )
    return joined.select("curriculum_id", F.concat_ws("\n", head, F.col("lines")).alias("body"))
