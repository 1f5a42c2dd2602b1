"""Report tables and documents, assembled per curriculum with aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syllagraph.functions.fields import is_quarter, node_id, node_label, years_of

from .ranks import ranked
from .summary import ordered_list, with_defaults


def report_header(curriculum: DataFrame, courses: DataFrame, summary: DataFrame, steps: DataFrame, schedule: DataFrame) -> DataFrame:
    """One row of facts per curriculum; the complexity total is unscaled. A curriculum without degree facts has the usual ones."""
    curriculum = with_defaults(curriculum)
    totals = courses.groupBy("curriculum_id").agg(F.sum("credits").alias("total_credits"), F.count("*").alias("course_count"))
    used = schedule.groupBy("curriculum_id").agg(F.countDistinct("term").alias("terms_used"))
    rows = curriculum.join(totals, "curriculum_id").join(summary, "curriculum_id").join(steps, "curriculum_id", "left").join(used, "curriculum_id", "left")
    path = F.when(F.size("steps") > 0, F.array_join("steps", " → ")).otherwise("N/A")
    return rows.select(
        "curriculum_id", F.col("name").alias("plan_name"), "institution", F.concat_ws(" ", "degree_type", "name").alias("degree_name"), "system_type", years_of(F.coalesce("terms_used", F.lit(0)), is_quarter(F.col("system_type"))).alias("years"), "cip_code",
        F.format_string("%.1f", "total_credits").alias("total_credits"), "course_count", "total_complexity", "longest_delay", "longest_delay_course", "highest_centrality", "highest_centrality_course", path.alias("delay_path"),
    )


def report_terms(schedule: DataFrame, courses: DataFrame) -> DataFrame:
    """curriculum_id, term, courses, credits of the used terms."""
    rows = schedule.select("curriculum_id", "term", "pos", "course_key", "credits").join(courses.select("curriculum_id", "course_key", "name"), ["curriculum_id", "course_key"])
    text = F.concat_ws(" - ", "course_key", "name")
    return rows.groupBy("curriculum_id", F.col("term").cast("bigint").alias("term")).agg(ordered_list("pos", text, ", ").alias("courses"), F.format_string("%.1f", F.sum("credits")).alias("credits"))


def metrics_ranked(rows: DataFrame, whole: bool = False) -> DataFrame:
    """Plan rows with metrics and their place by falling complexity, in plan order among equal ones. whole: a curriculum's rows
    lie together, so that one task numbers them."""
    if whole:
        return rows.withColumn("place", F.row_number().over(Window.partitionBy("curriculum_id").orderBy(F.col("complexity").desc(), "plan_pos")).cast("bigint"))
    return ranked(rows, "curriculum_id", [F.col("complexity").desc(), F.col("plan_pos")], "place")


def node_lines(rows: DataFrame, indent: str) -> Column:
    return F.concat(F.lit(indent), node_id(F.col("course_key")), F.lit('["'), node_label(F.col("course_key"), F.col("name"), F.col("complexity")), F.lit('"]'))


def edge_lines(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """curriculum_id, o, line: prerequisites, then corequisites, by the place of the later course and list order."""
    rows = edges.join(positions.select("curriculum_id", F.col("course_key").alias("dst"), "plan_pos"), ["curriculum_id", "dst"])
    arrow = F.when(F.col("kind") == "prereq", " --> ").otherwise(" -.-> ")
    order = F.struct(F.when(F.col("kind") == "prereq", 0).otherwise(1).alias("k"), "plan_pos", "ord", "src")
    return rows.select("curriculum_id", order.alias("o"), F.concat(F.lit("    "), node_id(F.col("src")), arrow, node_id(F.col("dst"))).alias("line"))


def mermaid_dag(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """curriculum_id, body: the whole graph of plan rows with metrics."""
    nodes = rows.groupBy("curriculum_id").agg(ordered_list("plan_pos", node_lines(rows, "    "), "\n").alias("nodes"))
    lines = edge_lines(edges, rows).groupBy("curriculum_id").agg(ordered_list("o", "line", "\n").alias("links"))
    return nodes.join(lines, "curriculum_id", "left").select("curriculum_id", F.concat_ws("\n", F.lit("```mermaid\nflowchart LR"), "nodes", F.lit(""), "links", F.lit("```\n")).alias("body"))


def mermaid_terms(rows: DataFrame, edges: DataFrame, schedule: DataFrame, curriculum: DataFrame, least: dict[bool, int]) -> DataFrame:
    """curriculum_id, body: a subgraph per term, empty ones included, and the requisites (edges) between scheduled courses."""
    last = schedule.groupBy("curriculum_id").agg(F.max("term").alias("last"))
    quarter = is_quarter(F.col("system_type"))
    terms = curriculum.join(last, "curriculum_id").select("curriculum_id", F.when(quarter, "Quarter").otherwise("Semester").alias("label"), F.greatest("last", F.when(quarter, least[True]).otherwise(least[False])).alias("terms"))
    every = terms.select("curriculum_id", "label", "terms", F.explode(F.sequence(F.lit(1), F.col("terms"))).alias("term"))
    placed = schedule.select("curriculum_id", "term", "pos", "course_key").join(rows.select("curriculum_id", "course_key", "name", "complexity"), ["curriculum_id", "course_key"])
    nodes = placed.groupBy("curriculum_id", "term").agg(ordered_list("pos", node_lines(placed, "        "), "\n").alias("nodes"))
    number = F.col("term").cast("string")
    empty = F.concat(F.lit("        empty"), number, F.lit('[" "]\n        style empty'), number, F.lit(" fill:none,stroke:none"))
    block = F.concat(F.lit("    subgraph term"), number, F.lit('["'), F.col("label"), F.lit(" "), number, F.lit('"]\n'), F.coalesce("nodes", empty), F.lit("\n    end\n\n"))
    blocks = every.join(nodes, ["curriculum_id", "term"], "left").withColumn("block", block).groupBy("curriculum_id", "terms").agg(ordered_list("term", "block", "").alias("blocks"))
    order = F.transform(F.sequence(F.lit(1), F.col("terms") - 1), lambda i: F.concat(F.lit("    term"), i.cast("string"), F.lit(" ~~~ term"), (i + 1).cast("string"), F.lit("\n")))
    links = edge_lines(edges, rows).groupBy("curriculum_id").agg(ordered_list("o", "line", "\n").alias("links"))
    joined = blocks.join(links, "curriculum_id", "left")
    return joined.select("curriculum_id", F.concat(F.lit("```mermaid\nflowchart LR\n"), "blocks", F.array_join(order, ""), F.lit("\n"), F.coalesce(F.concat("links", F.lit("\n")), F.lit("")), F.lit("```\n")).alias("body"))


def between(edges: DataFrame, courses: DataFrame) -> DataFrame:
    """The edges with both ends among the courses."""
    known = courses.select("curriculum_id", "course_key")
    return edges.join(known.withColumnRenamed("course_key", "src"), ["curriculum_id", "src"], "left_semi").join(known.withColumnRenamed("course_key", "dst"), ["curriculum_id", "dst"], "left_semi")


def plan_edges(edges: DataFrame, schedule: DataFrame) -> DataFrame:
    """curriculum_id, from, to, dashes: requisites between scheduled courses."""
    return between(edges, schedule).select("curriculum_id", F.col("src").alias("from"), F.col("dst").alias("to"), (F.col("kind") == "coreq").alias("dashes"))


def plan_edges_json(edges: DataFrame, courses: DataFrame) -> DataFrame:
    """curriculum_id, edges_json: the requisites between a curriculum's courses (curriculum_id, course_key, plan_pos) as one JSON
    list, prerequisites first, by the place of the later course and list order; [] without any."""
    rows = between(edges, courses).join(courses.select("curriculum_id", F.col("course_key").alias("dst"), "plan_pos"), ["curriculum_id", "dst"])
    dashes = F.col("kind") == "coreq"
    order = F.struct(dashes.alias("d"), "plan_pos", "ord", "src")
    edge = F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), dashes.alias("dashes"))
    lists = rows.groupBy("curriculum_id").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), edge.alias("e"))))["e"].alias("edges"))
    every = courses.select("curriculum_id").distinct().join(lists, "curriculum_id", "left")
    return every.select("curriculum_id", F.coalesce(F.to_json("edges"), F.lit("[]")).alias("edges_json"))


#: Introduction and legend of the document's diagram.
GRAPH_NOTE = """The following diagram shows the prerequisite relationships between courses.
- **Solid arrows** (→) indicate prerequisites
- **Dashed arrows** (⤍) indicate corequisites
- **C:N** indicates the complexity score
"""


def report_markdown(header: DataFrame, terms: DataFrame, ranked: DataFrame, diagram: DataFrame) -> DataFrame:
    """curriculum_id, file_name, body: one document per curriculum."""
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    term_rows = terms.groupBy("curriculum_id").agg(ordered_list("term", row(F.col("term").cast("string"), "courses", "credits"), "\n").alias("term_rows"))
    cells = row("course_key", "name", F.format_string("%.1f", "credits"), *[F.col(c).cast("string") for c in ("complexity", "blocking", "delay", "centrality")])
    metric_rows = ranked.groupBy("curriculum_id").agg(ordered_list("place", cells, "\n").alias("metric_rows"))
    h = header.join(term_rows, "curriculum_id", "left").join(metric_rows, "curriculum_id", "left").join(diagram, "curriculum_id", "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    facts = (("Institution", "institution"), ("Degree", "degree_name"), ("System", "system_type"), ("Years", "years"), ("CIP Code", "cip_code"), ("Total Credits", "total_credits"), ("Total Courses", "course_count"))
    label = F.when(is_quarter(F.col("system_type")), "Quarter").otherwise("Semester")
    parts = [
        F.concat(F.lit("# Curriculum Report: "), text("plan_name"), F.lit("\n\n## Overview\n\n| Property | Value |\n|----------|-------|")),
        *[F.concat(F.lit(f"| **{n}** | "), text(c), F.lit(" |")) for n, c in facts],
        F.lit("\n## Complexity Metrics Summary\n\n| Metric | Value | Details |\n|--------|-------|---------|"),
        F.concat(F.lit("| **Total Structural Complexity** | "), text("total_complexity"), F.lit(" | Sum of all course complexities |")),
        F.concat(F.lit("| **Longest Delay** | "), text("longest_delay"), F.lit(" | Course: "), text("longest_delay_course"), F.lit(" |")),
        F.concat(F.lit("| **Highest Centrality** | "), text("highest_centrality"), F.lit(" | Course: "), text("highest_centrality_course"), F.lit(" |")),
        F.concat(F.lit("\n### Longest Delay Path (Critical Path)\n\n"), text("delay_path"), F.lit("\n\n---\n\n## Term-by-Term Schedule\n")),
        F.concat(F.lit("| "), label, F.lit(" | Courses | Credits |\n|---|---|---|")), text("term_rows"),
        F.lit("\n---\n\n## Course Metrics\n\n| Course | Name | Credits | Complexity | Blocking | Delay | Centrality |\n|---|---|---|---|---|---|---|"), text("metric_rows"),
        F.lit("\n---\n\n## Curriculum Graph\n"), F.lit(GRAPH_NOTE), text("body"),
    ]
    return h.select("curriculum_id", F.concat(F.replace(F.col("curriculum_id").cast("string"), F.lit("/"), F.lit("_")), F.lit("_report.md")).alias("file_name"), F.concat_ws("\n", *parts).alias("body"))


def compare_metrics(expected: DataFrame, found: DataFrame) -> DataFrame:
    """curriculum_id, course_id, field: where expected rows differ from found ones (curriculum_id, course_id, complexity
    scaled, blocking, delay, centrality); a missing course is a difference, and so is a metric that only one side has."""
    theirs = found.select("curriculum_id", "course_id", F.lit(True).alias("found"), *[F.col(c).alias(f"f_{c}") for c in ("complexity", "blocking", "delay", "centrality")])
    rows = expected.join(theirs, ["curriculum_id", "course_id"], "left")
    exact = lambda c: F.when(~F.col(c).eqNullSafe(F.col(f"f_{c}")), F.lit(c))
    near = F.coalesce(F.abs(F.col("complexity") - F.col("f_complexity")) <= 0.1 + 1e-9, F.col("complexity").isNull() & F.col("f_complexity").isNull())
    wrong = F.array_compact(F.array(exact("delay"), exact("blocking"), exact("centrality"), F.when(~near, F.lit("complexity"))))
    fields = F.when(F.col("found").isNull(), F.array(F.lit("missing"))).otherwise(wrong)
    return rows.select("curriculum_id", "course_id", F.explode(fields).alias("field"))


def compare_totals(expected: DataFrame, found: DataFrame) -> DataFrame:
    """curriculum_id, expected_total, found_total: curricula whose scaled complexity totals (curriculum_id, total) differ by
    more than a half, or that were not found."""
    rows = expected.select("curriculum_id", F.col("total").alias("expected_total")).join(found.select("curriculum_id", F.col("total").alias("found_total")), "curriculum_id", "left")
    return rows.filter(~F.coalesce(F.abs(F.col("expected_total") - F.col("found_total")) <= 0.5 + 1e-9, F.lit(False)))


def compare_summary(expected: DataFrame, differences: DataFrame, totals: DataFrame) -> DataFrame:
    """curricula, passed, failed over all expected curricula; a course that differs or a wrong total (compare_totals) fails."""
    bad = differences.select("curriculum_id").union(totals.select("curriculum_id")).distinct().withColumn("bad", F.lit(True))
    rows = expected.select("curriculum_id").distinct().join(bad, "curriculum_id", "left")
    return rows.agg(F.count("*").alias("curricula"), F.count_if(F.col("bad").isNull()).alias("passed"), F.count_if(F.col("bad")).alias("failed"))
