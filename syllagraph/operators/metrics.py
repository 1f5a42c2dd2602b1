"""Course metrics from path counts: delay, blocking, complexity, centrality; no path is ever listed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import local
from .loops import by_place, numbered, sweep


def requisite_edges(edges: DataFrame) -> DataFrame:
    """(curriculum_id, src, dst): prerequisites, corequisites and strict ones as one set."""
    return edges.select("curriculum_id", "src", "dst").distinct()


def path_facts(swept: DataFrame) -> DataFrame:
    """Per vertex of a sweep: longest path to and from it in edges, number of paths and their lengths in vertices either way, and
    the vertices it leads to where the sweep kept their sets."""
    at = lambda d, c: F.max(F.when(F.col("main") & (F.col("dir") == d), F.col(c)))
    reached = F.sum(F.when(F.col("dir") == "b", F.bit_count("bits")).otherwise(0))
    return swept.groupBy("curriculum_id", "vertex").agg(at("f", "k").alias("longest_to"), at("b", "k").alias("longest_from"), at("f", "p").alias("p"), at("f", "lp").alias("lp"), at("b", "p").alias("s"), at("b", "lp").alias("ls"), (reached - 1).cast("bigint").alias("blocking"))


def facts_to_metrics(facts: DataFrame) -> DataFrame:
    """delay and centrality: lp*s + ls*p - p*s at vertices inside paths, 0 at their ends; null beyond 64 bits."""
    inner = (F.col("longest_to") > 0) & (F.col("longest_from") > 0)
    value = F.try_subtract(F.try_add(F.try_multiply("lp", F.col("s")), F.try_multiply("ls", F.col("p"))), F.try_multiply("p", F.col("s")))
    return facts.select("curriculum_id", "vertex", "longest_to", "longest_from", (F.col("longest_to") + F.col("longest_from") + 1).alias("delay"), F.when(inner, value).otherwise(F.lit(0)).cast("bigint").alias("centrality"), "blocking")


def numbered_metrics(vertices: DataFrame, edges: DataFrame, blocking: bool = True, small: bool = False) -> DataFrame:
    """Metrics of vertices that are numbers from 1 on in their curriculum; blocking counts the bits of the set of vertices that
    one leads to. Curricula of few vertices are a row each, the others go through one sweep; small: all are
    known to be so."""
    known = local.sizes(vertices)
    facts, large = local.path_facts(known, edges, blocking), known.filter("NOT small").select("curriculum_id")
    if not small and not large.isEmpty():
        swept = sweep(*[rows.join(large, "curriculum_id", "left_semi") for rows in (vertices, edges)], "fb", "b" if blocking else "")
        facts = facts.union(path_facts(swept))
    return facts_to_metrics(facts)


def named_metrics(vertices: DataFrame, edges: DataFrame, blocking: bool = True, small: bool = False) -> DataFrame:
    """The same of vertices of any kind."""
    numbers = numbered(vertices)
    rows = numbered_metrics(numbers.select("curriculum_id", F.col("place").alias("vertex")), by_place(edges, numbers), blocking, small)
    return rows.withColumnRenamed("vertex", "place").join(numbers, ["curriculum_id", "place"]).drop("place")


def course_metrics(vertices: DataFrame, edges: DataFrame, numbers: bool = False, small: bool = False) -> DataFrame:
    """curriculum_id, vertex, delay, blocking, complexity, centrality, longest_to of every vertex of graphs without cycles.
    numbers: vertices are numbers from 1 on in their curriculum."""
    rows = (numbered_metrics if numbers else named_metrics)(vertices, edges, True, small)
    return rows.select("curriculum_id", "vertex", "delay", "blocking", (F.col("delay") + F.col("blocking")).alias("complexity"), "centrality", "longest_to")


def delay_and_centrality(vertices: DataFrame, edges: DataFrame, numbers: bool = False, small: bool = False) -> DataFrame:
    return (numbered_metrics if numbers else named_metrics)(vertices, edges, False, small).drop("blocking")


def graph_errors(cyclic: DataFrame, metrics: DataFrame) -> DataFrame:
    """curriculum_id, stage, message: graphs with a cycle (loops.cyclic_curricula), and graphs whose path counts outgrow 64
    bits."""
    cycles = cyclic.select("curriculum_id", F.lit("metrics").alias("stage"), F.lit("cycle").alias("message"))
    lost = metrics.filter("centrality IS NULL").select("curriculum_id").distinct()
    return cycles.union(lost.select("curriculum_id", F.lit("metrics").alias("stage"), F.lit("overflow").alias("message")))
