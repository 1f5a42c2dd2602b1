"""Connected components of an edge table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Rounds after which an error is raised; each round at least halves a path, so this covers any table.
MOST_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    Each round every node picks its smallest neighbour, follows two more picks, and edges are drawn anew between what
    their ends picked. A picks table has one row per node, aggregated map-side first, so a node with very many edges
    costs no single task its edges; joins on such a node are split by adaptive execution.
    """
    work = saved(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "components-edges")
    found: DataFrame | None = None
    for _ in range(MOST_ROUNDS):
        if work.isEmpty():
            break
        both = work.union(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        picks = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("to")), "components-picks")
        for _ in range(2):
            ahead = picks.select(F.col("node").alias("to"), F.col("to").alias("next"))
            picks = picks.join(ahead, "to").select("node", F.col("next").alias("to"))
        picks = saved(picks, "components-picks")
        if found is None:
            found = picks.select("node", F.col("to").alias("root"))
        else:
            moved = picks.select(F.col("node").alias("root"), "to")
            found = saved(found.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "components-found")
        ends = work.join(picks.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(picks.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        work = saved(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "components-edges")
    else:
        raise RuntimeError("components did not settle")
    return found if found is not None else work.select(F.col("a").alias("node"), F.col("b").alias("root"))
