"""Metrics on hand-made graphs, on graphs with cycles, and on random graphs against listed paths."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from syllagraph.operators import keys, local, loops, metrics, ranks, summary

GRAPHS = {
    "tree": (["A", "B", "C", "D"], [("A", "B"), ("B", "D"), ("A", "C")], {"A": (3, 3, 0), "B": (3, 1, 3), "C": (2, 0, 0), "D": (3, 0, 0)}),
    "chain": (["A", "B", "C"], [("A", "B"), ("B", "C")], {"A": (3, 2, 0), "B": (3, 1, 3), "C": (3, 0, 0)}),
    "single": (["A"], [], {"A": (1, 0, 0)}),
    "diamond": (["A", "B", "C", "D", "E"], [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "E")], {"A": (4, 4, 0), "B": (4, 2, 4), "C": (4, 2, 4), "D": (4, 1, 8), "E": (4, 0, 0)}),
    "twice": (["A", "B"], [("A", "B"), ("A", "B")], {"A": (2, 1, 0), "B": (2, 0, 0)}),
    "loop": (["A", "B"], [("A", "A"), ("A", "B")], {}),
    "mutual": (["A", "B", "C"], [("A", "B"), ("B", "A"), ("B", "C")], {}),
}


def frames(spark, graphs):
    vertices = [(g, v) for g, (vs, *_) in graphs.items() for v in vs]
    edges = [(g, a, b, "prereq", 1) for g, (_, es, *_) in graphs.items() for a, b in es]
    return spark.createDataFrame(vertices, "curriculum_id string, vertex string"), spark.createDataFrame(edges, "curriculum_id string, src string, dst string, kind string, ord long")


def found_metrics(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r["curriculum_id"], {})[r["vertex"]] = (r["delay"], r["blocking"], r["centrality"])
        assert r["complexity"] == r["delay"] + r["blocking"]
    return out


def test_hand_graphs(spark):
    vertices, edges = frames(spark, GRAPHS)
    rows = metrics.course_metrics(vertices, edges)
    assert found_metrics(rows) == {g: known for g, (_, _, known) in GRAPHS.items() if known}
    errors = {(r["curriculum_id"], r["message"]) for r in metrics.graph_errors(loops.cyclic_curricula(edges), rows).collect()}
    assert errors == {("loop", "cycle"), ("mutual", "cycle")}


def test_no_graph(spark):
    vertices, edges = frames(spark, {"none": ([], [])})
    assert metrics.course_metrics(vertices, edges).count() == 0
    assert loops.cyclic_curricula(edges).count() == 0 and loops.closure(edges).count() == 0


def listed(vs, es):
    after = {v: sorted({b for a, b in es if a == v}) for v in vs}
    sources = [v for v in vs if all(b != v for _, b in es)]
    paths, open_ = [], [[v] for v in sources]
    while open_:
        p = open_.pop()
        if not after[p[-1]]:
            paths.append(p)
        open_ += [[*p, b] for b in after[p[-1]]]
    reach = {v: set() for v in vs}
    for v in vs:
        stack = [v]
        while stack:
            for b in after[stack.pop()]:
                if b not in reach[v]:
                    reach[v].add(b)
                    stack.append(b)
    return {v: (max(len(p) for p in paths if v in p), len(reach[v]), sum(len(p) for p in paths if v in p[1:-1])) for v in vs}


def test_random_graphs_equal_listed_paths(spark):
    rng = random.Random(4)
    graphs = {}
    for g in range(12):
        vs = [f"v{i:02}" for i in range(rng.randint(2, 11))]
        graphs[f"g{g}"] = (vs, [p for p in itertools.combinations(vs, 2) if rng.random() < 0.35], None)
    vertices, edges = frames(spark, graphs)
    assert found_metrics(metrics.course_metrics(vertices, edges)) == {g: listed(vs, es) for g, (vs, es, _) in graphs.items()}
    ends = {(r["curriculum_id"], r["vertex"]): (r["is_source"], r["is_sink"]) for r in keys.ends(vertices, metrics.requisite_edges(edges)).collect()}
    for g, (vs, es, _) in graphs.items():
        for v in vs:
            known = (all(b != v for _, b in es), all(a != v for a, _ in es))
            assert ends.get((g, v), (False, False)) == known


def test_reach_sets_over_several_words(spark):
    """A graph of 150 vertices (three words a set) next to small ones, against listed pairs; with and without cycles."""
    rng = random.Random(12)
    vs = [f"v{i:03}" for i in range(150)]
    es = [p for p in itertools.combinations(vs, 2) if rng.random() < 0.02]
    graphs = {"wide": (vs, es), "small": (["a", "b"], [("a", "b")]), "turning": (vs, [*es, (vs[140], vs[3])])}
    vertices, edges = frames(spark, graphs)
    pairs = {g: set() for g in graphs}
    for r in loops.closure(edges).collect():
        pairs[r["curriculum_id"]].add((r["src"], r["dst"]))
    for g, (own, links) in graphs.items():
        after = {}
        for a, b in links:
            after.setdefault(a, set()).add(b)
        want = set()
        for v in own:
            stack, seen = list(after.get(v, ())), set()
            while stack:
                x = stack.pop()
                if x not in seen:
                    seen.add(x)
                    stack += after.get(x, ())
            want |= {(v, x) for x in seen}
        assert pairs[g] == want, g
    known = listed(vs, es)
    assert {r["vertex"]: r["blocking"] for r in metrics.course_metrics(vertices, edges).filter("curriculum_id = 'wide'").collect()} == {v: known[v][1] for v in vs}


def test_longest_paths(spark):
    graphs = {"d": ([1, 2, 3, 4, 5], [(1, 3), (2, 3), (3, 4), (2, 5)]), "long": (list(range(1, 16)), [(i, i + 1) for i in range(1, 15)]), "one": ([1], []), "loop": ([1], [(1, 1)])}
    vertices = spark.createDataFrame([(g, v) for g, (vs, _) in graphs.items() for v in vs], "curriculum_id string, vertex long")
    edges = spark.createDataFrame([(g, a, b) for g, (_, es) in graphs.items() for a, b in es], "curriculum_id string, src long, dst long")
    paths = {}
    for r in sorted(loops.longest_paths(loops.sweep(vertices, edges, "f")).collect()):
        paths.setdefault(r["curriculum_id"], []).append(r["vertex"])
    assert paths == {"d": [1, 3, 4], "long": graphs["long"][0], "one": [1]}


def test_a_round_leaves_the_edges_in_place(spark):
    """In a round's join only the done vertices may move: no exchange lies between the join and the scan of the edges."""
    edges = spark.range(1, 60).selectExpr("id % 7 AS curriculum_id", "id AS src", "id + 1 AS dst")
    ways = loops.edge_table(edges, "fb")
    held = spark.range(1, 60).selectExpr("id % 7 AS curriculum_id", "if(id % 3 = 0, 'f', 'b') AS dir", "id AS vertex", "id % 2 AS need", "0L AS word", "0L AS bits", "1L AS p", "1L AS lp", "id % 5 AS got", "named_struct('less', 0L, 'via', 0L) AS far")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = loops.stated(loops.SENT, spark, "", held=held, ways=ways)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("Range") < plan.index("Bucketed: true")


def test_places_of_one_large_group(spark):
    """A group with most of the rows is ranked by several tasks."""
    rows = spark.range(4000).selectExpr("CASE WHEN id % 10 < 8 THEN 'big' ELSE concat('g', id % 97) END AS g", "(id * 7919) % 4001 AS o", "id AS place_of")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # they are small here
    try:
        own = ranks.by_range(rows, "g", [F.col("o").desc()]).filter("g = 'big'")
        assert own.select(F.spark_partition_id()).distinct().count() > 1
        got = ranks.ranked(rows, "g", [F.col("o").desc()], "place").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = {}
    for r in got:
        by.setdefault(r["g"], []).append((r["place"], -r["o"]))
    assert len(got) == 4000
    for own in by.values():
        assert sorted(own) == [(i, o) for i, o in enumerate(sorted(o for _, o in own), 1)]
    assert ranks.ranked(rows.limit(0), "g", [F.col("o")], "place").count() == 0


def test_counts_beyond_64_bits_are_errors(spark):
    """20 layers of ten: 10^20 paths."""
    layers = [[f"{i:02}{c}" for c in "abcdefghij"] for i in range(20)]
    graph = {"wide": ([v for x in layers for v in x], [(a, b) for x, y in itertools.pairwise(layers) for a in x for b in y])}
    vertices, edges = frames(spark, graph)
    rows = metrics.delay_and_centrality(vertices, edges)
    assert {r["delay"] for r in rows.collect()} == {20}
    assert {(r["curriculum_id"], r["message"]) for r in metrics.graph_errors(loops.cyclic_curricula(edges), rows).collect()} == {("wide", "overflow")}


def test_components_and_closure(spark):
    vertices, edges = frames(spark, {"g": (["a", "b", "c", "d", "e"], [("b", "a"), ("c", "b"), ("e", "d")]), "ring": (["x", "y", "z"], [("x", "y"), ("y", "z"), ("z", "x")])})
    roots = {(r["curriculum_id"], r["vertex"]): r["root"] for r in loops.components(vertices, edges).collect()}
    assert [roots["g", v] for v in "abcde"] == ["a", "a", "a", "d", "d"] and {roots["ring", v] for v in "xyz"} == {"x"}
    pairs = {(r["src"], r["dst"]) for r in loops.closure(edges).filter("curriculum_id = 'ring'").collect()}
    assert pairs == set(itertools.product("xyz", "xyz"))


@pytest.mark.parametrize("path, co, known", [
    (["A", "B", "C"], [("X", "B")], ["A", "(B+X)", "C"]),
    (["B", "C"], [("A", "B")], ["(B+A)", "C"]),
    (["A", "B", "C"], [("A", "C")], ["(A+C)", "B"]),
    (["M", "Z"], [("B", "M"), ("C", "M")], ["(M+C+B)", "Z"]),
])
def test_grouped_path(spark, path, co, known):
    """co: (required along, course)."""
    paths = spark.createDataFrame([("g", path)], "curriculum_id string, path array<string>")
    edges = spark.createDataFrame([("g", a, b, "coreq", 1) for a, b in co], "curriculum_id string, src string, dst string, kind string, ord long")
    steps = summary.grouped_path(paths, edges).collect()[0]["steps"]
    assert steps == known


def test_small_curricula_equal_the_loops(spark, monkeypatch):
    """What a batch of small graphs gives in one step a round is what the loops give: counts beyond 64 bits, cycles, lone
    vertices and sets of several words too."""
    rng = random.Random(7)
    layers = [[f"{i:02}{c}" for c in "abcdefghij"] for i in range(20)]
    graphs = {"wide": ([v for x in layers for v in x], [(a, b) for x, y in itertools.pairwise(layers) for a in x for b in y]), "lone": (["x"], []), "loop": (["a", "b", "c"], [("a", "b"), ("b", "a"), ("b", "c")])}
    for g, n in enumerate((2, 9, 30, 64, 65, 140)):
        vs = [f"v{i:03}" for i in range(n)]
        graphs[f"g{g}"] = (vs, [p for p in itertools.combinations(vs, 2) if rng.random() < 3 / n])
    vertices, edges = frames(spark, graphs)
    ends = vertices.filter("vertex LIKE '%9'").withColumnRenamed("vertex", "course_key")
    best = edges.groupBy("curriculum_id", F.col("dst").alias("course_key")).agg(F.max("src").alias("best"))
    builds = (
        lambda: metrics.course_metrics(vertices, edges), lambda: loops.closure(edges), lambda: loops.components(vertices, edges.filter("src < 'v02'")),
        lambda: summary.traced(ends, best).withColumn("path", F.array_join("path", ">")), lambda: loops.numbered_closure(*numbers(spark, graphs), own=True),
    )
    near = [sorted(map(str, b().collect())) for b in builds]
    monkeypatch.setattr(local, "SMALL", 0)
    assert near == [sorted(map(str, b().collect())) for b in builds] and all(near)


def numbers(spark, graphs):
    """Graphs by the places of their vertices."""
    at = {g: {v: i for i, v in enumerate(sorted(vs), 1)} for g, (vs, _) in graphs.items()}
    vertices = [(g, i) for g, of in at.items() for i in of.values()]
    edges = [(g, at[g][a], at[g][b]) for g, (_, es) in graphs.items() for a, b in es]
    return spark.createDataFrame(vertices, "curriculum_id string, vertex long"), spark.createDataFrame(edges, "curriculum_id string, src long, dst long")
