"""Loops over many small graphs at once, keyed by curriculum.

Edges are written once in buckets by the vertex they leave, so a round shuffles (or broadcasts, where they are few) its own
rows alone. Tables lie in the shared folder: the lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from syllagraph.storage import Rounds, bucketed, dealt, lean

from . import local
from .ranks import ranked

#: Bits of a word of a reach set.
WORD = 64
AT = ("curriculum_id", "dir", "vertex")


def cyclic_curricula(edges: DataFrame) -> DataFrame:
    """curriculum_id of every graph with a cycle. Edges whose source has no incoming edge are peeled off until none is
    left to peel; only graphs with a cycle keep any."""
    left = lean(edges.select("curriculum_id", "src", "dst").distinct(), "peel")
    n = left.count()
    while n:
        entered = left.select("curriculum_id", F.col("dst").alias("src")).distinct()
        seen = Observation()
        left = lean(left.join(entered, ["curriculum_id", "src"], "left_semi").observe(seen, F.count("*").alias("n")), "peel")
        if seen.get["n"] == n:
            break
        n = seen.get["n"]
    return left.select("curriculum_id").distinct()


def numbered(vertices: DataFrame) -> DataFrame:
    """curriculum_id, vertex, place: the vertices of each curriculum from 1 on, in their order."""
    return lean(ranked(vertices.select("curriculum_id", "vertex"), "curriculum_id", [F.col("vertex")], "place"), "numbers")


def by_place(edges: DataFrame, numbers: DataFrame) -> DataFrame:
    """edges between the places of their vertices."""
    of = lambda c: numbers.select("curriculum_id", F.col("vertex").alias(c), F.col("place").alias(f"{c}_place"))
    rows = edges.select("curriculum_id", "src", "dst").distinct().join(of("src"), ["curriculum_id", "src"]).join(of("dst"), ["curriculum_id", "dst"])
    return rows.select("curriculum_id", F.col("src_place").alias("src"), F.col("dst_place").alias("dst"))


def edge_table(edges: DataFrame, dirs: str) -> DataFrame:
    """curriculum_id, dir, vertex, to, to_need: each distinct edge, forward (f) and backward (b), and how many lead to its
    later vertex; in buckets by the vertex it leaves."""
    pairs = edges.select("curriculum_id", "src", "dst").distinct()
    ends = {"f": ("src", "dst"), "b": ("dst", "src")}
    ways = F.explode(F.array(*[F.struct(F.lit(d).alias("dir"), F.col(ends[d][0]).alias("vertex"), F.col(ends[d][1]).alias("to")) for d in dirs]))
    rows = pairs.select("curriculum_id", ways.alias("w")).select("curriculum_id", "w.*")
    needs = rows.groupBy("curriculum_id", "dir", "to").agg(F.count("*").alias("to_need"))
    rows = rows.join(needs, ["curriculum_id", "dir", "to"]).select(*AT, "to", "to_need")
    return bucketed(dealt(rows, *AT), "ways", *AT)


def word_of(vertex: str, reach: str) -> str:
    """The word of a reach set that a vertex lies in; 0 in a direction without sets."""
    return f"IF(dir = '{reach}', ({vertex} - 1) DIV {WORD}, 0L)"


def bit_of(vertex: str, reach: str) -> str:
    return f"IF(dir = '{reach}', shiftleft(1L, CAST(({vertex} - 1) % {WORD} AS INT)), 0L)"


#: What a vertex that is done sends along its edges: its counts once, on the row of its own word, and the words of its reach
#: set. A receiver whose own word isn't among those sent gets a row for it.
SENT = """
  SELECT curriculum_id, dir, to AS vertex, to_need AS need, m.* FROM (
    SELECT *, explode(IF(main AND word <> own_word, array(own, other), array(own))) AS m FROM (
      SELECT *,
        named_struct('word', word, 'bits', IF(word = own_word, bits | own_bit, bits), 'p', IF(main, p, 0L), 'lp', IF(main, try_add(lp, p), 0L), 'got', IF(main, 1L, 0L), 'far', IF(main, named_struct('less', coalesce(far.less, 0L) - 1L, 'via', vertex), NULL)) AS own,
        named_struct('word', own_word, 'bits', own_bit, 'p', 0L, 'lp', 0L, 'got', 0L, 'far', CAST(NULL AS STRUCT<less: BIGINT, via: BIGINT>)) AS other
      FROM (SELECT *, word = {word} AS main, {to_word} AS own_word, {to_bit} AS own_bit FROM (SELECT * FROM {held} WHERE got = need) JOIN {ways} USING (curriculum_id, dir, vertex))
    )
  )"""

#: A round: what is sent and what waits is added up by vertex and word. Counts lie on any row of a vertex while they are
#: gathered, and on all once it is done. Rows are dealt by vertex, so that its words are added up and looked at together
#: without another shuffle.
ROUND = """
SELECT curriculum_id, dir, vertex, need, word, bits, IF(whole, all_p, p) AS p, IF(whole, all_lp, lp) AS lp, IF(whole, all_got, got) AS got, IF(whole, all_far, far) AS far FROM (
  SELECT *, all_got = need AS whole FROM (
    SELECT *, IF(count(*) OVER v = count(p) OVER v, try_sum(p) OVER v, NULL) AS all_p, IF(count(*) OVER v = count(lp) OVER v, try_sum(lp) OVER v, NULL) AS all_lp, sum(got) OVER v AS all_got, min(far) OVER v AS all_far FROM (
      SELECT curriculum_id, dir, vertex, word, first(need) AS need, bit_or(bits) AS bits, IF(count(*) = count(p), try_sum(p), NULL) AS p, IF(count(*) = count(lp), try_sum(lp), NULL) AS lp, sum(got) AS got, min(far) AS far
      FROM (SELECT /*+ REPARTITION({tasks}, curriculum_id, dir, vertex) */ * FROM ({sent}
        UNION ALL SELECT curriculum_id, dir, vertex, need, word, bits, p, lp, got, far FROM {held} WHERE got <> need))
      GROUP BY curriculum_id, dir, vertex, word
    ) WINDOW v AS (PARTITION BY curriculum_id, dir, vertex)
  )
)"""

START = """
SELECT curriculum_id, dir, vertex, 1L AS need, {word} AS word, {bit} AS bits, 1L AS p, 1L AS lp, 1L AS got, CAST(NULL AS STRUCT<less: BIGINT, via: BIGINT>) AS far
FROM {ends} LEFT ANTI JOIN (SELECT curriculum_id, dir, to AS vertex FROM {ways}) USING (curriculum_id, dir, vertex)"""


def stated(text: str, spark: SparkSession, reach: str, **frames: DataFrame) -> DataFrame:
    """A statement of a round over frames."""
    text = text.replace("{sent}", SENT).replace("{tasks}", spark.conf.get("spark.sql.shuffle.partitions"))
    for name, of in (("{word}", word_of("vertex", reach)), ("{to_word}", word_of("to", reach)), ("{bit}", bit_of("vertex", reach)), ("{to_bit}", bit_of("to", reach))):
        text = text.replace(name, of)
    return spark.sql(text, **frames)


def sweep(vertices: DataFrame, edges: DataFrame, dirs: str = "fb", reach: str = "") -> DataFrame:
    """Every vertex of graphs without cycles once it is reached by all edges that lead to it: curriculum_id, dir, vertex, main,
    word, bits, p, lp, k, via. Vertices are numbers from 1 on in their curriculum.

    dir f goes along the edges, b against them. p: paths that end at the vertex, lp: their lengths in vertices together, null
    where they outgrow 64 bits; k: the longest in edges, via: the vertex before it on one of these, the smallest of several.
    In the direction `reach` there is a row per word of the set of vertices before it (itself included), elsewhere one row; main
    tells one of them. Each edge is used once; there are as many rounds as the longest path has vertices. Graphs with cycles,
    whose vertices wait for each other, are left out.
    """
    spark, ways = vertices.sparkSession, edge_table(edges, dirs)
    ends = vertices.select("curriculum_id", F.explode(F.array(*map(F.lit, dirs))).alias("dir"), F.col("vertex").cast("long").alias("vertex"))
    main, rows = F.expr(f"got = need AND word = {word_of('vertex', reach)}"), stated(START, spark, reach, ends=ends, ways=ways)
    rounds, finished = Rounds(spark, "sweep"), 0
    while True:
        seen = Observation()
        held = rounds.add(rows.observe(seen, F.count_if(main).alias("done")))
        if not seen.get["done"]:
            break
        finished += seen.get["done"]
        rows = stated(ROUND, spark, reach, held=held, ways=ways)
    out = rounds.rows().filter("got = need").select(*AT, main.alias("main"), "word", "bits", "p", "lp", F.coalesce(-F.col("far.less"), F.lit(0).cast("long")).alias("k"), F.col("far.via").alias("via"))
    if finished == len(dirs) * vertices.count():
        return out
    lost = ends.join(out, list(AT), "left_anti").select("curriculum_id").distinct()
    return out.join(lean(lost, "cyclic"), "curriculum_id", "left_anti")


def longest_paths(swept: DataFrame) -> DataFrame:
    """curriculum_id, place (from 0), vertex of a longest path of each graph, out of a sweep along the edges: its last vertex is
    the smallest of those that the longest ways end at. Ways back are walked by doubling: each round every vertex on the path
    jumps twice as far, so a path of n vertices takes log n rounds."""
    on = ("curriculum_id", "vertex")
    rows = swept.filter("dir = 'f' AND main").select(*on, "k", "via")
    ends = rows.groupBy("curriculum_id").agg(F.min(F.struct((-F.col("k")).alias("less"), "vertex")).alias("last")).select("curriculum_id", "last.vertex")
    jumps = bucketed(dealt(rows.filter("via IS NOT NULL").select(*on, F.col("via").alias("to")), *on), "jumps", *on)
    path = bucketed(dealt(ends, *on), "path", *on)
    while True:
        seen = Observation()
        ahead = path.join(jumps, list(on)).select("curriculum_id", F.col("to").alias("vertex"))
        path = bucketed(dealt(path.union(ahead), *on).observe(seen, F.count("*").alias("n")), "path", *on)
        twice = jumps.join(jumps.select("curriculum_id", F.col("vertex").alias("to"), F.col("to").alias("far")), ["curriculum_id", "to"])
        left = Observation()
        jumps = bucketed(dealt(twice.select(*on, F.col("far").alias("to")), *on).observe(left, F.count("*").alias("n")), "jumps", *on)
        if not left.get["n"]:
            return path.join(rows, list(on)).select("curriculum_id", F.col("k").alias("place"), "vertex")


def reach_sets(vertices: DataFrame, edges: DataFrame, small: bool = False, own: bool = False) -> DataFrame:
    """curriculum_id, vertex, word, bits of the vertices that each vertex leads to; with cycles too. Vertices are numbers from 1
    on in their curriculum; words without a vertex are left out. small: all curricula are known to be so. own: each
    vertex lies in its set."""
    known = local.sizes(vertices)
    found, large = local.reach_sets(known, edges, own), known.filter("NOT small").select("curriculum_id")
    if not small and not large.isEmpty():
        found = found.union(swept_sets(*[rows.join(large, "curriculum_id", "left_semi") for rows in (vertices, edges)], own))
    found = bucketed(dealt(found, "curriculum_id"), "sets", "curriculum_id")
    # without a cycle, a vertex that an edge leaves has a word
    rest = edges.select("curriculum_id", "src", "dst").distinct().join(found.select("curriculum_id").distinct(), "curriculum_id", "left_anti")
    if rest.isEmpty():
        return found
    rest = lean(rest, "rest")
    if own:
        alone = vertices.join(rest.select("curriculum_id").distinct(), "curriculum_id", "left_semi").withColumn("dir", F.lit("b"))
        found = found.union(alone.select("curriculum_id", "vertex", F.expr(word_of("vertex", "b")).alias("word"), F.expr(bit_of("vertex", "b")).alias("bits")))
    return found.union(cyclic_reach(rest))


def swept_sets(vertices: DataFrame, edges: DataFrame, itself: bool) -> DataFrame:
    """The same of large curricula without cycles; itself: each vertex lies in its set."""
    swept = sweep(vertices, edges, "b", "b")
    if itself:
        return swept.select("curriculum_id", "vertex", "word", "bits")
    own = F.when(F.col("main"), F.expr(bit_of("vertex", "b"))).otherwise(F.lit(0).cast("long"))
    return swept.select("curriculum_id", "vertex", "word", F.col("bits").bitwiseAND(F.bitwise_not(own)).alias("bits")).filter("bits <> 0")


def cyclic_reach(edges: DataFrame) -> DataFrame:
    """The same for graphs with cycles: words grow along the edges until no vertex gains a bit; each round passes on what the
    last one gained."""
    back = bucketed(dealt(edges.select("curriculum_id", F.col("dst").alias("vertex"), "src"), "curriculum_id", "vertex"), "back", "curriculum_id", "vertex")
    spot = ["curriculum_id", "vertex", "word"]
    ahead = edges.withColumn("dir", F.lit("b")).select("curriculum_id", F.col("src").alias("vertex"), F.expr(word_of("dst", "b")).alias("word"), F.expr(bit_of("dst", "b")).alias("bit"))
    first = ahead.groupBy(*spot).agg(F.bit_or("bit").alias("bits"))
    seen = gained = lean(first, "reach")
    while not gained.isEmpty():
        offered = gained.join(back, ["curriculum_id", "vertex"]).groupBy("curriculum_id", F.col("src").alias("vertex"), "word").agg(F.bit_or("bits").alias("bits"))
        old = F.coalesce("had", F.lit(0).cast("long"))
        new = lean(offered.join(seen.select(*spot, F.col("bits").alias("had")), spot, "left").select(*spot, F.col("bits").bitwiseAND(F.bitwise_not(old)).alias("bits")).filter("bits <> 0"), "gained")
        seen, gained = lean(seen.union(new).groupBy(*spot).agg(F.bit_or("bits").alias("bits")), "reach"), new
    return seen


def listed_pairs(words: DataFrame) -> DataFrame:
    """curriculum_id, src, dst of reach sets."""
    bits = F.explode(F.expr(f"filter(sequence(0, {WORD - 1}), i -> (shiftrightunsigned(bits, i) & 1L) = 1L)"))
    rows = words.select("curriculum_id", F.col("vertex").alias("src"), "word", bits.alias("i"))
    return rows.select("curriculum_id", "src", (F.col("word") * WORD + F.col("i") + 1).alias("dst"))


def closure(edges: DataFrame) -> DataFrame:
    """curriculum_id, src, dst: every pair with a path, in graphs with cycles too. Pairs are listed out of the reach sets at
    the end; no loop carries them."""
    pairs = edges.select("curriculum_id", "src", "dst")
    numbers = numbered(pairs.select("curriculum_id", F.col("src").alias("vertex")).union(pairs.select("curriculum_id", F.col("dst").alias("vertex"))).distinct())
    words = reach_sets(numbers.select("curriculum_id", F.col("place").alias("vertex")), by_place(pairs, numbers))
    rows = listed_pairs(words).select("curriculum_id", F.col("src").alias("a"), F.col("dst").alias("b"))
    of = lambda place, c: numbers.select("curriculum_id", F.col("place").alias(place), F.col("vertex").alias(c))
    return rows.join(of("a", "src"), ["curriculum_id", "a"]).join(of("b", "dst"), ["curriculum_id", "b"]).select("curriculum_id", "src", "dst")


def numbered_closure(vertices: DataFrame, edges: DataFrame, small: bool = False, own: bool = False) -> DataFrame:
    """The same of vertices that are numbers from 1 on in their curriculum. own: with the pair of each vertex and itself."""
    return listed_pairs(reach_sets(vertices, edges, small, own))


def components(vertices: DataFrame, edges: DataFrame, small: bool = False) -> DataFrame:
    """curriculum_id, vertex, root: the smallest vertex that undirected edges join it to."""
    on = ["curriculum_id", "vertex"]
    return vertices.select(*on).join(joined(edges, small), on, "left").select(*on, F.coalesce("root", "vertex").alias("root"))


def joined(edges: DataFrame, small: bool = False) -> DataFrame:
    """The same of the vertices of edges. Curricula of few edges are a row each; small: all are known to be so."""
    return local.parted(local.components, spread_labels, small, edges.select("curriculum_id", "src", "dst"))


def spread_labels(edges: DataFrame) -> DataFrame:
    """The same of the vertices of edges. Labels spread one edge and jump to their label's label each round; pairs and labels lie
    in buckets, so only what spreads is shuffled."""
    pairs = edges.select("curriculum_id", F.col("src").alias("vertex"), F.col("dst").alias("other"))
    pairs = pairs.union(pairs.select("curriculum_id", F.col("other").alias("vertex"), F.col("vertex").alias("other"))).distinct()
    on = ("curriculum_id", "vertex")
    pairs = bucketed(dealt(pairs, *on), "pairs", *on)
    now = bucketed(dealt(pairs.groupBy(*on).agg(F.least(F.col("vertex"), F.min("other")).alias("root")), *on), "labels", *on)
    while True:
        near = now.join(pairs, list(on)).groupBy("curriculum_id", F.col("other").alias("vertex")).agg(F.min("root").alias("near"))
        spread = now.join(near, list(on)).select("curriculum_id", "vertex", F.least("root", "near").alias("next"), "root")
        jump = now.select("curriculum_id", F.col("vertex").alias("next"), F.col("root").alias("far"))
        seen = Observation()
        new = spread.join(jump, ["curriculum_id", "next"]).select("curriculum_id", "vertex", F.least("next", "far").alias("root"), F.col("root").alias("old"))
        new = bucketed(dealt(new, *on).observe(seen, F.count_if(F.col("root") != F.col("old")).alias("changed")), "labels", *on)
        now = new.select("curriculum_id", "vertex", "root")
        if not seen.get["changed"]:
            return now
