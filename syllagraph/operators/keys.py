"""Course keys, requisite lists and edge tables; look-ups and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from syllagraph.functions.fields import degree_id, natural_key, normalize_course_key, split_ids

LISTS = {"prereq": "prereq_text", "coreq": "coreq_text", "strict": "strict_text"}


def merged_rows(rows: DataFrame) -> DataFrame:
    """One row per Course ID of parsed rows (curriculum_id, line_no, course_id, name, prefix, number, credits,
    canonical_name): the last row's fields, the first row's place, and every row's natural key kept for counting."""
    kept = rows.filter("prefix <> '' AND number <> ''").withColumn("natural_key", natural_key(F.col("prefix"), F.col("number")))
    fields = F.struct("name", "prefix", "number", "credits", "canonical_name", "natural_key")
    return kept.groupBy("curriculum_id", "course_id").agg(F.min("line_no").alias("plan_pos"), F.max_by(fields, "line_no").alias("f"), F.collect_list("natural_key").alias("all_keys")).select("curriculum_id", "course_id", "plan_pos", "f.*", "all_keys")


def with_storage_keys(courses: DataFrame) -> DataFrame:
    """Adds course_key: the natural key, or natural_key_id for all courses that share it within their curriculum. A course
    of several rows counts once per row under each of its natural keys."""
    counts = courses.select("curriculum_id", F.explode("all_keys").alias("natural_key")).groupBy("curriculum_id", "natural_key").agg(F.count("*").alias("n"))
    key = F.when(F.col("n") > 1, F.concat_ws("_", "natural_key", "course_id")).otherwise(F.col("natural_key"))
    return courses.join(counts, ["curriculum_id", "natural_key"]).withColumn("course_key", key).drop("n", "all_keys")


def storage_keys(courses: DataFrame) -> DataFrame:
    """Adds course_key to courses with one row each (curriculum_id, course_id, natural_key): one window."""
    repeated = F.count("*").over(Window.partitionBy("curriculum_id", "natural_key")) > 1
    return courses.withColumn("course_key", F.when(repeated, F.concat_ws("_", "natural_key", F.col("course_id").cast("string"))).otherwise(F.col("natural_key")))


def requisite_items(rows: DataFrame, kinds: tuple[str, ...] = tuple(LISTS)) -> DataFrame:
    """curriculum_id, course_id, kind, ord (from 1), item: the lists of each course, repeated items once."""
    lists = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.array_distinct(split_ids(F.col(LISTS[k]))).alias("items")) for k in kinds]))
    items = rows.select("curriculum_id", "course_id", lists.alias("l")).select("curriculum_id", "course_id", "l.kind", F.posexplode("l.items").alias("pos", "item"))
    return items.select("curriculum_id", "course_id", "kind", (F.col("pos") + 1).cast("bigint").alias("ord"), "item")


def resolved(items: DataFrame, courses: DataFrame) -> DataFrame:
    """curriculum_id, course_key, kind, ord, required_key: an item that is a Course ID stands for that course. Another
    prerequisite is kept as a normalised key; another corequisite is dropped."""
    ids = courses.select("curriculum_id", F.col("course_id").cast("string").alias("item"), F.col("course_key").alias("found"))
    owner = courses.select("curriculum_id", F.col("course_id").cast("string").alias("course_id"), "course_key")
    rows = items.withColumn("course_id", F.col("course_id").cast("string")).join(owner, ["curriculum_id", "course_id"]).join(ids, ["curriculum_id", "item"], "left")
    rows = rows.filter((F.col("kind") == "prereq") | F.col("found").isNotNull())
    return rows.select("curriculum_id", "course_key", "kind", "ord", F.coalesce("found", normalize_course_key(F.col("item"))).alias("required_key"))


def edges_of(required: DataFrame, courses: DataFrame) -> DataFrame:
    """curriculum_id, src, dst, kind, ord: requirements whose key is a course of the same curriculum, each pair once per
    kind (strict ones count as corequisites) at its first place. ord is (strict, place): strict ones come after listed ones."""
    known = courses.select("curriculum_id", F.col("course_key").alias("required_key"))
    kind = F.when(F.col("kind") == "prereq", "prereq").otherwise("coreq")
    rows = required.join(known, ["curriculum_id", "required_key"], "left_semi").withColumn("strict_last", F.struct((F.col("kind") == "strict").alias("strict"), "ord"))
    return rows.groupBy("curriculum_id", F.col("required_key").alias("src"), F.col("course_key").alias("dst"), kind.alias("kind")).agg(F.min("strict_last").alias("ord"))


def degrees(vertices: DataFrame, pairs: DataFrame) -> DataFrame:
    """curriculum_id, vertex, indegree, outdegree over distinct pairs (src, dst)."""
    into = pairs.groupBy("curriculum_id", F.col("dst").alias("vertex")).agg(F.count("*").alias("indegree"))
    out = pairs.groupBy("curriculum_id", F.col("src").alias("vertex")).agg(F.count("*").alias("outdegree"))
    on = ["curriculum_id", "vertex"]
    return vertices.select(*on).join(into, on, "left").join(out, on, "left").select(*on, F.coalesce("indegree", F.lit(0)).cast("bigint").alias("indegree"), F.coalesce("outdegree", F.lit(0)).cast("bigint").alias("outdegree"))


def ends(vertices: DataFrame, pairs: DataFrame) -> DataFrame:
    """curriculum_id, vertex, is_source, is_sink of vertices that nothing leads to or that lead nowhere."""
    on = ["curriculum_id", "vertex"]
    source = vertices.select(*on).join(pairs.select("curriculum_id", F.col("dst").alias("vertex")), on, "left_anti").withColumn("is_source", F.lit(True))
    sink = vertices.select(*on).join(pairs.select("curriculum_id", F.col("src").alias("vertex")), on, "left_anti").withColumn("is_sink", F.lit(True))
    return source.join(sink, on, "full_outer").select(*on, F.coalesce("is_source", F.lit(False)).alias("is_source"), F.coalesce("is_sink", F.lit(False)).alias("is_sink"))


def first_by_natural_key(courses: DataFrame) -> DataFrame:
    """The storage key found for each natural key: of several, the first in the plan."""
    return courses.groupBy("curriculum_id", "natural_key").agg(F.min_by("course_key", "plan_pos").alias("course_key"))


def courses_by_key(courses: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (curriculum_id, course_key) with the course of each storage key, and contained: whether there is one."""
    own = courses.select("curriculum_id", "course_key", F.struct(*[c for c in courses.columns if c not in ("curriculum_id", "course_key")]).alias("course"))
    return wanted.select("curriculum_id", "course_key").join(own, ["curriculum_id", "course_key"], "left").withColumn("contained", F.col("course").isNotNull())


def courses_by_natural_key(courses: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (curriculum_id, natural_key) with the storage key and course of each; of several the first in the plan."""
    keys = wanted.select("curriculum_id", "natural_key").join(first_by_natural_key(courses), ["curriculum_id", "natural_key"], "left")
    found = courses_by_key(courses, keys.filter("course_key IS NOT NULL").select("curriculum_id", "course_key").distinct())
    return keys.join(found, ["curriculum_id", "course_key"], "left").withColumn("contained", F.coalesce("contained", F.lit(False)))


def degrees_by_id(curriculum: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (degree_id) with the degree's type, system and code; of several curricula with that degree the smallest one's."""
    own = curriculum.groupBy(degree_id(F.col("degree_type"), F.col("name")).alias("degree_id")).agg(F.min(F.struct("curriculum_id", "degree_type", "system_type", "cip_code")).alias("d"))
    return wanted.select("degree_id").join(own, "degree_id", "left").select("degree_id", "d.*")


def neighbour_lists(courses: DataFrame, edges: DataFrame) -> DataFrame:
    """curriculum_id, course_key and its four lists joined by commas: requisites in list order, dependents by key."""
    back = edges.groupBy("curriculum_id", F.col("dst").alias("course_key")).agg(*[listed(k, "src", "ord").alias(n) for k, n in (("prereq", "prerequisites"), ("coreq", "corequisites"))])
    ahead = edges.groupBy("curriculum_id", F.col("src").alias("course_key")).agg(*[listed(k, "dst", "dst").alias(n) for k, n in (("prereq", "dependents"), ("coreq", "coreq_dependents"))])
    on = ["curriculum_id", "course_key"]
    rows = courses.select(*on).join(back, on, "left").join(ahead, on, "left")
    return rows.select(*on, *[F.coalesce(c, F.lit("")).alias(c) for c in ("prerequisites", "dependents", "corequisites", "coreq_dependents")])


def listed(kind: str, column: str, by: str):
    """List of a column over edges of one kind, ordered and joined by commas."""
    pair = F.when(F.col("kind") == kind, F.struct(F.col(by).alias("o"), F.col(column).alias("c")))
    return F.array_join(F.sort_array(F.collect_list(pair))["c"], ",")


def dag_listing(courses: DataFrame, edges: DataFrame) -> DataFrame:
    """curriculum_id, course_key, line: each course with what it requires."""
    lists = neighbour_lists(courses, edges)
    pre, co = F.replace("prerequisites", F.lit(","), F.lit(", ")), F.replace("corequisites", F.lit(","), F.lit(", "))
    parts = F.concat_ws(" | ", F.when(pre != "", F.concat(F.lit("prereq: "), pre)), F.when(co != "", F.concat(F.lit("coreq: "), co)))
    return lists.select("curriculum_id", "course_key", F.concat("course_key", F.lit(" → "), F.when(parts == "", "(no prerequisites or corequisites)").otherwise(parts)).alias("line"))


def missing_from_plans(plan_courses: DataFrame, courses: DataFrame) -> DataFrame:
    """curriculum_id, plan_id, message for plan courses that the school doesn't have."""
    lost = plan_courses.join(courses.select("curriculum_id", "course_key"), ["curriculum_id", "course_key"], "left_anti")
    return lost.select("curriculum_id", "plan_id", F.format_string("Plan '%s': missing course '%s'", "plan_id", "course_key").alias("message"))


def missing_requisites(required: DataFrame, courses: DataFrame) -> DataFrame:
    """curriculum_id, course_key, kind, required_key, message for prerequisites and corequisites that the school doesn't
    have; strict ones aren't checked. The message names the course by its natural key."""
    lost = required.filter("kind <> 'strict'").join(courses.select("curriculum_id", F.col("course_key").alias("required_key")), ["curriculum_id", "required_key"], "left_anti")
    named = lost.join(courses.select("curriculum_id", "course_key", "natural_key"), ["curriculum_id", "course_key"], "left")
    word = F.when(F.col("kind") == "prereq", "prerequisite").otherwise("corequisite")
    return named.select("curriculum_id", "course_key", "kind", "required_key", F.format_string("Course '%s': missing %s '%s'", F.coalesce("natural_key", "course_key"), word, F.col("required_key")).alias("message"))


def plan_edit(plan_courses: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Plan rows (curriculum_id, plan_id, pos, course_key) with courses added where absent and others removed."""
    on = ["curriculum_id", "plan_id", "course_key"]
    rows = plan_courses.select(*on, "pos").union(added.select(*on, "pos")).groupBy(*on).agg(F.min("pos").alias("pos"))
    return rows.join(removed.select(*on), on, "left_anti")


def course_upsert(courses: DataFrame, changes: DataFrame, order: str) -> DataFrame:
    """Rows of both, the one of the highest order for each key; replaced tells whether there were several."""
    rows = courses.union(changes.select(*courses.columns))
    values = F.struct(*[c for c in courses.columns if c not in ("curriculum_id", "course_key")])
    return rows.groupBy("curriculum_id", "course_key").agg(F.max_by(values, order).alias("v"), (F.count("*") > 1).alias("replaced")).select("curriculum_id", "course_key", "v.*", "replaced")
