"""Curriculum files: whole texts to metadata, course rows and an error table; sinks for tables and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from syllagraph.functions.fields import clean_field, split_fields

from .named_files import write_named_files

#: Header keys are looked for in so many lines; one misspelling is accepted.
HEADER_LINES = 10
#: Columns of the course section.
NAMES = ("course id", "course name", "prefix", "number", "prerequisites", "corequisites", "strict-corequisites", "credit hours", "canonical name")


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """curriculum_id, source_file, value: one row per file; value is null where its bytes aren't UTF-8. The id is the file's
    stem or, where files of several folders share one, its whole path without scheme and ending. Only paths are shuffled to
    find these."""
    uri, text = F.col("_metadata.file_path"), F.col("content").cast("string")
    rows = spark.read.format("binaryFile").load(paths).select(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))).alias("source_file"), F.when(F.is_valid_utf8(text), text).alias("value"))
    stem = F.regexp_extract("source_file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    shared = rows.select("source_file").groupBy(stem.alias("stem")).agg(F.count("*").alias("files")).filter("files > 1").select("stem")
    whole = F.regexp_extract("source_file", r"^(?:\w+:)?/*(.+?)(?:\.[^./]*)?$", 1)
    named = rows.withColumn("own", stem).join(shared, F.col("own") == F.col("stem"), "left")
    return named.select(F.when(F.col("stem").isNull(), F.col("own")).otherwise(whole).alias("curriculum_id"), "source_file", "value")


def lines_of(texts: DataFrame) -> DataFrame:
    """Adds the array of lines, ends of either kind."""
    return texts.withColumn("lines", F.split("value", "\r?\n"))


def numbered_lines(texts: DataFrame) -> DataFrame:
    """curriculum_id, pos (from 0), line."""
    return lines_of(texts).select("curriculum_id", F.posexplode("lines").alias("pos", "line")).withColumn("pos", F.col("pos").cast("bigint"))


def metadata_value(lines: Column, *keys: str) -> Column:
    """The second field of the last of the first lines whose first field is one of the keys; empty without one."""
    own = F.filter(F.slice(lines, 1, HEADER_LINES), lambda x: F.lower(clean_field(F.split(x, ",")[0])).isin(*keys))
    return F.coalesce(clean_field(F.get(F.split(F.element_at(own, -1), ","), F.lit(1))), F.lit(""))


def metadata(texts: DataFrame) -> DataFrame:
    """curriculum_id, name, institution, degree_type, system_type, cip_code, without a shuffle."""
    lines = F.col("lines")
    last = lambda *keys: F.when(F.size(F.filter(F.slice(lines, 1, HEADER_LINES), lambda x: F.lower(clean_field(F.split(x, ",")[0])).isin(*keys))) > 0, metadata_value(lines, *keys)).otherwise(F.lit(""))
    return lines_of(texts).select("curriculum_id", last("curriculum").alias("name"), last("institution", "insitution").alias("institution"), last("degree type").alias("degree_type"), last("system type").alias("system_type"), last("cip").alias("cip_code"))


def section_start(lines: Column) -> Column:
    """Place (from 1) of the first line that holds `courses` in any case; 0 without one."""
    return F.array_position(F.transform(lines, lambda x: F.contains(F.lower(x), F.lit("courses"))), True)


def sections(texts: DataFrame) -> DataFrame:
    """curriculum_id, marker_pos (from 0), header: of texts with a course section."""
    at = section_start(F.col("lines"))
    return lines_of(texts).withColumn("at", at).filter((F.col("at") > 0) & (F.col("at") < F.size("lines"))).select("curriculum_id", (F.col("at") - 1).cast("bigint").alias("marker_pos"), F.get("lines", F.col("at").cast("int")).alias("header"))


def course_rows(texts: DataFrame) -> DataFrame:
    """curriculum_id, line_no, course_id, name, prefix, number, prereq_text, coreq_text, strict_text, credits,
    canonical_name of the lines below the header, by header names.

    Blank lines and rows without a Course ID field, a prefix or a number are left out; credits that are no number are 0;
    an empty canonical name is null. No shuffle.
    """
    at = section_start(F.col("lines")).cast("int")
    found = lines_of(texts).withColumn("at", at).filter((F.col("at") > 0) & (F.col("at") < F.size("lines")))
    # the header's names are placed once a text, and a line is split once: in lambdas, no filter is pushed below them
    header = F.transform(split_fields(F.get("lines", F.col("at"))), F.lower)
    places = F.transform(F.array(header), lambda h: F.transform(F.lit(list(NAMES)), lambda n: F.array_position(h, n).cast("int")))[0]
    below = F.filter(F.transform(F.col("lines"), lambda x, i: F.struct(i.cast("bigint").alias("line_no"), x.alias("line"))), lambda x: (x["line_no"] > F.col("at")) & (F.trim(x["line"]) != ""))
    fields = F.transform(below, lambda x: F.struct(x["line_no"].alias("line_no"), F.transform(F.array(split_fields(x["line"])), lambda f: F.transform(F.col("places"), lambda p: F.when(p > 0, F.get(f, p - 1))))[0].alias("f")))
    rows = found.withColumn("places", places).select("curriculum_id", F.explode(fields).alias("r")).select("curriculum_id", "r.line_no", "r.f")
    get = lambda name: F.col("f")[NAMES.index(name)]
    text = lambda name: F.coalesce(get(name), F.lit(""))
    credit = F.when(get("credit hours").rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), get("credit hours").try_cast("double"))
    return rows.select(
        "curriculum_id", "line_no", get("course id").alias("course_id"), text("course name").alias("name"), text("prefix").alias("prefix"), text("number").alias("number"),
        text("prerequisites").alias("prereq_text"), text("corequisites").alias("coreq_text"), text("strict-corequisites").alias("strict_text"),
        F.coalesce(credit, F.lit(0.0)).alias("credits"), F.nullif(get("canonical name"), F.lit("")).alias("canonical_name"),
    ).filter("course_id IS NOT NULL")


def kept_courses(rows: DataFrame) -> DataFrame:
    return rows.filter("prefix <> '' AND number <> ''")


def file_errors(texts: DataFrame) -> DataFrame:
    """curriculum_id, stage, message: texts that can't be decoded, and texts without name, institution or course section. A bad
    file is a row here."""
    lost = texts.filter("value IS NULL").select("curriculum_id", F.lit("read").alias("stage"), F.lit("not UTF-8").alias("message"))
    texts = texts.filter("value IS NOT NULL")
    meta = metadata(texts)
    at = section_start(F.col("lines"))
    bad = lines_of(texts).filter((at == 0) | (at >= F.size("lines"))).select("curriculum_id", F.lit("sections").alias("stage"), F.lit("no course section").alias("message"))
    no = lambda column, message: meta.filter(F.col(column) == "").select("curriculum_id", F.lit("metadata").alias("stage"), F.lit(message).alias("message"))
    return lost.union(no("name", "no curriculum name")).union(no("institution", "no institution")).union(bad)


def expected_totals(texts: DataFrame) -> DataFrame:
    """curriculum_id, total, longest_delay, highest_centrality of finished metric tables, out of the lines before their courses;
    null where a table doesn't tell."""
    lines = F.slice("lines", 1, F.greatest(section_start(F.col("lines")).cast("int") - 1, F.lit(0)))

    def told(key: str, place: int) -> Column:
        """A field of the first line that begins with the key; from the right, as the field before it may hold commas."""
        fields = F.transform(F.split(F.get(F.filter(lines, lambda x: F.lower(clean_field(F.split(x, ",")[0])) == key), F.lit(0)), ","), clean_field)
        return F.get(F.filter(fields, lambda x: x != ""), F.lit(place)) if place >= 0 else F.element_at(F.filter(fields, lambda x: x != ""), place)

    return lines_of(texts.filter("value IS NOT NULL")).select("curriculum_id", told("total structural complexity", 1).try_cast("double").alias("total"), told("longest delay", 1).try_cast("double").cast("bigint").alias("longest_delay"), told("highest centrality course", -1).try_cast("double").cast("bigint").alias("highest_centrality"))


def read_expected_totals(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """curriculum_id, total, longest_delay, highest_centrality of finished metric tables: what they tell before their courses, or
    else the sum of their courses' complexities; null for the others."""
    texts = read_texts(spark, paths)
    summed = expected_metrics(texts).groupBy("curriculum_id").agg(F.sum("complexity").alias("sum"))
    return expected_totals(texts).join(summed, "curriculum_id", "left").select("curriculum_id", F.coalesce("total", "sum").alias("total"), "longest_delay", "highest_centrality")


def read_expected_metrics(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return expected_metrics(read_texts(spark, paths))


def expected_metrics(texts: DataFrame) -> DataFrame:
    """curriculum_id, course_id, complexity, blocking, delay, centrality of finished metric tables (quoted fields);
    rows of under 14 fields are left out and what is no number is 0."""
    rows = lines_of(texts).select("curriculum_id", F.posexplode("lines").alias("pos", "line"), section_start(F.col("lines")).alias("at")).filter("pos > at")
    fields = F.from_csv("line", ", ".join(f"f{i} string" for i in range(14)), {"quote": '"', "mode": "PERMISSIVE"})
    enough = F.size(F.split(F.regexp_replace("line", '"[^"]*"', ""), ",")) >= 14  # the last field may be empty
    rows = rows.filter(enough).select("curriculum_id", fields.alias("f")).select("curriculum_id", "f.*")
    number = lambda c: F.coalesce(F.trim(c).try_cast("double"), F.lit(0.0))
    return rows.select("curriculum_id", F.trim("f0").alias("course_id"), number("f10").alias("complexity"), number("f11").cast("bigint").alias("blocking"), number("f12").cast("bigint").alias("delay"), number("f13").cast("bigint").alias("centrality"))


def write_documents(documents: DataFrame, path: str) -> None:
    """(file_name, body): one text per file name, as the file of that name in the folder."""
    write_named_files(documents, path)


def write_course_metrics(rows: DataFrame, path: str) -> None:
    rows.repartition("curriculum_id").write.partitionBy("curriculum_id").option("header", True).csv(path)
