"""Fields, curriculum texts with every kind of fault, and whole batches out of them."""

import json
import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from syllagraph.functions import fields
from syllagraph.operators import keys, report, summary
from syllagraph.plans.batch import Batch
from syllagraph.sources import files, named_files


def value(spark, column, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]).select(column).collect()[0][0]


@pytest.mark.parametrize("raw, known", [("  a ", "a"), ('"a b"', "a b"), ('﻿ "x​"', "x"), ("　y ", "y"), ('a"b', 'a"b'), ("", "")])
def test_clean_field(spark, raw, known):
    assert value(spark, fields.clean_field(F.col("v")), v=raw) == known


@pytest.mark.parametrize("raw, known", [("CS 101", "CS101"), (" CS  101 (or equal)", "CS101"), ("CS101", "CS101"), ("CS 101 lab", "CS101"), ("(x)", ""), ("", "")])
def test_normalize_course_key(spark, raw, known):
    assert value(spark, fields.normalize_course_key(F.col("v")), v=raw) == known


def test_small_functions(spark):
    assert value(spark, fields.split_ids(F.col("v")), v=" 1; ;2;1 ") == ["1", "2", "1"]
    assert value(spark, fields.short_name(F.col("v")), v="é" * 21) == "é" * 17 + "..."
    assert value(spark, fields.node_id(F.col("v")), v="Ab-1é#") == "Ab_1é_"
    assert value(spark, fields.step_members(F.col("v")), v="(A+B)") == ["A", "B"] and value(spark, fields.step_members(F.col("v")), v="A") == ["A"]
    assert [value(spark, fields.number_text(F.col("v")), v=v) for v in (4.0, 0.5)] == ["4", "0.5"]
    assert [value(spark, fields.complexity_band(F.col("v")), v=v) for v in (5, 6, 15, 16)] == ["low", "medium", "medium", "high"]
    assert [value(spark, fields.csv_order(F.col("v")), v=v) for v in ("+7", "7", "x", "-7", "7a")] == [7, 7, 0, 0, 0]
    assert value(spark, fields.is_quarter(F.col("v")), v="Quarterly") and not value(spark, fields.is_quarter(F.col("v")), v="semster")
    assert [value(spark, fields.years_of(F.lit(n), F.lit(q))) for n, q in ((7, False), (8, False), (7, True))] == [4, 4, 3]


HEAD = "﻿Curriculum,Plan,,\nInsitution,\"A School\"\nDegree Type,BS\nSystem Type,semester\nCIP,11\n"
COLUMNS = "Course ID,Course Name,Prefix,Number,Prerequisites,Corequisites,Strict-Corequisites,Credit Hours,Institution,Canonical Name\n"
TEXTS = {
    "good": HEAD + "Courses,,\n" + COLUMNS + "1,One,CS,1,,,,3,,\r\n\n2,Two,CS,2,1;CS 1 (x);77,,,3d,,\n3,Three,CS,2,2,4;99,,1.5,,Canon\n4,Four,EE,,1,,,2,,\n4,Four,EE,9,1,,2,2,,\n1,Uno,CS,1,,,,4,,\n",
    "moved": HEAD + "my COURSES\nnumber,PREFIX,course id,Credit Hours\n10,MA,1,2\n,MA,2,2\n11,MA\n",
    "empty section": HEAD + "Courses\n\n" + COLUMNS + "1,One,CS,1,,,,3,,\n",
    "no name": HEAD.replace("Plan", "") + "Courses\n" + COLUMNS,
    "no school": HEAD.replace('"A School"', "") + "Courses\n" + COLUMNS,
    "no section": HEAD,
    "ends at marker": HEAD + "Courses",
    "cycle": HEAD + "Courses\n" + COLUMNS + "1,One,CS,1,,2,,3,,\n2,Two,CS,2,,1,,3,,\n",
    "blank": "",
}


@pytest.fixture(scope="module")
def batch(spark):
    return Batch(spark.createDataFrame(list(TEXTS.items()), "curriculum_id string, value string"))


def test_errors_are_rows(batch):
    assert {(r["curriculum_id"], r["stage"], r["message"]) for r in batch.errors.collect()} == {
        ("no name", "metadata", "no curriculum name"), ("no school", "metadata", "no institution"), ("no section", "sections", "no course section"), ("ends at marker", "sections", "no course section"),
        ("blank", "metadata", "no curriculum name"), ("blank", "metadata", "no institution"), ("blank", "sections", "no course section"), ("cycle", "metrics", "cycle"),
    }
    assert {r["curriculum_id"] for r in batch.plan.collect()} == {"good", "moved"}


def test_rows_and_keys(batch):
    rows = {(r["curriculum_id"], r["course_id"]): r for r in batch.courses.collect()}
    assert set(rows) == {("good", i) for i in "1234"} | {("moved", "1")}
    one = rows["good", "1"]
    assert (one["name"], one["credits"], one["course_key"], one["plan_pos"] < rows["good", "2"]["plan_pos"]) == ("Uno", 4.0, "CS1_1", True)
    assert (rows["good", "2"]["course_key"], rows["good", "3"]["course_key"], rows["good", "4"]["course_key"]) == ("CS2_2", "CS2_3", "EE9")
    assert rows["good", "2"]["credits"] == 0.0 and rows["good", "3"]["credits"] == 1.5 and rows["good", "3"]["canonical_name"] == "Canon" and one["canonical_name"] is None


def test_requisites_and_edges(batch):
    got = {(r["course_key"], r["kind"], r["required_key"]) for r in batch.required.filter("curriculum_id = 'good'").collect()}
    assert got == {("CS2_2", "prereq", "CS1_1"), ("CS2_2", "prereq", "CS1"), ("CS2_2", "prereq", "77"), ("CS2_3", "prereq", "CS2_2"), ("CS2_3", "coreq", "EE9"), ("EE9", "prereq", "CS1_1"), ("EE9", "strict", "CS2_2")}
    edges = {(r["src"], r["dst"], r["kind"]) for r in batch.all_edges.filter("curriculum_id = 'good'").collect()}
    assert edges == {("CS1_1", "CS2_2", "prereq"), ("CS2_2", "CS2_3", "prereq"), ("EE9", "CS2_3", "coreq"), ("CS1_1", "EE9", "prereq"), ("CS2_2", "EE9", "coreq")}
    missing = {r["required_key"] for r in keys.missing_requisites(batch.required, batch.all_courses).filter("curriculum_id = 'good'").collect()}
    assert missing == {"CS1", "77"}


def test_files_and_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "plan one.csv").write_text(TEXTS["moved"], encoding="utf-8")
    b = Batch.of_files(spark, str(tmp_path / "in"))
    report = b.reports().collect()
    assert [r["file_name"] for r in report] == ["plan one_report.md"] and "# Curriculum Report: Plan" in report[0]["body"] and "| 1 | MA10 -  | 2.0 |" in report[0]["body"]
    text = b.metric_files().collect()[0]["body"].split("\n")
    assert text[0] == "Curriculum,Plan" and text[-1].startswith('1,,"MA","10",') and text[-1].endswith(",1.0,0,1,0")
    b.write(str(tmp_path / "out"))
    b.write(str(tmp_path / "out"))  # a second run replaces the files
    assert sorted(os.listdir(tmp_path / "out")) == ["plan one_report.md", "plan one_w_metrics.csv"]
    assert (tmp_path / "out" / "plan one_report.md").read_bytes().decode() == report[0]["body"]
    assert (tmp_path / "out" / "plan one_w_metrics.csv").read_bytes().decode() == "\n".join(text)
    told = files.read_expected_totals(spark, str(tmp_path / "out" / "plan one_w_metrics.csv")).collect()[0]
    assert (told["total"], told["longest_delay"], told["highest_centrality"]) == (1.0, 1, 0)


def test_only_committed_attempts_leave_files(tmp_path):
    """A task that runs twice, or fails, leaves one file per name; names that are no file names are refused."""
    writer = named_files.NamedFilesWriter(str(tmp_path / "out"))
    rows = [Row(file_name="a.txt", body="one"), Row(file_name="b.txt", body=None)]
    lost, kept = writer.write(iter([Row(file_name="a.txt", body="half")])), writer.write(iter(rows))
    writer.commit([None, kept])
    assert lost.folder != kept.folder and sorted(os.listdir(tmp_path / "out")) == ["a.txt", "b.txt"]
    assert (tmp_path / "out" / "a.txt").read_text() == "one" and (tmp_path / "out" / "b.txt").read_bytes() == b""
    again = named_files.NamedFilesWriter(str(tmp_path / "out"))
    again.write(iter([Row(file_name="c.txt", body="x")]))
    again.abort([])
    assert sorted(os.listdir(tmp_path / "out")) == ["a.txt", "b.txt"]
    for name in ("", "..", "x/y"):
        with pytest.raises(ValueError):
            again.write(iter([Row(file_name=name, body="")]))


def test_a_file_that_is_not_utf8_is_an_error_row(spark, tmp_path):
    (tmp_path / "bad.csv").write_bytes(TEXTS["moved"].encode() + b"\xff\xfe")
    (tmp_path / "fine.csv").write_bytes(TEXTS["moved"].encode())
    b = Batch.of_files(spark, str(tmp_path))
    assert [tuple(r) for r in b.errors.collect()] == [("bad", "read", "not UTF-8")]
    assert {r["curriculum_id"] for r in b.plan.collect()} == {"fine"} and b.reports().count() == b.metric_files().count() == 1


def test_the_first_course_of_a_natural_key_is_the_first_in_the_plan(spark):
    rows = spark.createDataFrame([("g", "9", 1, "CS1", "CS1_9"), ("g", "10", 2, "CS1", "CS1_10")], "curriculum_id string, course_id string, plan_pos long, natural_key string, course_key string")
    assert [r["course_key"] for r in keys.first_by_natural_key(rows).collect()] == ["CS1_9"]
    required = spark.createDataFrame([("g", "CS1_10", "prereq", 1, "X")], "curriculum_id string, course_key string, kind string, ord long, required_key string")
    assert [r["message"] for r in keys.missing_requisites(required, rows).collect()] == ["Course 'CS1': missing prerequisite 'X'"]


def test_edges_as_json_and_critical_paths(batch):
    edges = {r["curriculum_id"]: json.loads(r["edges_json"]) for r in batch.edge_documents().collect()}
    assert edges["moved"] == [] and [(e["from"], e["to"], e["dashes"]) for e in edges["good"]] == [("CS1_1", "CS2_2", False), ("CS2_2", "CS2_3", False), ("CS1_1", "EE9", False), ("EE9", "CS2_3", True), ("CS2_2", "EE9", True)]
    paths = {r["curriculum_id"]: (r["length"], r["path"]) for r in batch.critical_paths.collect()}
    assert paths == {"good": (4, ["CS1_1", "CS2_2", "EE9", "CS2_3"]), "moved": (1, ["MA10"])}
    assert {r["curriculum_id"]: r["longest_delay"] for r in batch.summary.collect()} == {g: n for g, (n, _) in paths.items()}
    assert {(r["course_key"], r["required_key"]) for r in batch.warnings.collect()} == {("CS2_2", "CS1"), ("CS2_2", "77")}


def test_a_wrong_total_fails_a_curriculum(spark):
    schema = "curriculum_id string, course_id string, complexity double, delay long, blocking long, centrality long"
    expected = spark.createDataFrame([("a", "1", 1.0, 1, 0, 5), ("b", "1", 1.0, 1, 0, 5)], schema)
    totals = report.compare_totals(spark.createDataFrame([("a", 3.0), ("b", 4.0)], "curriculum_id string, total double"), spark.createDataFrame([("a", 3.0), ("b", 9.0)], "curriculum_id string, total double"))
    assert [tuple(r) for r in report.compare_summary(expected, report.compare_metrics(expected, expected), totals).collect()] == [(2, 1, 1)]


def test_files_of_one_stem_stay_apart(spark, tmp_path):
    for folder, text in (("a", TEXTS["moved"]), ("b", TEXTS["good"]), ("c", TEXTS["good"])):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / ("plan.csv" if folder < "c" else "other.csv")).write_text(text, encoding="utf-8")
    b = Batch.of_files(spark, [str(tmp_path / f) for f in "abc"])
    counts = {r["curriculum_id"]: r["count"] for r in b.plan.groupBy("curriculum_id").count().collect()}
    base = str(tmp_path).lstrip("/")
    assert counts == {f"{base}/a/plan": 1, f"{base}/b/plan": 4, "other": 4}
    assert b.errors.count() == 0 and b.reports().select("file_name").distinct().count() == 3


def test_expected_metrics_with_an_empty_last_field(spark, tmp_path):
    row = '1,"One, two",CS,1,,,,3,,,5.0,2,3.0,'
    (tmp_path / "m.csv").write_text("Courses\nheader\n" + row + "\n" + row + "7\nshort,row\n", encoding="utf-8")
    got = [(r["complexity"], r["blocking"], r["delay"], r["centrality"]) for r in files.read_expected_metrics(spark, str(tmp_path / "m.csv")).collect()]
    assert got == [(5.0, 2, 3, 0), (5.0, 2, 3, 7)]


def test_comparison_of_missing_and_null_metrics(spark):
    schema = "curriculum_id string, course_id string, complexity double, delay long, blocking long, centrality long"
    expected = spark.createDataFrame([("a", "1", 1.0, 1, 0, 5), ("a", "2", 1.0, 1, 0, 5), ("a", "3", 1.0, 1, 0, 5)], schema)
    found = spark.createDataFrame([("a", "1", 1.05, 1, 0, 5), ("a", "2", 1.0, 1, 0, None)], schema)
    assert {(r["course_id"], r["field"]) for r in report.compare_metrics(expected, found).collect()} == {("2", "centrality"), ("3", "missing")}
    totals = spark.createDataFrame([("a", 3.0), ("b", 4.0), ("c", 5.0)], "curriculum_id string, total double")
    got = report.compare_totals(totals, spark.createDataFrame([("a", 3.5), ("b", 4.6)], "curriculum_id string, total double"))
    assert {r["curriculum_id"] for r in got.collect()} == {"b", "c"}


def test_defaults_of_a_curriculum_without_a_degree(spark):
    rows = spark.createDataFrame([(1, "P", None, None, None, None, "S")], "curriculum_id long, name string, institution string, degree_type string, system_type string, cip_code string, school string")
    assert summary.with_defaults(rows).collect()[0][:6] == (1, "P", "S", "BS", "semester", "")


def test_no_texts(spark):
    b = Batch(spark.createDataFrame([], "curriculum_id string, value string"))
    assert b.plan.count() == 0 and b.errors.count() == 0 and b.reports().count() == 0
