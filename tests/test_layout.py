"""Where the queries' tables lie: joins inside curricula move no rows, and what a table was made of doesn't stay on the disk."""

from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from syllagraph.operators import schedule
from syllagraph.plans import frames as plans
from syllagraph.plans.frames import Frames
from syllagraph.plans.queries import BUILDS
from syllagraph.storage import FREE, lean


@pytest.fixture(scope="module")
def frames(spark, sf_dir):
    return Frames(spark, sf_dir)


@pytest.mark.parametrize("name", ["mermaid_terms", "report_header", "report_markdown", "export_text", "report_terms", "export_rows", "mermaid_dag", "term_totals", "coreq_group_priority", "course_chains", "plan_edges"])
def test_joins_inside_curricula_stay_in_place(spark, frames, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = BUILDS[name](frames)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Bucketed: true" in plan and "Exchange" not in plan


def test_edges_of_a_plan_need_no_schedule(spark, sf_dir):
    f = Frames(spark, sf_dir)
    n = BUILDS["plan_edges"](f).count()
    assert "schedule" not in f.__dict__ and "plan" not in f.__dict__
    assert n == f.key_edges.join(f.schedule.select("curriculum_id", F.col("course_key").alias("src")), ["curriculum_id", "src"]).count()


def test_a_table_leaves_no_shuffle_files(spark):
    local = [Path(str(d)) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {p for d in local for p in d.rglob("shuffle_*")}
    before, conf = shuffled(), spark.conf.get(FREE, None)
    rows = lean(spark.range(1000).groupBy((F.col("id") % 7).alias("g")).count(), "sums")
    assert rows.count() == 7 and spark.conf.get(FREE, None) == conf
    assert not {p for p in shuffled() - before if p.suffix == ".data" and p.stat().st_size > 2000}


def test_large_curricula_lie_apart(spark, sf_dir, frames, monkeypatch):
    """Where a curriculum is too large for one bucket and for a row, the results are the same."""
    names = ("course_metrics", "schedule_violations", "course_chains")
    near = [sorted(map(str, BUILDS[n](frames).collect())) for n in names]
    monkeypatch.setattr(plans, "WHOLE", 0)
    monkeypatch.setattr(plans.local, "SMALL", 30)
    f = Frames(spark, sf_dir)
    assert not f.whole and not f.small
    assert [sorted(map(str, BUILDS[n](f).collect())) for n in names] == near


def test_placing_reads_flat_columns():
    """A sliced column, lists without needs and a curriculum without groups."""
    course = pa.struct([("course_key", pa.string()), ("credits", pa.float64())])
    kind = pa.list_(pa.struct([("group_key", pa.string()), ("priority", pa.int64()), ("members", pa.list_(course)), ("filler", pa.bool_()), ("light", pa.bool_()), ("needs", pa.list_(pa.string()))]))
    group = lambda k, own, needs: {"group_key": k, "priority": 3, "members": [{"course_key": c, "credits": 2.5} for c in own], "filler": not needs, "light": False, "needs": needs}
    rows = [[group("x", ["x"], [])], [group("a", ["a", "b"], []), group("c", ["c"], ["a"])], [], [group("d", ["d"], [])]]
    assert list(schedule.group_lists(pa.array(rows, kind))) == rows
    assert list(schedule.group_lists(pa.array(rows, kind).slice(1))) == rows[1:]
