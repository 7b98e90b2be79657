"""The record sink: reruns replace, unpublished folders are invisible."""

import pytest

from turnloom.operators.positions import resume_from
from turnloom.sources import commits, sinks

SCHEMA = "idx bigint, GEN string"


def records(spark, n, text):
    return spark.range(n).selectExpr("id as idx", f"'{text}' as GEN")


def test_a_rerun_gives_rows_once(spark, tmp_path):
    path = str(tmp_path / "sink")
    assert commits.read_committed(spark, path, SCHEMA).count() == 0
    for text in ("first", "second"):
        commits.write_committed(records(spark, 5, text), path, "run-1", 0)
    commits.write_committed(records(spark, 3, "other"), path, "run-1", 1)
    commits.write_committed(records(spark, 2, "x"), path, "run-2", 0)
    rows = commits.read_committed(spark, path, SCHEMA)
    assert {(r["run"], r["epoch"], r["GEN"]): r["count"] for r in
            rows.groupBy("run", "epoch", "GEN").count().collect()} == {
        ("run-1", 0, "second"): 5, ("run-1", 1, "other"): 3, ("run-2", 0, "x"): 2}
    assert commits.read_committed(spark, path, SCHEMA, run="run-2").count() == 2


def test_a_run_that_stops_early_leaves_nothing_visible(spark, tmp_path):
    path = str(tmp_path / "sink")
    commits.write_committed(records(spark, 4, "kept"), path, "run", 0)
    staged = commits.stage(records(spark, 9, "lost"), path, "run", 0)
    assert {r["GEN"] for r in commits.read_committed(spark, path, SCHEMA).collect()} == {"kept"}
    assert commits.vacuum(spark, path) == 1
    with pytest.raises(ValueError, match="nothing staged"):
        commits.publish(spark, path, "run", 0, staged)
    assert commits.read_committed(spark, path, SCHEMA).count() == 4


def test_a_run_goes_on_from_its_records(spark, tmp_path):
    path = str(tmp_path / "sink")
    assert commits.next_row(spark, path, "run") == 0
    commits.write_committed(records(spark, 4, "a"), path, "run", 0)
    at = commits.next_row(spark, path, "run")
    assert at == 4 and resume_from(records(spark, 6, "b"), at).count() == 2
    commits.write_committed(records(spark, 0, "a"), path, "empty", 0)
    assert commits.next_row(spark, path, "empty") == 0


def test_names_that_would_leave_the_folder_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="named by"):
        commits.stage(records(spark, 1, "a"), str(tmp_path), "../x")


def test_scratch_tables_can_be_removed(spark):
    first, second = [sinks.written(spark.range(n), "scratch") for n in (3, 4)]
    sinks.discard(first)
    assert second.count() == 4 and sinks.exists(spark, second.inputFiles()[0].rpartition("/")[0])
    with pytest.raises(Exception, match="(?i)not.*exist|not found"):
        first.count()
