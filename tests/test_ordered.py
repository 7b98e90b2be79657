"""Running means over arriving answers: restarts, repeated batches, late and repeated answers."""

import pytest
from pyspark.sql import functions as F

from turnloom.operators import metrics
from turnloom.sources import readers
from turnloom.streaming import ordered

ANSWERS = "idx bigint, task string, beams array<string>, sequence_scores array<double>"


def answers(spark, ids, beam=None):
    return spark.createDataFrame([(i, "R", [beam or f"word{i % 3} x"], [0.0]) for i in ids], ANSWERS)


@pytest.fixture()
def samples(spark):
    rows = [(i, f"word{i % 2}", "word1", "train" if i % 4 else "test") for i in range(60)]
    return spark.createDataFrame(rows, "idx bigint, label string, topic string, part string")


def stream(spark, path):
    return readers.stream_generations(spark, path, files_per_trigger=1000)


def rows_of(df):
    return sorted((r["idx"], r["cnt"], *[round(r[f"run_{m}"], 9) for m in metrics.METRICS]) for r in df.collect())


def test_four_triggers_one_of_them_repeated(spark, samples, tmp_path, monkeypatch):
    path, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    mark = ordered._mark
    for quarter in range(4):
        answers(spark, range(15 * quarter, 15 * quarter + 15)).coalesce(1).write.mode("append").parquet(path)
        if quarter == 2:  # everything is written, but the mark: the batch comes again after the restart
            def broken(*_):
                raise RuntimeError("driver lost")

            monkeypatch.setattr(ordered, "_mark", broken)
            with pytest.raises(Exception, match="driver lost"):
                ordered.run_ordered(stream(spark, path), samples, out, check, parts=3)
            assert ordered.finished(spark, out, "rows").count() == 30
            monkeypatch.setattr(ordered, "_mark", mark)
        ordered.run_ordered(stream(spark, path), samples, out, check, parts=3)
    whole = metrics.running_metrics(answers(spark, range(60)).join(samples, "idx"))
    got = ordered.finished(spark, out, "rows")
    assert rows_of(got) == rows_of(whole)
    assert got.select("batch").distinct().count() == 4
    last = ordered.totals(spark, out).first()
    assert last["cnt"] == 60 and last["hit1"] == pytest.approx(whole.where("idx = 59").first()["run_hit1"])


def test_late_and_repeated_answers_are_kept_apart(spark, samples, tmp_path):
    out = str(tmp_path / "out")
    ordered.ordered_batch(answers(spark, [0, 1, 2, 5, 5]), 0, samples, out, parts=2)
    before = rows_of(ordered.finished(spark, out, "rows"))
    second = answers(spark, [1, 3, 7, 7, 7, 8])
    for _ in range(2):  # the same batch twice changes nothing
        ordered.ordered_batch(second, 1, samples, out, parts=2)
        rows = ordered.finished(spark, out, "rows")
        assert rows_of(rows.where("batch = 0")) == before
        assert [r[:2] for r in rows_of(rows)] == [(0, 1), (1, 2), (2, 3), (5, 4), (7, 5), (8, 6)]
        apart = sorted((r["batch"], r["idx"], r["reason"], r["answers"])
                       for r in ordered.finished(spark, out, "apart").collect())
        assert apart == [(0, 5, "repeated", 1), (1, 1, "repeated", 1), (1, 3, "late", 1), (1, 7, "repeated", 2)]
    with pytest.raises(ValueError, match="never finished"):
        ordered.ordered_batch(second, 5, samples, out)


def test_groups_have_their_own_means(spark, samples, tmp_path):
    out = str(tmp_path / "out")
    for batch_id, ids in enumerate((range(20), range(20, 30), [])):
        ordered.ordered_batch(answers(spark, ids), batch_id, samples, out, per=["part"], parts=3)
    whole = metrics.running_metrics(answers(spark, range(30)).join(samples, "idx"), per=["part"])
    assert rows_of(ordered.finished(spark, out, "rows")) == rows_of(whole)
    counts = {r["part"]: r["cnt"] for r in ordered.totals(spark, out, ["part"]).collect()}
    assert counts == {"test": 8, "train": 22}


def test_an_equal_answer_counts_once_whatever_its_order(spark, samples, tmp_path):
    both = answers(spark, [4], "word0").unionByName(answers(spark, [4], "other"))
    results = set()
    for n, df in enumerate((both, both.orderBy(F.col("beams").desc()))):
        ordered.ordered_batch(df, 0, samples, str(tmp_path / str(n)))
        results.add(tuple(rows_of(ordered.finished(spark, str(tmp_path / str(n)), "rows"))))
    assert len(results) == 1
