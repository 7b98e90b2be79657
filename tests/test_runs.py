"""Epochs, copies, batches, whole numbers and unfinished stream batches."""

import pytest
from pyspark.sql import functions as F

from turnloom.operators import candidates, metrics, prepare
from turnloom.plans import workflows
from turnloom.streaming import running

ANSWERS = "epoch int, idx bigint, beams array<string>, label string, topic string"


def test_running_means_per_epoch(spark):
    rows = [(e, i, ["a b" if e else "x"], "a b", "a") for e in (0, 1) for i in range(30)]
    df = spark.createDataFrame(rows, ANSWERS)
    out = metrics.running_metrics(df, block=4, per=["epoch"]).collect()
    assert len(out) == 60
    assert all(r.cnt == r.idx + 1 and r.run_hit1 == r.epoch for r in out)
    final = {r.epoch: r.hitgen for r in metrics.summary(df, per=["epoch"]).collect()}
    assert final == {0: "0.0000", 1: "1.0000"}


def test_repeated_answers_raise(spark):
    df = spark.createDataFrame([(0, 1, ["a"], "a", "a"), (1, 1, ["a"], "a", "a")], ANSWERS)
    assert metrics.running_metrics(df, per=["epoch"]).count() == 2
    with pytest.raises(Exception, match="not unique"):
        metrics.running_metrics(df).collect()


def test_whole_passage_numbers(one):
    base = F.array(*[F.lit(f"p{i}") for i in range(1, 14)])
    gen = F.lit("Passage 12. Passage 0, Passage 99 and Passage 99999999999, Passage 2")
    assert one(candidates.passage_picks(gen, base), "x string", "") == ["p12", "p13", "p2"]
    assert one(candidates.passage_picks(gen, base, strict=True), "x string", "") == ["p1", "p13", "p9", "p9", "p2"]


@pytest.mark.parametrize("partitions", [1, 200])
def test_copies_stay_in_one_part(spark, partitions):
    rows = spark.range(40).select(F.col("id").alias("idx"), F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    out = prepare.train_val_split(rows.repartition(partitions), 3).collect()
    val = sorted((r.idx, r["copy"]) for r in out if r.part == "val")
    assert len(out) == 80 and len(val) == 6 and len({i for i, _ in val}) == 3
    alone = prepare.train_val_split(spark.range(40).withColumnRenamed("id", "idx"), 3)
    assert {r.idx for r in alone.where("part = 'val'").collect()} == {i for i, _ in val}
    order = [r.idx for r in prepare.shuffle_rows(rows, 7).collect()]
    assert sum(a == b for a, b in zip(order, order[1:])) < 10


def test_dense_batches(spark):
    rows = spark.createDataFrame(
        [(i, list(range(i % 13 + 1))) for i in range(0, 1000, 37)], "idx bigint, input_ids array<int>")
    rows = rows.withColumn("labels", F.col("input_ids"))
    out = workflows.training_batches(prepare.shuffle_rows(rows, 1), 4, F.lit(-5)).collect()
    sizes = {}
    for r in out:
        sizes.setdefault(r.batch, []).append((len(r.input_ids), len(r.labels), len(r.attention_mask)))
        gap = r.attention_mask.count(0)
        assert r.labels[:gap] == [-100] * gap and r.labels[gap:] == r.input_ids[gap:]
    assert sorted(sizes) == list(range(7)) and all(len(sizes[b]) == 4 for b in range(6))
    assert all(len({n for row in rows for n in row}) == 1 for rows in sizes.values())


def test_unfinished_batch_is_not_used(spark, tmp_path):
    out = str(tmp_path)
    spark.range(3).write.parquet(f"{out}/state/batch=0")
    spark.createDataFrame([(0,)], "batch bigint").write.parquet(f"{out}/done/0")
    spark.range(9).write.parquet(f"{out}/state/batch=1")
    assert running.latest(spark, out).count() == 3
