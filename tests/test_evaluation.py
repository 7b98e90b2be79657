"""One evaluation run, recipes of training and test, several splits in one score."""

import pytest
from pyspark.sql import functions as F

from turnloom.operators import metrics
from turnloom.plans import workflows
from turnloom.settings import RECIPES, TEST_RECIPES, TRAIN_RECIPES, Settings
from turnloom.sources import commits

PROMPTS = "idx bigint, topic string, label string, prompt string"
RECORD = "idx bigint, GEN string, hit_scores string, beam_scores string"


def flat(spark, rows, cfg):
    """Answers of prompts in order, numbered as batches leave them."""
    size = cfg.eval_batch_size * cfg.num_beams
    out = [(at // size, at % size, text, -float(at % cfg.num_beams))
           for at, text in enumerate(t for beams in rows for t in beams)]
    return spark.createDataFrame(out, "batch bigint, place bigint, text string, score double").repartition(3)


def test_a_run_of_two_epochs(spark, tmp_path):
    cfg = Settings(prompt="DP2R_inspired", num_beams=2, eval_batch_size=3)
    prompts = spark.createDataFrame([(7 * i + 3, "t", f"word{i}", "p") for i in range(11)], PROMPTS)
    good, bad = [[[f"say word{i}", "x"] if i % k == 0 else ["no", "x"] for i in range(11)] for k in (1, 2)]
    path = str(tmp_path)
    for epoch, rows in ((1, bad), (2, good), (1, bad)):
        final = workflows.evaluate(flat(spark, rows, cfg), prompts, cfg, path, "run", epoch)
        assert final["hit_scores"].startswith("1.0000" if epoch == 2 else "0.5455")
    records = commits.read_committed(spark, f"{path}/records", RECORD)
    assert records.groupBy("epoch").count().orderBy("epoch").collect() == [(1, 11), (2, 11)]
    first = records.where("epoch = 1 and idx = 10").first()
    assert first["GEN"] == "no | x" and first["hit_scores"].startswith("0.5000|")
    assert first["beam_scores"] == "0.7311|0.2689"
    assert commits.next_row(spark, f"{path}/records", "run", 2) == 74


def test_without_write_the_first_rows_and_the_summary_stay(spark, tmp_path):
    cfg = Settings(prompt="DP2R_inspired", num_beams=1, eval_batch_size=8, write=False)
    prompts = spark.createDataFrame([(i, "t", "a", "p") for i in range(130)], PROMPTS)
    rows = [["a"]] * 100 + [["b"]] * 30
    final = workflows.evaluate(flat(spark, rows, cfg), prompts, cfg, str(tmp_path), "run")
    assert final["hit_scores"].startswith("0.7692")
    assert commits.read_committed(spark, f"{tmp_path}/records", RECORD).count() == 100


def test_a_missing_beam_raises(spark):
    rows = spark.createDataFrame([(0, 0, "a", 0.0), (0, 1, "b", 0.0), (0, 2, "c", 0.0)],
                                 "batch bigint, place bigint, text string, score double")
    with pytest.raises(Exception, match="not all beams of row 1"):
        metrics.batched_beams(rows, 4, 2).collect()


def test_recipes_of_training_and_test():
    assert not TRAIN_RECIPES["inspired_passage"].force_gpt and TEST_RECIPES["inspired_passage"].force_gpt
    assert (TRAIN_RECIPES["durec_item"].topic_conf, TEST_RECIPES["durec_item"].topic_conf) == (1.0, 0.7)
    assert (TRAIN_RECIPES["durec_passage"].n_sampled_positive, TEST_RECIPES["durec_passage"].n_sampled_positive) == (3, 4)
    assert TRAIN_RECIPES.keys() == TEST_RECIPES.keys() == RECIPES.keys()


def test_splits_that_both_count_from_zero_score_together(spark):
    samples = spark.createDataFrame(
        [(i, s, f"{s}{i}") for s in ("train", "test") for i in range(4)], "idx bigint, split string, topic string")
    samples = samples.withColumns({"label": F.col("topic"), "response": F.col("topic"),
                                   "target_knowledge": F.concat("topic", F.lit("-p1"))})
    gen = samples.where("split = 'test' or idx < 2").select(
        "idx", "split", F.array(F.concat(F.lit("Therefore topic is "), "topic")).alias("beams"))
    exact = workflows.score(gen, samples, None, Settings(prompt="UDGIP2I_cot"), by=["split"])
    assert {r["split"]: r["hit1"] for r in exact.collect()} == {"train": 1.0, "test": 1.0}
    found = workflows.score(gen, samples, None, Settings(prompt="DIP2I_cot", inspired=True), by=["split"])
    assert {r["split"]: r["hit1"] for r in found.collect()} == {"train": 0.5, "test": 1.0}
    know = samples.select("idx", "split", F.array(F.array(
        F.concat("topic", F.lit("-p0")), F.concat("topic", F.lit("-p1")))).alias("predicted_know"))
    picked = gen.withColumn("beams", F.array(F.lit("Passage 2. x")))
    hits = workflows.score(picked, samples, know, Settings(prompt="DIP2P"), by=["split"])
    assert {r["split"]: r["hit1"] for r in hits.collect()} == {"train": 0.5, "test": 1.0}
