"""Joins, gates and the six recipes end to end."""

import re

import pytest
from pyspark.sql import functions as F

from turnloom.functions.tokens import Tokenizer
from turnloom.operators import joins, labels, positions, prepare, render
from turnloom.plans import workflows
from turnloom.settings import RECIPES, Settings


def test_merge_is_a_left_join(spark):
    samples = spark.createDataFrame([(0,), (1,), (2,)], "idx bigint")
    know = spark.createDataFrame([(0, [["a"]]), (1, [[]]), (7, [["x"]])], "idx bigint, predicted_know array<array<string>>")
    on = {r.idx: (r.predicted_know, r.combined) for r in joins.merge_knowledge(samples, know, True).collect()}
    assert on == {0: ([["a"]], True), 1: ([[]], True), 2: (None, True)}
    off = {r.idx: r.predicted_know for r in joins.merge_knowledge(samples, know, disable_know=True).collect()}
    assert off == {0: [[]], 1: [[]], 2: None}
    assert [r.idx for r in joins.unmatched_knowledge(samples, know).collect()] == [7]


def test_splits_that_both_count_from_zero(spark):
    """Passages, the dictionary lookup and answers meet the rows of their own split."""
    rows = [(0, "train", ["x", "a"], [["t0x"], ["t0a"]]), (0, "test", ["a", "x"], [["e0a"], ["e0x"]]),
            (1, "test", ["x"], [["e1x"]])]
    samples = spark.createDataFrame([r[:3] for r in rows], "idx bigint, split string, predicted_topic array<string>")
    know = spark.createDataFrame(
        [(r[0], r[1], r[3]) for r in rows], "idx bigint, split string, predicted_know array<array<string>>")
    keys = joins.row_keys(samples, know)
    assert keys == ["idx", "split"] and joins.row_keys(samples, know.drop("split")) == ["idx"]
    merged = joins.merge_knowledge(samples, know)
    assert {(r.idx, r.split): r.predicted_know for r in merged.collect()} == {r[:2]: r[3] for r in rows}
    checked = joins.db_check(merged, spark.createDataFrame([("a",)], "topic string"), keys)
    assert {(r.idx, r.split): r.predicted_know for r in checked.collect()} == {
        (0, "train"): [["t0a"]], (0, "test"): [["e0a"]], (1, "test"): [["e1x"]]}
    assert joins.unmatched_knowledge(samples.where("split = 'test'"), know).select("split").collect()[0][0] == "train"
    answers = samples.select("idx", "split", F.lit("g").alias("g"))
    assert joins.eval_join(answers, samples, know).count() == 3


def test_db_check(spark):
    topics = spark.createDataFrame([("A\xa0b",), ("C",)], "topic string")
    rows = [
        (0, [" A b ", "x", "C", "C", "c"], [.5, .2, .1, .05, .01], [["1"], ["2"], ["3"], ["4"], ["5"]]),
        (1, ["x", "y"], [.5, .2], [["1"], ["2"]]), (2, ["x", "C"], [.5, .2], [["1"]]),
        (3, [" C", "C"], [.5, .2], [["1"], ["2"]]),
    ]
    df = spark.createDataFrame(rows, "idx bigint, predicted_topic array<string>, "
                               "predicted_topic_confidence array<double>, predicted_know array<array<string>>")
    out = {r.idx: tuple(r)[1:] for r in joins.db_check(df, topics).collect()}
    assert out[0] == ([" A b ", "C"], [.5, .1], [["1"], ["3"]])
    assert out[1] == (["x"], [.5], [["1"]])
    assert out[2] == (["x"], [.5], [["1"]])          # the list of passages is shorter
    assert out[3] == ([" C", "C"], [.5, .2], [["1"], ["2"]])


def test_hot_topic_is_spread(spark):
    """A third of all rows asks for one topic: its rows get many join keys."""
    rows = spark.range(3000).select(
        F.col("id").alias("idx"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("predicted_topic"))
    topics = spark.createDataFrame([("hot",), ("t4",)], "topic string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = joins.topic_semi(rows, topics)
        assert kept.count() == 1001
        assert "SortMergeJoin" in kept._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


GATE = "idx int, topic string, predicted_topic array<string>, gpt_selection string, topic_cot string"


def test_gates(spark):
    df = spark.createDataFrame([
        (0, "A", ["a", "b"], "s", "x Therefore, A"), (1, "A", ["b", "a"], "", "x"),
        (2, "Z", ["a", "b"], "s", "z"), (3, "Z", ["a"], "", "Therefore"), (4, "A\xa0", ["A"], "s", "Therefore b")], GATE)
    ids = lambda out: {r.idx for r in out.collect()}
    assert ids(prepare.gate_topic_hit(df, 1)) == {0, 4}
    assert ids(prepare.gate_topic_hit(df, 2)) == {0, 1, 4}
    assert ids(prepare.gate_topic_hit(df, 2, inspired=True)) == set()
    cfg = Settings(prompt="DIP2P", topk_topic=2, positive="gpt_selection")
    assert ids(prepare.gate_train(df, cfg)) == {0, 4}
    assert ids(prepare.gate_train(df, cfg.with_(force_gpt=True))) == {0, 1, 4}
    assert ids(prepare.gate_train(df, cfg.with_(force_topic=True))) == {0, 2, 4}
    assert ids(prepare.gate_train(df, cfg.with_(force_topic=True, force_gpt=True))) == {0, 1, 2, 3, 4}
    cot = cfg.with_(prompt="UDGIP2I_cot")
    assert ids(prepare.gate_train(df, cot)) == {0}
    assert ids(prepare.gate_train(df, cot.with_(force_topic=True))) == {0, 2}


def test_split_sizes(spark):
    df = spark.range(1000).withColumnRenamed("id", "idx")
    part = lambda size: {r.part: r["count"] for r in prepare.train_val_split(df, size).groupBy("part").count().collect()}
    assert part(0) == {"train": 1000}
    assert part(100) == {"train": 900, "val": 100}
    assert 150 < part(0.2)["val"] < 250


def test_shuffle_rows(spark):
    df = spark.range(200).withColumnRenamed("id", "idx")
    order = lambda d, seed: [r.idx for r in prepare.shuffle_rows(d, seed).collect()]
    assert order(df, 1) == order(df.repartition(13), 1) != sorted(order(df, 1))
    assert order(df, 1) != order(df, 2) and sorted(order(df, 2)) == list(range(200))


@pytest.mark.parametrize("name", list(RECIPES))
def test_recipe(spark, tables, name):
    cfg = RECIPES[name]
    samples, know = tables.samples(), tables.knowledge()
    test = samples.where("split = 'test'")
    prompts = workflows.prompt_table(test, know, cfg).collect()
    assert len(prompts) == test.count()
    assert all(p.prompt.endswith("### Response:") and "  \n\n### " not in p.prompt for p in prompts)
    train = workflows.training_table(
        samples.where("split = 'train'"), know, cfg.with_(train_only_outputs=True)).collect()
    assert train
    for row in train:
        assert row.example.startswith(row.prompt[:200]) and row.output == row.label
        assert len(row.input_ids) == len(row.labels) == len(row.attention_mask)
        shown = [int(x) for x in re.findall(r"^Passage (\d+)\. ", row.passages_text, re.M)]
        if not cfg.combined:
            assert shown[:len(row.passages)] == list(range(1, len(row.passages) + 1))
        if cfg.task == "P" and row.passage_label:
            assert all(line in row.passages_text for line in row.passage_label.split("\nPassage "))
        if cfg.task == "I":
            assert len(row.topics) <= cfg.topk_topic and row.topic in row.label_text
    scores = workflows.score(tables.generations(cfg.task), samples, know, cfg, by=["split"]).collect()
    assert len(scores) == 2
    for row in scores:
        values = [v for k, v in row.asDict().items() if k != "split"]
        assert all(0 <= v <= 1 for v in values)
        if cfg.task == "P":
            assert values == sorted(values)


def test_same_table_under_any_partitioning(spark, tables):
    cfg = RECIPES["inspired_item"].with_(topic_num_shuffle=True, seed=9, train_only_outputs=True)
    def run(parts):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            samples = spark.createDataFrame(tables.samples().collect(), tables.samples().schema).repartition(parts)
            know = spark.createDataFrame(tables.knowledge().collect(), tables.knowledge().schema).repartition(parts)
            out = workflows.training_table(samples, know, cfg).select("idx", "example", "labels")
            return [tuple(map(str, r)) for r in out.collect()]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert run(1) == run(23)


def test_epochs_draw_anew(tables):
    cfg = RECIPES["durec_item"]
    texts = lambda e: {r.idx: r.example for r in labels.train_texts(
        prepare.prepare(tables.samples(), tables.knowledge(), cfg), cfg.with_(epoch=e)).select("idx", "example").collect()}
    assert texts(0) == texts(0) != texts(1)


def test_unused_lists_change_nothing(tables):
    """Leaving out the passage lists no prompt can use gives the same prompts and examples."""
    samples, know = tables.samples(), tables.knowledge()
    for cfg in (RECIPES["durec_item"], RECIPES["durec_passage"], RECIPES["inspired_response"]):
        whole = joins.merge_knowledge(
            prepare.clean_samples(samples, cfg), prepare.cut_knowledge(know, cfg.passage_cutoff), cfg.combined)
        short = prepare.prepare(samples, know, cfg)
        assert short.selectExpr("max(size(predicted_know)) AS n").first().n == cfg.lists_needed
        for build in (render.build_prompts, labels.train_texts):
            texts = [{r.idx: r.prompt for r in build(rows, cfg).select("idx", "prompt").collect()}
                     for rows in (whole, short)]
            assert texts[0] == texts[1]


def test_merge_doubles_the_rows(tables):
    cfg = Settings(prompt="DP2R_inspired", positive="target", merge=True, force_topic=True)
    out = workflows.training_table(tables.samples(), tables.knowledge(), cfg)
    counts = {r["copy"]: r["count"] for r in out.groupBy("copy").count().collect()}
    assert counts[0] == counts[1] == tables.samples().count()
    bare = out.where("copy = 1").select("passages", "positives").collect()
    assert all(r.passages == r.positives[:3] for r in bare)


def test_other_flags_run(tables):
    samples, know = tables.samples(), tables.knowledge()
    for changes in (
        {"db_check": True, "combined": True, "topk_topic": 3}, {"disable_know": True}, {"debug": True},
        {"test_continue": 5}, {"filtering": True, "strict_compat": True, "combined": True, "topk_topic": 2},
        {"combined": True, "random_passages": True, "topk_topic": 2}, {"redial": True}, {"all_passages": True},
        {"combined_top1": True, "combined": True, "topk_topic": 2}, {"target": True}, {"val_set_size": 3},
    ):
        cfg = Settings(prompt="DIP2I", positive="target", force_topic=True, **changes)
        n = samples.count()
        want = 2 * min(n, 50) if cfg.debug else n - cfg.test_continue
        topics = joins.topic_list(samples) if cfg.db_check else None
        assert workflows.prompt_table(samples, know, cfg, topics).count() == want
        assert workflows.training_table(samples, know, cfg, topics).count() > 0
        if cfg.db_check:
            with pytest.raises(ValueError, match="topics"):
                workflows.prompt_table(samples, know, cfg)


def test_subword_hook(tables):
    vocab = Tokenizer(encode=lambda s: [ord(c) for c in s], decode=lambda i: "".join(map(chr, i)), eos_id=3)
    cfg = Settings(prompt="DIP2P", positive="target", force_topic=True, train_only_outputs=True,
                   cutoff=40, passage_cutoff=10)
    out = workflows.training_table(tables.samples(), tables.knowledge(), cfg, tok=vocab).first()
    assert out.input_ids[-1] == 3 and out.labels[0] == -100
    assert len(out.dialog) <= 40 and all(len(p) <= 10 for p in out.passages)
    assert out.labels.count(-100) == len(out.prompt)


def test_scored_table(tables):
    cfg = RECIPES["durec_response"]
    prompts = workflows.prompt_table(tables.samples(), tables.knowledge(), cfg)
    rows = workflows.scored_table(tables.generations("R"), prompts)
    assert rows.count() == prompts.count()


def test_resume_reaches_the_scan(tables):
    plan = positions.resume_from(tables.samples(), 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(idx,5)" in plan
