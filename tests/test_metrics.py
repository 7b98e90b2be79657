"""Scores against plain Python on small rows."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from turnloom.functions.ngrams import bleu_sample, bleu_scores, clipped_matches
from turnloom.functions.numbers import beam_softmax, fixed4, format_scores
from turnloom.operators import metrics, positions


def bleu(pred, ref, k):
    p, r = pred.split(), ref.split()
    if not p:
        return 0.0
    grams = lambda t: Counter(tuple(t[i:i + k]) for i in range(len(t) - k + 1))
    match = sum((grams(p) & grams(r)).values())
    penalty = 1.0 if len(p) > len(r) else math.exp(1 - len(r) / len(p))
    return penalty * match / max(1, len(p) - k + 1)


def test_bleu_against_counting(spark):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice("abcde#") for _ in range(rng.randint(0, 12)))
    rows = [(i, text(), text()) for i in range(150)] + [(150, "a b", "a b"), (151, "a #1 a", "a a #1"),
                                                        (152, "", ""), (153, "x", "")]
    df = spark.createDataFrame(rows, "id int, p string, r string")
    out = df.select("p", "r", bleu_scores("p", "r").alias("b"), bleu_sample("p", "r", 2).alias("two")).collect()
    for row in out:
        assert row.b == pytest.approx([bleu(row.p, row.r, k) for k in (1, 2, 3, 4)], abs=1e-12)
        assert row.two == pytest.approx(row.b[1])
        assert all(0 <= x <= 1 for x in row.b)


def test_clipped_matches(one):
    assert one(clipped_matches("x", "array('a', 'a', 'b')"), "x array<string>", ["a"] * 5 + ["b", "c"]) == 3


def test_fixed4_is_c_formatting(spark):
    rng = random.Random(2)
    values = [k / 32 for k in range(33)] + [k / n for n in (3, 7, 20000, 64, 100000) for k in range(0, n, max(1, n // 200))]
    values += [rng.random() for _ in range(500)] + [rng.random() * 10 ** -rng.randint(1, 9) for _ in range(500)]
    values += [0.00005, 0.00015, 0.00025, 0.99995, 0.999949999, 1.0, 0.0, 2.0 ** -60]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for row in df.select("x", fixed4("x").alias("t")).collect():
        assert row.t == "%.4f" % row.x, row.x


def test_format_scores(one):
    assert one(format_scores("x"), "x array<double>", [0.5, 1 / 32]) == "0.5000|0.0312"
    assert one(format_scores("x", "\t"), "x array<double>", []) == ""


def test_softmax(one):
    out = one(beam_softmax("x"), "x array<double>", [-0.5, -1.0, -1000.0])
    assert sum(out) == pytest.approx(1) and out[0] / out[1] == pytest.approx(math.exp(0.5))
    assert one(beam_softmax("x"), "x array<double>", [-3.0]) == [0.0]


ANSWERS = [
    # idx, beams, label, topic
    (0, ["I say Foo", "bar"], "foo ", "FOO"), (1, ["nothing", "x", "Foo"], "foo", "z"),
    (2, ["a"], "", "b"), (3, ["b| c"], "b| c", "c"), (4, ["b", "c"], "b| c", "q"),
]
SCHEMA = "idx bigint, beams array<string>, label string, topic string"


def test_hits(spark):
    df = spark.createDataFrame(ANSWERS, SCHEMA)
    out = metrics.hit_at_k(df).first()
    assert [out[f"hit{k}"] for k in range(1, 6)] == pytest.approx([3 / 5, 4 / 5, 1, 1, 1])
    assert metrics.hitgen(df).first().hitgen == pytest.approx(2 / 5)
    assert metrics.row_count(df).first().cnt == 5


def test_running_metrics_and_blocks(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice(["a b", "b c d", "a"])], rng.choice(["a b", "c d"]), "a") for i in range(57)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    whole = {r.idx: r for r in metrics.running_metrics(df).collect()}
    small = {r.idx: r for r in metrics.running_metrics(df, block=3).collect()}
    hits = bleus = 0.0
    for i, beams, label, topic in rows:
        hits += label in beams[0]
        bleus += bleu(beams[0], label, 2)
        for got in (whole[i], small[i]):
            assert got.cnt == i + 1
            assert got.run_hit1 == pytest.approx(hits / (i + 1))
            assert got.run_bleu2 == pytest.approx(bleus / (i + 1))
    final = metrics.bleu_corpus(df).first()
    assert small[56].run_bleu2 == pytest.approx(final.bleu2)


def test_substring_flags(spark):
    df = spark.createDataFrame([(" gen ", "Gen", "a gen b"), ("x", "", "y")], "b string, label string, prompt string")
    out = metrics.substring_flags(df.withColumn("beams", F.array("b"))).collect()
    assert (out[0].contain, out[0].llama_hit, out[0].espresso_hit) == (True, False, False)
    assert (out[1].contain, out[1].llama_hit, out[1].espresso_hit) == (False, True, True)


def test_item_hits(spark):
    gen = spark.createDataFrame([
        (0, ['so. Therefore, "A"', "x"], 1), (1, ["A. Therefore, B"], 1), (2, ["topic is Topic 12. a  b"], 1),
        (3, ["the topic is A", "B"], 1), (4, ["A"], 1)], "idx bigint, beams array<string>, epoch int")
    samples = spark.createDataFrame(
        [(0, "A", "A"), (1, "A", "A"), (2, "A\xa0b", "A b"), (3, "a", "a"), (4, "Q&A", "Q&A"), (5, "A", "A")],
        "idx bigint, topic string, label string")
    assert metrics.item_hit_inspired(gen, samples).first().hit1 == pytest.approx(1 / 6)
    # rows 0 to 3 have a topic to recommend; 2 and 3 name it exactly
    assert metrics.item_hit_exact(gen, samples).first().hit1 == pytest.approx(2 / 4)
    both = gen.union(gen.withColumn("epoch", F.lit(2)).where("idx > 0"))
    out = {r.epoch: r.hit1 for r in metrics.item_hit_inspired(both, samples, per=["epoch"]).collect()}
    assert out == {1: pytest.approx(1 / 6), 2: 0.0}


def test_passage_hits_divide_by_all_samples(spark):
    gen = spark.createDataFrame([(0, ["Passage 2. x"]), (1, ["none"])], "idx bigint, beams array<string>")
    samples = spark.createDataFrame([(0, "b", "u"), (1, "b", "u"), (2, "b", "v")],
                                    "idx bigint, target_knowledge string, split string")
    know = spark.createDataFrame([(i, [["", "a", "b", "c", "d", "e"]]) for i in range(3)],
                                 "idx bigint, predicted_know array<array<string>>")
    out = metrics.passage_hit_at_k(gen, samples, know).first()
    assert [out.hit1, out.hit2, out.hit4] == pytest.approx([1 / 3, 2 / 3, 2 / 3])
    by = {r.split: r.hit2 for r in metrics.passage_hit_at_k(gen, samples, know, by=["split"]).collect()}
    assert by == {"u": 1.0, "v": 0.0}
    table = {r.idx: r.predicted_know for r in metrics.rerank_table(gen, samples, know).collect()}
    assert table == {0: ["b"], 1: []}


def test_distinct_n(spark):
    df = spark.createDataFrame([(["a b a"],), (["a b"],)], "beams array<string>")
    assert metrics.distinct_n(df, 1).first().dist1 == pytest.approx(2 / 5)
    assert metrics.distinct_n(df, 2).first().dist2 == pytest.approx(2 / 3)


def test_pad_batches(spark):
    df = spark.createDataFrame([(i, ["t"] * (i + 1)) for i in range(5)], "idx bigint, input_ids array<string>")
    out = {r.idx: r for r in metrics.pad_batches(df, 2, F.lit("p"), multiple=4).collect()}
    assert [len(out[i].input_ids) for i in range(5)] == [4, 4, 4, 4, 8]
    assert out[0].input_ids == ["p", "p", "p", "t"] and out[0].attention_mask == [0, 0, 0, 1]


def test_beams_reshape(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "pos bigint, text string").repartition(3)
    out = {r.idx: r.beams for r in metrics.beams_reshape(df, 3).collect()}
    assert out == {0: ["t0", "t1", "t2"], 1: ["t3", "t4", "t5"]}


@pytest.mark.parametrize("n", [0, 1, 2, 30, 100, 130])
def test_head_tail(spark, n):
    df = spark.range(n).withColumnRenamed("id", "idx")
    got = sorted(r.idx for r in positions.head_tail(df).collect())
    assert got == sorted(list(range(n))[:50] + list(range(n))[-50:])


def test_dense_positions_do_not_depend_on_partitions(spark):
    rng = random.Random(4)
    rows = list({(rng.randint(0, 300), rng.randint(0, 40)) for _ in range(400)})
    for parts in (1, 9):
        df = spark.createDataFrame(rows, "a bigint, b bigint").repartition(parts)
        out = positions.dense_positions(
            df, "idx", positions.block_start(F.col("a"), 100),
            [F.col("a"), positions.block_start(F.col("b"), 4)], [F.col("a"), F.col("b")])
        assert [tuple(r) for r in out.orderBy("idx").collect()] == [(*r, i) for i, r in enumerate(sorted(rows))]


def test_padded_batches_pad_their_labels(spark):
    from pyspark.sql import functions as F
    from turnloom.operators import metrics

    rows = [(0, [1], [1]), (1, [1, 2, 3], [-100, 2, 3])]
    df = spark.createDataFrame(rows, "idx long, input_ids array<int>, labels array<int>")
    for r in metrics.pad_batches(df, 2, F.lit(0)).collect():
        assert len(r.input_ids) == len(r.attention_mask) == len(r.labels) == 8
        assert r.labels[:5] == [-100] * 5


def test_a_dialog_holds_all_earlier_turns(spark, tmp_path):
    from turnloom.plans.fixtures import Tables

    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(20)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    got = {r.turn: r.context for r in Tables(spark, str(tmp_path)).dialogs().collect()}
    assert got[19] == "[SEP]".join(f"turn {t}" for t in range(19))
    assert sorted(got) == list(range(1, 20, 2))
