"""List rules: filters, refill, limits, draws."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from turnloom.functions import lists, seeded
from turnloom.operators import candidates
from turnloom.settings import Settings

STRINGS = "x array<string>"


def test_minus_keeps_duplicates(one):
    assert one(lists.minus("x", F.array(F.lit("b"))), STRINGS, ["a", "b", "a"]) == ["a", "a"]
    assert one(lists.negatives("x", F.array(F.lit("b"))), STRINGS, ["a", "", "b"]) == ["a"]


def test_take(one):
    assert one(lists.take("x", -1), STRINGS, ["a", "b"]) == ["a", "b"]
    assert one(lists.take("x", 1), STRINGS, ["a", "b"]) == ["a"]
    assert one(lists.take("x", F.lit(-3)), STRINGS, ["a", "b"]) == []


def test_mentions_and_refill_with_regex_characters(one):
    passages = ["no", "About C++ (2.*)", "more", "c++ (2.*) again"]
    topic = F.lit(" C++ (2.*) ")
    assert one(lists.mentions("x", topic), STRINGS, passages) == [passages[1], passages[3]]
    assert one(lists.mentions_refill("x", topic, 3), STRINGS, passages) == [
        passages[1], passages[3], "no"]
    assert one(lists.mentions_refill("x", topic, 1), STRINGS, passages) == [passages[1], passages[3]]


def test_refill_sees_through_nbsp(one):
    out = one(lists.mentions_refill("x", F.lit("a b"), 1, nbsp=True), STRINGS, ["n", "a\xa0b"])
    assert out == ["a\xa0b"]
    out = one(lists.mentions_refill("x", F.lit("a b"), 1), STRINGS, ["n", "a\xa0b"])
    assert out == ["n"]


def test_number_list(one):
    assert one(lists.number_list("x", "Item"), STRINGS, ["a", "b"]) == "Item 1. a\nItem 2. b"
    assert one(lists.number_list("x", "Item"), STRINGS, []) == ""


def test_shuffle_is_a_permutation_by_hash(one):
    values = [f"v{i}" for i in range(20)]
    out = one(seeded.shuffled("x", 7, F.lit(3), "s"), STRINGS, values)
    key = lambda i: hashlib.md5(f"7|3|s|{i}".encode()).hexdigest()
    assert out == [values[i] for i in sorted(range(20), key=key)]
    assert one(seeded.random_passages("x", 5, 7, F.lit(3)), STRINGS, values) != values[:5]


def test_shuffle_is_close_to_uniform(spark):
    rows = spark.range(3000).withColumn("x", F.array(*map(F.lit, "abc")))
    firsts = rows.select(F.get(seeded.shuffled("x", 1, "id", "s"), F.lit(0)).alias("f"))
    counts = {r.f: r["count"] for r in firsts.groupBy("f").count().collect()}
    assert set(counts) == set("abc") and min(counts.values()) > 850


def test_random_topic_count_range(spark):
    rows = spark.range(500).select(seeded.random_topic_count(4, 1, "id").alias("k")).distinct()
    assert {r.k for r in rows.collect()} == {2, 3, 4}
    assert spark.range(1).select(seeded.random_topic_count(1, 1, "id").alias("k")).first().k == 1


@pytest.mark.parametrize("topics, gold, k, size", [
    (["a", "b", "c", "d"], "d", 3, 3), (["a", "b"], "a", 3, 2), (["a", "b", "c"], "z", 2, 2),
    ([], "z", 2, 0),
])
def test_item_random_negative(one, topics, gold, k, size):
    out = one(seeded.item_random_negative("x", F.lit(gold), k, 3, 1, F.lit(5)), STRINGS, topics)
    assert len(out) == len(set(out)) == size
    if gold in topics:
        assert out[0] == topics.index(gold)
        assert all(p < 3 for p in out[1:])
    else:
        assert out == list(range(size))


@pytest.mark.parametrize("threshold, want", [
    (1.0, ["a", "b", "c"]), (0.7, ["a", "b"]), (0.5, ["a"]), (0.75, ["a", "b"]), (0.0, []),
])
def test_confidence_prefix(one, threshold, want):
    out = one(candidates.confidence_prefix("t", "c", 3, threshold),
              "t array<string>, c array<double>", list("abcd"), [0.5, 0.25, 0.125, 0.1])
    assert out == want


def test_passage_rerank_digits(one):
    schema = "g string, b array<string>"
    base = ["p1", "p2", "p3"]
    rank = lambda g: one(candidates.passage_rerank("g", "b"), schema, g, base)
    assert rank("Passage 2. x") == ["p2", "p1", "p3"]
    assert rank("Passage 12") == ["p1", "p2", "p3"]
    assert rank("Passage 0") == ["p3", "p1", "p2"]
    assert rank("Passage x, Passage 9") == base
    assert rank("Passage 3 Passage 3") == ["p3", "p3", "p1", "p2"]
    assert one(candidates.passage_rerank("g", "b"), schema, "Passage 0", []) == []


# --- candidate building against a row-wise description of the rules ---------------------------
def refill(passages, topic, n):
    t = topic.lower().strip()
    hits = [p for p in passages if t in p.lower().strip()]
    rest = [p for p in passages if t not in p.lower().strip()]
    return hits + rest[:max(n - len(hits), 0)]


def single(row, cfg):
    positives = row["candidate_knowledges_gpt"][:cfg.n_sampled_positive]
    hard = [p for p in row["predicted_know"][0] if p and p not in positives]
    n = cfg.n_hard_negative
    if n == -1:
        n = cfg.n_sampled_negative - len(positives)
    if cfg.filtering:
        hard = refill(hard, row["predicted_topic"][0], n)
    return [(positives + hard[:max(n, 0)])[:cfg.n_sampled_negative]]


def combined(row, cfg):
    positives = row["candidate_knowledges_gpt"][:cfg.n_sampled_positive]
    out = []
    for topic, passages in list(zip(row["predicted_topic"], row["predicted_know"]))[:cfg.topk_topic]:
        part = [p for p in passages if p and p not in positives]
        if cfg.filtering:
            part = refill(part, topic, cfg.n_sampled_negative)
        if topic.lower() == row["topic"].lower():
            part = positives + part
        out.append(part if cfg.n_sampled_negative == -1 else part[:cfg.n_sampled_negative])
    return out


SCHEMA = ("idx bigint, topic string, predicted_topic array<string>, "
          "predicted_know array<array<string>>, candidate_knowledges_gpt array<string>")


def random_rows(n=40):
    rng = random.Random(5)
    words = ["red", "blue", "red bolt", "Ring"]
    for i in range(n):
        topics = rng.sample(words, 3)
        know = [[rng.choice(["", "about Red", "blue one", "a ring", "red bolt", "x"]) + str(rng.randint(0, 2))
                 if rng.random() > .2 else "" for _ in range(rng.randint(0, 6))] for _ in range(3)]
        flat = [p for l in know for p in l if p]
        positives = rng.sample(flat, min(len(flat), rng.randint(0, 3)))
        yield (i, rng.choice(words).upper(), topics, know, positives)


@pytest.mark.parametrize("changes", [
    {}, {"filtering": True}, {"n_hard_negative": 1}, {"n_hard_negative": 0},
    {"n_sampled_positive": 1, "filtering": True}, {"n_sampled_negative": 1},
])
def test_candidate_lists(spark, changes):
    rows = list(random_rows())
    df = spark.createDataFrame(rows, SCHEMA)
    names = [f.strip().split(" ")[0] for f in SCHEMA.split(",")]
    for many in (False, True):
        cfg = Settings(combined=many, topk_topic=3, **changes)
        out = candidates.with_candidates(df, cfg).select("idx", "positions", "passage_lists").collect()
        for got in out:
            row = dict(zip(names, rows[got.idx]))
            if many:
                want = combined(row, cfg)
                assert got.passage_lists == [want[p] for p in got.positions]
                assert sorted(got.positions) == [0, 1, 2]
            else:
                assert got.passage_lists == single(row, cfg)


def test_shuffle_only_permutes(spark):
    df = spark.createDataFrame(list(random_rows()), SCHEMA)
    plain = Settings(combined=True, topk_topic=3, n_sampled_negative=-1)
    lists_of = lambda cfg: {
        r.idx: r.passage_lists for r in candidates.with_candidates(df, cfg).collect()}
    a, b = lists_of(plain), lists_of(plain.with_(shuffle=True))
    assert a != b
    assert all(list(map(sorted, a[i])) == list(map(sorted, b[i])) for i in a)


def test_selected_topic_takes_its_own_passages(spark):
    row = (0, "a", ["a", "b"], [["pa"], ["pb"]], ["x"], "b")
    df = spark.createDataFrame([row], SCHEMA + ", selected_topic string")
    cfg = Settings(combined=True, topk_topic=2, selected_topic=True)
    out = candidates.with_candidates(df, cfg).first()
    assert (out.topics, out.passage_lists) == (["b"], [["pb"]])


def test_ragged_and_empty_inputs(spark):
    rows = [(0, "a", [], [], []), (1, "a", ["a", "b"], [["p"]], ["q"])]
    df = spark.createDataFrame(rows, SCHEMA)
    out = candidates.with_candidates(df, Settings(combined=True, topk_topic=3)).orderBy("idx").collect()
    assert (out[0].topics, out[0].passage_lists) == ([], [])
    assert sorted(map(tuple, out[1].passage_lists)) == [(), ("q", "p")]
    out = candidates.with_candidates(df, Settings()).orderBy("idx").collect()
    assert out[0].passage_lists == [[]] and out[1].passage_lists == [["q", "p"]]


def test_top1_override(spark):
    rows = [(0, "a", ["a", "b"], ["a", "b"]), (2, "z", ["a", "b"], ["a"]), (1, "z", ["a", "b"], ["k"]),
            (4, "z", ["a"], ["a"])]
    df = spark.createDataFrame(rows, "idx bigint, topic string, predicted_topic array<string>, topics array<string>")
    out = {r.idx: (r.even, r.every) for r in df.select(
        "idx", candidates.top1_override(Settings()).alias("even"),
        candidates.top1_override(Settings(input_top1=True)).alias("every")).collect()}
    assert out == {0: (["a"], ["a"]), 2: (["b"], ["b"]), 1: (["k"], ["b"]), 4: ([], [])}


def test_positive_pick_modes(spark):
    row = (3, [["a", "b", "c"], ["z"]], ["g1", "g2"], "sel", "tgt")
    df = spark.createDataFrame([row], "idx bigint, predicted_know array<array<string>>, "
                               "candidate_knowledges_gpt array<string>, gpt_selection string, target_knowledge string")
    pick = lambda mode: df.select(candidates.positive_pick(Settings(positive=mode)).alias("p")).first().p
    assert pick("pseudo") in ("a", "b") and pick("highly_relevant") in ("g1", "g2")
    assert (pick("gpt_selection"), pick("target")) == ("sel", "tgt")
    with pytest.raises(ValueError):
        pick("only_pseudo")
