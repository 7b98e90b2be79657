"""Passage dictionary, split JSON arrays, exact selection, observed merges, batches by length, groupings."""

import json
import random

import pytest
from pyspark.sql import Observation, functions as F

from turnloom.operators import joins, metrics, passages, selection
from turnloom.sources import readers

KNOW = "idx bigint, predicted_know array<array<string>>"


@pytest.fixture()
def know(spark):
    rng = random.Random(9)
    texts = ["", "one two three", "a b c d e f", "é x", "one"]
    rows = [(i, [[rng.choice(texts) for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(0, 3))])
            for i in range(40)]
    return rows + [(100, None), (101, []), (102, [[]]), (103, [[], ["one", None]])]


def test_dictionary_round_trip_cuts_each_text_once(spark, know):
    df = spark.createDataFrame(know, KNOW).repartition(3)
    refs, words = passages.references(df), passages.dictionary(df)
    back = {r["idx"]: r["predicted_know"] for r in passages.expand(refs, words).collect()}
    assert back == dict(know)
    seen = Observation()
    cut = passages.expand(refs, passages.cut_once(words, 2, seen=seen))
    got = {r["idx"]: r["predicted_know"] for r in cut.collect()}
    short = lambda t: None if t is None else {"one two three": "one two", "a b c d e f": "a b"}.get(t, t)
    assert got == {i: None if k is None else [[short(t) for t in l] for l in k] for i, k in know}
    assert seen.get["texts"] == len({t for _, k in know for l in k or [] for t in l} - {None})


def test_more_columns_travel_along(spark, know):
    df = spark.createDataFrame(know, KNOW).withColumn("split", F.lit("test")).withColumn("text", F.lit(1))
    back = passages.expand(passages.references(df), passages.dictionary(df), ["idx", "split"])
    assert sorted(back.columns) == sorted(df.columns) and back.count() == len(know)


# --- one JSON array, many tasks -------------------------------------------------------------------
def write(path, text):
    path.mkdir(parents=True, exist_ok=True)
    (path / "know.json").write_text(text, encoding="utf-8")


def array(know):
    return json.dumps([{"predicted_know": k} for _, k in know], ensure_ascii=False, separators=(", ", ":"))


def test_one_array_file_is_read_by_several_tasks(spark, tmp_path):
    rng = random.Random(2)
    know = [(i, [["passage %d \"quoted\" {\"predicted_know\": 1} \n é" % i] * rng.randint(0, 30)]) for i in range(400)]
    write(tmp_path / "one", array(know))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        tasks = spark.read.option("lineSep", readers.RECORD_START).text(str(tmp_path / "one")).rdd.getNumPartitions()
        rows = readers.read_knowledge_split(spark, str(tmp_path / "one"), split="test").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert tasks > 5
    assert {r["idx"]: r["predicted_know"] for r in rows} == dict(know)
    assert {r["split"] for r in rows} == {"test"}


def test_blocks_empty_arrays_and_broken_records(spark, tmp_path):
    for start in (0, 100):
        write(tmp_path / "blocks" / f"start={start}", array([(0, [["a"]]), (1, None)]))
    write(tmp_path / "blocks" / "start=200", "[ ]\n")
    rows = {r["idx"]: r["predicted_know"] for r in readers.read_knowledge_split(spark, str(tmp_path / "blocks")).collect()}
    assert rows == {0: [["a"]], 1: None, 100: [["a"]], 101: None}
    write(tmp_path / "broken", '[{"predicted_know": [["a"]]},\n{"predicted_know": [["b"}, {"predicted_know": [["c"]]}\n]\n')
    rows = {r["idx"]: r["predicted_know"] for r in readers.read_knowledge_split(spark, str(tmp_path / "broken")).collect()}
    assert rows == {0: [["a"]], 1: None, 2: [["c"]]}


@pytest.mark.parametrize("text", ['{"predicted_know": [["a"]]}', '[{"predicted_know": [["a"]]}, null]',
                                  '[{"idx": 1, "predicted_know": [["a"]]}]'])
def test_other_files_raise(spark, tmp_path, text):
    write(tmp_path / "other", text)
    with pytest.raises(Exception, match="not an array of records"):
        readers.read_knowledge_split(spark, str(tmp_path / "other")).collect()


# --- the n smallest -------------------------------------------------------------------------------
def test_selection_equals_sorting(spark):
    rows = [(i, f"{(i * 7919) % 97:032x}") for i in range(500)]  # ties, and one bucket for all
    more = [(1000 + i, f"{i % 5:x}" + "0" * 31) for i in range(20)]
    df = spark.createDataFrame(rows + more, "idx long, key string").repartition(4)
    order = sorted((k, i) for i, k in rows + more)
    for n in (1, 2, 97, 519, 520, 1000):
        assert selection.nth_key(df, n, "key") == order[min(n, len(order)) - 1]
        got = df.where(selection.among_smallest(df, n, "key")).select("key", "idx").collect()
        assert sorted(map(tuple, got)) == order[:n]
    assert df.where(selection.among_smallest(df, 0, "key")).count() == 0
    assert selection.nth_key(df.limit(0), 3, "key") is None


# --- merges that count ----------------------------------------------------------------------------
def test_too_long_knowledge_raises(spark):
    samples = spark.range(5).withColumnRenamed("id", "idx")
    know = spark.createDataFrame([(i, [["a"]]) for i in range(4)], KNOW)
    merged, seen = joins.merge_observed(samples, know)
    assert sorted(r["idx"] for r in merged.collect()) == [0, 1, 2, 3, 4]
    assert joins.check_observed(seen) == {"samples": 5, "knowledge": 4, "bare": 1, "unmatched": 0}
    merged, seen = joins.merge_observed(samples.where("idx < 3"), know)
    assert merged.count() == 3
    with pytest.raises(ValueError, match="1 passage lists have no sample"):
        joins.check_observed(seen)


# --- batches of like length, sketches, groupings --------------------------------------------------
def test_batches_of_like_length(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(1, 100)) for i in range(1003)]
    df = spark.createDataFrame(rows, "idx long, n int")
    results = []
    for parts in (1, 5):
        got = metrics.length_batches(df.repartition(parts), 8, F.col("n"), 42, mega=10).collect()
        results.append(sorted((r["idx"], r["batch"], r["place"]) for r in got))
    assert results[0] == results[1] and len({r[0] for r in results[0]}) == 1003
    batches = {}
    for i, batch, _ in results[0]:
        batches.setdefault(batch, []).append(rows[i][1])
    assert sorted(batches) == list(range(126)) and sorted(map(len, batches.values()))[1] == 8
    pad = lambda groups: sum(max(g) * len(g) - sum(g) for g in groups)
    plain = [[n for _, n in rows[i:i + 8]] for i in range(0, 1003, 8)]
    assert pad(batches.values()) < pad(plain) / 3
    lengths = [max(batches[k]) for k in sorted(batches)]
    assert lengths != sorted(lengths) and lengths != sorted(lengths, reverse=True)


def test_sketches_merge_in_any_order(spark):
    rng = random.Random(3)
    rows = [(i % 2, [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(40))]) for i in range(400)]
    df = spark.createDataFrame(rows, "part int, beams array<string>")
    parts = [metrics.distinct_n_sketches(df.where(F.col("part") == i)) for i in (0, 1)]
    both = [{r["n"]: r["dist"] for r in metrics.merge_distinct_n(a.unionByName(b)).collect()}
            for a, b in (parts, parts[::-1])]
    assert both[0] == both[1]
    exact = {r["n"]: r["dist"] for r in metrics.distinct_ngrams(df).collect()}
    assert both[0] == pytest.approx(exact, rel=0.05)


def test_cube_tells_null_groups_from_totals(spark):
    rows = [("a", None, ["x"], "x", "t"), ("a", "g", ["y"], "x", "t"), ("b", "g", ["x"], "x", "t")]
    df = spark.createDataFrame(rows, "split string, goal string, beams array<string>, label string, topic string")
    got = {(r["split"], r["goal"], r["grouping"]): (r["cnt"], r["hit1"]) for r in metrics.score_cube(df, ["split", "goal"]).collect()}
    assert got == {("a", None, 0): (1, 1.0), ("a", "g", 0): (1, 0.0), ("b", "g", 0): (1, 1.0), ("a", None, 1): (2, 0.5),
                   ("b", None, 1): (1, 1.0), (None, None, 2): (1, 1.0), (None, "g", 2): (2, 0.5), (None, None, 3): (3, 2 / 3)}
    few = metrics.score_cube(df, ["split", "goal"], [["split"], []]).collect()
    assert sorted(r["grouping"] for r in few) == [1, 1, 3]
