"""Sources, sinks and the streaming run."""

import json

import pytest
from pyspark.sql import functions as F

from turnloom import fixed_values as fv
from turnloom.operators import joins, metrics, prepare
from turnloom.sources import readers, sinks
from turnloom.streaming import running

KNOW = "idx bigint, predicted_know array<array<string>>"


def test_samples_both_formats(spark, tables, tmp_path):
    samples = tables.samples()
    for fmt in ("parquet", "json"):
        for split in ("train", "test"):
            samples.where(F.col("split") == split).drop("split").write.format(fmt).save(f"{tmp_path}/{fmt}/{split}")
        back = readers.read_both(spark, f"{tmp_path}/{fmt}/train", f"{tmp_path}/{fmt}/test", fmt)
        columns = [c for c in back.columns if c in samples.columns]
        assert sorted(map(str, back.select(columns).collect())) == sorted(map(str, samples.select(columns).collect()))


def test_knowledge_single_array_file(spark, tmp_path):
    rows = [{"predicted_know": [["a \xe9", ""], []]}, {"predicted_know": [[]]}, {"predicted_know": [["c"]]}]
    path = tmp_path / "know.json"
    path.write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    got = {r.idx: r.predicted_know for r in readers.read_knowledge(spark, str(path)).collect()}
    assert got == {i: r["predicted_know"] for i, r in enumerate(rows)}


def test_knowledge_in_blocks(spark, tmp_path):
    rows = [(i, [[f"p{i}"], []]) for i in range(23)]
    df = spark.createDataFrame(rows, KNOW).repartition(5)
    sinks.write_knowledge(df, f"{tmp_path}/k", block=5)
    back = readers.read_knowledge(spark, f"{tmp_path}/k")
    assert sorted((r.idx, r.predicted_know) for r in back.collect()) == rows
    df.write.parquet(f"{tmp_path}/p")
    assert readers.read_knowledge_table(spark, f"{tmp_path}/p").count() == 23
    for named in (readers.read_knowledge_table(spark, f"{tmp_path}/p", split="test"),
                  readers.read_knowledge(spark, f"{tmp_path}/k", "test")):
        assert named.where("split = 'test'").count() == 23


def test_templates_by_file_and_by_directory(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    for name, t in fv.TEMPLATES.items():
        (folder / f"{name}.json").write_text(json.dumps({"description": "d", **t}, indent=2), encoding="utf-8")
    assert readers.load_templates(spark, str(folder)) == fv.TEMPLATES
    sinks.write_templates(spark, fv.TEMPLATES, f"{tmp_path}/dirs")
    assert readers.load_templates(spark, f"{tmp_path}/dirs") == fv.TEMPLATES


def scored(spark, n):
    df = spark.createDataFrame(
        [(i, [f"gén {i}"], "label", "topic", "prompt", [-0.5]) for i in range(n)],
        "idx bigint, beams array<string>, label string, topic string, prompt string, sequence_scores array<double>")
    return metrics.scored_records(df)


def test_scored_sink(spark, tmp_path):
    records = scored(spark, 130)
    sinks.write_scored(records, f"{tmp_path}/all")
    sinks.write_scored(records, f"{tmp_path}/first", write=False)
    assert spark.read.json(f"{tmp_path}/all").count() == 130
    first = spark.read.json(f"{tmp_path}/first")
    assert sorted(r.idx for r in first.select("idx").collect()) == list(range(100))
    assert set(sinks.RECORD) <= set(first.columns)
    line = spark.read.text(f"{tmp_path}/first").first().value
    assert "gén" in line and json.loads(line)["hit_scores"].count("|") == 4


def test_summary_and_layout(spark, tmp_path):
    df = spark.createDataFrame([(0, ["a b"], "a b", "a"), (1, ["c"], "d", "e")],
                               "idx bigint, beams array<string>, label string, topic string")
    sinks.write_summary(metrics.summary(df), f"{tmp_path}/s")
    out = json.loads(spark.read.text(f"{tmp_path}/s").first().value)
    assert out == {"hitgen": "0.5000", "hit_scores": "|".join(["0.5000"] * 5),
                   "bleu_scores": "0.5000|0.5000|0.0000|0.0000", "sample_bleu_scores": "0.0000|0.0000|0.0000|0.0000"}
    sinks.write_layout(df.select("idx"), f"{tmp_path}/l", "a/b", "run")
    folders = sorted(p.name for p in (tmp_path / "l").iterdir() if p.is_dir())
    assert folders == ["model=a-b"]


def test_scratch_needs_a_shared_folder(spark):
    assert "/turnloom/" in sinks.scratch_dir(spark, "x")
    assert sinks.scratch_dir(spark, "x") != sinks.scratch_dir(spark, "x")


def test_written_and_bucketed(spark):
    df = spark.range(20).withColumnRenamed("id", "idx")
    assert sinks.written(df, "t").count() == 20
    _, a = sinks.bucketed(df, "a", buckets=2)
    _, b = sinks.bucketed(df, "b", buckets=2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = a.join(b, "idx")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_stream_ends_in_the_batch_result(spark, tables, tmp_path):
    samples = sinks.written(tables.samples(False).select(
        "idx", "split", "topic", prepare.pick_label("R").alias("label")), "s")
    gen = tables.generations("R")
    path = str(tmp_path)
    first, second = gen.where("idx % 2 = 0"), gen.where("idx % 2 = 1")
    first.repartition(2).write.parquet(f"{path}/in")
    totals = lambda: running.stream_metrics(
        readers.stream_generations(spark, f"{path}/in"), samples, by=["split"])
    running.run_available(totals(), f"{path}/out", f"{path}/checkpoint")
    seen = running.latest(spark, f"{path}/out").agg(F.sum("cnt").alias("n")).first().n
    assert seen == first.count()
    # more answers arrive; the run goes on from its checkpoint
    second.repartition(1).write.mode("append").parquet(f"{path}/in")
    running.run_available(totals(), f"{path}/out", f"{path}/checkpoint")
    got = {r.split: r for r in running.latest(spark, f"{path}/out").collect()}
    rows = metrics.row_scores(joins.eval_join(gen, samples))
    want = rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("cnt"), *[F.avg(m).alias(m) for m in metrics.METRICS])
    for w in want.collect():
        assert got[w.split].cnt == w.cnt
        assert all(got[w.split][m] == pytest.approx(w[m]) for m in metrics.METRICS)
