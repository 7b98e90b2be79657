"""Lists that rows share, and derived tables that stay narrow."""

import os
import time

import pytest
from pyspark.sql import functions as F

from turnloom.operators import joins, passages, prepare
from turnloom.plans import fixtures
from turnloom.plans.catalog import QUERIES, list_columns, size
from turnloom.settings import RECIPES, Settings
from turnloom.sources import readers, sinks

LISTS = {1: ["a b c", None, ""], 2: ["d" * 5000, "e f"], 3: []}
REFS = [(0, 0, 1), (0, 1, 2), (0, 2, 1), (1, 0, 9), (1, 1, 3), (2, 0, 2)]
WANT = {0: [LISTS[1], LISTS[2], LISTS[1]], 1: [[], []], 2: [LISTS[2]]}


@pytest.fixture
def shared(spark):
    return passages.SharedLists(
        spark.createDataFrame(REFS, "idx bigint, pos int, list bigint"),
        spark.createDataFrame(list(LISTS.items()), "list bigint, passages array<string>"))


def rows_of(df):
    return {r.idx: r.predicted_know for r in df.collect()}


def test_every_form_holds_the_same_lists(spark, shared):
    rows = spark.range(4).withColumnRenamed("id", "idx")
    assert rows_of(shared.whole()) == WANT
    assert rows_of(joins.merge_knowledge(rows, shared)) == WANT | {3: None}
    assert rows_of(joins.eval_join(rows, rows, shared)) == WANT
    assert rows_of(joins.merge_knowledge(rows, shared, disable_know=True)) == {0: [[]], 1: [[]], 2: [[]], 3: None}
    assert rows_of(shared.take(1).whole()) == {k: v[:1] for k, v in WANT.items()}


def test_packed_lists_stay_near_their_size(spark, shared):
    """A batch is bounded by packed bytes, so a list must not unpack to many times its packed size."""
    got = shared.lists.select(F.length(passages.pack(F.col("passages").cast("array<binary>"))).alias("n"), "list")
    assert {r.list: r.n for r in got.collect()}[2] >= 5000 // passages.LEAST


@pytest.mark.parametrize("compression", [None, "gzip"])
def test_shared_lists_as_files(spark, shared, tmp_path, compression):
    path = f"{tmp_path}/know"
    sinks.write_knowledge(shared.whole(), path, block=2, compression=compression)
    assert rows_of(readers.read_knowledge(spark, path)) == WANT
    assert rows_of(readers.read_knowledge_split(spark, path)) == WANT


@pytest.mark.parametrize("least", [1, 1 << 30])
def test_shared_lists_are_dealt_to_files(spark, monkeypatch, tmp_path, least):
    """Rows of many blocks, in rounds and at once, without a number, and names that stand twice or have no list."""
    monkeypatch.setattr(sinks, "ROUND", least)
    lists = LISTS | {n: [f"{n} [{{\"predicted_know\":] {i}, }}]\n" for i in range(n)] for n in range(4, 9)} | {None: ["x"], 9: None}
    refs = [(i, pos, (i * 3 + pos) % 11) for i in range(57) if i // 5 != 4 for pos in range(i % 4 + 1)]
    refs += [(None, 0, 2), (None, 1, 1), (56, 1, None), (56, 0, 2), (56, 0, 2)]
    shared = passages.SharedLists(
        spark.createDataFrame(refs, "idx bigint, pos int, list bigint").repartition(5),
        spark.createDataFrame(list(lists.items()), "list bigint, passages array<string>"))
    rounds, blocks = [], sinks._write_blocks
    monkeypatch.setattr(sinks, "_write_blocks", lambda *a: (rounds.append(a), blocks(*a)))
    before, flag = held(spark), spark.conf.get(sinks.CLEANUP)
    for k, compression in enumerate([None, "gzip"]):
        sinks.write_knowledge(shared, f"{tmp_path}/{k}", block=5, compression=compression)
        want = rows_of(shared.whole())
        assert len(want) == 53
        # A file tells a row's number by its place: the numbers that are left out are a whole block.
        assert rows_of(readers.read_knowledge(spark, f"{tmp_path}/{k}")) == want
        assert rows_of(readers.read_knowledge_split(spark, f"{tmp_path}/{k}")) == want
    assert (len(rounds) > 6) == (least == 1)
    assert held(spark) == before and spark.conf.get(sinks.CLEANUP) == flag
    with pytest.raises(Exception, match="already exists"):
        sinks.write_knowledge(shared, f"{tmp_path}/0")


def held(spark):
    """What stands in the scratch folder, but for the tables of other tests."""
    top = sinks._scratch(spark)
    return {n for n in (os.listdir(top) if os.path.isdir(top) else []) if n.startswith(("refs-", "lists-", "records-"))}


def shuffled(spark):
    """Bytes of shuffle files; they go soon after they are dropped."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    paths = [files.apply(i).getPath() for i in range(files.size())]
    return sum(os.path.getsize(p) for p in paths if "/shuffle_" in p and os.path.exists(p))


@pytest.mark.parametrize("name", ["scan_knowledge_split", "scan_knowledge"])
def test_a_scan_leaves_its_files_alone_on_disk(spark, tmp_path, name):
    """Neither the whole texts that were shuffled nor a second copy of the rows, while the files are read."""
    write_tables(spark, tmp_path, [(1, t, "assistant" if t % 2 else "user", f"{t}") for t in range(400)], 2000)
    tables = fixtures.Tables(spark, str(tmp_path))
    know = tables.knowledge().where(F.size("predicted_know") > 0)
    want = know.select("idx", size("predicted_know").alias("n_lists"), *list_columns("passages", F.flatten("predicted_know")))
    whole = sum(r.n for r in know.select(F.length(F.to_json("predicted_know")).alias("n")).collect())
    before, left = held(spark), shuffled(spark)
    got = QUERIES[name](spark, str(tmp_path))
    for _ in range(50):
        if shuffled(spark) - left < whole / 10:
            break
        time.sleep(0.2)
    assert whole > 1 << 23 and shuffled(spark) - left < whole / 10
    assert held(spark) == before
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def write_tables(spark, path, turns, size):
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(
        f"{path}/conversations.parquet")
    docs = [(i, os.urandom(size // 2).hex(), "en", "s", size) for i in range(30)]
    spark.createDataFrame(docs, fixtures.GIVEN["documents"]).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, f"item {i}", 0, 0.0) for i in range(5)], fixtures.GIVEN["supplier"]).write.parquet(
        f"{path}/supplier.parquet")


def test_shared_passages_are_cut_before_they_are_dealt(spark, tables):
    for cfg in (RECIPES["durec_item"], RECIPES["inspired_response"], Settings(prompt="DIP2I", combined=True)):
        short = prepare.prepare(tables.samples(), tables.lists(), cfg)
        whole = prepare.prepare(tables.samples(), tables.knowledge(), cfg)
        assert rows_of(short) == rows_of(whole)
        assert short.columns == whole.columns


def test_a_long_conversation_is_not_stored_per_reply(spark, tmp_path):
    """Stored bytes follow the conversations; the dialogs of 600 turns hold about 150 times their text."""
    rows = [(1, t, "assistant" if t % 2 else "user", f"{t} " + os.urandom(300).hex()) for t in range(600)]
    rows += [(2, 3, "assistant", "nothing before"), (3, 0, "user", "x[SEP]y"), (3, 0, "user", None),
             (3, 1, "assistant", "z"), (3, 1, "assistant", "z"), (3, 2, "assistant", "w")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in range(30)], fixtures.GIVEN["documents"]).write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"item {i}", 0, 0.0) for i in range(5)], fixtures.GIVEN["supplier"]).write.parquet(
        f"{tmp_path}/supplier.parquet")
    tables = fixtures.Tables(spark, str(tmp_path))
    samples = {r.idx: r for r in tables.samples().collect()}
    stored = sum(os.path.getsize(f.removeprefix("file:")) for f in tables._rows().inputFiles())
    assert stored < 4 * 600 * 600
    assert len(samples) == 303 and all(r.conv_id != 2 for r in samples.values())
    said = lambda r, c: [t[3] for t in sorted(rows, key=lambda t: t[:2]) if t[0] == c and t[1] < r.turn and t[3]]
    first = [r for r in samples.values() if r.conv_id == 1]
    assert all(r.dialog.removesuffix("[SEP]") == "[SEP]".join(said(r, 1)) for r in first)
    # A reply that stands twice has every turn before it twice, once for each.
    assert {(r.turn, r.dialog.removesuffix("[SEP]")) for r in samples.values() if r.conv_id == 3} == {
        (1, "x[SEP]y[SEP]x[SEP]y"), (2, "x[SEP]y[SEP]z[SEP]z")}
    for r in tables.generations("R").collect():
        if r.idx % 3 == 2:
            assert r.beams[0] == samples[r.idx].dialog.split("[SEP]")[-1]
