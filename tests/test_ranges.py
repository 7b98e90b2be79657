"""Positions and running totals by range partitions, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from turnloom.operators.ranges import range_positions, range_running, ranged


@pytest.mark.parametrize("gap", [1, 10**12])
def test_positions_of_sparse_and_text_keys(spark, gap):
    n = 3000
    df = spark.range(n).select((F.col("id") * gap).alias("id"), F.md5(F.col("id").cast("string")).alias("key"))
    by_id = range_positions(df, "at", [F.col("id")], 7).collect()
    assert {r["id"]: r["at"] for r in by_id} == {i * gap: i for i in range(n)}
    by_key = range_positions(df, "at", [F.col("key").desc()], 7).collect()
    assert [r["at"] for r in sorted(by_key, key=lambda r: r["key"], reverse=True)] == list(range(n))


def test_one_value_is_dealt_to_many_partitions(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("k"))
    sizes = [r["count"] for r in ranged(df, [F.col("k")], 8).groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1500
    rows = range_positions(df, "at", [F.col("k")], 8).collect()
    assert sorted(r["at"] for r in rows) == list(range(4000))
    nulls = [r["at"] for r in rows if r["k"] is None]
    assert sorted(nulls) == list(range(len(nulls)))  # nulls come first


def test_running_totals_per_group(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i * 10**12, rng.randint(-5, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, id long, x long")
    got = range_running(df, {"total": F.col("x")}, [F.col("id")], per=["g"], parts=5).collect()
    sums, want = {}, {}
    for g, i, x in rows:
        sums[g] = sums.get(g, 0) + x
        want[g, i] = sums[g]
    assert {(r["g"], r["id"]): r["total"] for r in got} == want


def test_repeats_raise_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "id long, x long")
    with pytest.raises(Exception, match="not unique"):
        range_running(df, {"t": F.col("x")}, [F.col("id")], parts=1, unique=True).collect()
    assert range_positions(df.limit(0), "at", [F.col("id")]).count() == 0
    assert range_running(df.limit(0), {"t": F.col("x")}, [F.col("id")]).count() == 0
