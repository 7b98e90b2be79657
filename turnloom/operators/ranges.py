"""Row positions and running totals for any order of rows, by range partitions.

Rows are range-partitioned by the order and written once, each with its partition and its place in it.
Spark samples the keys to cut the ranges, so sparse numbers, strings and several columns are dealt as
evenly as dense numbers. Totals per partition, one row each, give the offset of every partition; the only
window without a key is over those rows. The place inside a partition needs no window at all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from turnloom.sources.sinks import written

PLACE_BITS = 33  # monotonically_increasing_id: partition above, row in the partition below


def ranged(
    df: DataFrame, order: Sequence[Column], parts: int | None = None, spread: bool = True
) -> DataFrame:
    """The rows, sorted in range partitions and written, with ``_part`` and ``_place`` (both from 0).

    Rows that are equal in ``order`` are spread over neighbouring partitions, in any order among
    themselves, so one value may be any share of the rows; without ``spread`` they stay together.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = [F.monotonically_increasing_id()] if spread else []
    dealt = df.repartitionByRange(n, *order, *tie).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    return written(dealt.select(
        "*", F.shiftright(place, PLACE_BITS).alias("_part"),
        place.bitwiseAND((1 << PLACE_BITS) - 1).alias("_place")), "ranged")


def offsets(rows: DataFrame, sums: Mapping[str, Column], per: Sequence[str] = ()) -> DataFrame:
    """Per range partition, the totals of all partitions before it: one row per partition (and group)."""
    totals = rows.groupBy(*per, "_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = W.partitionBy(*(per or [F.lit(0)])).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return totals.select(*per, "_part", *[
        F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums])


def range_positions(df: DataFrame, name: str, order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """Number the rows 0, 1, 2, … in ``order``; equal rows in any order among themselves.

    The offsets are one row per range partition, so joining them never shuffles the rows unless
    partitions outnumber what Spark broadcasts.
    """
    rows = ranged(df, order, parts)
    first = offsets(rows, {"_first": F.lit(1).cast("bigint")})
    return rows.join(first, "_part").select(
        *df.columns, (F.col("_first") + F.col("_place")).alias(name))


def range_running(
    df: DataFrame, values: Mapping[str, Column], order: Sequence[Column], per: Sequence[str] = (),
    parts: int | None = None, unique: bool = False,
) -> DataFrame:
    """Add a running total, current row included, for every value, for each group of ``per`` anew.

    Groups come before ``order``, so a group is a run of range partitions; a window sees the rows of one
    group in one range partition. With ``unique``, rows that repeat in a group's order raise.
    """
    names = list(values)
    held = df.select("*", *[values[n].alias(f"_v_{n}") for n in names],
                     F.struct(*order).alias("_order"))
    rows = ranged(held, [*[F.col(c) for c in per], *order], parts, spread=not unique)
    before = offsets(rows, {f"_o_{n}": F.col(f"_v_{n}") for n in names}, per)
    ordered = W.partitionBy(*per, "_part").orderBy("_place")
    inside = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    repeats = F.lag("_order").over(ordered).eqNullSafe(F.col("_order")) if unique else F.lit(False)
    running = rows.select(
        *df.columns, "_part", repeats.alias("_repeats"),
        *[F.sum(f"_v_{n}").over(inside).alias(f"_r_{n}") for n in names])
    same = F.lit(True)
    for c in [*per, "_part"]:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}"))
    return running.alias("r").join(before.alias("b"), same).select(
        *[F.col(f"r.{c}") for c in df.columns],
        *[F.when(F.col("_repeats"), F.raise_error("the order of rows is not unique"))
          .otherwise(F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(n) for n in names])
