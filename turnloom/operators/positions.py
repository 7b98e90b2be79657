"""Row positions and running totals without a single-task window.

Totals run in three steps: per fine block, over the fine blocks of a coarse block, over the
coarse blocks. Blocks follow the values of the key: with dense ids no window sees more rows than a
block holds, with sparse ids the window over the coarse blocks grows with their number.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BLOCK = 10_000


def running_sums(
    df: DataFrame,
    values: Mapping[str, Column],
    coarse: Column,
    fine: Sequence[Column],
    order: Sequence[Column],
    per: Sequence[str] = (),
    unique: bool = False,
) -> DataFrame:
    """Add a running total, current row included, for every value.

    ``coarse``, then ``fine``, then ``order`` must sort the rows as ``order`` alone does, and
    ``order`` should be unique; with ``unique``, rows that repeat raise while the job runs. Totals
    start anew for every value of the columns ``per``, which must not be NULL.
    """
    fine_names = [f"_fine{i}" for i in range(len(fine))]
    top = [*per, "_coarse"]
    keys = [*top, *fine_names]
    names = list(values)
    keyed = df.select(
        "*", coarse.alias("_coarse"), *[f.alias(n) for f, n in zip(fine, fine_names)],
        *[values[n].alias(f"_v_{n}") for n in names],
    )
    fine_totals = keyed.groupBy(*keys).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    coarse_totals = fine_totals.groupBy(*top).agg(
        *[F.sum(f"_t_{n}").alias(f"_t_{n}") for n in names]
    )

    def before(window) -> list[Column]:
        frame = window.rowsBetween(W.unboundedPreceding, -1)
        return [F.coalesce(F.sum(f"_t_{n}").over(frame), F.lit(0)) for n in names]

    # One row per coarse block: the only window over all of them.
    coarse_before = coarse_totals.select(
        *top,
        *[
            c.alias(f"_c_{n}")
            for n, c in zip(names, before(W.partitionBy(*(per or [F.lit(0)])).orderBy("_coarse")))
        ],
    )
    fine_before = fine_totals.select(
        *keys,
        *[
            c.alias(f"_f_{n}")
            for n, c in zip(names, before(W.partitionBy(*top).orderBy(*fine_names)))
        ],
    ).join(coarse_before, top)
    offsets = fine_before.select(
        *keys, *[(F.col(f"_f_{n}") + F.col(f"_c_{n}")).alias(f"_o_{n}") for n in names]
    )
    ordered = W.partitionBy(*keys).orderBy(*order)
    inside = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    place = F.struct(*order)
    repeats = F.lag(place).over(ordered) == place if unique else F.lit(False)
    running = keyed.select(
        *df.columns, *[k for k in keys if k not in per], repeats.alias("_repeats"),
        *[F.sum(f"_v_{n}").over(inside).alias(f"_r_{n}") for n in names],
    )
    return running.join(offsets, keys).select(
        *df.columns,
        *[
            F.when(F.col("_repeats"), F.raise_error("the order of rows is not unique"))
            .otherwise(F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(n)
            for n in names
        ],
    )


def dense_positions(
    df: DataFrame, name: str, coarse: Column, fine: Sequence[Column], order: Sequence[Column]
) -> DataFrame:
    """Number the rows 0, 1, 2, … in ``order``."""
    counted = running_sums(df, {name: F.lit(1).cast("bigint")}, coarse, fine, order)
    return counted.withColumn(name, F.col(name) - 1)


def block_start(position: Column, size: int) -> Column:
    """The first position of the block, in integer arithmetic."""
    return position - position % size


def index_blocks(idx: str = "idx", block: int = BLOCK) -> tuple[Column, list[Column]]:
    """Coarse and fine block of a numeric row index."""
    return block_start(F.col(idx), block * block), [block_start(F.col(idx), block)]


def running_by_index(
    df: DataFrame, values: Mapping[str, Column], idx: str = "idx", block: int = BLOCK,
    per: Sequence[str] = (), unique: bool = False,
) -> DataFrame:
    coarse, fine = index_blocks(idx, block)
    return running_sums(df, values, coarse, fine, [F.col(idx)], per, unique)


def hash_positions(df: DataFrame, name: str, key: str, *tie: str) -> DataFrame:
    """Number the rows in the order of a hexadecimal hash column."""
    return dense_positions(
        df, name, F.substring(key, 1, 2), [F.substring(key, 1, 5)],
        [F.col(key), *[F.col(t) for t in tie]],
    )


def head_tail(df: DataFrame, n: int = 50, idx: str = "idx") -> DataFrame:
    """The first and the last ``n`` rows; a table shorter than 2n repeats its middle."""
    head = df.orderBy(F.col(idx)).limit(n)
    tail = df.orderBy(F.col(idx).desc()).limit(n)
    return head.unionByName(tail)


def resume_from(df: DataFrame, offset: int, idx: str = "idx") -> DataFrame:
    """Skip the rows before a position; the test reaches the scan."""
    return df.where(F.col(idx) >= offset)
