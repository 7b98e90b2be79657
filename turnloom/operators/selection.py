"""The n smallest keys of a table by distributed selection, without numbering its rows.

A histogram of the first four hexadecimal digits of the key names the bucket that holds the n-th key; only
that bucket is counted again by its next four digits. Two rounds part 2^32 buckets, so what is left then is a
handful of rows even of 10^11, and their order gives the last key that is in. The rows are then filtered by
that key, in place: no row is shuffled or sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

DIGITS = 4
ROUNDS = 2


def nth_key(df: DataFrame, n: int, key: str, tie: str = "idx") -> tuple | None:
    """The n-th smallest (key, tie), n from 1; the last one if there are fewer; None of an empty table.

    ``key`` is a hexadecimal hash. At most 16^4 counts a round reach the driver.
    """
    prefix, left = "", n
    rows = df.select(key, tie)
    for _ in range(ROUNDS):
        inside = rows.where(F.col(key).startswith(prefix)) if prefix else rows
        at = len(prefix) + 1
        counts = inside.groupBy(F.substring(key, at, DIGITS).alias("digits")).count().collect()
        taken = 0
        for r in sorted(counts, key=lambda r: r["digits"]):
            if taken + r["count"] >= left:
                prefix, left = prefix + r["digits"], left - taken
                break
            taken += r["count"]
        else:  # fewer than n
            last = rows.agg(F.max(F.struct(key, tie)).alias("last")).first()["last"]
            return None if last is None else tuple(last)
    final = rows.where(F.col(key).startswith(prefix)).orderBy(key, tie).limit(left)
    return tuple(final.agg(F.max(F.struct(key, tie)).alias("last")).first()["last"])


def among_smallest(df: DataFrame, n: int, key: str, tie: str = "idx") -> Column:
    """Is a row among the n smallest of ``df`` by (key, tie)? The n-th key is sought while the plan is built."""
    last = nth_key(df, n, key, tie) if n > 0 else None
    if last is None:
        return F.lit(False)
    bound, last_tie = last
    return (F.col(key) < bound) | ((F.col(key) == bound) & (F.col(tie) <= last_tie))
