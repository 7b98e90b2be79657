"""Reproducible draws.

Every draw is a hash of (seed, row, stream, position): it does not depend on partitioning, on
retries of a lost task or on the order of evaluation, and SQL engines agree on it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from turnloom.functions.lists import take
from turnloom.functions.text import col

Part = Column | str | int


def draw_key(seed: Part, idx: Column | str, stream: str, *parts: Part) -> Column:
    """md5 of ``seed|idx|stream|part…``."""
    texts = [F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string")]
    texts += [col(idx).cast("string"), F.lit(stream)]
    texts += [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *texts))


def draw_int(key: Column, modulus: int | Column) -> Column:
    """0 … modulus-1 from the first 32 bits of a draw key."""
    number = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")
    return number % (F.lit(modulus) if isinstance(modulus, int) else modulus)


def shuffled(arr: Column | str, seed: Part, idx: Column | str, stream: str, *parts: Part) -> Column:
    """The list in the order of its draw keys."""
    keyed = F.transform(
        col(arr),
        lambda x, i: F.struct(
            draw_key(seed, idx, stream, *parts, i).alias("key"), i.alias("pos"), x.alias("value")
        ),
    )
    return F.transform(F.sort_array(keyed), lambda s: s["value"])


def random_passages(
    arr: Column | str, n: int | Column, seed: Part, idx: Column | str, *parts: Part
) -> Column:
    """Shuffle, then the first ``n``."""
    return take(shuffled(arr, seed, idx, "random", *parts), n)


def random_pick(arr: Column | str, seed: Part, idx: Column | str, stream: str) -> Column:
    """One element; NULL for an empty list."""
    size = F.greatest(F.size(col(arr)), F.lit(1))
    return F.get(col(arr), draw_int(draw_key(seed, idx, stream), size).cast("int"))


def random_topic_count(k: int | Column, seed: Part, idx: Column | str) -> Column:
    """Uniform in 2 … k; k itself when k is below 2."""
    top = F.lit(k) if isinstance(k, int) else k
    drawn = draw_int(draw_key(seed, idx, "count"), F.greatest(top - 1, F.lit(1))) + 2
    return F.when(top > 1, drawn).otherwise(top).cast("int")


def item_random_negative(
    topics: Column | str, gold: Column | str, k: int | Column, pool: int,
    seed: Part, idx: Column | str,
) -> Column:
    """Positions of the gold topic and of distinct random others among the first ``pool``.

    Without the gold topic the first k positions are used; with too few others the result is
    shorter than k.
    """
    limit = F.lit(k) if isinstance(k, int) else k
    n_topics = F.size(col(topics))
    gold_pos = (F.array_position(col(topics), col(gold)) - 1).cast("int")
    pool_size = F.least(F.lit(pool), n_topics)
    others = F.filter(
        F.when(pool_size > 0, F.sequence(F.lit(0), pool_size - 1)).otherwise(
            F.array().cast("array<int>")
        ),
        lambda p: p != gold_pos,
    )
    drawn = F.slice(shuffled(others, seed, idx, "pool"), F.lit(1), F.greatest(limit - 1, F.lit(0)))
    first = F.least(limit, n_topics)
    return F.when(gold_pos >= 0, F.concat(F.array(gold_pos), drawn)).otherwise(
        F.when(first > 0, F.sequence(F.lit(0), first - 1)).otherwise(
            F.array().cast("array<int>")
        )
    )
