"""Array expressions on candidate lists.

A column that is used inside a lambda is evaluated again for every element unless it is bound
first; ``let`` binds it, so that a list pipeline stays linear.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from turnloom.functions.text import col, replace, strip
from turnloom.fixed_values import NBSP
from turnloom.settings import ALL


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty_list() -> Column:
    return F.array().cast("array<string>")


def or_empty(arr: Column | str) -> Column:
    return F.coalesce(col(arr), empty_list())


def take(arr: Column | str, n: int | Column) -> Column:
    """The first ``n`` elements; -1 means all."""
    if isinstance(n, int):
        return col(arr) if n == ALL else F.slice(col(arr), F.lit(1), F.lit(max(n, 0)))
    return F.slice(col(arr), F.lit(1), F.greatest(n, F.lit(0)))


topk_topics = take
topk_passages = take
positives_limit = take


def non_empty(arr: Column | str) -> Column:
    return F.filter(col(arr), lambda x: x != F.lit(""))


def minus(arr: Column | str, other: Column | str) -> Column:
    """List difference which keeps duplicates (``array_except`` would drop them)."""
    return let(col(other), lambda o: F.filter(col(arr), lambda x: ~F.array_contains(o, x)))


def negatives(arr: Column | str, positives: Column | str) -> Column:
    """Non-empty passages that are no positive."""
    return minus(non_empty(arr), positives)


def _mention(passage: Column, topic: Column, nbsp: bool) -> Column:
    # The topic is stripped, so stripping the passage could not change the answer.
    text = replace(passage, NBSP, " ") if nbsp else passage
    return F.contains(F.lower(text), topic)


def mentions(arr: Column | str, topic: Column | str) -> Column:
    """Passages that contain the topic, without refill."""
    key = strip(F.lower(col(topic)))
    return let(key, lambda t: F.filter(col(arr), lambda x: _mention(x, t, False)))


def mentions_refill(
    arr: Column | str, topic: Column | str, n: int | Column, nbsp: bool = False
) -> Column:
    """Passages that contain the topic; when fewer than ``n``, others follow up to ``n``.

    Each passage is tested once; the flags are then used for both halves.
    """
    key = strip(F.lower(col(topic)))
    tested = let(
        key,
        lambda t: F.transform(
            col(arr), lambda x: F.struct(_mention(x, t, nbsp).alias("hit"), x.alias("text"))
        ),
    )
    limit = F.lit(n) if isinstance(n, int) else n

    def refill(flags: Column) -> Column:
        hits = F.transform(F.filter(flags, lambda f: f["hit"]), lambda f: f["text"])
        rest = F.transform(F.filter(flags, lambda f: ~f["hit"]), lambda f: f["text"])
        missing = F.greatest(limit - F.size(hits), F.lit(0))
        return F.concat(hits, F.slice(rest, F.lit(1), missing))

    return let(tested, refill)


def number_list(arr: Column | str, word: str, start: int | Column = 1) -> Column:
    """``{word} {i}. {text}`` lines."""
    first = F.lit(start) if isinstance(start, int) else start
    lines = F.transform(
        col(arr),
        lambda x, i: F.concat(F.lit(f"{word} "), (i + first).cast("string"), F.lit(". "), x),
    )
    return F.array_join(lines, "\n")
