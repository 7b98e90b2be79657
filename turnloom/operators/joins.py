"""Joins and set operations on rows aligned by ``idx`` and on the topic dictionary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F

from turnloom.functions.lists import let
from turnloom.functions.text import norm_space, strip
from turnloom.operators.passages import SharedLists

NO_KNOWLEDGE = "array(cast(array() as array<string>))"


def row_keys(*tables: DataFrame) -> list[str]:
    """``idx``, and ``split`` where all tables have it: each split may count its rows from 0."""
    return ["idx", "split"] if all("split" in t.columns for t in tables) else ["idx"]


def merge_knowledge(
    samples: DataFrame, know: DataFrame | SharedLists, combined: bool = False, disable_know: bool = False
) -> DataFrame:
    """Attach the passages of each row; rows past the knowledge table keep NULL.

    Passages with a ``split`` go to the rows of that split only.
    """
    if isinstance(know, SharedLists):
        if not disable_know:
            return know.joined(samples.drop("predicted_know")).withColumn("combined", F.lit(combined))
        know = know.refs.select("idx").distinct()
    lists = F.expr(NO_KNOWLEDGE) if disable_know else F.col("predicted_know")
    keys = row_keys(samples, know)
    right = know.select(*keys, lists.alias("predicted_know"))
    joined = samples.drop("predicted_know").join(right, keys, "left")
    return joined.withColumn("combined", F.lit(combined))


def unmatched_knowledge(samples: DataFrame, know: DataFrame) -> DataFrame:
    """Knowledge rows without a sample; a correct input has none."""
    keys = row_keys(samples, know)
    return know.join(samples.select(*keys), keys, "left_anti")


def merge_observed(
    samples: DataFrame, know: DataFrame, combined: bool = False
) -> tuple[DataFrame, Observation]:
    """``merge_knowledge`` and the counts of both sides, taken by the pass that merges.

    The observation holds ``samples``, ``knowledge``, ``bare`` (samples without passages) and ``unmatched``
    (passages without a sample) once an action has run; ``check_observed`` raises on the last.
    """
    keys = row_keys(samples, know)
    left = samples.drop("predicted_know").withColumn("_sample", F.lit(True))
    right = know.select(*keys, "predicted_know", F.lit(True).alias("_know"))
    seen = Observation()
    both = left.join(right, keys, "full").observe(
        seen, F.count("_sample").alias("samples"), F.count("_know").alias("knowledge"),
        F.count_if(F.col("_know").isNull()).alias("bare"),
        F.count_if(F.col("_sample").isNull()).alias("unmatched"))
    merged = both.where("_sample").select(*samples.drop("predicted_know").columns, "predicted_know")
    return merged.withColumn("combined", F.lit(combined)), seen


def check_observed(seen: Observation) -> dict[str, int]:
    """The counts of ``merge_observed``; passages that no sample takes raise."""
    counts = seen.get
    if counts["unmatched"]:
        raise ValueError(f"{counts['unmatched']} passage lists have no sample: {counts}")
    return counts


def topic_list(*samples: DataFrame) -> DataFrame:
    """Distinct gold topics of several sample tables: the item dictionary."""
    topics = samples[0].select("topic")
    for more in samples[1:]:
        topics = topics.unionByName(more.select("topic"))
    return topics.distinct()


def topic_semi(df: DataFrame, topics: DataFrame, topic: str = "predicted_topic") -> DataFrame:
    """Rows whose stripped topic is in the dictionary (normalised there, case kept).

    The dictionary grows with the data, so it is never forced into a broadcast: Spark
    broadcasts it below its size threshold. Above that, adaptive execution splits the left
    side of a hot topic, whatever its share.
    """
    left = df.withColumn("_topic", strip(topic))
    entries = topics.select(norm_space("topic").alias("_topic")).distinct()
    return left.join(entries, "_topic", "left_semi").drop("_topic")


def first_occurrence(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The first row of every key by position."""
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(pos)))
    return ranked.where("_rank = 1").drop("_rank")


def known_positions(
    df: DataFrame, topics: DataFrame, keys: Sequence[str] = ("idx",)
) -> DataFrame:
    """The row keys and ``kept``: first positions of the predicted topics found in the dictionary.

    Repeats are dropped inside the row; only (keys, position, topic) is exploded and shuffled.
    """
    firsts = F.filter(
        F.transform(
            "predicted_topic",
            lambda t, i: F.when(
                F.array_position("predicted_topic", t) == i + 1,
                F.struct(i.alias("pos"), t.alias("predicted_topic")),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    exploded = df.select(*keys, F.inline(firsts))
    known = topic_semi(exploded, topics)
    return known.groupBy(*keys).agg(F.sort_array(F.collect_list("pos")).alias("kept"))


def keep_positions(
    df: DataFrame, kept: DataFrame | None = None, keys: Sequence[str] = ("idx",)
) -> DataFrame:
    """Cut topics, confidences and passages to the kept positions, or to the first one.

    Without ``kept`` the rows hold them already, in a column of that name, which goes.
    Positions past the end of the shortest of the three lists do not count.
    """
    names = [
        n for n in ("predicted_topic", "predicted_topic_confidence", "predicted_know")
        if n in df.columns
    ]
    sizes = [F.size(n) for n in names]
    shortest = F.least(*sizes) if len(sizes) > 1 else sizes[0]
    inside = let(shortest, lambda n: F.filter("kept", lambda p: p < n))
    joined = (df if kept is None else df.join(kept, list(keys), "left")).withColumn("kept", inside)
    joined = joined.withColumn(
        "kept", F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.array(F.lit(0)))
    )
    picked = {n: _at(F.col(n)) for n in names}
    return joined.withColumns(picked).select(*[c for c in df.columns if c != "kept"])


def _at(arr: Column) -> Column:
    inside = F.filter("kept", lambda p: p < F.size(arr))
    return F.when(arr.isNotNull(), F.transform(inside, lambda p: F.get(arr, p)))


def db_check(df: DataFrame, topics: DataFrame, keys: Sequence[str] = ("idx",)) -> DataFrame:
    """Keep the predicted topics (with confidence and passages) found in the dictionary; a row
    that keeps nothing falls back to its first topic."""
    return keep_positions(df, known_positions(df, topics, keys), keys)


def union_with_without_know(with_know: DataFrame, without: DataFrame) -> DataFrame:
    """Rows with knowledge followed by the same rows without; ``copy`` tells them apart."""
    return with_know.withColumn("copy", F.lit(0)).unionByName(without.withColumn("copy", F.lit(1)))


def eval_join(
    generations: DataFrame, samples: DataFrame, know: DataFrame | SharedLists | None = None
) -> DataFrame:
    """Generations with their samples and, if given, their raw passages."""
    joined = generations.join(samples, row_keys(generations, samples))
    if isinstance(know, SharedLists):
        return know.joined(joined, "inner")
    return joined if know is None else joined.join(know, row_keys(joined, know))
