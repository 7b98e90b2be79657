"""Means after every row while answers arrive: carry-over prefix sums over micro-batches.

A micro-batch goes on from the totals that the batch before it committed, one row per group: running sums
inside the batch come from range partitions, the carried totals are added. Everything a batch writes lies
in folders of its number and is overwritten when the batch is repeated, and it starts from the batch before,
never from itself, so a repeated batch changes nothing. A batch counts once its mark is written, last.

Rows are in ``idx`` order, as in the batch operator. An answer at or before the last committed ``idx`` of
its group cannot get a place any more: it is kept apart, as ``late``, or as ``repeated`` if its row was
counted before. Only those few answers are looked up, in the part of the committed rows that their ids span.
Of several answers to one row in one batch the least by digest is counted, the others are kept apart.

Folders below ``out``: ``rows`` (own scores, running means, count), ``apart`` (late and repeated answers),
``state`` (totals), ``done`` (marks), each with ``batch=N`` inside.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnloom.operators import metrics
from turnloom.operators.joins import row_keys
from turnloom.operators.ranges import range_running
from turnloom.sources.sinks import exists, written

ALL = "_all"  # the one group where no columns name groups


def run_ordered(
    stream: DataFrame, samples: DataFrame, out: str, checkpoint: str, per: Sequence[str] = (),
    parts: int | None = None,
) -> None:
    """Process all files that are there, then stop; a restart goes on from the checkpoint."""

    def store(batch: DataFrame, batch_id: int) -> None:
        ordered_batch(batch, batch_id, samples, out, per, parts)

    query = (
        stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def ordered_batch(
    batch: DataFrame, batch_id: int, samples: DataFrame, out: str, per: Sequence[str] = (),
    parts: int | None = None,
) -> None:
    """Score one batch of answers and go on from the totals of the batch before."""
    spark, keys = batch.sparkSession, list(per) or [ALL]
    arrived = written(batch, "arrived")
    first, last = arrived.agg(F.min("idx"), F.max("idx")).first()
    # Reaches the scan: a sample table in idx order is read in this part only.
    known = samples.where(F.col("idx").between(first, last)) if first is not None else samples.limit(0)
    scores = metrics.row_scores(arrived.join(known, row_keys(arrived, known)))
    if not per:
        scores = scores.withColumn(ALL, F.lit(0))
    told = F.md5(F.to_json(F.struct("beams")))
    chosen = scores.groupBy(*keys, "idx").agg(
        F.min_by(F.struct(*metrics.METRICS), told).alias("s"), F.count(F.lit(1)).alias("answers"))
    before = _state(spark, out, batch_id, chosen, keys)
    placed = written(_joined(chosen, before.select(*keys, F.col("last")), keys).select(
        *keys, "idx", "s.*", "answers",
        F.coalesce(F.col("idx") > F.col("last"), F.lit(True)).alias("new")), "placed")
    _apart(spark, placed, out, batch_id, keys, first).drop(ALL).write.mode("overwrite").parquet(
        f"{out}/apart/batch={batch_id}")
    new = placed.where("new").select(*keys, "idx", *metrics.METRICS)
    sums: dict[str, Column] = {f"run_{m}": F.col(m).cast("double") for m in metrics.METRICS}
    sums["cnt"] = F.lit(1).cast("bigint")
    running = _joined(range_running(new, sums, [F.col("idx")], keys, parts), before, keys)
    count = F.col("cnt") + F.coalesce("sum_cnt", F.lit(0))
    running.select(
        *per, "idx", *metrics.METRICS, count.alias("cnt"),
        *[((F.col(f"run_{m}") + F.coalesce(f"sum_{m}", F.lit(0.0))) / count).alias(f"run_{m}")
          for m in metrics.METRICS],
    ).write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")
    added = new.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sum_cnt"), F.max("idx").alias("last"),
        *[F.sum(F.col(m).cast("double")).alias(f"sum_{m}") for m in metrics.METRICS])
    before.unionByName(added).groupBy(*keys).agg(
        F.sum("sum_cnt").alias("sum_cnt"), F.max("last").alias("last"),
        *[F.sum(f"sum_{m}").alias(f"sum_{m}") for m in metrics.METRICS],
    ).coalesce(1).write.mode("overwrite").parquet(f"{out}/state/batch={batch_id}")
    _mark(spark, out, batch_id)


def _mark(spark: SparkSession, out: str, batch_id: int) -> None:
    spark.range(1).select(F.lit(batch_id).cast("bigint").alias("number")).write.mode("overwrite").parquet(
        f"{out}/done/batch={batch_id}")


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which NULL groups meet."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.alias("l").join(right.alias("r"), same, "left").select(
        "l.*", *[f"r.{c}" for c in right.columns if c not in keys])


def _state(spark: SparkSession, out: str, batch_id: int, like: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The totals after the batch before; the first batch starts from none."""
    if batch_id == 0:
        return like.limit(0).select(
            *keys, F.lit(0).cast("bigint").alias("sum_cnt"), F.lit(0).cast("bigint").alias("last"),
            *[F.lit(0.0).alias(f"sum_{m}") for m in metrics.METRICS])
    if not exists(spark, f"{out}/done/batch={batch_id - 1}"):
        raise ValueError(f"batch {batch_id - 1} was never finished in {out}")
    return spark.read.parquet(f"{out}/state/batch={batch_id - 1}")


def _apart(spark: SparkSession, placed: DataFrame, out: str, batch_id: int, keys: Sequence[str],
           first: int | None) -> DataFrame:
    """Late and repeated answers: keys, idx, reason and how many."""
    again = placed.where("new and answers > 1").select(
        *keys, "idx", F.lit("repeated").alias("reason"), (F.col("answers") - 1).alias("answers"))
    behind = placed.where("not new").select(*keys, "idx", "answers")
    if batch_id == 0 or behind.isEmpty():
        return again
    counted = finished(spark, out, "rows", batch_id).where(F.col("idx") >= first)
    if ALL in keys:
        counted = counted.withColumn(ALL, F.lit(0))
    told = _joined(behind, counted.select(*keys, "idx", F.lit(True).alias("_counted")), [*keys, "idx"])
    return again.unionByName(told.select(
        *keys, "idx", F.when(F.col("_counted"), "repeated").otherwise("late").alias("reason"), "answers"))


def finished(spark: SparkSession, out: str, what: str, before: int | None = None) -> DataFrame:
    """``rows`` or ``apart`` of the finished batches (before a number), with ``batch``."""
    done = spark.read.parquet(f"{out}/done").select(F.col("batch").cast("bigint").alias("batch"))
    rows = spark.read.parquet(f"{out}/{what}").withColumn("batch", F.col("batch").cast("bigint"))
    if before is not None:
        done, rows = done.where(F.col("batch") < before), rows.where(F.col("batch") < before)
    return rows.join(done, "batch", "left_semi")


def totals(spark: SparkSession, out: str, per: Sequence[str] = ()) -> DataFrame:
    """Means and count per group after the last finished batch."""
    last = spark.read.parquet(f"{out}/done").agg(F.max("number")).first()[0]
    state = spark.read.parquet(f"{out}/state/batch={last}")
    return state.select(*per, F.col("sum_cnt").alias("cnt"), *[
        (F.col(f"sum_{m}") / F.col("sum_cnt")).alias(m) for m in metrics.METRICS])
