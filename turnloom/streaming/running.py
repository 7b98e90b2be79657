"""Running metrics over generations that arrive as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnloom.operators import metrics


def stream_metrics(
    stream: DataFrame, samples: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Totals so far per group: a stream-static join and a grouped aggregate.

    The state holds one row per group, not the answers.
    """
    rows = metrics.row_scores(stream.join(samples, "idx"))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cnt"), *[F.avg(m).alias(m) for m in metrics.METRICS]
    )


def run_available(totals: DataFrame, out: str, checkpoint: str) -> None:
    """Process all files that are there, then stop; a restart goes on from the checkpoint.

    Every trigger overwrites its own folder, so a repeated batch leaves the same result. A batch is
    listed as done after its state is written.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/state/batch={batch_id}")
        done = batch.sparkSession.range(1).select(F.lit(batch_id).cast("bigint").alias("batch"))
        done.write.mode("overwrite").parquet(f"{out}/done/{batch_id}")

    query = (
        totals.writeStream.outputMode("complete").foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The state after the last finished batch."""
    done = spark.read.schema("batch bigint").parquet(f"{out}/done/*")
    return spark.read.parquet(f"{out}/state/batch={done.agg(F.max('batch')).first()[0]}")
