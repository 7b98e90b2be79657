"""Session settings the tables need."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROW_READER = "spark.sql.parquet.enableNestedColumnVectorizedReader"


def wide_rows(spark: SparkSession) -> SparkSession:
    """Read nested columns row by row instead of in batches of 4096 rows.

    One row of the passage table holds all passages of a sample, so a batch of them may need
    gigabytes in every task. Tables with flat columns only keep the batch reader.
    """
    spark.conf.set(ROW_READER, "false")
    return spark
