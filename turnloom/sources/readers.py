"""Sources: samples, passages, prompt templates, generations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from turnloom.sources import schemas
from turnloom.sources.session import wide_rows


def read_samples(spark: SparkSession, path: str, split: str, fmt: str = "parquet") -> DataFrame:
    """A sample table (Parquet or JSON lines) tagged with its split."""
    return spark.read.schema(schemas.SAMPLE).format(fmt).load(path).withColumn(
        "split", F.lit(split)
    )


def read_both(spark: SparkSession, train_path: str, test_path: str, fmt: str = "parquet") -> DataFrame:
    return read_samples(spark, train_path, "train", fmt).unionByName(
        read_samples(spark, test_path, "test", fmt)
    )


def read_knowledge(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Passages from JSON **array** files; the position in the array is the row index.

    A JSON array cannot be split, so one file is one task. A large list therefore comes as
    directories ``start=N``, each with the array of the rows from N on; a single file without
    that directory starts at 0. Train and test lists both count from 0: name their ``split``, so
    that the union of both tables joins the right samples.
    """
    files = spark.read.option("wholetext", True).text(path)
    start = F.col("start").cast("bigint") if "start" in files.columns else F.lit(0).cast("bigint")
    rows = files.select(
        start.alias("start"), F.posexplode(F.from_json("value", schemas.KNOWLEDGE_ARRAY))
    )
    named = [] if split is None else [F.lit(split).alias("split")]
    return rows.select(
        (F.col("start") + F.col("pos")).alias("idx"), *named, F.col("col.predicted_know")
    )


RECORD_START = '{"predicted_know"'


def read_knowledge_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """The same rows from JSON array files of any size, each read by as many tasks as it has splits.

    Records are told apart at ``{"predicted_know"``, which cannot stand inside a JSON string, since its quotes
    would be escaped there. The files are read twice and written nowhere: the first pass counts the records of every
    split, which gives every split its first number, so nothing passes through one task.

    A record that is no valid JSON has a NULL list; an element that is not an object with that first key (a
    ``null``, say) and a file that does not begin with an array raise. ``[]`` has no rows.
    """
    pieces = spark.read.option("lineSep", RECORD_START).text(path)
    start = F.col("start").cast("bigint") if "start" in pieces.columns else F.lit(0).cast("bigint")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
             F.monotonically_increasing_id().alias("place")]
    # Behind a record stand a comma or the closing bracket, with white space; a piece that is none gives "".
    record = F.regexp_extract("value", r"(?s)\A(\s*:.*\})\s*[,\]]?\s*\z", 1)
    parsed = F.from_json(F.concat(F.lit(RECORD_START), "record"), schemas.KNOWLEDGE_RECORD)
    rows = pieces.select(
        start.alias("start"), *place, F.rlike("value", F.lit(r"\A\s*\[\s*\]?\s*\z")).alias("opens"),
        record.alias("record"))
    # One row per split, as the file listing has: the only windows are over the splits of a file, and whole
    # records stay where they are. Both passes have the same plan for the files, so places agree.
    splits = pieces.select(*place).groupBy("file", "block").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = rows.join(F.broadcast(splits), ["file", "block"], "left")
    # The first piece of a file is the bracket that opens the array; every other must be a record.
    inside = F.col("place") - F.col("first")
    number = F.col("before") + inside - 1
    wrong = F.when(number < 0, ~F.col("opens")).otherwise(F.col("record") == "")
    checked = F.when(F.coalesce((inside >= 0) & (inside < F.col("n")), F.lit(False)), F.when(wrong, F.raise_error(F.concat(
        F.lit("not an array of records that begin with predicted_know: "), "file"))).otherwise(number)).otherwise(
        F.raise_error(F.concat(F.lit("read otherwise than it was counted: "), "file")).cast("bigint"))
    named = [] if split is None else [F.lit(split).alias("split")]
    return placed.withColumn("_number", checked).where("_number >= 0").select(
        (F.col("start") + F.col("_number")).alias("idx"), *named, parsed["predicted_know"].alias("predicted_know"))


def read_knowledge_table(
    spark: SparkSession, path: str, fmt: str = "parquet", split: str | None = None
) -> DataFrame:
    """Passages from a splittable table with an explicit index, tagged with their split if named."""
    rows = wide_rows(spark).read.schema(schemas.KNOWLEDGE).format(fmt).load(path)
    return rows if split is None else rows.withColumn("split", F.lit(split))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Prompt templates, one JSON object per file, named by file or by a ``name=`` directory."""
    files = spark.read.option("multiLine", True).json(path)
    if "name" in files.columns:
        name = F.col("name")
    else:
        name = F.regexp_replace("_metadata.file_name", r"\.json$", "")
    return files.select(
        name.alias("name"),
        *[
            (F.col(c) if c in files.columns else F.lit("")).alias(c)
            for c in ("prompt_input", "prompt_no_input", "response_split")
        ],
    )


def load_templates(spark: SparkSession, path: str) -> dict[str, dict[str, str]]:
    """The templates as planning-time literals: one short row per prompt name."""
    return {
        r["name"]: {k: r[k] or "" for k in ("prompt_input", "prompt_no_input", "response_split")}
        for r in read_templates(spark, path).collect()
    }


def read_generations(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.GENERATION).format(fmt).load(path)


def stream_generations(
    spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 1
) -> DataFrame:
    """Generations as they arrive as files."""
    return (
        spark.readStream.schema(schemas.GENERATION).format(fmt)
        .option("maxFilesPerTrigger", files_per_trigger).load(path)
    )
