"""Sinks: scored rows, summaries, re-ranked passages, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from turnloom.operators.passages import SharedLists
from turnloom.operators.positions import block_start

FIRST_ROWS = 100
RECORD = (
    "CONTEXT", "GEN", "ANSWER", "hitgen", "hit_scores", "bleu_scores", "sample_bleu_scores",
    "contain", "llama_hit", "beam_scores", "espresso_hit",
)

ROUND = 1 << 30  # characters that a round of ``write_knowledge`` deals at least, however little the lists hold
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LOCAL: dict[str, str] = {}  # application to its folder in local mode


def _scratch(spark: SparkSession) -> str:
    """The application's folder below the shared one the cluster names; a local one in local mode only."""
    base, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="turnloom-")
        base = _LOCAL[app]
    return f"{base.rstrip('/')}/turnloom/{app}"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder of this application."""
    return f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def release(spark: SparkSession) -> None:
    """Remove everything this application wrote below the shared folder, when its results are read."""
    fs, place = _fs(spark, _scratch(spark))
    fs.delete(place, True)


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Cut the lineage: write a table to the shared folder and read it back."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a complete table? Spark marks a folder when all of its files are there."""
    fs, mark = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(mark)


def discard(df: DataFrame) -> None:
    """Remove the folder of a table from ``written`` that nothing will read again."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = file.rpartition("/")[0]
        if f"/turnloom/{spark.sparkContext.applicationId}/" in folder:
            fs, place = _fs(spark, folder)
            fs.delete(place, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the query that wrote them ends, not when the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def bucketed(df: DataFrame, name: str, key: str = "idx", buckets: int | None = None,
             compression: str | None = None) -> tuple[str, DataFrame]:
    """Write a table bucketed by its row key below the shared folder.

    Tables with the same bucketing join on the key without a shuffle. One shuffle here pays for
    every later join; the number of buckets follows ``spark.sql.shuffle.partitions``. Files are not
    sorted, since a bucketed scan does not hand that order on.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"turnloom_{name}_{uuid.uuid4().hex}"
    options = {"path": scratch_dir(spark, name)} | ({"compression": compression} if compression else {})
    df.repartition(n, key).write.bucketBy(n, key).options(**options).saveAsTable(table)
    return table, spark.table(table)


def write_scored(
    df: DataFrame, path: str, write: bool = True, first_rows: int = FIRST_ROWS
) -> None:
    """Append scored records as JSON lines; with ``write`` off only the ``first_rows`` (per epoch)."""
    rows = df if write else df.where(F.col("cnt") <= first_rows)
    keys = [c for c in df.columns if c not in (*RECORD, "cnt")]
    rows.select(*keys, *RECORD).write.mode("append").json(path)


def write_summary(df: DataFrame, path: str) -> None:
    """Append the final metrics as one JSON line."""
    df.write.mode("append").json(path)


def write_layout(
    df: DataFrame, path: str, model: str, run_name: str, run_date: Column | None = None
) -> None:
    """Results below model / month and day / run name."""
    day = F.date_format(F.current_date(), "MMdd") if run_date is None else run_date
    out = df.withColumns({
        "model": F.lit(model.replace("/", "-")), "run_date": day, "run_name": F.lit(run_name),
    })
    out.write.mode("append").partitionBy("model", "run_date", "run_name").json(path)


def write_knowledge(
    df: DataFrame | SharedLists, path: str, block: int = 100, compression: str | None = None
) -> None:
    """Passages as JSON array files of ``block`` rows below ``start=N`` directories.

    Compressed files cannot be split by a reader. Shared lists are dealt to the blocks of the rows that name
    them, whose whole text is shuffled nowhere else.
    """
    if isinstance(df, SharedLists):
        return _write_shared(df, path, block, compression)
    blocks = df.groupBy(block_start(F.col("idx"), block).alias("start")).agg(
        F.sort_array(F.collect_list(F.struct("idx", "predicted_know"))).alias("rows")
    )
    arrays = F.to_json(
        F.transform("rows", lambda r: F.struct(r["predicted_know"].alias("predicted_know")))
    )
    blocks.select("start", arrays.alias("value")).write.partitionBy("start").text(path, compression)


def _write_shared(know: SharedLists, path: str, block: int, compression: str | None) -> None:
    """Lists are stored once, then dealt to blocks of rows in rounds, each about as much as all lists hold.

    What a round has shuffled goes when it ends, so the disk holds the files, the lists once and one round. A block's
    rows follow each other into its file: no block has to fit into memory.
    """
    spark = know.refs.sparkSession
    whole = W.partitionBy("start")
    chars = F.aggregate("passages", F.lit(0).cast("bigint"), lambda n, p: n + F.coalesce(F.length(p), F.lit(0)))
    with shuffles_dropped(spark):
        refs = written(know.refs.select("idx", "pos", "list", block_start(F.col("idx"), block).alias("start"))
                       .withColumns({"first": F.min("idx").over(whole), "last": F.max("idx").over(whole)}), "refs")
        table, lists = bucketed(know.lists.select("list", "passages", F.coalesce(chars, F.lit(0)).alias("chars")),
                                "lists", "list", compression="zstd")
        named = refs.groupBy("list").agg(F.count(F.lit(1)).alias("n")).join(lists.select("list", "chars"), "list")
        dealt = named.agg(F.sum(F.col("n") * F.col("chars"))).first()[0] or 0
        once = lists.agg(F.sum("chars")).first()[0] or 0
        rounds = max(1, -(-dealt // max(once, ROUND)))
        for n in range(rounds):
            turn = F.pmod(F.floor(F.coalesce("start", F.lit(0)) / block), F.lit(rounds)) == n
            _write_blocks(SharedLists(refs.where(turn), lists.drop("chars")).rows("start", "first", "last"), path,
                          compression, "append" if n else "error")
    discard(refs)
    discard(lists)
    spark.sql(f"DROP TABLE {table}")


def _write_blocks(rows: DataFrame, path: str, compression: str | None, mode: str) -> None:
    """Rows of whole blocks, one after another in one line; ``first`` and ``last`` name the rows that open and close the array."""
    line = F.concat(
        F.when(F.col("idx").eqNullSafe(F.col("first")), "[").otherwise(","), F.to_json(F.struct("predicted_know")),
        F.when(F.col("idx").eqNullSafe(F.col("last")), "]").otherwise(""))
    lines = rows.select("start", "idx", line.alias("value")).sortWithinPartitions("start", "idx")
    lines.select("start", "value").write.mode(mode).partitionBy("start").text(path, compression, lineSep=" ")


def write_templates(spark: SparkSession, templates: dict[str, dict[str, str]], path: str) -> None:
    rows = [(k, t["prompt_input"], t["prompt_no_input"], t["response_split"])
            for k, t in templates.items()]
    schema = "name string, prompt_input string, prompt_no_input string, response_split string"
    spark.createDataFrame(rows, schema).write.partitionBy("name").json(path)
