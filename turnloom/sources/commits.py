"""Record sink that can be rerun: staged folders, published by a manifest.

A run writes the records of an epoch to a new folder of its own and, when that is complete, publishes it by
creating one empty file whose name holds a version and the folder. Creating a file is atomic, so readers see
all records of a commit or none; the highest version of (run, epoch) counts, so a rerun replaces what it wrote
before. A run that stops before it publishes leaves an invisible folder, which ``vacuum`` removes.

    path/data/run=R/epoch=E/commit=ID/…        records
    path/_commits/R/E/0000000001.ID            published

Readers list the published files, one per commit, not the data.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

NAME = re.compile(r"[A-Za-z0-9._-]+")
PLACE = re.compile(r"/_commits/([^/]+)/(-?[0-9]+)/([0-9]{10,})\.([0-9a-f]{32})$")


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def stage(df: DataFrame, path: str, run: str, epoch: int = 0) -> str:
    """Write records where no reader looks yet; returns the commit's name."""
    if not NAME.fullmatch(run):
        raise ValueError(f"a run is named by letters, digits, '.', '_' and '-': {run!r}")
    commit = uuid.uuid4().hex
    df.drop("run", "epoch", "commit").write.json(f"{path}/data/run={run}/epoch={int(epoch)}/commit={commit}")
    return commit


def publish(spark: SparkSession, path: str, run: str, epoch: int, commit: str) -> int:
    """Make a staged commit the records of (run, epoch); returns its version."""
    fs, folder = _fs(spark, f"{path}/data/run={run}/epoch={int(epoch)}/commit={commit}")
    if not fs.exists(folder):
        raise ValueError(f"nothing staged as {commit}")
    versions = [v for r, e, v, _ in _entries(spark, path) if (r, e) == (run, int(epoch))]
    version = max(versions, default=0) + 1
    _, mark = _fs(spark, f"{path}/_commits/{run}/{int(epoch)}/{version:010d}.{commit}")
    if not fs.createNewFile(mark):
        raise ValueError(f"{commit} is published already")
    return version


def write_committed(df: DataFrame, path: str, run: str, epoch: int = 0) -> int:
    """Write the records of one epoch of a run; the same run again replaces them."""
    return publish(df.sparkSession, path, run, epoch, stage(df, path, run, epoch))


def _entries(spark: SparkSession, path: str) -> list[tuple[str, int, int, str]]:
    fs, pattern = _fs(spark, f"{path}/_commits/*/*/*")
    found = [PLACE.search(str(s.getPath())) for s in fs.globStatus(pattern) or []]
    return [(m[1], int(m[2]), int(m[3]), m[4]) for m in found if m]


def commits(spark: SparkSession, path: str) -> dict[tuple[str, int], str]:
    """The commit that counts per (run, epoch). Two publishers of one version: the later name counts."""
    best: dict[tuple[str, int], tuple[int, str]] = {}
    for run, epoch, version, commit in _entries(spark, path):
        best[run, epoch] = max(best.get((run, epoch), (0, "")), (version, commit))
    return {k: commit for k, (_, commit) in best.items()}


def read_committed(spark: SparkSession, path: str, schema: str, run: str | None = None) -> DataFrame:
    """All published records, or those of one run, with ``run`` and ``epoch``."""
    given = StructType.fromDDL(schema)
    fields = [f for f in given if f.name not in ("run", "epoch")]
    whole = StructType([*fields, StructField("run", StringType()), StructField("epoch", LongType())])
    places = [f"{path}/data/run={r}/epoch={e}/commit={c}" for (r, e), c in commits(spark, path).items()
              if run in (None, r)]
    if not places:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", f"{path}/data").json(places)


def next_row(spark: SparkSession, path: str, run: str, epoch: int = 0, idx: str = "idx") -> int:
    """Where a run that was broken off goes on: one past the last recorded row, for ``resume_from``."""
    rows = read_committed(spark, path, f"{idx} bigint", run).where(F.col("epoch") == epoch)
    last = rows.agg(F.max(idx)).first()[0]
    return 0 if last is None else last + 1


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove folders that no reader can see: replaced commits and unpublished ones. No run may be writing."""
    fs, pattern = _fs(spark, f"{path}/data/*/*/*")
    kept, removed = set(commits(spark, path).values()), 0
    for status in fs.globStatus(pattern) or []:
        if status.getPath().getName().removeprefix("commit=") not in kept:
            fs.delete(status.getPath(), True)
            removed += 1
    return removed
