"""Line dedup by content-defined chunks of lines and by least runs of lines.

Lines are hashed; a rolling hash over the hashes of the last lines ends a chunk wherever it is a
multiple of ``every``, so boundaries depend on the lines around them only and shift with them when
lines are put in elsewhere. A chunk of two lines or more that occurs again anywhere in the corpus is
removed everywhere but at its first place (smallest document, then position). Chunks that agree in their
hash are compared byte by byte with the first one before anything is removed.

Boundaries seldom fall on both ends of a short shared passage. So from every line on, and back from
every line, the shortest run of two lines or more with over ``LEAST_WORDS`` words (or over ``LEAST_BYTES``
bytes, for scripts without spaces) is a chunk too. Whatever run of that size occurs again is covered by
them: each of its lines begins such a run inside it, or lies in the one that ends with it. The first
occurrence of a line in the corpus always stays.

Chunks travel as digests; texts are read again only for documents that hold a repeated digest, and the
bytes of a chunk travel once per document that holds it. Counting is a sum per digest, so a chunk that
a third of all documents share is counted where it is read, and joins on it are split by Spark.

Defined cases: a null text is empty, has one empty line, and stays null; lines are separated by \\n and
kept as they are; a line on its own is never removed; repeats inside one document count; rows with a
null identifier and repeated identifiers are told apart by a digest of their text, and rows equal in
both are judged as one; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    BinaryType, LongType, StringType, StructField, StructType,
)

from turnloom.llm import text as T
from turnloom.sources.sinks import written

WINDOW, EVERY, LONGEST = 2, 3, 512
LEAST_WORDS, LEAST_BYTES = 50, 400
MULTIPLIER = 0x9E3779B97F4A7C15
CHUNKS = StructType([StructField("doc", LongType()), StructField("mark", LongType()),
                     StructField("line", LongType()), StructField("lines", LongType()),
                     StructField("h1", LongType()), StructField("h2", LongType())])
BYTES = StructType([*CHUNKS.fields, StructField("content", BinaryType())])
CLEANED = StructType([
    StructField("doc", LongType()), StructField("n_lines", LongType()),
    StructField("n_removed", LongType()), StructField("clean", StringType()),
])


def line_starts(data: np.ndarray) -> np.ndarray:
    """Where the lines of a text start, and one past the end of its last line."""
    return np.concatenate([[0], np.flatnonzero(data == 10) + 1, [len(data) + 1]])


def boundaries(hashes: np.ndarray, window: int = WINDOW, every: int = EVERY, longest: int = LONGEST
               ) -> np.ndarray:
    """First line of every chunk, and the number of lines."""
    n = len(hashes)
    rolling = np.zeros(n, np.uint64)
    for back in range(min(window, n)):
        rolling[back:] += hashes[:n - back] * np.uint64(pow(MULTIPLIER, back, 1 << 64))
    cut = np.ones(n + 1, bool)
    cut[1:n] = T.mix(rolling[:-1]) % np.uint64(every) == 0
    cuts = np.flatnonzero(cut)
    if len(cuts) > 1 and np.diff(cuts).max() > longest:  # long runs without a boundary
        cuts = np.unique(np.concatenate([
            np.arange(a, b, longest) for a, b in zip(cuts[:-1], cuts[1:])] + [[n]]))
    return cuts


def least_runs(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First line and line after the last of the shortest runs that begin or end with each line."""
    n = len(starts) - 1
    space = T.SPACE[data]
    words = np.searchsorted(np.flatnonzero(~space[1:] & space[:-1]), starts - 1)  # after a first word
    if not space[0]:
        words[1:] += 1
    lines = np.arange(n + 1)
    to, since = np.full(n + 1, n + 1), np.full(n + 1, -1)
    for size, least in ((words, LEAST_WORDS), (starts, LEAST_BYTES)):
        to = np.minimum(to, np.searchsorted(size, size + least, side="right"))
        since = np.maximum(since, np.searchsorted(size, size - least) - 1)
    to, since = np.maximum(to, lines + 2), np.minimum(since, lines - 2)
    return (np.concatenate([lines[to <= n], since[since >= 0]]),
            np.concatenate([to[to <= n], lines[since >= 0]]))


def spans(data: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
    """First line and line after the last of every chunk of two lines or more, in order."""
    if len(starts) < 3:
        return []
    cuts = boundaries(T.range_hashes(data, starts[:-1], starts[1:] - 1))
    long = np.diff(cuts) >= 2
    first, past = least_runs(data, starts)
    return sorted({*zip(cuts[:-1][long].tolist(), cuts[1:][long].tolist()), *zip(first.tolist(), past.tolist())})


def chunks(data: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(first line, number of lines, bytes) of every chunk of two lines or more."""
    starts = line_starts(data)
    raw, at = data.tobytes(), starts.tolist()
    for a, b in spans(data, starts):
        yield a, b - a, raw[at[a]:at[b] - 1]


def _mark(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def _digest(content: bytes) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(content)
    return (value >> 64) - (1 << 63), (value & ((1 << 64) - 1)) - (1 << 63)


def _text(value: pa.Scalar) -> np.ndarray:
    buffer = value.as_buffer() if value.is_valid else None
    return np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = _text(value)
            mark = _mark(data.tobytes())
            for line, n, content in chunks(data):
                out.append((doc, mark, line, n, *_digest(content)))
                if len(out) >= 100_000:
                    yield _rows(out, CHUNKS)
                    out = []
        if out:
            yield _rows(out, CHUNKS)


def _rows(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    types = {LongType(): pa.int64(), StringType(): pa.string(), BinaryType(): pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.array(c, types[f.dataType]) for c, f in zip(zip(*rows), schema)], schema.names)


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the chunks whose lines are listed."""
    for batch in batches:
        out, held = [], 0
        for doc, value, lines in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            data, wanted = _text(value), {(x["line"], x["lines"]) for x in lines}
            mark = _mark(data.tobytes())
            for line, n, content in chunks(data):
                if (line, n) in wanted:
                    out.append((doc, mark, line, n, *_digest(content), content))
                    held += len(content)
            if held > 4 << 20:
                yield _rows(out, BYTES)
                out, held = [], 0
        if out:
            yield _rows(out, BYTES)


def _cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the repeated chunks of a document, as few as hold all their lines."""
    for batch in batches:
        out = []
        for doc, mark, found in zip(*[c.to_pylist() for c in batch.columns]):
            end, best = 0, None  # lines before ``end`` are held; ``best`` reaches furthest on
            for x in sorted(found, key=lambda x: (x["line"], -x["lines"])):
                if best is not None and x["line"] > end:
                    out.append((doc, mark, *best))
                    end, best = max(end, best[0] + best[1]), None
                if x["line"] + x["lines"] > max(end, best[0] + best[1] if best else 0):
                    best = tuple(x[f] for f in CHUNKS.names[2:])
            if best is not None:
                out.append((doc, mark, *best))
        if out:
            yield _rows(out, CHUNKS)


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, held = [], 0
        for doc, value, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            data = _text(value)
            starts = line_starts(data)
            n, gone = len(starts) - 1, np.zeros(len(starts) - 1, bool)
            for span in spans or ():
                gone[span["line"]:span["line"] + span["lines"]] = True
            raw = data.tobytes()
            text = raw.decode() if not gone.any() else b"\n".join(
                raw[starts[i]:starts[i + 1] - 1] for i in np.flatnonzero(~gone)).decode()
            out.append((doc, n, int(gone.sum()), text if value.is_valid else None))
            held += len(text)
            if held > 4 << 20:
                yield _rows(out, CLEANED)
                out, held = [], 0
        if out:
            yield _rows(out, CLEANED)


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, mark and the array ``spans`` (line, lines) of the chunks to remove, per document."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("binary").alias("text"))
    found = written(rows.mapInArrow(_chunked, CHUNKS), "chunks")
    place = F.struct(F.col("doc").isNull().alias("null"), "doc", "mark", "line", "lines")
    repeated = written(found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where(
        "n > 1").select("h1", "h2", "first"), "repeated")
    is_first = F.col("doc").eqNullSafe(F.col("first.doc"))
    for part in ("mark", "line", "lines"):
        is_first &= F.col(part) == F.col(f"first.{part}")
    # Chunks overlap; only those that hold all repeated lines of a document, and their firsts, are compared.
    later = found.join(repeated, ["h1", "h2"]).where(~is_first).groupBy("doc", "mark").agg(
        F.collect_set(F.struct("line", "lines", "h1", "h2")).alias("found"))
    later = written(later.mapInArrow(_cover, CHUNKS), "later")
    at = ["doc", "mark", "line", "lines"]
    firsts = repeated.join(later.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    wanted = later.select(at).unionByName(firsts.select([f"first.{c}" for c in at])).groupBy("doc", "mark").agg(
        F.collect_set(F.struct("line", "lines")).alias("wanted"))
    content = _joined(rows, wanted, "wanted", "inner").mapInArrow(_bytes, BYTES).dropDuplicates(at)
    content = written(content, "contents").join(repeated, ["h1", "h2"])
    firsts = content.where(is_first).select("h1", "h2", F.col("content").alias("original"))
    same = content.where(~is_first).join(firsts, ["h1", "h2"]).where(F.col("content") == F.col("original"))
    return same.groupBy("doc", "mark").agg(
        F.collect_list(F.struct("line", "lines")).alias("spans"))


@F.arrow_udf(LongType())
def _marks(column: pa.Array) -> pa.Array:
    return pa.array([_mark(_text(v).tobytes()) for v in column], pa.int64())


def _joined(rows: DataFrame, per_doc: DataFrame, column: str, how: str) -> DataFrame:
    """doc, text and the array of the document's marks; documents meet on identifier and digest."""
    right = per_doc.withColumnsRenamed({"doc": "_doc", "mark": "_mark"})
    marked = rows.withColumn("mark", _marks("text"))
    on = (F.col("mark") == F.col("_mark")) & F.col("doc").eqNullSafe(F.col("_doc"))
    return marked.join(right, on, how).select("doc", "text", column)


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, n_lines, n_removed and the text without repeated chunks, one row per row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("binary").alias("text"))
    gone = removals(docs, doc_id, text)
    return _joined(rows, gone, "spans", "left").mapInArrow(_clean, CLEANED)


def op10_line_chunks(spark, sf_dir: str) -> DataFrame:
    out = cleaned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        F.col("doc").alias("doc_id"), "n_lines", "n_removed",
        F.char_length("clean").cast("long").alias("clean_chars"),
        F.sha2("clean", 256).alias("clean_sha256"))
