"""Language identification: averaged hashed subword embeddings and a linear softmax, trained in numpy.

A text is the average of the embeddings of its subwords: all runs of 1 to 3 bytes inside a word with
its borders, hashed into 2^14 rows. A softmax over the average gives the languages. Both layers are
trained by stochastic gradient descent on a bounded sample of labelled texts; a temperature and a
rejection threshold are then calibrated on a part of the sample that training did not see. As both
layers are linear before the softmax, prediction adds one precomputed row of scores per subword.

Defined cases: a null text or one without a letter is ``und`` with score 0; whole texts are read,
however long; rows with a null label are not learned from, an empty one is a label like others; with one label or none, every text
with a letter gets that label, or ``und``; an empty table gives an empty result; repeated rows are
predicted alike; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    BinaryType, BooleanType, DoubleType, LongType, StringType, StructField, StructType,
)

from turnloom.llm import text as T

BITS, ORDERS = 14, (1, 2, 3)
SAMPLE = 1500  # texts per label that training may see, on average
SECTION = T.PIECE // 2  # bytes that are worked on at a time, of many texts or of one
TOTAL, LABELS = 12_000, 256  # texts of all labels together, on average, and labels it may see
DIMENSIONS, EPOCHS, RATE = 16, 6, 0.5
CALIBRATION = 4  # every fourth text of the sample
TARGET = 0.99  # accuracy wanted of what is not rejected
VECTORS = StructType([StructField("label", StringType()), StructField("at", BinaryType()),
                      StructField("n", BinaryType())])
PREDICTED = StructType([
    StructField("doc_id", LongType()), StructField("held_out", BooleanType()),
    StructField("lang_pred", StringType()), StructField("score", DoubleType()),
    StructField("rejected", BooleanType()),
])


def sections(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The bytes of a column in sections: bytes, where each row starts in them, starts of subwords.

    A section has the bytes after its own that a subword may reach into. Rows outside it are empty there.
    """
    data, offsets = T.text_bytes(column)
    for at in range(0, len(data), SECTION):
        end = min(at + SECTION + max(ORDERS) - 1, len(data))
        yield data[at:end], np.clip(offsets - at, 0, end - at), min(SECTION, end - at)


def subwords(data: np.ndarray, offsets: np.ndarray, starts: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashed subwords that begin in the first ``starts`` bytes, and their rows, in order for each length."""
    low = T.LOWER[data]
    low = np.where(T.SPACE[low], np.uint8(0x20), low).astype(np.uint32)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    codes, owner = [], []
    for n in ORDERS:
        if len(low) < n:
            continue
        code = np.zeros(len(low) - n + 1, np.uint32)
        for i in range(n):
            code = code * np.uint32(256) + low[i:len(low) - n + 1 + i]
        inside = row[:len(row) - n + 1] == row[n - 1:]
        if n > 1:  # white space only at the borders
            for i in range(1, n - 1):
                inside &= low[i:len(low) - n + 1 + i] != 0x20
        else:
            inside &= low != 0x20
        inside[starts:] = False
        hashed = (code + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        hashed ^= hashed >> np.uint32(15)
        hashed *= np.uint32(0xC2B2AE35)
        codes.append((hashed >> np.uint32(32 - BITS))[inside])
        owner.append(row[:len(row) - n + 1][inside])
    return codes, owner


def counted(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per row, its different subwords and their shares."""
    for lo, hi in T.row_ranges(column, SECTION):
        found = [np.zeros(0, np.int64)] * (hi - lo)
        for section in sections(column.slice(lo, hi - lo)):
            codes, owner = subwords(*section)
            code = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
            own = np.concatenate(owner) if owner else np.zeros(0, np.int64)
            order = np.argsort(own, kind="stable")
            code = code[order].astype(np.int64)
            edges = np.searchsorted(own[order], np.arange(hi - lo + 1))
            for i in np.flatnonzero(np.diff(edges)):
                n = np.bincount(code[edges[i]:edges[i + 1]], minlength=len(found[i]))
                n[:len(found[i])] += found[i]
                found[i] = n
        for n in found:
            at = np.flatnonzero(n)
            yield at, n[at] / max(1, n.sum())


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # score of every subword for every label
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        z = (scores + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 7) -> Model:
    """SGD over texts in random order, one text a step, with a falling rate."""
    names = sorted(set(labels))
    if not names:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    y = np.array([names.index(label) for label in labels])
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 1 / DIMENSIONS, (1 << BITS, DIMENSIONS))
    weight, bias = np.zeros((DIMENSIONS, len(names))), np.zeros(len(names))
    held = np.arange(len(y)) % CALIBRATION == CALIBRATION - 1
    steps, done = EPOCHS * int((~held).sum()), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(np.flatnonzero(~held)):
            rate = RATE * (1 - done / steps)
            done += 1
            at, share = vectors[i]
            if not len(at):
                continue
            hidden = share @ embedding[at] * 10
            z = hidden @ weight + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = weight @ p
            weight -= rate * np.outer(hidden, p)
            bias -= rate * p
            embedding[at] -= rate * 10 * np.outer(share, back)
    model = Model(names, (embedding @ weight * 10).astype(np.float32), bias)
    if held.any() and len(names) > 1:
        _calibrate(model, [vectors[i] for i in np.flatnonzero(held)], y[held])
    return model


def _calibrate(model: Model, vectors: list, y: np.ndarray) -> None:
    """Temperature by likelihood; then the lowest threshold that keeps ``TARGET`` accuracy."""
    scores = np.array([share @ model.table[at] if len(at) else np.zeros(len(model.labels))
                       for at, share in vectors])
    loss = {}
    for t in np.geomspace(0.25, 8, 41):
        model.temperature = float(t)
        loss[float(t)] = -np.log(np.maximum(model.probabilities(scores)[np.arange(len(y)), y], 1e-12)).sum()
    model.temperature = min(loss, key=loss.get)
    p = model.probabilities(scores)
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-top)
    accuracy = np.cumsum(right[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(accuracy >= TARGET)
    model.reject_below = 1.0 if not len(good) else 0.0 if good[-1] == len(y) - 1 else float(top[order][good[-1]])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(at.astype("<i4").tobytes(), share.astype("<f4").tobytes())
                for at, share in counted(T.one_array(batch.column(1)))]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.binary()) for c in zip(*rows)]], VECTORS.names)


def fit(labelled: DataFrame, label: str, text: str, key: Column, sample: int = SAMPLE,
        total: int = TOTAL, labels: int = LABELS) -> Model:
    """Train on about ``sample`` texts of every label; all if there are fewer.

    About ``total`` texts are learned from and collected at most, equally many of every label, and of more
    than ``labels`` labels the most frequent. Rows are chosen by a hash of key and text, so one identifier
    with many texts is sampled like many identifiers, and a row that repeats counts once.
    """
    rows = labelled.select(F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text"),
                           key.cast("string").alias("key")).where("label is not null and text is not null")
    hashed = rows.withColumn("hash", F.xxhash64("key", "text"))
    # Sketches of the different rows are merged map-side, so a label of any size is one row after the shuffle.
    counts = hashed.groupBy("label").agg(F.approx_count_distinct("hash", 0.01).alias("rows"))
    common = counts.orderBy(F.desc("rows"), "label").limit(labels).collect()
    each = min(sample, total / max(len(common), 1))
    shares = labelled.sparkSession.createDataFrame(
        [(r.label, min(1.0, each / r.rows)) for r in common], "label string, share double")
    picked = hashed.join(F.broadcast(shares), "label").where(
        F.pmod("hash", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    picked = picked.select("label", "text", "key").distinct()
    found = picked.select("label", "text").mapInArrow(_vectors, VECTORS).collect()
    found.sort(key=lambda r: (r["label"], bytes(r["at"]), bytes(r["n"])))
    rng = np.random.default_rng(11)
    order = rng.permutation(len(found))
    vectors = [(np.frombuffer(found[i]["at"], "<i4"), np.frombuffer(found[i]["n"], "<f4")) for i in order]
    return train(vectors, [found[i]["label"] for i in order])


def _letters(column: pa.Array) -> np.ndarray:
    """Whether a text has a letter."""
    found = np.zeros(len(column), bool)
    for data, offsets, starts in sections(column):
        low = T.LOWER[data[:starts]]
        row = np.searchsorted(offsets, np.flatnonzero((low >= 97) & (low <= 122)), side="right") - 1
        found[row] = True
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in column[int(i)].as_py() or "")
    return found


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = T.one_array(batch.column(2))
            for lo, hi in T.row_ranges(texts, SECTION):
                piece, rows = texts.slice(lo, hi - lo), hi - lo
                scores, n = np.zeros((rows, len(model.labels))), np.zeros(rows)
                for code, own in ((c, o) for section in sections(piece) for c, o in zip(*subwords(*section))):
                    edges = np.searchsorted(own, np.arange(rows + 1))
                    n += np.diff(edges)
                    for k in range(len(model.labels)):
                        sums = np.concatenate([[0.0], np.cumsum(model.table[code, k], dtype=np.float64)])
                        scores[:, k] += sums[edges[1:]] - sums[edges[:-1]]
                known = _letters(piece) & bool(model.labels)
                best, top = np.full(rows, "und", object), np.zeros(rows)
                if model.labels:
                    p = model.probabilities(scores / np.maximum(n, 1)[:, None])
                    best = np.where(known, np.array(model.labels, object)[p.argmax(axis=1)], "und")
                    top = np.where(known, p.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, rows), batch.column(1).slice(lo, rows),
                     pa.array(best.tolist(), pa.string()), pa.array(top),
                     pa.array(~known | (top < model.reject_below))], PREDICTED.names)

    return run


def predict(docs: DataFrame, model: Model, held_out: Column, doc_id: str = "doc_id", text: str = "text"
            ) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected (too uncertain for the calibrated accuracy)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out"),
                       F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_predict(model), PREDICTED)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs.where(~held_out), "lang", "text", F.col("doc_id"))
    return predict(docs, model, held_out)
