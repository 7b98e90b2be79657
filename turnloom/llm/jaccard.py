"""Exact n-gram Jaccard join by PartEnum signatures.

Texts become sets of hashed word shingles. Sets that are equal form a class at once. For the others,
sizes are cut into bands [l, r] with r = floor(l / threshold), so similar sets lie in the same or in
neighbouring bands; each set takes part in the join of its own band and of the next one. Within a band
similar sets differ in at most k features, k growing with r. The feature domain is partitioned by hash
into n1 parts of n2 parts each, with n1 so large that two similar sets differ in at most one feature in
some of the n1 parts (with some parts to spare), so there they agree on n2 - 1 of its n2 parts. Every
subset of n2 - 1 parts of every part gives one signature, the hash of the set's features in it, and
similar sets share at least one. Candidate pairs are verified on their sets.

Signatures of empty projections would gather unrelated sets. They are left out for a set with fewer
such parts than are to spare, since a similar pair then shares another signature; only sets with more
of them keep theirs.

No signature's group is expanded into all its pairs while links are still to be found: each member is
first compared with one centre of its group, twice with different centres, and linked members get a
common label. Only pairs with different labels are then compared, so a large group of copies costs one
comparison per member and round. What is returned is exact: all pairs that share a signature either
have one label or were compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from turnloom.llm import text as T
from turnloom.llm.components import components
from turnloom.sources.sinks import written

PARTS = 3  # n2
SKETCH = 16  # words of 64 bits
SIGNATURES = StructType([StructField("sig", LongType()), StructField("id", LongType())])
DIGESTS = StructType([StructField("id", LongType()), StructField("n", LongType()),
                      StructField("h1", LongType()), StructField("h2", LongType()),
                      StructField("sketch", BinaryType()), StructField("wide", BinaryType())])
SETS = StructType([*DIGESTS.fields[:4], StructField("grams", BinaryType())])


@lru_cache(maxsize=1 << 16)
def _band(size: int, num: int, den: int) -> tuple[int, int]:
    """Number of the band of a size, and its upper end."""
    low, number = 1, 0
    while True:
        high = low * den // num
        if size <= high:
            return number, high
        low, number = high + 1, number + 1


def differences(high: int, num: int, den: int) -> int:
    """Most features in which two similar sets of at most ``high`` features differ."""
    return (den - num) * 2 * high // (den + num)


def first_level(k: int) -> tuple[int, int]:
    """n1 and the parts to spare: at most one difference in ``spare`` + 1 parts of the n1."""
    needed = (k + 2) // 2
    spare = 1 + needed // 16
    return needed + spare, spare


def signatures(grams: np.ndarray, num: int, den: int) -> np.ndarray:
    """All signatures of one sorted set of feature hashes."""
    size = len(grams)
    if not size:
        return np.zeros(0, np.uint64)
    out = []
    own, high = _band(size, num, den)
    for band, top in ((own, high), (own + 1, (high + 1) * den // num)):
        k = differences(top, num, den)
        if not k:
            continue  # only equal sets are similar, and those are one class already
        n1, spare = first_level(k)
        cell = (T.mix(grams + np.uint64(band)) % np.uint64(n1 * PARTS)).astype(np.int64)
        sums = np.zeros(n1 * PARTS, np.uint64)
        np.add.at(sums, cell, T.mix(grams ^ np.uint64(0x5851F42D4C957F2D)))
        count = np.bincount(cell, minlength=n1 * PARTS).reshape(n1, PARTS)
        sums = sums.reshape(n1, PARTS)
        total, members = sums.sum(axis=1, dtype=np.uint64), count.sum(axis=1)
        left = total[:, None] - sums  # without one part
        empty = (members[:, None] - count) == 0
        place = np.arange(n1 * PARTS, dtype=np.uint64).reshape(n1, PARTS)
        sig = T.mix(T.mix(left + place * np.uint64(0xD1342543DE82EF95)) + np.uint64(band + 1))
        if empty.any(axis=1).sum() <= spare:
            sig = sig[~empty]
        out.append(sig.ravel())
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _digest(grams: np.ndarray) -> tuple[int, int]:
    a = T.mix(grams ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    b = T.mix(grams + np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _digests(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(g), *_digest(g), *_sketches(g)) for g in T.shingle_sets(batch.column(1), n)]
            types = [pa.int64()] * 3 + [pa.binary()] * 2
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], DIGESTS.names)

    return run


def _signatures(n: int, num: int, den: int):
    """Signatures of the first row of every class that the task meets (a repeat adds nothing).

    Of an identifier with different sets (the columns n, h1 and h2 are not null) only rows with the set
    that stands for it give any.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            sigs, own, held = [], [], 0
            stands = zip(*[batch.column(c).to_pylist() for c in (2, 3, 4)])
            for i, grams, own_set in zip(ids, T.shingle_sets(batch.column(1), n), stands):
                digest = _digest(grams)
                if digest in seen or own_set[0] is not None and own_set != (len(grams), *digest):
                    continue
                seen.add(digest)
                sigs.append(signatures(grams, num, den))
                own.append(np.full(len(sigs[-1]), i, np.int64))
                held += len(sigs[-1])
                if held > 100_000:
                    yield pa.RecordBatch.from_arrays(
                        [_signed(np.concatenate(sigs)), pa.array(np.concatenate(own))], SIGNATURES.names)
                    sigs, own, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays(
                    [_signed(np.concatenate(sigs)), pa.array(np.concatenate(own))], SIGNATURES.names)

    return run


def _sketches(grams: np.ndarray) -> tuple[bytes, bytes]:
    """Parity of the features per bit, over 1024 bits and over the power of two at or above the size.

    Differing bits bound the differing features from below.
    """
    hashed = T.mix(grams + np.uint64(0x2545F4914F6CDD1D))
    out = []
    for width in (64 * SKETCH, max(64 * SKETCH, 1 << (max(len(grams), 1) - 1).bit_length())):
        bits = (hashed % np.uint64(width)).astype(np.int64)
        odd = np.bincount(bits, minlength=width) & 1
        out.append(np.packbits(odd.astype(bool)).tobytes())
    return out[0], out[1]


@F.arrow_udf(LongType())
def _apart(left: pa.Array, right: pa.Array) -> pa.Array:
    """Differing bits of two wide sketches; the longer one is folded to the other's width."""
    out = []
    for a, b in zip(left, right):
        x, y = np.frombuffer(a.as_buffer(), np.uint8), np.frombuffer(b.as_buffer(), np.uint8)
        width = min(len(x), len(y))
        x, y = (np.bitwise_xor.reduce(v.reshape(-1, width), axis=0) for v in (x, y))
        out.append(int(np.bitwise_count(x ^ y).sum()))
    return pa.array(out, pa.int64())


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for i, grams in zip(batch.column(0).to_pylist(), T.shingle_sets(batch.column(1), n)):
                rows.append((i, len(grams), *_digest(grams), grams.astype("<u8").tobytes()))
                held += 8 * len(grams)
                if held > 4 << 20:
                    yield _set_rows(rows)
                    rows, held = [], 0
            if rows:
                yield _set_rows(rows)

    return run


def _set_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), types)], SETS.names)


@F.arrow_udf(LongType())
def _common(left: pa.Array, right: pa.Array) -> pa.Array:
    """Size of the intersection of two sorted distinct sets."""
    out = []
    for a, b in zip(left, right):
        x, y = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        out.append(int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0)
    return pa.array(out, pa.int64())


def _near(a: str, b: str, num: int, den: int) -> Column:
    """Whether sizes and sketches of two members leave room for the threshold."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(SKETCH)),
                F.lit(0))
    return ((F.least(n_a, n_b) * den >= F.greatest(n_a, n_b) * num)
            & (apart * (den + num) <= (den - num) * (n_a + n_b)))


def _verified(pairs: DataFrame, rows: DataFrame, of: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold; sets are built for the pairs' texts only."""
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    sets = rows.join(wanted, "id", "left_semi").mapInArrow(_sets(n), SETS)
    own = of.join(wanted, "id", "left_semi").select("id", "n", "h1", "h2")
    # An identifier may repeat: the row with the set that stands for it, once.
    sets = written(sets.join(own, ["id", "n", "h1", "h2"], "left_semi").dropDuplicates(["id"]), "sets")
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("grams").alias("g_a"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("grams").alias("g_b"))
    both = pairs.join(left, "a").join(right, "b")
    common = _common("g_a", "g_b")
    measured = both.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("total"), common.alias("common"))
    return written(measured.where(F.col("common") * (num + den) >= F.col("total") * num).select("a", "b"),
                   "links")


def classes(docs: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """id, n (set size), h1, h2 (digest), rep (smallest identifier with an equal set), rows, mixed.

    One row per identifier; where it repeats with different sets (mixed), the largest stands for it.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    digests = rows.where(F.col("id").isNotNull()).mapInArrow(_digests(n), DIGESTS)
    own = F.struct("n", "h1", "h2")
    per_id = written(digests.groupBy("id").agg(
        F.max(F.struct("n", "h1", "h2", "sketch", "wide")).alias("d"), F.count("*").alias("rows"),
        (F.min(own) < F.max(own)).alias("mixed")).select("id", "d.*", "rows", "mixed"), "digests")
    repeated = per_id.where("n > 0").groupBy("n", "h1", "h2").agg(
        F.min("id").alias("rep"), F.count("*").alias("ids")).where("ids > 1").drop("ids")
    joined = per_id.join(repeated, ["n", "h1", "h2"], "left")
    return written(joined.withColumn("rep", F.coalesce("rep", "id")), "classes")


def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 4, num: int = 85,
          den: int = 100) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets, and links (a, b) between class representatives that join what is similar.

    The links are a subset of all similar pairs that has the same connected components.
    """
    of = classes(docs, doc_id, text, n)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    rows = rows.where(F.col("id").isNotNull())
    mixed = written(of.where("mixed").select("id", "n", "h1", "h2"), "mixed")
    emitted = rows.join(mixed, "id", "left").select("id", "text", "n", "h1", "h2").mapInArrow(_signatures(n, num, den), SIGNATURES)
    found = written(_several(emitted, "id").select("sig", "id"), "members")
    reps = of.select("id", "rep").distinct()
    grouped = found.join(reps, "id").select("sig", F.col("rep").alias("id"))
    members = written(_several(grouped, "id").select("sig", "id").distinct(), "members")
    parts = [F.conv(F.hex(F.substring("sketch", 8 * i + 1, 8)), 16, -10).cast("long").alias(f"s{i}")
             for i in range(SKETCH)]
    sketches = written(of.join(members.select("id").distinct(), "id", "left_semi").select(
        "id", "n", *parts, "wide"), "sketches")

    near = tried = None
    open_ = members.withColumn("label", F.col("id"))
    for turn in range(2):
        group = W.partitionBy("sig")
        centre = (F.min_by("id", F.xxhash64("sig", "id")) if turn else F.min("id")).over(group)
        pairs = open_.withColumn("c", centre).where("id <> c").select(
            F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()
        pairs = _filtered(pairs, open_, sketches, tried, num, den)
        good = _verified(pairs, rows, of, n, num, den)
        tried = pairs if tried is None else tried.unionByName(pairs)
        near = good if near is None else near.unionByName(good)
        labels = written(components(near), "labels").select(
            F.col("node").alias("id"), F.col("component").alias("_label"))
        labelled = open_.drop("label").join(labels, "id", "left").select(
            "sig", "id", F.coalesce("_label", "id").alias("label"))
        open_ = written(_several(labelled, "label").select("sig", "id", "label"), "open")

    sketched = open_.join(sketches.drop("wide"), "id")
    x, y = sketched.alias("x"), sketched.alias("y")
    rest = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.id") < F.col("y.id"))
                  & (F.col("x.label") != F.col("y.label")) & _near("x", "y", num, den))
    rest = rest.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    rest = _filtered(rest, open_, sketches, tried, num, den)
    return of, near.unionByName(_verified(rest, rows, of, n, num, den))


def _several(members: DataFrame, column: str) -> DataFrame:
    """The rows of signatures under which a column has more than one value (one shuffle)."""
    group = W.partitionBy("sig")
    return members.select("*", F.min(column).over(group).alias("_lo"),
                          F.max(column).over(group).alias("_hi")).where("_lo < _hi")


def _filtered(pairs: DataFrame, members: DataFrame, sketches: DataFrame, tried: DataFrame | None,
              num: int, den: int) -> DataFrame:
    """Pairs that sizes, sketches and labels leave open and that were not compared before."""
    own = written(sketches.join(members.select("id", "label").distinct(), "id"), "labelled")
    x, y = own.alias("x"), own.alias("y")
    room = (den - num) * (F.col("x.n") + F.col("y.n"))
    kept = pairs.alias("p").join(x, F.col("p.a") == F.col("x.id")).join(y, F.col("p.b") == F.col("y.id")).where(
        _near("x", "y", num, den) & (F.col("x.label") != F.col("y.label")))
    kept = kept.select("a", "b", room.alias("room"), _apart("x.wide", "y.wide").alias("apart")).where(
        F.col("apart") * (den + num) <= F.col("room")).select("a", "b")
    if tried is not None:
        kept = kept.join(tried, ["a", "b"], "left_anti")
    return written(kept, "pairs")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 4, num: int = 85,
           den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for every row with an identifier.

    Defined cases: a null or empty text has the empty set, is linked with nothing and is its own
    component; fewer words than ``n`` make one shingle; rows with a null identifier are left out; an
    identifier that repeats is one document with the largest of its sets, and returns all its rows;
    other columns are never read; an empty table gives an empty result.
    """
    of, near = links(docs, doc_id, text, n, num, den)
    found = components(near).select(F.col("node").alias("rep"), "component")
    joined = of.join(found, "rep", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.coalesce("component", "rep").alias("component_id"), "rows")
    return joined.withColumn("rows", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int")))).drop("rows")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5,
               num: int = 80, den: int = 100) -> DataFrame:
    """One document of every component of similar texts, the one with the smallest identifier.

    All columns stay; rows with a null identifier stay, rows of one identifier stay or go together.
    """
    of, near = links(docs, doc_id, text, n, num, den)
    found = components(near).select(F.col("node").alias("rep"), "component")
    name = T.fresh("_gone", docs.columns)
    gone = of.join(found, "rep", "left").where(F.coalesce("component", "rep") != F.col("id")).select(
        F.col("id").alias(name))
    return docs.join(gone, F.col(doc_id).cast("long") == F.col(name), "left_anti")


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s
  from words),
grams as (select doc_id, len(s) as n, unnest(s) as g from sets),
links as (
  select a.doc_id as x, b.doc_id as y from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
sym as (select x, y from links union all select y, x from links),
reach(x, y) as (select x, y from sym union select r.x, b.y from reach r join sym b on r.y = b.x)
select doc_id, len(s)::bigint as n_shingles,
  least(doc_id, coalesce((select min(y) from reach where x = doc_id), doc_id)) as component_id
from sets
"""
