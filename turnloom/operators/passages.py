"""Passage dictionary: lists hold digests, every distinct passage is stored, cut and encoded once.

A sample carries the passages of all its predicted items, and an item the same passages for all samples, so
nearly every text is a copy. The dictionary (digest, text) holds each once; lists of digests take 32 bytes a
passage through shuffles and gates; whole texts come back in one join at the end, for the passages that are
still wanted.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.types import ArrayType, BinaryType

from turnloom.functions import tokens
from turnloom.functions.tokens import Tokenizer

REFS = "passage_refs"
LEAST = 4  # a packed list takes at least this part of its size, so a batch of packed lists stays small unpacked


def digest(passage: Column) -> Column:
    return F.unhex(F.sha2(passage, 256))


def references(know: DataFrame) -> DataFrame:
    """``predicted_know`` replaced by lists of digests, in the row, without a shuffle."""
    refs = F.transform("predicted_know", lambda one: F.transform(one, digest))
    return know.withColumn(REFS, refs).drop("predicted_know")


def dictionary(*know: DataFrame) -> DataFrame:
    """(digest, text) of the distinct passages of knowledge tables; NULL passages have no entry.

    Copies fall together in the task that reads them, before the shuffle.
    """
    texts = None
    for table in know:
        part = table.select(F.explode(F.flatten("predicted_know")).alias("text")).where("text is not null")
        texts = part if texts is None else texts.unionByName(part)
    return texts.groupBy(digest(F.col("text")).alias("digest")).agg(F.first("text").alias("text"))


def cut_once(passages: DataFrame, passage_cutoff: int, tok: Tokenizer | None = None,
             seen: Observation | None = None) -> DataFrame:
    """Every dictionary text cut to its first tokens; ``seen`` then counts the texts that were cut."""
    counted = passages if seen is None else passages.observe(seen, F.count(F.lit(1)).alias("texts"))
    return counted.select("digest", tokens.truncate_head("text", passage_cutoff, tok).alias("text"))


def expand(refs: DataFrame, passages: DataFrame, keys: Sequence[str] = ("idx",)) -> DataFrame:
    """``predicted_know`` again: texts in the places of their digests.

    Digests meet texts in one join, whose row side is narrow and which splits the rows of a passage that very
    many samples hold; a row's passages then come together by its keys. Digests without an entry give NULL.
    """
    places = F.flatten(F.transform(REFS, lambda one, i: F.transform(
        one, lambda d, j: F.struct(i.alias("i"), j.alias("j"), d.alias("digest")))))
    rest = [c for c in refs.columns if c not in (REFS, *keys)]
    exploded = refs.select(*keys, F.size(REFS).alias("_lists"), F.inline_outer(places))
    found = exploded.join(passages, "digest", "left")
    entry = F.when(F.col("i").isNotNull(), F.struct("i", "j", "text"))
    grouped = found.groupBy(*keys).agg(
        F.max("_lists").alias("_lists"), F.sort_array(F.collect_list(entry)).alias("_found"))
    lists = F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest("_lists", F.lit(1)) - 1), lambda i: i < F.col("_lists")),
        lambda i: F.transform(F.filter("_found", lambda x: x["i"] == i), lambda x: x["text"]))
    know = grouped.select(*keys, F.when(F.col("_lists") >= 0, lists).alias("predicted_know"))
    return know if not rest else refs.drop(REFS).join(know, list(keys))


@dataclass(frozen=True)
class SharedLists:
    """Passage lists that many rows share: ``refs`` (idx, pos, list) name them, ``lists`` (list, passages) holds each once.

    What is done to every list is done here before the lists are dealt to the rows that name them. A name
    without a list stands for an empty one.
    """

    refs: DataFrame
    lists: DataFrame

    def take(self, n: int) -> SharedLists:
        """The first ``n`` lists of every row; below 0 all of them."""
        return self if n < 0 else replace(self, refs=self.refs.where(F.col("pos") < n))

    def changed(self, fn: Callable[[DataFrame], DataFrame]) -> SharedLists:
        """``fn`` takes and returns a table with the lists as ``predicted_know``."""
        held = fn(self.lists.select("list", F.array("passages").alias("predicted_know")))
        return replace(self, lists=held.select("list", F.get("predicted_know", F.lit(0)).alias("passages")))

    def whole(self) -> DataFrame:
        """(idx, predicted_know): the table in which every row holds its lists."""
        return self.rows()

    def rows(self, *by: str) -> DataFrame:
        """``whole`` with columns of ``refs`` that follow from ``idx``; rows with the same first one share a task.

        Tasks are then as many as the shuffle is wide, since joining them would bring wide rows together.
        """
        none = F.array().cast(self.lists.schema["passages"].dataType)
        lists = self.lists.select("list", F.col("passages").alias("held"))
        return self._dealt(lists, F.coalesce("held", none), *by).withColumnRenamed("held", "predicted_know")

    def joined(self, rows: DataFrame, how: str = "left") -> DataFrame:
        """Rows with ``predicted_know``. A list is packed once, dealt so, and unpacked in the rows that hold it:
        for whole texts. Rows meet their lists before they are unpacked, since that forgets the partitioning."""
        both = rows.join(self._dealt(self._packed(), F.col("held")), "idx", how)
        whole = unpack("held").cast(f"array<{self._kind()}>")
        return both.withColumn("predicted_know", whole).drop("held")

    def _kind(self) -> str:
        return self.lists.schema["passages"].dataType.simpleString()

    def _packed(self) -> DataFrame:
        return self.lists.select("list", pack(F.col("passages").cast("array<binary>")).alias("held"))

    def _dealt(self, lists: DataFrame, held: Column, *by: str) -> DataFrame:
        """(idx, held): what is held of a row's lists."""
        keys, tasks = [*by, "idx"], [int(self.refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))] if by else []
        dealt = self.refs.join(lists, "list", "left").select(*keys, "pos", held.alias("held"))
        grouped = dealt.repartition(*tasks, keys[0]).groupBy(*keys).agg(
            F.sort_array(F.collect_list(F.struct("pos", "held"))).alias("k"))
        return grouped.select(*keys, F.transform("k", lambda s: s["held"]).alias("held"))


@F.arrow_udf(BinaryType())
def pack(lists: pa.Array) -> pa.Array:
    """Lists of byte strings, one compressed string each: size, then zstandard bytes."""
    codec, out = pa.Codec("zstd", compression_level=3), []
    for one in lists:
        data = pickle.dumps(one.as_py())
        short = len(data).to_bytes(8, "little") + codec.compress(data, asbytes=True)
        out.append(short.ljust(len(data) // LEAST, b"\0"))  # the zeros are lost in any shuffle's compression
    return pa.array(out, pa.binary())


@F.arrow_udf(ArrayType(ArrayType(BinaryType())))
def unpack(rows: pa.Array) -> pa.Array:
    """The lists of every row again; one that is missing is empty."""
    def lists(blob: bytes | None) -> list[bytes | None]:
        if blob is None:
            return []
        with pa.input_stream(pa.BufferReader(memoryview(blob)[8:]), compression="zstd") as data:
            return pickle.loads(data.read(int.from_bytes(blob[:8], "little")))

    whole = [None if row is None else [lists(blob) for blob in row] for row in (r.as_py() for r in rows)]
    return pa.array(whole, pa.list_(pa.list_(pa.binary())))
