"""Best-fit packing of tokenised documents into sequences under several capacities.

Documents become pieces of at most ``tokens`` ids. Pieces are dealt round-robin to shards of bounded
size, and each shard is packed by vector best-fit, largest first: a piece asks for tokens, one document
and an attention cost (its length squared), and of the open sequences that hold it under every capacity
the one with the smallest weighted norm of what would remain (or the largest weighted dot product of
demand and residual) takes it.

Defined cases: a null or empty text is the closing id alone; repeated rows are documents of their own
(their pieces are never joined by identifier, so none is lost or doubled); an empty table gives an
empty result; other columns are never read.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from turnloom.llm.text import row_ranges
from turnloom.sources.sinks import written

CLOSING = 2
SHARD = 8192
BATCH = 6 << 20
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_TEXT = {"<|endoftext|>": 50256}
PIECES = StructType([
    StructField("doc_id", LongType()), StructField("piece", LongType()),
    StructField("start", LongType()), StructField("length", LongType()),
    StructField("tokens", BinaryType()),
])
PLACED = StructType([
    *[f for f in PIECES if f.name != "tokens"], StructField("ids_crc32", LongType()),
    StructField("sequence_id", LongType()), StructField("offset", LongType()),
    StructField("max_documents", LongType()), StructField("max_attention", DoubleType()),
])


def default_tokenizer() -> str:
    """Path of the byte-level ranks installed on this machine (ids as in byte_bpe_50k.json)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Token ids of many texts at once.

    The tokenizer splits a text before it merges anything, and always does before a space that
    follows something else than white space. So the ids of a text are those of its parts between
    spaces in a row, each part with its space. The different parts of a batch are encoded together
    once, and cut apart where a token begins with a space. A text with white space on both sides of
    a space is encoded as a whole.
    """

    def __init__(self, path: str | None):
        import tiktoken

        with open(path or default_tokenizer(), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.model = tiktoken.Encoding(
            "bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=END_OF_TEXT)
        self.spaced = np.zeros(max(ranks.values()) + 2, bool)
        self.spaced[[i for token, i in ranks.items() if token[0] == 0x20]] = True

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, allowed_special="all", disallowed_special=()), "<u4")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text starts in them (one entry more)."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        edges = np.asarray(lists.offsets).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        which = np.asarray(coded.indices).astype(np.int64)
        edges -= edges[0]
        bare = pc.match_substring_regex(coded.dictionary, BARE).to_numpy(zero_copy_only=False)
        plain = coded.dictionary.filter(pa.array(~bare))
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(plain)], plain), " ")[0].as_py()
        ids = np.asarray(self.model.encode_ordinary(" " + joined) if joined else [], "<u4")
        at = np.flatnonzero(self.spaced[ids])
        n = len(bare)
        # The first part of a text has no space before it; odd texts are encoded as one first part.
        firsts = [self.whole(text if is_odd else text.partition(" ")[0])
                  for text, is_odd in zip(texts.to_pylist(), odd)]
        extra = [self.whole(" " + part) for part in coded.dictionary.filter(pa.array(bare)).to_pylist()]
        start, length = np.zeros(n + len(firsts), np.int64), np.zeros(n + len(firsts), np.int64)
        start[:n][~bare] = at
        length[:n][~bare] = np.diff(np.append(at, len(ids)))
        for places, arrays in ((np.flatnonzero(bare), extra), (np.arange(n, n + len(firsts)), firsts)):
            sizes = np.array([len(x) for x in arrays], np.int64)
            start[places] = len(ids) + np.cumsum(sizes) - sizes
            length[places] = sizes
            ids = np.concatenate([ids, *arrays]) if arrays else ids
        which[edges[:-1]] = np.arange(n, n + len(firsts))
        sizes = length[which]
        ends = np.cumsum(sizes)
        flat = np.repeat(start[which] - (ends - sizes), sizes)
        flat += np.arange(len(flat))
        return ids[flat], np.concatenate([[0], ends])[edges]


WS = "[\\t-\\r\\x{1c}-\\x{1f} \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
ODD = rf"{WS} {WS}|  |<\|"
BARE = rf"^{WS}|{WS}$|^$"


@lru_cache(maxsize=2)
def _encoder(path: str | None) -> Encoder:
    return Encoder(path)


def _cut(path: str | None, tokens: int):
    width = 4 * tokens
    closing = np.array([CLOSING], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for lo, hi in row_ranges(batch.column(1), BATCH):
                part = batch.slice(lo, hi - lo)
                ids, edges = encoder.encode(part.column(1))
                out, held = [], 0
                for i, doc_id in enumerate(part.column(0).to_pylist()):
                    own = ids[edges[i]:edges[i + 1]].tobytes() + closing
                    first = len(own) if len(own) <= width else len(own) % width
                    cuts = [0] if first == 0 else [0, first]
                    cuts += range(cuts[-1] + width, len(own) + 1, width)
                    out.extend((doc_id, piece, a // 4, (b - a) // 4, own[a:b])
                               for piece, (a, b) in enumerate(zip(cuts, cuts[1:])))
                    held += len(own)
                    if held > 4 << 20:
                        yield _rows(out)
                        out, held = [], 0
                if out:
                    yield _rows(out)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), types)], PIECES.names)


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokens: int = 1024,
           tokenizer: str | None = None) -> DataFrame:
    """Pieces of at most ``tokens`` ids: doc_id, piece, start, length, tokens (uint32, little-endian).

    Only longer documents are cut; the remainder comes first. ``tokenizer`` is the path of a
    vocabulary file that every executor can read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_cut(tokenizer, tokens), PIECES)


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float],
             weights: tuple[float, float, float], score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece; the pieces must come in the order in which they are placed.

    A piece that no empty bin can hold gets one of its own (it was cut to fit by its tokens; its
    attention cost alone may be above the capacity).
    """
    n = len(lengths)
    w = [x / c for x, c in zip(weights, capacity)]
    least = np.append(np.minimum.accumulate(lengths[::-1])[::-1], 0)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    left = np.empty((3, 64))  # what remains of each capacity in every open bin
    number = np.empty(64, np.int64)
    open_, made = 0, 0
    for i, length in enumerate(lengths.tolist()):
        need = (length, 1.0, float(length) ** 2)
        fits = np.flatnonzero((left[0, :open_] >= need[0]) & (left[1, :open_] >= need[1]) & (left[2, :open_] >= need[2]))
        if len(fits):
            rest = left[:, fits]
            if score == "norm":
                value = sum(((rest[d] - need[d]) * w[d]) ** 2 for d in range(3))
                best = fits[np.argmin(value)]
            else:
                value = sum(rest[d] * (w[d] * need[d] / capacity[d]) for d in range(3))
                best = fits[np.argmax(value)]
        else:
            if open_ == len(number):
                left = np.concatenate([left, np.empty_like(left)], axis=1)
                number = np.concatenate([number, np.empty_like(number)])
            best, open_ = open_, open_ + 1
            left[:, best], number[best] = capacity, made
            made += 1
        bins[i], offsets[i] = number[best], int(capacity[0] - left[0, best])
        left[:, best] -= need
        if left[0, best] < least[i + 1] or (left[:, best] < 1).any():
            open_ -= 1  # nothing that is left fits: close the bin
            left[:, best], number[best] = left[:, open_], number[open_]
    return bins, offsets


def tightest(lengths: np.ndarray, tokens: int, weights: tuple[float, float, float], score: str = "norm",
             documents: int | None = None, attention: float | None = None,
             ) -> tuple[tuple[float, float, float], np.ndarray, np.ndarray]:
    """Capacities, bins and offsets; a capacity that is not given is searched.

    The searched ones are as small as they can be without one more bin than tokens alone need: first the
    attention cost of a bin (in sixteenths of a full piece's, a half or more), then the documents in it.
    Both are found by bisection, and what is returned was packed and counted. ``lengths`` come in the
    order in which they are placed.
    """
    def packed(d, a):
        capacity = (float(tokens), float(d), float(a))
        bins, offsets = best_fit(lengths, capacity, weights, score)
        return capacity, bins, offsets

    full = float(tokens) ** 2
    n = len(lengths)
    best = packed(documents or max(n, 1), attention or full)
    if n == 0 or (documents and attention):
        return best
    made = best[1].max() + 1
    if attention is None:
        low, high = 7, 16
        while high - low > 1:
            middle = (low + high) // 2
            tried = packed(best[0][1], full * middle / 16)
            if tried[1].max() < made:
                best, high = tried, middle
            else:
                low = middle
    if documents is None:
        low, high = (n - 1) // int(made), int(np.bincount(best[1]).max())
        best = ((best[0][0], float(high), best[0][2]), *best[1:])
        while high - low > 1:
            middle = (low + high) // 2
            tried = packed(middle, best[0][2])
            if tried[1].max() < made:
                best, high = tried, middle
            else:
                low = middle
    return best


def _pack(tokens, documents, attention, weights, score):
    def run(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        ids = np.array(table["doc_id"].fill_null(-1))
        order = np.lexsort((table["piece"].to_numpy(), ids, -lengths))
        capacity, bins, offsets = tightest(lengths[order], tokens, weights, score, documents, attention)
        sorted_ = table.take(pa.array(order))
        sequence = sorted_["shard"].to_numpy() * (1 << 32) + bins
        return pa.table({
            **{c: sorted_[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")},
            "sequence_id": pa.array(sequence), "offset": pa.array(offsets),
            "max_documents": pa.array(np.full(len(bins), capacity[1], np.int64)),
            "max_attention": pa.array(np.full(len(bins), capacity[2])),
        })

    return run


def place(cut: DataFrame, tokens: int = 1024, documents: int | None = None,
          attention: float | None = None, weights: tuple[float, float, float] = (1.0, 0.3, 0.3),
          score: str = "norm", shard: int = SHARD) -> DataFrame:
    """A sequence and an offset for every piece (doc_id, piece, start, length, ids_crc32).

    ``documents`` and ``attention`` (sum of squared lengths) limit a sequence besides its tokens; without
    them every shard takes the smallest that cost it no sequence (``tightest``). Either way the limits are
    in ``max_documents`` and ``max_attention``; a piece above the attention limit stands alone.
    ``cut`` is written first, without token ids, so that rows keep their place when a task is
    repeated. Rows are dealt to shards by their place in that table, whatever their identifiers.
    """
    stored = written(cut, "pieces")
    shards = max(1, math.ceil(stored.count() / shard))
    dealt = stored.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_pack(tokens, documents, attention, weights, score), PLACED)


def used(placed: DataFrame, tokens: int = 1024) -> DataFrame:
    """sequence_id, and the shares of its tokens, documents and attention cost that are taken (above 1: a lone piece)."""
    return placed.groupBy("sequence_id").agg(
        (F.sum("length") / tokens).alias("tokens"), (F.count("*") / F.first("max_documents")).alias("documents"),
        (F.sum(F.col("length") * F.col("length")) / F.first("max_attention")).alias("attention"))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokens: int = 1024,
         tokenizer: str | None = None, **capacities) -> DataFrame:
    """Places of all pieces of ``docs``; see ``pieces`` and ``place``."""
    cut = pieces(docs, doc_id, text, tokens, tokenizer)
    narrow = cut.select("doc_id", "piece", "start", "length", F.crc32("tokens").alias("ids_crc32"))
    return place(narrow, tokens, **capacities)


def sequences(cut: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed ids: sequence_id, tokens, doc_ids.

    Every place gets the ids of its piece. Documents that repeat have equal pieces under one name; these
    count once here, so that a place finds its ids once (pieces of one name, length and CRC-32 are equal).
    """
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    once = cut.withColumn("ids_crc32", F.crc32("tokens")).groupBy(*keys).agg(F.first("tokens").alias("tokens"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"p.{k}").eqNullSafe(F.col(f"c.{k}"))
    return (
        placed.alias("p").join(once.alias("c"), same)
        .groupBy("p.sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("p.offset", "p.doc_id", "c.tokens"))).alias("parts"))
        .select("sequence_id",
                F.aggregate("parts", F.lit(b"").cast("binary"),
                            lambda a, p: F.concat(a, p["tokens"])).alias("tokens"),
                F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"))
    )


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
