"""License scans by an exact set-similarity join of text blocks with license templates.

A template is a set of words; a text block holds it when it contains at least ``threshold`` of its words
(all of them if the template is shorter than ``WHOLE`` words, where one word is a version or a variant).
Tokens are ordered by how many documents of the whole corpus hold them, rarest first, and sets are sorted
in that order. With ``need`` words to share, a block can hold a template only if

    prefix:     one of the template's first ``size - need + 1`` tokens is among the block's own first
                ``size of the block - need + 1`` tokens,
    length:     the block has at least ``need`` tokens,
    positions:  from the first shared token on, both sets have enough tokens left,

and pairs that pass are verified on their sets. Blocks are sets of template words only, since other words
are shared with none; that changes no result. Blocks of ``2 * width`` words begin every ``width`` words,
with ``width`` the power of two at or above a template's length, so every run of ``width + 1`` words lies
whole in a block; templates of one width are joined with the blocks of that width.

The templates are a parameter, at most ``MOST_WORDS`` words, and travel with the task; texts are read twice,
once to count the templates' words, once to join, and never shuffled. Long texts are read in pieces, and
hold only the places of template words in memory.

Base phrases are templates with threshold 1, and a block that holds all their words is then searched for
them word by word; a place counts in the one block in whose first half it begins.

Defined cases: a null text is empty; an empty text has no words and no labels; labels and places do not
depend on the number of copies of a row, and repeated rows are scanned alike; no templates give empty
labels; an empty table gives an empty result; columns that are not named are never read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from turnloom.llm import text as T

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
OUTSIDE = np.zeros(256, bool)
OUTSIDE[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
MOST_WORDS = 100_000
THRESHOLD = Fraction(4, 5)
WHOLE = 12
# Phrases and labels of the base scan.
PHRASES = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"),
           ("mit", "mit license"))
# Public notices as their licenses word them, and short forms in use.
NOTICES = (
    ("agpl-3.0", "GNU Affero General Public License version 3"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc0-1.0", "CC0 1.0 Universal Public Domain Dedication"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of "
                   "the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
            "fee is hereby granted"),
    ("lgpl-notice", "GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
                   "software and associated documentation files (the \"Software\"), to deal in the Software "
                   "without restriction"),
    ("mit-release", "Released under the MIT License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
SCANNED = StructType([
    StructField("doc_id", LongType()), StructField("n_words", LongType()), StructField("n_base", LongType()),
    StructField("first_word", LongType()), StructField("last_word", LongType()),
    StructField("base_labels", StringType()), StructField("labels", StringType()),
    StructField("score", DoubleType()),
])
COUNTS = StructType([StructField("word", LongType()), StructField("n", LongType())])


def lower(text: str) -> str:
    return text.translate(str.maketrans(T.UPPER_AZ, T.LOWER_AZ))


@dataclass(frozen=True)
class Template:
    """A license text: its words in order, and how many different ones a block must share."""

    label: str
    words: tuple[str, ...]
    need: int
    exact: bool  # a base phrase, whose words must follow each other

    @property
    def width(self) -> int:
        return 1 << (len(self.words) - 1).bit_length()


def templates(phrases=PHRASES, notices=NOTICES, threshold: Fraction = THRESHOLD, whole: int = WHOLE
              ) -> list[Template]:
    """Templates of (label, text) pairs; those of fewer than ``whole`` different words must be held whole."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and not above 1")
    out = []
    for exact, pairs, share in ((True, phrases, Fraction(1)), (False, notices, Fraction(threshold))):
        for label, text in pairs:
            words = tuple(WORD.findall(lower(text)))
            if not words:
                raise ValueError(f"no words in the template of {label}")
            size = len(set(words))
            out.append(Template(label, words, size if size < whole else -(-size * share // 1), exact))
    if sum(len(t.words) for t in out) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words do not travel with every task")
    return out


def _word_codes(words: Sequence[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    return T.range_hashes(data, ends - [len(r) for r in raw], ends)


class Vocabulary:
    """The templates' words: hashes for look-up, numbers for use."""

    def __init__(self, found: Sequence[Template]):
        words = sorted({w for t in found for w in t.words})
        codes = _word_codes(words) if words else np.zeros(0, np.uint64)
        order = np.argsort(codes)
        self.words, self.codes = [words[i] for i in order], codes[order]

    def places(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Row, number of its words, places and numbers of the template words, whole texts in pieces."""
        for lo, hi in T.row_ranges(column):
            data, offsets = T.text_bytes(column.slice(lo, hi - lo))
            if hi - lo == 1:
                yield lo, *self._long(data)
                continue
            at, ids, before = self._look_up(data, offsets)
            rows = np.searchsorted(at, before)
            for i in range(hi - lo):
                a, b = rows[i], rows[i + 1]
                yield lo + i, int(before[i + 1] - before[i]), at[a:b] - before[i], ids[a:b]

    def _look_up(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = T.LOWER[data]
        starts, ends, before = T.word_ranges(data, offsets, OUTSIDE)
        codes = T.range_hashes(data, starts, ends)
        if not len(self.codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), before
        slot = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        at = np.flatnonzero(self.codes[slot] == codes)
        return at, slot[at], before

    def _long(self, data: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """One text, cut between words about every ``T.PIECE`` bytes."""
        n, at, ids, begin = 0, [], [], 0
        while begin < len(data):
            end = min(begin + T.PIECE, len(data))
            while end < len(data) and not OUTSIDE[T.LOWER[data[end]]]:
                end += 1
            piece = data[begin:end]
            places, found, before = self._look_up(piece, np.array([0, len(piece)]))
            at.append(places + n)
            ids.append(found)
            n, begin = n + int(before[-1]), end
        return n, *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, ids))


class Index:
    """Templates in the global token order, with their prefixes by token, per width of blocks."""

    def __init__(self, found: Sequence[Template], counts: dict[int, int]):
        self.vocabulary = Vocabulary(found)
        words = self.vocabulary.words
        order = sorted(range(len(words)), key=lambda i: (counts.get(i, 0), words[i]))
        self.rank = np.empty(len(words), np.int64)
        self.rank[order] = np.arange(len(words))
        number = {w: int(self.rank[i]) for i, w in enumerate(words)}
        self.found = list(found)
        self.sets = [sorted({number[w] for w in t.words}) for t in found]
        self.runs = [[number[w] for w in t.words] for t in found]
        self.prefixes: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, (t, tokens) in enumerate(zip(found, self.sets)):
            for j, token in enumerate(tokens[:len(tokens) - t.need + 1]):
                self.prefixes[t.width][token].append((k, j))
        self.rare = {}
        for width, by_token in self.prefixes.items():
            self.rare[width] = np.zeros(len(words), bool)
            self.rare[width][list(by_token)] = True

    def blocks(self, at: np.ndarray, ranks: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
        """Blocks with a prefix token of some template: their number, and the slice of places in them."""
        near = np.unique(at[self.rare[width][ranks]] // width)
        near = np.unique(np.concatenate([near, near - 1]))
        near = near[near >= 0]
        for b, lo, hi in zip(near.tolist(), np.searchsorted(at, near * width).tolist(),
                             np.searchsorted(at, (near + 2) * width).tolist()):
            yield b, slice(lo, hi)

    def matches(self, block: list[int], width: int) -> Iterator[tuple[int, int]]:
        """Templates that a block (its tokens in order) holds, with the number of tokens shared."""
        tried, by_token, size, members = set(), self.prefixes[width], len(block), set(block)
        for i, token in enumerate(block):
            for k, j in by_token.get(token, ()):
                need, tokens = self.found[k].need, self.sets[k]
                if k in tried or i > size - need:
                    continue  # length, and the block's own prefix
                tried.add(k)  # the first shared token: what is left of both sets bounds the overlap
                if min(size - i, len(tokens) - j) < need:
                    continue
                shared = sum(t in members for t in tokens)
                if shared >= need:
                    yield k, shared

    def scan(self, n_words: int, at: np.ndarray, ids: np.ndarray) -> tuple:
        """n_words, number of base places, first, last, base labels, all labels, score of one text."""
        ranks, places, base, labels, score = self.rank[ids], set(), set(), set(), 0.0
        for width in self.prefixes:
            for b, inside in self.blocks(at, ranks, width):
                block = np.unique(ranks[inside]).tolist()
                here = None
                for k, shared in self.matches(block, width):
                    found = self.found[k]
                    if found.exact:
                        if here is None:
                            here = dict(zip(at[inside].tolist(), ranks[inside].tolist()))
                        run = self.runs[k]
                        starts = [p for p, r in here.items() if r == run[0] and p < (b + 1) * width
                                  and all(here.get(p + i) == r2 for i, r2 in enumerate(run))]
                        if not starts:
                            continue
                        places.update((p, k) for p in starts)
                        base.add(found.label)
                    labels.add(found.label)
                    score = max(score, shared / len(self.sets[k]))
        first = [p for p, _ in places]
        return (n_words, len(places), min(first, default=None), max(first, default=None),
                ",".join(sorted(base)), ",".join(sorted(labels)), score)


def _count(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.words), np.int64)
        for batch in batches:
            for _, _, _, ids in vocabulary.places(batch.column(0)):
                total[np.unique(ids)] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], COUNTS.names)

    return run


def _scan(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(ids[row], *index.scan(n, at, found))
                    for row, n, at, found in index.vocabulary.places(batch.column(1))]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)], SCANNED.names)

    return run


def index(docs: DataFrame, found: Sequence[Template], text: str = "text") -> Index:
    """Templates in the order of the corpus; the counts are at most one row per template word."""
    counts = docs.select(F.col(text).cast("string")).mapInArrow(_count(Vocabulary(found)), COUNTS).groupBy(
        "word").agg(F.sum("n").alias("n")).collect()
    return Index(found, {r["word"]: r["n"] for r in counts})


def scan(docs: DataFrame, found: Sequence[Template] | None = None, doc_id: str = "doc_id", text: str = "text"
         ) -> DataFrame:
    """One row per document: words, places of base phrases, base labels, all labels, best containment."""
    ready = index(docs, templates() if found is None else found, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_scan(ready), SCANNED)


def op13_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _template_sql() -> str:
    rows = [f"({i}, '{t.label}', {t.need}, {t.width}, {str(t.exact).lower()}, {list(t.words)!r})"
            for i, t in enumerate(templates())]
    return ", ".join(rows)


ORACLE = f"""
with t(k, label, need, width, exact, words) as (values {_template_sql()}),
tw as (select distinct k, width, unnest(words) as word from t),
d as (
  select row_number() over () as row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{T.UPPER_AZ}', '{T.LOWER_AZ}'),
                       '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws
  from documents),
w as (select row, i - 1 as pos, ws[i] as word from d, unnest(range(1, len(ws) + 1)) as u(i)),
hits as (select w.row, w.pos, tw.k, tw.width, w.word from w join tw using (word)),
held as (
  select h.row, h.k, b, count(distinct word) as shared
  from hits h, unnest([h.pos // width, h.pos // width - 1]) as u(b) where b >= 0 group by h.row, h.k, b),
found as (
  select distinct row, label, shared / (select count(*) from tw where tw.k = t.k) as score
  from held join t using (k) where shared >= need and not exact),
base as (
  select d.row, t.label, i - 1 as pos from t, d, unnest(range(1, len(ws) + 1)) as u(i)
  where exact and ws[i:i + len(words) - 1] = words),
b as (select row, count(*) as n, min(pos) as lo, max(pos) as hi from base group by row),
l as (
  select row, string_agg(distinct label, ',' order by label) as labels, max(score) as score
  from (select * from found union all select row, label, 1.0 from base) group by row),
bl as (select row, string_agg(distinct label, ',' order by label) as labels from base group by row)
select doc_id, len(ws)::bigint as n_words, coalesce(n, 0)::bigint as n_base, lo::bigint as first_word,
  hi::bigint as last_word, coalesce(bl.labels, '') as base_labels, coalesce(l.labels, '') as labels,
  coalesce(l.score, 0.0)::double as score
from d left join b using (row) left join l using (row) left join bl using (row)
"""
