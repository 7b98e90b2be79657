"""Secret scan: fixed patterns, and strings that a primed compressor finds new.

Beside the base patterns, every string of key characters in the sentence of a sensitive word (also in
camelCase or plural; a sentence ends at a line's end too), within ``REACH`` characters of it, or in a private
key block, is a candidate. A string that is reported makes candidates of those parted from it by white space,
quotes or punctuation only.

A candidate's novelty is its marginal compressed size: a zstandard compressor whose dictionary holds the
commonest identifiers of the whole corpus and the words of configuration code compresses the text around the
candidate with and without it. Names are built of words, so camelCase humps and parts between underscores that
the dictionary knows are left out first, and what remains is measured. What cannot be compressed is reported as
``novel``: ``SHARE`` bytes a character and ``LEAST`` bytes in all, ``LEAST_LETTERS`` for letters alone, since a
rare long word looks as new as a short key of letters does.

Identifiers of more than ``LONGEST`` characters are not counted for the dictionary. Defined cases: a null text is
empty and has no spans; very long texts are scanned whole; repeated rows are scanned alike; an empty table gives
an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from turnloom.llm.text import row_ranges

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
# A maximal run has no shorter one inside that the contract's pattern would take instead.
SENSITIVE_WORDS = ("passw", "passphrase", "pwd", "secret", "token", "key", "auth", "credential", "bearer")
SENSITIVE = re.compile(  # no letter on either side, or a new hump of a camelCase name
    r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z])|(?=[A-Z][a-z]))"
    r"(?i:passw(?:or)?d|passphrase|pwd|secret|token|(?:api|access|private|client|ssh)[ _-]?key"
    r"|auth(?:orization)?|credential|bearer)(?i:s?)(?:(?![A-Za-z])|(?<=[a-z])(?=[A-Z]))", re.A)
BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(.*?)(?:-----END|\Z)", re.S)
TAIL = re.compile(r"\s+([A-Za-z0-9+/=]{1,11})(?=\s*-----END)")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
SENTENCE = re.compile(r"""[.!?]["')\]]*\s|[\r\n]""")
PART = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}(?![a-z])")
REACH, AROUND = 48, 160
SHARE, LEAST, LEAST_LETTERS = 0.55, 10, 14  # marginal bytes a character, and in all
WORDS, NAMES, LONGEST, USUAL = 2048, 8192, 255, 8
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{3,}", re.A)
CODE = ("password passwd secret token api_key apikey access_key private_key client_secret username user "
        "config configuration settings environment variable import return function class public static "
        "https http www example localhost Authorization Bearer Basic null true false None default value "
        "get set name value type key index count list item data file path page error timeout "
        "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 changeme placeholder your_key_here")
COUNTS = StructType([StructField("word", StringType()), StructField("n", LongType())])
FOUND = StructType([
    StructField("doc_id", LongType()), StructField("n_assign", LongType()),
    StructField("n_access", LongType()), StructField("n_hex", LongType()),
    StructField("n_novel", LongType()), StructField("base_sha256", StringType()),
    StructField("spans", StringType()),
])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Identifiers of every piece of text with their counts."""
    for batch in batches:
        for lo, hi in row_ranges(batch.column(0), 8 << 20):
            seen = Counter()
            for value in batch.column(0).slice(lo, hi - lo).to_pylist():
                seen.update(IDENTIFIER.findall(value or ""))
            words = [w for w in seen if len(w) <= LONGEST]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64())], ["word", "n"])


def common_words(docs: DataFrame, text: str = "text", words: int = NAMES) -> list[str]:
    """The commonest identifiers of all texts; their number and length bound what reaches the driver.

    A word with digits, or long enough to be a candidate, counts from ``USUAL`` occurrences on: a small
    corpus has few other words, and a secret with some copies must not pass for a name.
    """
    counted = docs.select(F.col(text).cast("string")).mapInArrow(_count, COUNTS)
    total = counted.groupBy("word").agg(F.sum("n").alias("n"))
    top = total.where((F.col("n") >= USUAL) | ~F.col("word").rlike("[0-9]|.{12}")).orderBy(F.desc("n"), "word").limit(words)
    # Below another operator the limit ends in a task; at the top every partition's words go to the driver.
    return [r["word"] for r in top.where(F.length("word") > 0).orderBy(F.desc("n"), "word").collect()]


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    # This strategy with a target length stores literals as they are: coding them would start at some size
    # of the surroundings, and what a string adds would depend on that.
    raw = zstandard.ZstdCompressionParameters.from_level(
        9, strategy=zstandard.STRATEGY_FAST, target_length=1, min_match=4, write_content_size=0,
        write_checksum=0, write_dict_id=0)
    return zstandard.ZstdCompressor(compression_params=raw, dict_data=primed)


def dictionary_of(words: list[str]) -> bytes:
    """Raw dictionary of the first ``WORDS``; what is likelier stands nearer to its end."""
    return (" ".join(reversed(words[:WORDS])) + " " + CODE).encode()


def known_parts(words: list[str]) -> frozenset[str]:
    """The words that names are built of, in lower case; parts long enough to be a key are none."""
    parts = {p.lower() for w in [*words, *CODE.split()] for p in PART.findall(w)}
    return frozenset(p for p in parts if 3 <= len(p) < 12)


KNOWN = known_parts([])


def unnamed(value: str, known: frozenset[str] = KNOWN) -> str:
    """A string without the parts that are known words."""
    return PART.sub(lambda m: "" if m[0].lower() in known else m[0], value)


def marginal_bytes(before: str, value: str, after: str, dictionary: bytes) -> int:
    """Compressed bytes that a string adds to the text around it."""
    compress = _compressor(dictionary).compress
    return len(compress((before + value + after).encode())) - len(compress((before + after).encode()))


def is_novel(text: str, start: int, end: int, dictionary: bytes, known: frozenset[str], linked: bool) -> bool:
    """Is a candidate incompressible beside its surroundings?

    For one among others like it, candidates around it are left out: the lines of a key do not make one
    another usual."""
    value = unnamed(text[start:end], known)
    least = LEAST if any(c.isdigit() for c in value) else LEAST_LETTERS
    if len(value) < least - 4:  # a string cannot add much more than itself
        return False
    before, after = text[max(0, start - AROUND):start], text[end:end + AROUND]
    if linked:
        before, after = (CANDIDATE.sub(lambda m: m[0] if unnamed(m[0], known) == "" else "", part)
                         for part in (before, after))
    return marginal_bytes(before, value, after, dictionary) >= max(least, SHARE * len(value))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def novel_spans(text: str, base: list[tuple[int, int, int]], dictionary: bytes,
                known: frozenset[str] = KNOWN, reach: int = REACH) -> list[tuple[int, int, int]]:
    """Incompressible candidates beside a sensitive word or a reported one, outside the base spans."""
    low = text.lower()
    if not any(w in low for w in SENSITIVE_WORDS):
        return []
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    starts, ends = [a for a, _ in runs], [b for _, b in runs]
    begin: dict[int, int] = {}  # where the candidate begins in each run that is one
    edges = [0, *(m.end() for m in SENTENCE.finditer(text)), len(text)]
    done = 0  # words come in order, and so do the windows around them: each run is looked at once
    for word in SENSITIVE.finditer(text):
        a, b = word.span()
        sentence = bisect_right(edges, a, 0, len(edges) - 1)
        low_at = bisect_left(ends, min(edges[sentence - 1], a - reach))
        high = bisect_right(starts, max(edges[sentence], b + reach))
        for at in range(max(low_at, done), high):
            start = b if starts[at] < b < ends[at] else starts[at]  # the word may stand in the run
            if ends[at] - start >= 12:
                begin[at] = start
        done = max(done, high)
    linked = set()  # in a key block, or beside one that is reported
    for block in BLOCK.finditer(text) if "-----BEGIN " in text else ():
        linked.update(range(bisect_left(starts, block.start(1)), bisect_left(starts, block.end(1))))
    for at in linked:
        begin.setdefault(at, starts[at])
    taken = sorted((a, b) for a, _, b in base)
    far = list(accumulate((b for _, b in taken), max))  # how far the base spans up to each one go
    out, ahead = [], sorted(begin, reverse=True)
    while ahead:
        at = ahead.pop()
        start, end = begin[at], ends[at]
        before = bisect_left(taken, (end,)) - 1  # the last base span that begins before the end
        if before < 0 or far[before] <= start:
            if not is_novel(text, start, end, dictionary, known, at in linked):
                continue
            out.append((start, 3, end))
            tail = TAIL.match(text, end)
            if tail:
                out.append((tail.start(1), 3, tail.end(1)))
        for beside in (at - 1, at + 1):
            if 0 <= beside < len(runs) and beside not in begin:
                gap = text[ends[min(at, beside)]:starts[max(at, beside)]]
                if not any(c.isalnum() for c in gap):
                    begin[beside] = starts[beside]
                    linked.add(beside)
                    ahead.append(beside)
    return sorted(out)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _scan(dictionary: bytes, known: frozenset[str], reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py() or ""
                base = base_spans(text)
                new = novel_spans(text, base, dictionary, known, reach)
                n = np.bincount([k for _, k, _ in base], minlength=3).tolist() if base else [0, 0, 0]
                out.append((doc_id, *n, len(new), hashlib.sha256(_joined(base).encode()).hexdigest(),
                            _joined(base + new)))
            if out:
                types = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), types)], FOUND.names)

    return run


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """doc_id, counts per kind, digest of the base spans, all spans (kind:start:end, code points).

    ``reach``: how far beyond its sentence a sensitive word makes candidates."""
    words = common_words(docs, text)
    dictionary, known = dictionary_of(words), known_parts(words)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_scan(dictionary, known, reach), FOUND)


def masked(text: str, spans: str, mark: str = "[{kind}]") -> str:
    """A text with its spans replaced, for cleaning a corpus after the scan."""
    out, at = [], 0
    for kind, start, end in sorted((s.split(":") for s in spans.split(",") if s), key=lambda s: int(s[1])):
        start, end = int(start), int(end)
        if start >= at:
            out += [text[at:start], mark.format(kind=kind.upper())]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
