"""Quality rules under weak supervision.

Eight rules vote good, bad or abstain on every text. Expectation-maximisation over the counts of
vote patterns (at most 3^8 rows) estimates how reliable each rule is, and the posterior probability
of good decides, instead of all rules having to pass.

Defined cases: a null text counts as empty; a text without words votes bad by its length and fails
the base rule; repeated rows are judged alike, each on its own; an empty table gives an empty result;
other columns are never read, and columns that clash with the new ones are renamed inside.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from turnloom.llm import text as T, votes

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
          "n_same_next", "n_letters", "n_capitals", "n_shouts", "n_plain_words")
WINDOW = 8
SYMBOLS = "#*$%&|<>"
# Rule: (share of bad votes expected in good texts, in bad texts).
RULES = {
    "symbols": (0.02, 0.35), "repeats": (0.02, 0.3), "same_next": (0.02, 0.3),
    "capitals": (0.02, 0.3), "shouts": (0.02, 0.3), "dup_lines": (0.02, 0.2),
    "word_length": (0.02, 0.2), "plain_words": (0.02, 0.4),
}


def _flags(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


SYMBOL, SHOUT = _flags(SYMBOLS), _flags("!?")
CAPITAL, SMALL = _flags(T.UPPER_AZ), _flags(T.LOWER_AZ)
PLAIN_END = _flags(".,;:!?\"')")
PLAIN = CAPITAL | SMALL | _flags("'-") | (np.arange(256) >= 128)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which entries are equal to another one."""
    _, where, count = np.unique(keys, return_inverse=True, return_counts=True)
    return count[where] > 1


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every text in a piece of a column."""
    data, offsets = T.text_bytes(column)
    starts, ends, before = T.word_ranges(data, offsets)
    words = T.range_hashes(data, starts, ends)
    row = T.owners(before)
    salt = T.mix(row.astype(np.uint64) + np.uint64(1))
    out = {"n_words": np.diff(before)}
    out["word_chars"] = T.per_row(T.FIRST_BYTE[data] & ~T.SPACE[data], offsets)
    out["n_symbols"] = T.per_row(SYMBOL[data], offsets)
    out["n_shouts"] = T.per_row(SHOUT[data], offsets)
    out["n_capitals"] = T.per_row(CAPITAL[data], offsets)
    out["n_letters"] = out["n_capitals"] + T.per_row(SMALL[data], offsets)

    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    out["n_same_next"] = T.per_row(same, before)

    covered = np.zeros(len(words), bool)
    windows = T.window_hashes(words, WINDOW)
    if len(windows):
        whole = np.flatnonzero(row[:len(windows)] == row[WINDOW - 1:])
        found = whole[_repeated(windows[whole] ^ salt[whole])]
        step = np.zeros(len(words) + 1, np.int64)
        np.add.at(step, found, 1)
        np.add.at(step, found + WINDOW, -1)
        covered = np.cumsum(step[:-1]) > 0
    out["n_repeat_words"] = T.per_row(covered, before)

    # Lines end at \n and at the end of the row; the \n itself belongs to none.
    breaks = np.flatnonzero(data == 10)
    from_ = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    of_row = np.sort(np.concatenate(
        [np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1]), kind="stable")
    to = np.empty_like(from_)
    if len(from_):
        to[:-1] = from_[1:] - 1
        to[-1] = len(data)
        last = np.searchsorted(of_row, np.arange(len(offsets) - 1), side="right") - 1
        to[last] = offsets[1:]
    letters = np.concatenate([[0], np.cumsum(~T.SPACE[data])])
    full = np.flatnonzero(letters[to] > letters[from_])
    lines = T.range_hashes(data, from_[full], to[full])
    keys = lines ^ T.mix(of_row[full].astype(np.uint64) + np.uint64(1))
    first = np.zeros(len(full), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    rows = len(offsets) - 1
    out["n_lines"] = np.bincount(of_row[full], minlength=rows)
    out["n_dup_lines"] = np.bincount(of_row[full][~first], minlength=rows)

    # A plain word holds letters, apart from punctuation at its end.
    odd = np.concatenate([[0], np.cumsum(~PLAIN[data])])
    closing = np.zeros(len(words), np.int64)
    tail = ends.copy()
    for _ in range(2):
        at = (tail > starts) & PLAIN_END[data[np.maximum(tail - 1, 0)]] if len(data) else tail > starts
        closing += at
        tail = tail - at
    out["n_plain_words"] = T.per_row((odd[tail] == odd[starts]) & (tail > starts), before)
    return out


@F.arrow_udf(StructType([StructField(c, LongType()) for c in COUNTS]))
def _measured(column: pa.Array) -> pa.Array:
    parts = [measure(column.slice(lo, hi - lo)) for lo, hi in T.row_ranges(column)]
    arrays = [pa.array(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0), pa.int64())
              for c in COUNTS]
    return pa.StructArray.from_arrays(arrays, list(COUNTS))


def counts(text: Column) -> Column:
    """Struct of all counts of a text."""
    return _measured(text)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)).cast("tinyint")


def rule_votes(c: Column) -> dict[str, Column]:
    """The vote of every rule, from the struct of counts; a text without words gets bad votes."""
    words = F.greatest(c["n_words"], F.lit(1)).cast("double")
    letters = F.greatest(c["n_letters"], F.lit(1)).cast("double")
    lines = F.greatest(c["n_lines"], F.lit(1)).cast("double")

    def share(part: str, whole: Column, bad: float, good: float) -> Column:
        x = c[part] / whole
        return _vote(x > bad, x <= good)

    length, plain = c["word_chars"] / words, c["n_plain_words"] / words
    return {
        "symbols": share("n_symbols", words, 0.1, 0.02),
        "repeats": share("n_repeat_words", words, 0.3, 0.1),
        "same_next": share("n_same_next", words, 0.1, 0.03),
        "capitals": share("n_capitals", letters, 0.3, 0.15),
        "shouts": share("n_shouts", words, 0.3, 0.1),
        "dup_lines": share("n_dup_lines", lines, 0.5, 0.2),
        "word_length": _vote((length < 2) | (length > 16), (length >= 3) & (length <= 11)),
        "plain_words": _vote(plain < 0.7, plain >= 0.85),
    }


def base_failed(c: Column) -> Column:
    return (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])


def learn(docs: DataFrame, text: str = "text") -> votes.VoteModel:
    """Fit the vote model on all texts; the driver gets one row per vote pattern."""
    measured = docs.select(counts(F.col(text)).alias("c"))
    patterns = (
        measured.select(*[v.alias(n) for n, v in rule_votes(F.col("c")).items()])
        .groupBy(*RULES).count().collect()
    )
    votes_seen = np.array([r[:-1] for r in patterns]).reshape(-1, len(RULES))
    return votes.fit(votes_seen, np.array([r[-1] for r in patterns]),
                     votes.expected(list(RULES.values())))


def posterior(c: Column, model: votes.VoteModel) -> Column:
    """Probability of good, as a native expression over the votes."""
    total = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for vote, table in zip(rule_votes(c).values(), model.evidence):
        total = total + F.when(vote < 0, table[-1]).when(vote > 0, table[1]).otherwise(table[0])
    return 1 / (1 + F.exp(-total))


def judge(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """All columns of ``docs``, and a struct ``quality``: counts, base_failed, p_good, kept.

    A column of that name in ``docs`` stays; the struct then gets leading underscores.
    """
    model = learn(docs, text)
    name = T.fresh("quality", docs.columns)
    measured = docs.select("*", counts(F.col(text)).alias(name))
    c = F.col(name)
    p = posterior(c, model)
    return measured.withColumn(name, F.struct(
        *[c[n].alias(n) for n in COUNTS], base_failed(c).alias("base_failed"), p.alias("p_good"),
        (~base_failed(c) & (p >= threshold)).alias("kept")))


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose text passes the base rule and is good with at least ``threshold``."""
    model = learn(docs, text)
    name = T.fresh("quality", docs.columns)
    c = F.col(name)
    measured = docs.select("*", counts(F.col(text)).alias(name))
    return measured.where(~base_failed(c) & (posterior(c, model) >= threshold)).select(
        *[F.col(f"`{n}`") for n in docs.columns])


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select(
        "doc_id", *[f"quality.{c}" for c in COUNTS[:5]], "quality.base_failed", "quality.kept",
        "quality.p_good")
