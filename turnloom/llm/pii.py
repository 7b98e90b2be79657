"""Personal data by weak supervision: labelers vote on candidate spans, a trained classifier decides.

Candidates are all spans of the base patterns, also those that fail their check, and of looser ones.
Regex labelers (strict form, checksum), a gazetteer labeler (top-level domains, reserved addresses, number
ranges that are never given out) and context labelers (words before the span, technical words, being part of
a longer string) vote for or against personal data, or abstain. Per kind of span, expectation-maximisation
over the counts of vote patterns estimates how reliable they are and how much of the kind is personal; it
begins from stated vote shares, and every pattern that the labelers of a kind can cast counts as ``VIRTUAL``
further spans in their expected shares, so a kind that a corpus hardly holds keeps the stated judgement.
The posteriors train one logistic classifier on kind, votes and form of the span; every kind weighs the
same there, however frequent. Both see counts per pattern over the whole corpus, at most a few thousand rows.

Base spans that pass stay in any case, and base spans that fail their check are what the classifier learns
to reject, beside loose candidates that labelers speak against. Loose candidates that touch no base span are
added when the classifier holds them for personal data.

Defined cases: a null text is empty and has no spans; very long texts are scanned whole, in time linear in
their length but for sorting their spans; repeated rows are scanned alike; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from turnloom.llm import votes

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "local_phone", "national_id", "iban", "spelled_email")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHAR = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE = {
    4: re.compile(r"(?<![\w+(])(?:\([0-9]{3}\) |[0-9]{3}[-. ])[0-9]{3}[-.][0-9]{4}(?![\w-])", re.A),
    5: re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", re.A),
    6: re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.A),
    7: re.compile(r"(?<!\w)[a-z0-9._-]{2,64} ?(?:\(at\)|\[at\]) ?[a-z0-9-]{2,64} ?(?:\(dot\)|\[dot\]) ?[a-z]{2,6}(?!\w)",
                  re.A),
}
DIGIT = re.compile(r"[0-9]")
CONTEXT = re.compile(
    r"mail|contact|write|phone|tel|call|mobile|fax|card|visa|credit|account|iban|ssn|social|passport|"
    r"address|host|server|login|customer", re.I)
TECHNICAL = re.compile(r"version|build|release|chapter|section|isbn|invoice|order|serial|part no|model|sku", re.I)
DOMAINS = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "app", "dev", "online",
           "site", "cloud", "tech", "shop", "blog", "email", "xyz", "me", "io", "ai")
# Shares of the votes against, none, for: among personal data, and among other spans.
RULES = {
    "strict": ((0.05, 0.05, 0.90), (0.60, 0.05, 0.35)),
    "checksum": ((0.01, 0.50, 0.49), (0.45, 0.50, 0.05)),
    "gazetteer": ((0.05, 0.45, 0.50), (0.40, 0.45, 0.15)),
    "context": ((0.005, 0.45, 0.545), (0.005, 0.85, 0.145)),
    "technical": ((0.03, 0.96, 0.01), (0.40, 0.59, 0.01)),
    "free": ((0.05, 0.01, 0.94), (0.50, 0.01, 0.49)),
}
PRIOR = (0.9, 0.6, 0.6, 0.7, 0.5, 0.5, 0.5, 0.6)  # share of personal data, per kind
VIRTUAL, STRENGTH = 50.0, 200.0
# Which votes a labeler can cast, where not all three: by rule, by kind.
CAST = {"context": (0, 1), "technical": (-1, 0), "free": (-1, 1)}
CHECKED, TOLD = (2, 6), (0, 1, 2, 3)  # kinds with a checksum, kinds with a strict form
FORM = ("long", "spaced", "parens", "letters")
FEATURES = (*[f"is_{k}" for k in KINDS], *[f"{r}_{v}" for r in RULES for v in ("for", "against")], *FORM)
PATTERNS = StructType([StructField("kind", LongType()), StructField("votes", StringType()),
                       StructField("form", StringType()), StructField("n", LongType())])
FOUND = StructType([
    StructField("doc_id", LongType()), *[StructField(f"n_{k}", LongType()) for k in BASE],
    StructField("n_added", LongType()), StructField("base_sha256", StringType()),
    StructField("spans", StringType()),
])


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _iban(value: str) -> bool:
    value = value.replace(" ", "")
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around every @, since a search from the left would walk each word once per character."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHAR:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def candidates(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(kind, start, end, whether the base check passes) of all candidate spans."""
    if "@" in text:
        for a, b in _emails(text):
            yield 0, a, b, True
    if DIGIT.search(text):
        for m in IP.finditer(text):
            yield 1, *m.span(), all(len(p.lstrip("0")) <= 3 and int(p) <= 255 if len(p) < 40
                                    else not p.strip("0") for p in m[0].split("."))
        for m in CARD.finditer(text):
            n = m.end() - m.start()
            if n >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                yield 2, *m.span(), 13 <= len(digits) <= 19 and luhn(digits)
        if "+" in text:
            for m in PHONE.finditer(text):
                yield 3, *m.span(), 9 <= sum(c.isdigit() for c in m[0]) <= 15
        for kind in (4, 5, 6):
            for m in LOOSE[kind].finditer(text):
                yield kind, *m.span(), False
    if "at)" in text or "at]" in text:
        for m in LOOSE[7].finditer(text):
            yield 7, *m.span(), False


def _gazetteer(kind: int, value: str) -> int:
    """For, against or no vote by what is known of such values."""
    if kind in (0, 7):
        last = value.rstrip(")] ").replace(" ", "").rpartition(")" if ")" in value else "." if "." in value else "]")[2]
        last = last.rpartition(".")[2].lower()
        return 1 if last in DOMAINS else 0 if len(last) == 2 and last.isalpha() else -1
    if kind == 1:
        return -1 if value.startswith(("0.", "127.", "255.")) or value.endswith(".0") else 1
    digits = [c for c in value if c.isdigit()]
    if kind in (2, 3):
        return -1 if len(set(digits)) <= 2 else 0
    if kind == 4:  # area and exchange never begin with 0 or 1
        return -1 if digits[0] in "01" or digits[3] in "01" or len(set(digits)) <= 2 else 1
    if kind == 5:  # areas, groups and serials that are never given out
        return -1 if value[:3] in ("000", "666") or value[0] == "9" or value[4:6] == "00" or value[7:] == "0000" else 0
    return 0


def label(text: str, kind: int, a: int, b: int, passes: bool) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Votes of the labelers, and the form of the span, for one candidate."""
    value, before = text[a:b], text[max(0, a - 40):a]
    strict = (1 if passes else -1) if kind in TOLD else 0
    checksum = 0 if kind not in CHECKED else 1 if (passes if kind == 2 else _iban(value)) else -1
    context = 1 if CONTEXT.search(before) else 0
    technical = -1 if TECHNICAL.search(before) else 0
    left, right = text[a - 1:a], text[b:b + 1]
    joined = left.isalnum() or right.isalnum() or left in ("/", "_", "#") or right in ("/", "_")
    form = int(b - a > 16), int(" " in value), int("(" in value), int(any(c.isalpha() for c in value))
    return (strict, checksum, _gazetteer(kind, value), context, technical, -1 if joined else 1), form


def features(kind: int, vote: tuple[int, ...], form: tuple[int, ...]) -> tuple[int, ...]:
    return (*[int(kind == k) for k in range(len(KINDS))], *[int(v == x) for v in vote for x in (1, -1)], *form)


def castable(kind: int) -> list[tuple[int, ...]]:
    """All vote patterns that the labelers can cast on a kind."""
    votes_of = [CAST.get(r, (-1, 0, 1)) for r in RULES]
    votes_of[0] = (-1, 1) if kind in TOLD else (0,)
    votes_of[1] = (-1, 1) if kind in CHECKED else (0,)
    return list(itertools.product(*votes_of))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for value in batch.column(0):
            text = value.as_py() or ""
            for kind, a, b, passes in candidates(text):
                vote, form = label(text, kind, a, b, passes)
                seen[kind, ",".join(map(str, vote)), ",".join(map(str, form))] += 1
    if seen:
        rows = [(*k, n) for k, n in seen.items()]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), types)], PATTERNS.names)


def fit_classifier(features: np.ndarray, target: np.ndarray, counts: np.ndarray, steps: int = 400,
                   ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression on soft targets by Newton steps; the last weight is the bias."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w, total = np.zeros(x.shape[1]), max(counts.sum(), 1.0)
    for _ in range(min(steps, 50) if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (counts * (p - target)) / total + ridge * w
        hessian = (x.T * (counts * p * (1 - p))) @ x / total + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(seen: list[tuple[int, tuple[int, ...], tuple[int, ...], int]]) -> np.ndarray:
    """Weights of the classifier from (kind, votes, form, count) of all candidates."""
    start = np.array([[shares[1] for shares in RULES.values()], [shares[0] for shares in RULES.values()]])
    rows, target, weight = [], [], []
    for kind, prior in enumerate(PRIOR):
        own = [(v, f, float(n)) for k, v, f, n in seen if k == kind]
        patterns = castable(kind)
        at = np.arange(len(RULES))
        shares = np.array([sum(p * np.prod(start[c, at, np.array(v) + 1]) for c, p in ((1, prior), (0, 1 - prior)))
                           for v in patterns])
        own += [(v, (0,) * len(FORM), VIRTUAL * x) for v, x in zip(patterns, shares / shares.sum())]
        vote, counts = np.array([v for v, _, _ in own]), np.array([n for _, _, n in own])
        model = votes.fit(vote, counts, start, prior=prior, strength=STRENGTH)
        rows += [features(kind, v, f) for v, f, _ in own]
        target.append(model.posterior(vote))
        weight.append(counts / counts.sum())
    return fit_classifier(np.array(rows, float), np.concatenate(target), np.concatenate(weight), ridge=1e-5)


def learn(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Weights of the span classifier, from all candidates of all texts."""
    def numbers(joined: str) -> tuple[int, ...]:
        return tuple(int(v) for v in joined.split(","))

    seen = docs.select(F.col(text).cast("string")).mapInArrow(_patterns, PATTERNS).groupBy(
        "kind", "votes", "form").agg(F.sum("n").alias("n")).orderBy("kind", "votes", "form").collect()
    return train([(r["kind"], numbers(r["votes"]), numbers(r["form"]), r["n"]) for r in seen])


def probability(values: tuple[int, ...], weights: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-(np.dot(values, weights[:-1]) + weights[-1]))))


def find(text: str, weights: np.ndarray, threshold: float = 0.5
         ) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans as (kind, start, end); added ones touch neither base nor added ones."""
    base, loose = [], []
    for kind, a, b, passes in candidates(text):
        if passes:
            base.append((kind, a, b))
        elif kind >= len(BASE):
            loose.append((a, b, kind))
    base.sort()
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = list(itertools.accumulate((b for _, b in taken), max))  # how far the spans so far go
    added, end = [], 0
    for a, b, kind in sorted(loose):
        before = bisect.bisect_left(starts, b)
        if a < end or before and reach[before - 1] > a:
            continue
        if probability(features(kind, *label(text, kind, a, b, False)), weights) >= threshold:
            added.append((kind, a, b))
            end = b
    return base, added


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _scan(weights: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                base, added = find(value.as_py() or "", weights, threshold)
                n = [sum(k == i for k, _, _ in base) for i in range(len(BASE))]
                out.append((doc_id, *n, len(added), hashlib.sha256(_joined(base).encode()).hexdigest(),
                            _joined(base + added)))
            if out:
                types = [pa.int64()] * 6 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), types)], FOUND.names)

    return run


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, counts per base kind and of added spans, digest of the base spans, all spans."""
    weights = learn(docs, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_scan(weights, threshold), FOUND)


def op8_personal_data(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
