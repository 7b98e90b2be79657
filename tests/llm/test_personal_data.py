"""Personal data: what the labelers and the trained classifier decide, on planted spans."""

import random
import time

import pytest

from turnloom.llm import pii


def iban(rng, good=True):
    body = "".join(rng.choice("0123456789") for _ in range(18))
    check = next(c for c in range(2, 99) if pii._iban(f"DE{c:02d}{body}") == good)
    return f"DE{check:02d}{body}"


def number(rng, form, first="23456789"):
    """``N`` is a leading digit, ``#`` any digit."""
    return "".join(rng.choice(first) if c == "N" else rng.choice("0123456789") if c == "#" else c for c in form)


GOOD = {
    "local_phone": lambda r: f"{r.choice(['call', 'phone', 'you reach us at', 'mobile'])} {number(r, 'N2#-N3#-####')} soon",
    "national_id": lambda r: f"{r.choice(['ssn', 'social security', 'his number'])} {number(r, 'N2#-45-67N#', '12345678')} is",
    "iban": lambda r: f"{r.choice(['account', 'pay to', 'iban'])} {iban(r)} please",
    "spelled_email": lambda r: f"write to {r.choice(['jo', 'a.li', 'kim'])}{r.randint(1, 99)} (at) mail (dot) {r.choice(['com', 'org', 'de'])} or",
}
BAD = {
    "local_phone": lambda r: f"{r.choice(['serial', 'invoice', 'part no'])} {number(r, 'N2#-N3#-####')} or {number(r, '0##-N##-####')} here",
    "national_id": lambda r: f"{r.choice(['order no', 'model', 'version'])} {number(r, 'N2#-45-67N#', '12345678')} and {number(r, '000-##-####')}",
    "iban": lambda r: f"{r.choice(['account', 'pay to', 'batch'])} {iban(r, good=False)} please",
    "spelled_email": lambda r: f"meet {r.choice(['jo', 'kim'])} (at) noon (dot) {r.choice(['qqqq', 'zzz'])} or",
}


@pytest.fixture(scope="module")
def weights():
    return pii.train([])


def test_votes_for_and_against_have_weights_of_both_signs(weights):
    by_name = dict(zip(pii.FEATURES, weights))
    for rule in ("strict", "checksum", "gazetteer", "free"):
        assert by_name[f"{rule}_for"] > 0.5 and by_name[f"{rule}_against"] < -0.5
    assert by_name["technical_against"] < -0.5 < 0.5 < by_name["context_for"]


@pytest.mark.parametrize("kind", list(GOOD))
def test_precision_and_recall_on_planted_spans(weights, kind):
    rng, k = random.Random(3), pii.KINDS.index(kind)
    found = sum(any(s[0] == k for s in pii.find(GOOD[kind](rng), weights)[1]) for _ in range(300))
    wrong = sum(bool(pii.find(BAD[kind](rng), weights)[1]) for _ in range(300))
    assert found >= 0.95 * 300 and wrong <= 0.05 * 300, (found, wrong)


def test_a_corpus_teaches_the_labelers(spark):
    """Numbers that only ever follow technical words lower the share of personal data of their kind."""
    rng = random.Random(1)
    rows = [(i, f"invoice {number(rng, 'N2#-N3#-####')} paid. " * 5) for i in range(300)]
    learned = pii.learn(spark.createDataFrame(rows, "doc_id long, text string"))
    kind = pii.KINDS.index("local_phone")
    plain = pii.features(kind, (0, 0, 1, 0, 0, 1), (0, 0, 0, 0))
    assert pii.probability(plain, learned) < pii.probability(plain, pii.train([]))
    got = pii.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.selectExpr("sum(n_added)").first()[0] == 0


def test_added_spans_equal_brute_force(weights):
    rng = random.Random(9)
    makers = [*GOOD.values(), *BAD.values()]
    pieces = ["a.b@mail.com", "+1 (302) 555-8032", "10.1.2.3", "4111 1111 1111 1111", "é", "\n"]
    for _ in range(300):
        text = " ".join(rng.choice([rng.choice(makers)(rng), rng.choice(pieces)]) for _ in range(rng.randint(0, 8)))
        base = sorted((k, a, b) for k, a, b, ok in pii.candidates(text) if ok)
        added = []
        for a, b, k in sorted((a, b, k) for k, a, b, _ in pii.candidates(text) if k >= len(pii.BASE)):
            if any(a < y and x < b for _, x, y in base + added):
                continue
            if pii.probability(pii.features(k, *pii.label(text, k, a, b, False)), weights) >= 0.5:
                added.append((k, a, b))
        assert pii.find(text, weights) == (base, added)


def test_many_spans_take_linear_time(weights):
    def seconds(n):
        text = "a.b@mail.com 302-555-8032 or " * n
        start = time.perf_counter()
        assert len(pii.find(text, weights)[0]) == n
        return time.perf_counter() - start

    seconds(100)
    assert seconds(8000) < 14 * max(seconds(1000), 0.01)


def test_spark_path(spark):
    rows = [(1, "write jo1 (at) mail (dot) com or ssn 212-45-6781", "x"), (1, "write jo1 (at) mail (dot) com or ssn 212-45-6781", "x"),
            (None, "order no 212-45-6781", "x"), (3, None, "x"), (4, "", "x"), (5, "word " * 300_000 + "call 302-555-8032", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(2)
    got = sorted(((r.doc_id or 0, r.n_added, r.spans) for r in pii.scan(df).collect()))
    assert got[0] == (0, 0, "") and got[1] == got[2] and got[1][1] == 2
    assert got[3:5] == [(3, 0, ""), (4, 0, "")] and got[5][1] == 1
