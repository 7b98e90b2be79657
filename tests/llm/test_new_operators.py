"""Merkle manifest, conversation repair and license scan against plain Python on small tables."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnloom.llm import licenses, merkle, repair

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string, tree string, level string"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    langs = ["en", "en", "en", "de", None, ""]
    rows = [(i if i != 7 else None, rng.choice([None, "", "text %d" % i, "é" * 5000]), rng.choice(langs),
             rng.choice([None, "s1"]), rng.choice([None, 3, 2**63 - 1]), "x", "y", "z") for i in range(150)]
    return rows + [rows[3], rows[3], (3, "other", "en", None, 1, "x", "y", "z"), (900, "alone", "xx", None, 1, "", "", "")]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, n_chars):
    i, text, lang, source = row[:4]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n_chars, text)])


def tree(leaves):
    """Top, and per leaf its siblings with their side."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, a in enumerate(at):
            if (a ^ 1) < len(level):
                paths[i].append((a & 1, level[a ^ 1]))
            else:
                paths[i].append(None)
        level = [sha(*level[i:i + 2]) for i in range(0, len(level), 2)]
        at = [a // 2 for a in at]
    return level[0], paths


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_proofs_equal_plain_trees(spark, corpus, bits):
    from zlib import crc32

    groups = defaultdict(list)
    for row in corpus:
        groups[row[2]].append((row[0] is not None, row[0] or 0, leaf(row, row[4]), row))
    subroots, inner = {}, {}
    for lang, rows in groups.items():
        rows.sort(key=lambda r: r[:3])
        subroots[lang], paths = tree([r[2] for r in rows])
        inner[lang] = list(zip(rows, paths))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    root, outer = tree([subroots[x] for x in langs])
    want = []
    for lang, above in zip(langs, outer):
        for (_, _, h, row), path in inner[lang]:
            n = row[4]
            claim = n + 1 if n is not None and row[0] is not None and crc32(str(row[0]).encode()) % 7 == 0 else n
            at = leaf(row, claim)
            for step in path + above:
                at = sha(at) if step is None else sha(step[1], at) if step[0] else sha(at, step[1])
            proof = sha(*[s[1] for s in path + above if s])
            want.append((row[0], h, subroots[lang], root, proof, at, at == root))
    docs = spark.createDataFrame(corpus, DOCS).repartition(3)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    longer = F.when(tampered, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    rows = merkle.manifest(docs, claims={"n_chars": longer.cast("decimal(20,0)")}, bits=bits).collect()
    got = []
    for r in rows:
        hexed = [bytes(r[c]).hex() for c in ("leaf", "subroot", "root")]
        folded = merkle.fold(bytes(r["claim"] or r["leaf"]), bytes(r["segment"])).hex()
        proof = sha("".join(s.hex() for s in merkle.siblings(bytes(r["segment"]))))
        got.append((r["key"], *hexed, proof, folded, folded == hexed[2]))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_few_rows(spark):
    docs = spark.createDataFrame([], DOCS)
    assert merkle.manifest(docs).count() == 0
    (row,) = merkle.manifest(spark.createDataFrame([(1, None, None, None, None, "", "", "")], DOCS)).collect()
    assert row["leaf"] == row["subroot"] == row["root"] and row["segment"] == b""


# --- conversation repair --------------------------------------------------------------------------
def exhaustive(rows):
    """All repairs of up to 40, by enumeration with up to three Inserts in a row."""
    def inserted(found):
        out = new = set(found)
        for _ in range(3):
            new = {(c + 3, a + "I", repair.NEXT[q, repair.EXPECTED[q][0]]) for c, a, q in new}
            out = out | new
        return out

    found = inserted({(0, "", repair.START)})
    for initial, fault in rows:
        more, new = 3 * (fault == "truncated"), set()
        for c, a, q in found:
            new.add((c + 4, a + "D", q))
            if fault not in ("blank", "duplicate"):
                new.add((c + more + 3, a + "R", repair.NEXT[q, repair.EXPECTED[q][0]]))
                if (q, initial) in repair.NEXT:
                    new.add((c + more, a + "K", repair.NEXT[q, initial]))
        found = inserted({x for x in new if x[0] <= 40})
    return min((c, a) for c, a, q in found if q in repair.FINAL)


def test_agenda_finds_the_lightest_repair():
    rng = random.Random(2)
    for _ in range(300):
        rows = [(rng.choice(["s", "u", "a", "t", ""]), rng.choice(["", "", "blank", "duplicate", "truncated"]))
                for _ in range(rng.randint(0, 5))]
        (weight,) = repair.lightest(rows, {repair.START: (0, "")}, True).values()
        assert weight == exhaustive(rows), rows


def worked_out(rows):
    """One conversation in plain Python: rows of (turn, role, text)."""
    rows = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for t, r, x in rows))
    seen, faults, counts = set(), [], dict(blank=0, duplicate=0, truncated=0)
    for _, _, role, text in rows:
        chars = re.findall("[^\x20\x09-\x0D]", text)
        fault = ("blank" if not chars else "duplicate" if (role, text) in seen
                 else "truncated" if chars[-1] not in ".!?" else "")
        counts[fault] = counts.get(fault, 0) + 1
        seen.add((role, text))
        faults.append((role[:1], fault))
    cost, audit = exhaustive(faults)
    kept = "\n".join(f"{r}:{t}" for r, t in repair.edited([(r, t, "") for _, _, r, t in rows], audit))
    turns = [t for known, t, _, _ in rows if known]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[0] + b[0] for a, b in zip(faults, faults[1:])]
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("block", [2, 1024])
def test_repairs_equal_plain_python(spark, block):
    rng = random.Random(4)
    by_conv = defaultdict(list)
    for conv in [None, *range(60)]:
        for t in range(rng.randint(1, 6)):
            by_conv[conv].append((rng.choice([t, t, None, 10 * t]), rng.choice(["user", "assistant", "system", "tool", None, ""]),
                                  rng.choice(["Yes.", "No", "", " \n", None, "Yes.", "Long " * 3000, f"Row {t}!"])))
    by_conv[1].append(by_conv[1][0])
    rows = [(c, *r, "x", "y") for c, rs in by_conv.items() for r in rs]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seen string, said string")
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repaired(df.repartition(3), block=block).collect()}
    assert got == {c: worked_out(rs) for c, rs in by_conv.items()}
    assert repair.repaired(df.limit(0)).count() == 0


def test_long_conversation_in_blocks():
    rng = random.Random(8)
    rows = [(i, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", " "]) + str(i)) for i in range(700)]
    results = set()
    for block in (50, 333, 1024):
        state = repair.Repair(block)
        for row in rows:
            state.add(*row, False)
        results.add(state.result())
    assert len(results) == 1


# --- license scan ---------------------------------------------------------------------------------
def held(words, found):
    """Base places, base labels, labels and score of one text, every block against every template."""
    places, base, labels, score = [], set(), set(), 0.0
    for t in found:
        if t.exact:
            here = [i for i in range(len(words)) if tuple(words[i:i + len(t.words)]) == t.words]
            places += here
            if here:
                base.add(t.label)
                labels.add(t.label)
                score = 1.0
            continue
        for b in range(0, len(words), t.width):
            shared = len(set(words[b:b + 2 * t.width]) & set(t.words))
            if shared >= t.need:
                labels.add(t.label)
                score = max(score, shared / len(set(t.words)))
    return (len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), score)


def test_license_scan_equals_brute_force(spark):
    rng = random.Random(6)
    found = licenses.templates()
    vocabulary = sorted({w for t in found for w in t.words})
    texts = [None, "", "...", "MIT License", "mit-license É cc by", "CC BY cc by", "gnu general public license"]
    for _ in range(120):
        words = [rng.choice(vocabulary) if rng.random() < 0.8 else "other" for _ in range(rng.randint(0, 120))]
        t = list(rng.choice(found).words)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = "changed"
        at = rng.randint(0, len(words))
        texts.append(rng.choice([" ", "\n", "-", "\x7f"]).join([*words[:at], *t, *words[at:]]).upper())
    texts.append("word " * 400_000 + "Released under the MIT License." + " word" * 10)
    rows = [(i, t, "a", "b") for i, t in enumerate(texts)] + [(3, texts[3], "a", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n string").repartition(4)
    got = sorted((tuple(r) for r in licenses.scan(df).collect()), key=repr)
    want = sorted(((i, *held(licenses.WORD.findall(licenses.lower(t or "")), found)) for i, t, *_ in rows), key=repr)
    assert got == want
    assert any(r[6] != r[5] for r in got)
    assert licenses.scan(df.limit(0)).count() == 0
    assert all(r["labels"] == "" for r in licenses.scan(df, []).collect())


def test_token_order_does_not_change_the_result():
    found, rng = licenses.templates(), random.Random(1)
    text = "Licensed under CC BY-NC 4.0 and " + " ".join(w for t in found for w in t.words)
    results = set()
    for _ in range(5):
        counts = {i: rng.randint(0, 9) for i in range(300)}
        index = licenses.Index(found, counts)
        ((_, n, at, ids),) = index.vocabulary.places(pa.array([text]))
        results.add(index.scan(n, at, ids))
    assert len(results) == 1


def test_template_limits():
    with pytest.raises(ValueError, match="no words"):
        licenses.templates(phrases=(("x", "..."),))
    with pytest.raises(ValueError, match="threshold"):
        licenses.templates(threshold=0)
    with pytest.raises(ValueError, match="do not travel"):
        licenses.templates(notices=(("long", "w " * (licenses.MOST_WORDS + 1)),))
    assert np.all(licenses.OUTSIDE[[32, 47, 58, 96, 123, 127]]) and not licenses.OUTSIDE[200]
