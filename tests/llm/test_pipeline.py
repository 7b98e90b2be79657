"""The pipeline against its parts worked out in plain Python, on the smallest tables."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import SMALL
from turnloom.llm import jaccard, packing, quality

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), name)
        counts.append(docs.count())
        if name != "best_fit_packing":
            assert docs.columns == columns
    assert counts[1] < counts[0] and counts[2] <= counts[1] and counts[4] >= counts[3]
    assert max(r[0] for r in docs.groupBy("sequence_id").sum("length").select("sum(length)").collect()) <= 1024


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), name)
        assert docs.count() == 0


def linked(texts):
    """Smallest identifier of every text's component, all pairs of five-word shingle sets at 0.8."""
    sets, parent = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = re.findall("[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[j:j + 5]) for j in range(len(w) - 4)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(texts, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in texts}


def test_run_equals_plain_python(spark):
    """Which documents come out, how often, and the ids of their pieces; only the verdicts of the quality
    model are taken from its own query, which has its tests."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    good = [r.doc_id for r in quality.op9_quality_rules(spark, SMALL).where("kept").collect()]
    owner = {}
    for i in good:
        text = (rows[i].text or "").translate(LOWER)
        owner[text] = max(i, owner.get(text, i))
    texts = {i: rows[i].text for i in sorted(owner.values())}
    kept = {i for i, c in linked(texts).items() if i == c}
    assert len(kept) < len(texts) < len(good) < len(rows)

    import public_tokenizers

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*model.encode(rows[i].text or "", add_special_tokens=False).ids, 2] for i in kept}
    out = corpus_pipeline.run(spark, SMALL)
    placed = out.collect()
    assert {r.doc_id for r in placed} == kept
    copies, per_piece, places = Counter(), Counter(), defaultdict(list)
    for r in placed:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        copies[r.doc_id] += r.piece == 0
        per_piece[r.doc_id, r.piece] += 1
        places[r.sequence_id].append((r.offset, r.length, part))
    for i in kept:  # every copy has all its pieces; only documents above 1024 ids are cut
        n = sum(1 for d, _ in per_piece if d == i)
        assert n == max(-(-len(ids[i]) // 1024), 1)
        assert {per_piece[i, p] for p in range(n)} == {copies[i]}
    tokens = Counter()
    for i in kept:
        tokens[rows[i].source] += len(re.findall("[^\x20\x09-\x0D]+", rows[i].text or ""))
    largest = max(tokens, key=tokens.get)
    assert all(1 <= copies[i] <= 2 for i in kept)
    assert all(copies[i] == 1 for i in kept if rows[i].source == largest)
    for parts in places.values():
        at = 0
        for offset, length, _ in sorted(parts, key=lambda p: p[:2]):
            assert offset == at
            at += length
        assert at <= 1024

    # The packed ids, read back for every sequence, documents that come twice included.
    cut = packing.pieces(docs.where(F.col("doc_id").isin(sorted(kept))))
    whole = {r.sequence_id: np.frombuffer(r.tokens, "<u4").tolist() for r in packing.sequences(cut, out).collect()}
    assert whole == {s: [t for _, _, part in sorted(p, key=lambda x: x[:2]) for t in part] for s, p in places.items()}


def test_near_stage_takes_a_column_named_like_its_own(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "x"), (2, text + " more", "y"), (3, "other words are here now", "z")]
    kept = jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string, _gone string"))
    assert kept.columns == ["doc_id", "text", "_gone"] and {r.doc_id for r in kept.collect()} == {1, 3}
