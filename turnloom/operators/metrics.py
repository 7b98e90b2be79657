"""Scores of generated answers.

Inputs are rows of generations joined with their samples: ``beams``, ``label``, ``topic`` and,
where named, ``prompt``, ``sequence_scores`` and the passages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from turnloom import fixed_values as fv
from turnloom.functions import text
from turnloom.functions.lists import let
from turnloom.functions.ngrams import bleu_scores, ngrams
from turnloom.functions.numbers import beam_softmax, format_scores, fixed4
from turnloom.operators import candidates, positions
from turnloom.operators.joins import eval_join, row_keys
from turnloom.operators.passages import SharedLists
from turnloom.operators.prepare import exclude_topics
from turnloom.operators.ranges import range_positions, range_running
from turnloom.sources.sinks import written

HIT_KS = (1, 2, 3, 4, 5)
BLEU_KS = (1, 2, 3, 4)


FIRST_BEAM = "coalesce(get(beams, 0), '')"


def first_beam() -> Column:
    return F.expr(FIRST_BEAM)


def joined_beams() -> Column:
    return F.array_join("beams", fv.BEAM_JOINER)


def hit_flags(ks: Sequence[int] = HIT_KS) -> Column:
    """Per k: is the stripped label part of the first k beams, in lower case?

    Stripping the beams as well could not change the answer.
    """
    label = F.lower(text.strip("label"))
    return let(
        label,
        lambda l: F.array(*[
            F.contains(
                F.lower(F.array_join(F.slice("beams", 1, k), fv.HIT_JOINER)), l
            ).cast("int")
            for k in ks
        ]),
    )


def hitgen_flag() -> Column:
    return F.contains(F.lower(first_beam()), F.lower("topic")).cast("int")


def row_scores(df: DataFrame, ks: Sequence[int] = HIT_KS) -> DataFrame:
    """Add ``hit1…``, ``hitgen`` and ``bleu1…4`` of every row."""
    staged = df.withColumns({"_hits": hit_flags(ks), "_bleu": bleu_scores(FIRST_BEAM, "label")})
    return staged.withColumns({
        **{f"hit{k}": F.get("_hits", F.lit(i)) for i, k in enumerate(ks)},
        "hitgen": hitgen_flag(),
        **{f"bleu{k}": F.get("_bleu", F.lit(i)) for i, k in enumerate(BLEU_KS)},
    }).drop("_hits", "_bleu")


def _mean(df: DataFrame, names: Sequence[str], by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(n).alias(n) for n in names])


def hit_at_k(df: DataFrame, ks: Sequence[int] = HIT_KS, by: Sequence[str] = ()) -> DataFrame:
    flags = df.withColumn("_hits", hit_flags(ks))
    named = flags.select(*by, *[F.get("_hits", F.lit(i)).alias(f"hit{k}") for i, k in enumerate(ks)])
    return _mean(named, [f"hit{k}" for k in ks], by)


def hitgen(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _mean(df.select(*by, hitgen_flag().alias("hitgen")), ["hitgen"], by)


def bleu_corpus(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the row scores, not pooled counts."""
    scored = df.select(*by, bleu_scores(FIRST_BEAM, "label").alias("_b"))
    named = scored.select(*by, *[F.get("_b", F.lit(i)).alias(f"bleu{k}") for i, k in enumerate(BLEU_KS)])
    return _mean(named, [f"bleu{k}" for k in BLEU_KS], by)


response_bleu = bleu_corpus


def row_count(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("cnt"))


def distinct_ngrams(df: DataFrame, ns: Sequence[int] = (1, 2, 3, 4), by: Sequence[str] = ()) -> DataFrame:
    """Per ``n`` the distinct n-grams over all n-grams of the first beams, as ``dist``, in one pass.

    Grams are counted per value first (partial sums before the shuffle), so a frequent gram
    does not make one task large.
    """
    def tagged(n: int) -> Column:
        size = F.lit(n).cast("bigint")
        return F.transform(ngrams(FIRST_BEAM, n), lambda g: F.struct(size.alias("n"), g.alias("gram")))

    counts = df.select(*by, F.inline(F.concat(*[tagged(n) for n in ns]))).groupBy(*by, "n", "gram").agg(F.count(F.lit(1)).alias("times"))
    return counts.groupBy(*by, "n").agg((F.count(F.lit(1)) / F.sum("times")).alias("dist"))


def distinct_n(df: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """The same for one ``n``, as ``dist{n}``."""
    return distinct_ngrams(df, (n,), by).select(*by, F.col("dist").alias(f"dist{n}"))


METRICS = [f"hit{k}" for k in HIT_KS] + ["hitgen"] + [f"bleu{k}" for k in BLEU_KS]


def running_metrics(
    df: DataFrame, block: int | None = None, per: Sequence[str] = ()
) -> DataFrame:
    """Mean of every metric over the rows up to and including each row, in ``idx`` order, as
    ``run_*``, with the row's own scores and ``cnt``.

    The means start anew for every value of ``per`` (such as the epoch); an ``idx`` that repeats
    within one raises. The scores are written once, while the plan is built: totals and windows then
    read numbers, not answers. Rows are summed in range partitions of ``idx``, or, with ``block``, in
    blocks of so many ids, which suits dense ids only.
    """
    scored = written(row_scores(df).select(*per, "idx", *METRICS), "scores")
    sums = {f"run_{m}": F.col(m).cast("double") for m in METRICS}
    sums["cnt"] = F.lit(1).cast("bigint")
    if block is None:
        running = range_running(scored, sums, [F.col("idx")], per, unique=True)
    else:
        running = positions.running_by_index(scored, sums, block=block, per=per, unique=True)
    return running.withColumns({f"run_{m}": F.col(f"run_{m}") / F.col("cnt") for m in METRICS})


def substring_flags(df: DataFrame) -> DataFrame:
    """Case-sensitive tests for a stripped text inside another; an empty text is found."""
    beam, label = text.strip(first_beam()), text.strip("label")
    return df.withColumns({
        "contain": F.contains("prompt", beam),
        "llama_hit": F.contains(first_beam(), label),
        "espresso_hit": F.contains("prompt", label),
    })


def scored_records(df: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """The eleven-column record of every scored row, with ``per``, ``idx`` and ``cnt``."""
    texts = substring_flags(df).withColumn("beam_softmax", beam_softmax("sequence_scores"))
    rows = texts.join(running_metrics(df, per=per), [*per, "idx"])
    return rows.select(
        *per, "idx", "cnt",
        F.col("prompt").alias("CONTEXT"),
        joined_beams().alias("GEN"),
        F.col("label").alias("ANSWER"),
        fixed4("run_hitgen").alias("hitgen"),
        format_scores(_array(f"run_hit{k}" for k in HIT_KS)).alias("hit_scores"),
        format_scores(_array(f"run_bleu{k}" for k in BLEU_KS)).alias("bleu_scores"),
        format_scores(_array(f"bleu{k}" for k in BLEU_KS)).alias("sample_bleu_scores"),
        "contain", "llama_hit",
        format_scores("beam_softmax").alias("beam_scores"),
        "espresso_hit",
    )


def _array(names) -> str:
    return f"array({', '.join(names)})"


def summary(df: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """The final metrics, one row (per epoch or other ``per``); the sample scores are those of the
    last row."""
    scored = row_scores(df)
    last = F.max_by(F.struct(*[f"bleu{k}" for k in BLEU_KS]), "idx")
    totals = scored.groupBy(*per).agg(*[F.avg(m).alias(m) for m in METRICS], last.alias("last"))
    return totals.select(
        *per, fixed4("hitgen").alias("hitgen"),
        format_scores(_array(f"hit{k}" for k in HIT_KS)).alias("hit_scores"),
        format_scores(_array(f"bleu{k}" for k in BLEU_KS)).alias("bleu_scores"),
        format_scores(_array(f"last.bleu{k}" for k in BLEU_KS)).alias("sample_bleu_scores"),
    )


def _share_of_samples(
    rows: DataFrame, samples: DataFrame, hits: dict[str, Column], by: Sequence[str],
    per: Sequence[str],
) -> DataFrame:
    """Sums of hit flags over the answered rows, divided by the number of all sample rows."""
    sums = rows.groupBy(*per, *by).agg(
        *[F.coalesce(F.sum(h.cast("int")), F.lit(0)).alias(n) for n, h in hits.items()]
    )
    if by:
        totals = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
        joined = totals.join(sums, list(by), "inner" if per else "left")
        size = F.col("_all")
    else:
        joined, size = sums, samples.agg(F.count(F.lit(1)).alias("_all")).scalar()
    return joined.select(
        *per, *by, *[(F.coalesce(F.col(n), F.lit(0)) / size).alias(n) for n in hits]
    )


def _answered(
    gen: DataFrame, samples: DataFrame, told: Sequence[str], known: Sequence[str]
) -> DataFrame:
    """Answers with columns of their samples; they meet on ``split`` too where both tables have it."""
    keys = row_keys(gen, samples)
    left = gen.select(*keys, *[c for c in told if c not in keys])
    return left.join(samples.select(*keys, *[c for c in known if c not in keys]), keys)


def item_hit_inspired(
    gen: DataFrame, samples: DataFrame, by: Sequence[str] = (), per: Sequence[str] = ()
) -> DataFrame:
    """Share of all sample rows whose label is part of the conclusion of the answer, exact
    characters; a sample without an answer counts as a miss.

    ``by`` are columns of the samples, ``per`` columns of the answers (such as the epoch).
    """
    tail = text.after_last(joined_beams(), fv.CONCLUSION)
    rows = _answered(gen, samples, ["beams", *per], ["label", *by])
    return _share_of_samples(rows, samples, {"hit1": F.contains(tail, F.col("label"))}, by, per)


def exact_item_flag() -> Column:
    """Does the answer name exactly the gold topic? After ``topic N. `` the whole rest counts,
    else the first beam of the tail."""
    tail = text.norm_answer(text.after_last(joined_beams(), fv.TOPIC_MARKER), drop_quotes=True)
    gold = text.norm_answer("topic")

    def named(t: Column) -> Column:
        numbered = F.regexp_extract(t, f"(?s){fv.NUMBERED_TOPIC}(.*)", 1)
        return F.when(F.rlike(t, F.lit(fv.NUMBERED_TOPIC)), numbered).otherwise(
            F.substring_index(t, fv.BEAM_JOINER, 1)
        )

    return (let(tail, named) == gold).cast("int")


def item_hit_exact(
    gen: DataFrame, samples: DataFrame,
    exclude: tuple[str, ...] = fv.NO_RECOMMENDATION_TOPICS, by: Sequence[str] = (),
    per: Sequence[str] = (),
) -> DataFrame:
    """Share of exact topic matches among the answered rows with a topic to recommend."""
    rows = _answered(gen, exclude_topics(samples, exclude), ["beams", *per], ["topic", *by])
    return rows.groupBy(*per, *by).agg(F.avg(exact_item_flag()).alias("hit1"))


def context_append(df: DataFrame) -> DataFrame:
    """Prompt, newline, generation (after the response marker)."""
    gen = text.after_last(joined_beams(), fv.EVAL_RESPONSE_MARKER)
    return df.withColumn("context", F.concat("prompt", F.lit("\n"), gen))


def reranked(
    gen: DataFrame, samples: DataFrame, know: DataFrame | SharedLists, by: Sequence[str] = (),
    per: Sequence[str] = (), base_size: int = 4, strict: bool = False,
) -> DataFrame:
    """Every answered sample with ``base`` (the first ``base_size``), ``picked`` and ``reranked``
    passages (raw, uncut). Of lists that rows share only what can be in a base is dealt to the rows."""
    if isinstance(know, SharedLists):
        know = know.take(1).changed(lambda lists: lists.withColumn(
            "predicted_know", F.array(candidates.rerank_base(n=base_size)))).whole()

    def keyed(table: DataFrame, *columns) -> DataFrame:
        keys = [k for k in ("idx", "split") if k in table.columns]
        return table.select(*keys, *[c for c in columns if not (isinstance(c, str) and c in keys)])

    base = keyed(know, candidates.rerank_base(n=base_size).alias("base"))
    answers = keyed(gen, *per, text.after_last(joined_beams(), fv.EVAL_RESPONSE_MARKER).alias("gen"))
    rows = eval_join(answers, keyed(samples, "target_knowledge", *by), base)
    picked = rows.withColumn("picked", candidates.passage_picks("gen", "base", strict))
    return picked.withColumn(
        "reranked", F.concat("picked", candidates.unpicked("base", "picked"))
    )


def passage_hit_at_k(
    gen: DataFrame, samples: DataFrame, know: DataFrame | SharedLists, ks: Sequence[int] = (1, 2, 3, 4),
    by: Sequence[str] = (), per: Sequence[str] = (), base_size: int = 4, strict: bool = False,
) -> DataFrame:
    """Share of all sample rows whose target is among the first k re-ranked passages."""
    place = F.array_position("reranked", F.col("target_knowledge")).alias("place")
    rows = reranked(gen, samples, know, by, per, base_size, strict).select(*per, *by, place)
    hits = {f"hit{k}": F.col("place").between(1, k) for k in ks}
    return _share_of_samples(rows, samples, hits, by, per)


def rerank_table(gen: DataFrame, samples: DataFrame, know: DataFrame | SharedLists) -> DataFrame:
    """The picked passages per row in the shape of a knowledge table."""
    return reranked(gen, samples, know).select("idx", F.col("picked").alias("predicted_know"))


def beams_reshape(df: DataFrame, num_beams: int) -> DataFrame:
    """(pos, text) rows of a flat answer list to one row per ``num_beams`` answers."""
    grouped = df.groupBy(F.expr(f"pos div {int(num_beams)}").alias("idx")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("_rows")
    )
    return grouped.select("idx", F.transform("_rows", lambda r: r["text"]).alias("beams"))


def batched_beams(df: DataFrame, batch_size: int, num_beams: int) -> DataFrame:
    """(batch, place, text, score) rows as a generating job leaves them, to one row per prompt.

    ``row`` numbers the prompts over all batches; ``beams`` and ``sequence_scores`` are in the order of
    the answers. A row with fewer or more than ``num_beams`` answers raises.
    """
    place = F.col("batch") * int(batch_size) * int(num_beams) + F.col("place")
    grouped = df.withColumn("_at", place).groupBy(
        F.expr(f"_at div {int(num_beams)}").alias("row")).agg(
        F.sort_array(F.collect_list(F.struct("_at", "text", "score"))).alias("_rows"))
    whole = F.when(F.size("_rows") != num_beams, F.raise_error(F.concat(
        F.lit("not all beams of row "), F.col("row").cast("string")))).otherwise(F.col("_rows"))
    return grouped.withColumn("_rows", whole).select(
        "row", F.transform("_rows", lambda r: r["text"]).alias("beams"),
        F.transform("_rows", lambda r: r["score"]).alias("sequence_scores"))


def pad_batches(
    df: DataFrame, batch: int, pad: Column, ids: str = "input_ids", multiple: int = 8,
    idx: str = "idx",
) -> DataFrame:
    """Left-pad every row to the longest of its batch, rounded up to a multiple.

    ``labels``, where there are any, get the label that training ignores. A batch is a fixed number of
    rows, so the window over it is never large.
    """
    batched = df.withColumn("batch", F.expr(f"`{idx}` div {int(batch)}"))
    joined = batched.withColumn("_longest", F.max(F.size(ids)).over(W.partitionBy("batch")))
    width = (F.ceil(F.col("_longest") / multiple) * multiple).cast("int")
    gap = width - F.size(ids)
    ignored = F.lit(fv.IGNORED_LABEL)
    if "labels" in df.columns:
        ignored = ignored.cast(df.schema["labels"].dataType.elementType)
    labels = {} if "labels" not in df.columns else {
        "labels": F.concat(F.array_repeat(ignored, width - F.size("labels")), F.col("labels"))
    }
    return joined.withColumns(labels | {
        ids: F.concat(F.array_repeat(pad, gap), F.col(ids)),
        "attention_mask": F.concat(
            F.array_repeat(F.lit(0), gap), F.array_repeat(F.lit(1), F.size(ids))
        ),
    }).drop("_longest")


def score_cube(
    df: DataFrame, by: Sequence[str], sets: Sequence[Sequence[str]] | None = None
) -> DataFrame:
    """Mean of every metric for several groupings in one pass: all subsets of ``by``, or ``sets``.

    ``grouping`` tells the columns that a row sums up from those whose value is NULL: one bit a column of
    ``by``, the last column lowest, 1 where it is summed up. Rows are scored once and summed before they
    are dealt; each grouping adds one narrow row a group and task.
    """
    names = [list(s) for s in sets] if sets is not None else [
        [c for i, c in enumerate(by) if mask >> i & 1] for mask in range(1 << len(by))]
    scored = row_scores(df).select(*by, *METRICS)
    columns = [F.col(c) for c in by]
    return scored.groupingSets([[F.col(c) for c in s] for s in names], *columns).agg(
        F.grouping_id(*columns).cast("bigint").alias("grouping"), F.count(F.lit(1)).alias("cnt"),
        *[F.avg(m).alias(m) for m in METRICS])


def distinct_n_sketches(
    df: DataFrame, ns: Sequence[int] = (1, 2, 3, 4), by: Sequence[str] = (), lg_size: int = 12
) -> DataFrame:
    """Per group and ``n`` the number of n-grams and a sketch of the distinct ones, a few KB whatever the
    number of answers. Sketches of several batches or epochs are merged by ``merge_distinct_n``."""
    def tagged(n: int) -> Column:
        size = F.lit(n).cast("bigint")
        return F.transform(ngrams(FIRST_BEAM, n), lambda g: F.struct(size.alias("n"), g.alias("gram")))

    rows = df.select(*by, F.inline(F.concat(*[tagged(n) for n in ns])))
    return rows.groupBy(*by, "n").agg(
        F.count(F.lit(1)).alias("grams"), F.hll_sketch_agg("gram", F.lit(lg_size)).alias("sketch"))


def merge_distinct_n(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``dist`` of all batches together; merging in any order gives the same."""
    merged = sketches.groupBy(*by, "n").agg(
        F.sum("grams").alias("grams"), F.hll_union_agg("sketch").alias("sketch"))
    return merged.select(*by, "n", "grams", (F.hll_sketch_estimate("sketch") / F.col("grams")).alias("dist"))


def length_batches(
    df: DataFrame, batch: int, length: Column, seed: int | str, mega: int = 50, idx: str = "idx"
) -> DataFrame:
    """Batches of rows of like length in a random, reproducible order: ``batch`` and ``place`` in it.

    Rows are numbered in the order of a seeded hash and cut into blocks of ``mega`` batches; inside a block
    they are sorted by length, longest first, and cut into batches; batches then get a seeded order of their
    own. A window sees one block. Each row comes once; all batches but one are full.
    """
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(idx)))
    keyed = df.withColumns({"_key": key, "_length": length})
    placed = range_positions(keyed, "_pos", [F.col("_key"), F.col(idx)])
    block = placed.withColumn("_block", F.expr(f"_pos div {int(batch) * int(mega)}"))
    order = W.partitionBy("_block").orderBy(F.col("_length").desc(), "_key", idx)
    cut = block.withColumn("_rank", (F.row_number().over(order) - 1).cast("bigint")).withColumns({
        "_cut": F.expr(f"_rank div {int(batch)}"), "place": F.expr(f"_rank % {int(batch)}")})
    told = F.md5(F.concat_ws("|", F.lit(str(seed)), "_block", "_cut"))
    cuts = cut.where("place = 0").select("_block", "_cut", told.alias("_told"))
    numbers = range_positions(cuts, "batch", [F.col("_told"), F.col("_block"), F.col("_cut")]).drop("_told")
    return cut.join(numbers, ["_block", "_cut"]).select(*df.columns, "batch", "place")
