"""Candidate topics and passages of a row: ranked, filtered, sampled and cut, all inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnloom import fixed_values as fv
from turnloom.functions import lists, seeded
from turnloom.functions.lists import let, or_empty, take
from turnloom.functions.text import norm_topic
from turnloom.settings import ALL, Settings


def confidence_prefix(
    topics: Column | str, confs: Column | str, k: int, threshold: float
) -> Column:
    """The first k topics, and of these the ones before which the confidences sum up to less
    than the threshold; a threshold of 1 keeps all k."""
    heads = F.slice(topics, 1, k)
    if threshold == 1:
        return heads
    conf_heads = F.slice(confs, 1, k)
    n_paired = let(
        F.struct(heads.alias("t"), conf_heads.alias("c")),
        lambda z: F.slice(z["t"], F.lit(1), F.size(z["c"])),
    )

    def before(c: Column) -> Column:
        return F.transform(
            c, lambda _, i: F.aggregate(F.slice(c, F.lit(1), i), F.lit(0.0), lambda a, x: a + x)
        )

    sums = let(conf_heads, before)
    return let(
        sums,
        lambda s: F.filter(n_paired, lambda _, i: F.get(s, i) < F.lit(threshold)),
    )


def item_list(cfg: Settings) -> Column:
    """Candidate topics of a prompt."""
    return confidence_prefix(
        "predicted_topic", "predicted_topic_confidence", cfg.topk_topic, cfg.topic_conf
    )


def prompt_lists(topics: Column, cfg: Settings) -> Column:
    """Per shown topic its passages for the prompt path; no refill after the topic filter."""
    n = cfg.n_sampled_negative

    def passages(i: Column) -> Column:
        base = lists.non_empty(or_empty(F.get("predicted_know", i)))
        if cfg.random_passages and not cfg.all_passages:
            return seeded.random_passages(base, n, cfg.draw_seed, "idx", i)
        if cfg.filtering:
            base = lists.mentions(base, F.get("predicted_topic", i))
        return take(base, n)

    return F.transform(topics, lambda _, i: passages(i))


def prompt_list_single(topic: Column | str, cfg: Settings) -> Column:
    """Passages of the first topic for the prompt path, with refill after the topic filter."""
    n = cfg.n_sampled_negative
    base = lists.non_empty(or_empty(F.get("predicted_know", F.lit(0))))
    if cfg.filtering:
        base = lists.mentions_refill(base, topic, n, nbsp=True)
    return take(base, n)


def positive_pick(cfg: Settings) -> Column:
    """The target passage by mode; ``pseudo`` draws among the first passages of the first topic."""
    if cfg.positive == "pseudo":
        pool = take(or_empty(F.get("predicted_know", F.lit(0))), cfg.n_pseudo)
        return seeded.random_pick(pool, cfg.draw_seed, "idx", "target")
    if cfg.positive == "highly_relevant":
        return seeded.random_pick("candidate_knowledges_gpt", cfg.draw_seed, "idx", "target")
    if cfg.positive == "gpt_selection":
        return F.col("gpt_selection")
    if cfg.positive == "target":
        return F.col("target_knowledge")
    raise ValueError(f"unknown positive mode {cfg.positive!r}")


def topic_positions(cfg: Settings) -> Column:
    """Positions of the candidate topics of a training row, in random order."""
    k: Column = F.least(F.lit(cfg.topk_topic if cfg.combined else 1), F.size("predicted_topic"))
    if cfg.topic_num_shuffle:
        k = seeded.random_topic_count(k, cfg.draw_seed, "idx")
    if cfg.item_random_negative:
        positions = seeded.item_random_negative(
            "predicted_topic", "topic", k, cfg.item_random_negative_num, cfg.draw_seed, "idx"
        )
    else:
        positions = F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(
            F.array().cast("array<int>")
        )
    return seeded.shuffled(positions, cfg.draw_seed, "idx", "topic")


def candidates_single(cfg: Settings) -> Column:
    """Positives, then hard negatives of the first topic; needs a ``positives`` column."""
    n = cfg.n_sampled_negative
    n_hard: Column
    if cfg.n_hard_negative == ALL:
        n_hard = F.lit(n) - F.size("positives") if n != ALL else F.lit(ALL)
    else:
        n_hard = F.lit(cfg.n_hard_negative)
    hard = lists.negatives(or_empty(F.get("predicted_know", F.lit(0))), "positives")
    if cfg.filtering:
        hard = lists.mentions_refill(hard, F.get("predicted_topic", F.lit(0)), n_hard)
    hard = hard if cfg.n_hard_negative == ALL and n == ALL else take(hard, n_hard)
    if cfg.shuffle:
        hard = seeded.shuffled(hard, cfg.draw_seed, "idx", "hard")
    mixed = take(F.concat(F.col("positives"), hard), n)
    return seeded.shuffled(mixed, cfg.draw_seed, "idx", "mixed") if cfg.shuffle else mixed


def candidates_combined(cfg: Settings) -> Column:
    """Per candidate topic its passages; needs ``positives``, ``positions`` and ``topics``.

    The gold topic's list starts with the positives.
    """
    n = cfg.n_sampled_negative

    def passages(p: Column, i: Column, gold: Column) -> Column:
        out = lists.negatives(or_empty(F.get("predicted_know", p)), "positives")
        if cfg.filtering:
            key = F.get("predicted_topic", i if cfg.strict_compat else p)
            out = lists.mentions_refill(out, key, n)
        is_gold = norm_topic(F.get("topics", i)) == gold
        out = F.when(is_gold, F.concat(F.col("positives"), out)).otherwise(out)
        out = take(out, n)
        return seeded.shuffled(out, cfg.draw_seed, "idx", "passage", i) if cfg.shuffle else out

    return let(
        norm_topic("topic"),
        lambda gold: F.transform(F.col("positions"), lambda p, i: passages(p, i, gold)),
    )


def random_lists(cfg: Settings) -> Column:
    """Per candidate topic random passages (an ablation); positives play no part."""
    return F.transform(
        F.col("positions"),
        lambda p, i: seeded.random_passages(
            or_empty(F.get("predicted_know", p)), cfg.n_sampled_negative, cfg.draw_seed, "idx", i
        ),
    )


def with_candidates(df: DataFrame, cfg: Settings) -> DataFrame:
    """Add ``positives``, ``topics`` and ``passage_lists`` (one list per shown block)."""
    out = df.withColumn(
        "positives", lists.positives_limit("candidate_knowledges_gpt", cfg.n_sampled_positive)
    ).withColumn("positions", topic_positions(cfg))
    topics = F.transform("positions", lambda p: F.get("predicted_topic", p))
    if cfg.selected_topic and "selected_topic" in df.columns:
        topics = F.array("selected_topic")
        place = (F.array_position("predicted_topic", F.col("selected_topic")) - 1).cast("int")
        first = F.coalesce(F.get("positions", F.lit(0)), F.lit(0))
        out = out.withColumn(
            "positions",
            F.array(first if cfg.strict_compat else F.when(place >= 0, place).otherwise(first)),
        )
    out = out.withColumn("topics", topics)
    if not cfg.combined:
        return out.withColumn("passage_lists", F.array(candidates_single(cfg)))
    chosen = random_lists(cfg) if cfg.random_passages else candidates_combined(cfg)
    return out.withColumn("passage_lists", chosen)


def top1_override(cfg: Settings) -> Column:
    """Ablation: on even rows (or always) the item list is the first predicted topic when it is
    the gold one, else the second."""
    first, second = F.get("predicted_topic", F.lit(0)), F.get("predicted_topic", F.lit(1))
    single = F.filter(
        F.array(F.when(F.col("topic") == first, first).otherwise(second)), lambda t: t.isNotNull()
    )
    if cfg.input_top1:
        return single
    return F.when(F.col("idx") % 2 == 0, single).otherwise(F.col("topics"))


def passage_picks(gen: Column | str, base: Column | str, strict: bool = False) -> Column:
    """Passages named in a generation: 0 is the last passage, numbers past the end are skipped,
    repeated mentions stay. ``strict`` reads one digit per mention, else the whole number counts."""
    numbers = F.regexp_extract_all(
        gen, F.lit(fv.PASSAGE_PICK if strict else fv.PASSAGE_NUMBER), F.lit(1))

    def pick(b: Column) -> Column:
        places = F.transform(numbers, lambda d: d.try_cast("int") - 1)
        return F.filter(
            F.transform(
                places, lambda p: F.get(b, F.when(p < 0, F.size(b) - 1).otherwise(p))
            ),
            lambda x: x.isNotNull(),
        )

    return let(base if isinstance(base, Column) else F.col(base), pick)


def unpicked(base: Column | str, picked: Column | str) -> Column:
    """Passages that no mention picked, in order."""
    return lists.minus(base, picked)


def rerank_base(know: Column | str = "predicted_know", n: int = 4) -> Column:
    """The first ``n`` non-empty raw passages of the first topic."""
    return take(lists.non_empty(or_empty(F.get(know, F.lit(0)))), n)


def passage_rerank(gen: Column | str, base: Column | str) -> Column:
    """Named passages in order, then the others."""
    return let(
        F.struct(
            (base if isinstance(base, Column) else F.col(base)).alias("base"),
            passage_picks(gen, base).alias("picked"),
        ),
        lambda z: F.concat(z["picked"], unpicked(z["base"], z["picked"])),
    )


