"""One query per operator, over whole tables.

Every query reads the given tables through ``Tables`` and returns scalars: lists are joined and
long texts are given as md5 and length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnloom import fixed_values as fv
from turnloom.functions import lists, numbers, seeded, text, tokens
from turnloom.functions.ngrams import bleu_scores
from turnloom.operators import (
    candidates, joins, labels, metrics, passages, positions, prepare, ranges, render, selection,
)
from turnloom.plans import workflows
from turnloom.plans.fixtures import Tables
from turnloom.settings import RECIPES, TRAIN_RECIPES, Settings
from turnloom.sources import commits, readers, sinks
from turnloom.streaming import ordered, running

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BY_SPLIT = ("split",)
SEED = "42.0"
BASE = Settings(n_sampled_negative=4, topk_topic=3)


def query(name: str):
    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        return fn

    return register


# --- shared shapes ----------------------------------------------------------------------------
def size(arr: Column | str) -> Column:
    return F.size(arr).cast("bigint")


def digest(c: Column | str) -> Column:
    return F.md5(text.col(c))


def list_digest(arr: Column | str) -> Column:
    return F.md5(F.array_join(arr, "|"))


def text_columns(name: str, c: Column) -> list[Column]:
    return [digest(c).alias(f"{name}_md5"), F.length(c).cast("bigint").alias(f"{name}_length")]


def list_columns(name: str, arr: Column) -> list[Column]:
    return [list_digest(arr).alias(f"{name}_md5"), size(arr).alias(f"n_{name}")]


def nine(c: Column | str, name: str) -> Column:
    return F.round(text.col(c), 9).alias(name)


def sample_lists(t: Tables, passages: bool = False) -> DataFrame:
    """Samples with their uncut passages."""
    return joins.merge_knowledge(t.samples(passages, dialog=False), t.lists())


def prepared(t: Tables, cfg: Settings) -> DataFrame:
    return prepare.prepare(t.samples(), t.lists(), cfg)


def scored_rows(t: Tables, task: str) -> DataFrame:
    """Answers with label, topic and split of their samples."""
    samples = t.samples(passages=task == "P", dialog=False)
    labelled = samples.select("idx", "split", "topic", prepare.pick_label(task).alias("label"))
    return joins.eval_join(t.generations(task), labelled)


def prompted_rows(t: Tables) -> DataFrame:
    """Response answers with the prompt they were generated for."""
    cfg = RECIPES["inspired_response"]
    prompts = render.build_prompts(prepared(t, cfg), cfg)
    return joins.eval_join(
        t.generations("R"), prompts.select("idx", "split", "topic", "label", "prompt")
    )


# --- sources and sinks ------------------------------------------------------------------------
@query("scan_samples")
def scan_samples(t):
    path = sinks.scratch_dir(t.spark, "samples")
    samples = t.samples()
    for split in ("train", "test"):
        samples.where(F.col("split") == split).drop("split").write.parquet(f"{path}/{split}")
    rows = readers.read_both(t.spark, f"{path}/train", f"{path}/test")
    return rows.select(
        "idx", "split", "topic", digest("dialog").alias("dialog_md5"),
        size("predicted_topic").alias("n_predicted"),
        digest("target_knowledge").alias("target_md5"),
    )


@query("scan_knowledge")
def scan_knowledge(t):
    path = sinks.scratch_dir(t.spark, "knowledge")
    sinks.write_knowledge(t.lists(), path, compression="gzip")
    rows = readers.read_knowledge(t.spark, path)
    return rows.select(
        "idx", size("predicted_know").alias("n_lists"),
        *list_columns("passages", F.flatten("predicted_know")),
    )


@query("scan_templates")
def scan_templates(t):
    path = sinks.scratch_dir(t.spark, "templates")
    sinks.write_templates(t.spark, fv.TEMPLATES, path)
    return prompt_query(t, "DIP2I", templates=readers.load_templates(t.spark, path))


@query("sink_scored")
def sink_scored(t):
    path = sinks.scratch_dir(t.spark, "scored")
    sinks.write_scored(metrics.scored_records(prompted_rows(t)), path)
    rows = t.spark.read.schema(
        "idx bigint, CONTEXT string, GEN string, ANSWER string, hitgen string, hit_scores string,"
        " bleu_scores string, sample_bleu_scores string, contain boolean, llama_hit boolean,"
        " beam_scores string, espresso_hit boolean"
    ).json(path)
    return rows.select(
        "idx", digest("CONTEXT").alias("context_md5"), digest("GEN").alias("gen_md5"),
        digest("ANSWER").alias("answer_md5"), "hitgen", "hit_scores", "bleu_scores",
        "sample_bleu_scores", "contain", "llama_hit", "beam_scores", "espresso_hit",
    )


@query("sink_scored_epochs")
def sink_scored_epochs(t):
    rows = scored_rows(t, "R").withColumn("epoch", F.lit(0).cast("bigint"))
    later = rows.withColumns({"epoch": F.lit(1).cast("bigint"), "beams": F.reverse("beams")})
    records = metrics.scored_records(
        rows.unionByName(later).withColumn("prompt", F.col("label")), per=["epoch"])
    path = sinks.scratch_dir(t.spark, "scored-epochs")
    sinks.write_scored(records, path)
    return t.spark.read.schema(
        "epoch bigint, idx bigint, GEN string, hitgen string, hit_scores string, bleu_scores string,"
        " sample_bleu_scores string"
    ).json(path).select("epoch", "idx", digest("GEN").alias("gen_md5"), "hitgen", "hit_scores",
                        "bleu_scores", "sample_bleu_scores")


@query("sink_summary")
def sink_summary(t):
    path = sinks.scratch_dir(t.spark, "summary")
    sinks.write_summary(metrics.summary(scored_rows(t, "R")), path)
    return t.spark.read.schema(
        "hitgen string, hit_scores string, bleu_scores string, sample_bleu_scores string"
    ).json(path)


@query("sink_layout")
def sink_layout(t):
    path = sinks.scratch_dir(t.spark, "layout")
    rows = scored_rows(t, "I").select("idx", "label", metrics.joined_beams().alias("gen"))
    sinks.write_layout(rows, path, model="base/model", run_name="item_selection")
    back = t.spark.read.schema(
        "idx bigint, label string, gen string, model string, run_date string, run_name string"
    ).json(path)
    return back.select(
        "idx", digest("label").alias("label_md5"), digest("gen").alias("gen_md5"), "model", "run_name",
        F.rlike("run_date", F.lit("^[0-9]{4}$")).alias("dated"))


@query("sink_rerank")
def sink_rerank(t):
    rows = metrics.rerank_table(t.generations("P"), t.samples(dialog=False), t.lists())
    return rows.select("idx", *list_columns("picked", F.col("predicted_know")))


# --- projections and normalisation ------------------------------------------------------------
def document_texts(t: Tables, fn) -> DataFrame:
    out = t.read("documents").select("doc_id", fn("text").alias("out"))
    return out.select("doc_id", *text_columns("out", F.col("out")))


@query("norm_space")
def norm_space(t):
    return document_texts(t, text.norm_space)


@query("norm_topic")
def norm_topic(t):
    return document_texts(t, text.norm_topic)


@query("norm_answer")
def norm_answer(t):
    return document_texts(t, lambda c: text.norm_answer(c, drop_quotes=True))


def sample_text(t: Tables, name: str, fn) -> DataFrame:
    out = t.samples(passages=False, dialog=name == "dialog").select("idx", fn(name).alias("out"))
    return out.select("idx", *text_columns("out", F.col("out")))


@query("dialog_text")
def dialog_text(t):
    return sample_text(t, "dialog", text.dialog_text)


@query("response_text")
def response_text(t):
    return sample_text(t, "response", text.response_text)


@query("profile_filter")
def profile_filter(t):
    return t.samples(False, False).select("idx", text.profile_filter("user_profile").alias("profile"))


@query("goal_pick")
def goal_pick(t):
    df = t.samples(False, False)
    return df.select("idx", prepare.pick_goal(df).alias("goal"),
                     prepare.pick_goal(df, use_query=True).alias("refined"))


@query("topic_pick")
def topic_pick(t):
    df = t.samples(False, False)
    return df.select("idx", prepare.pick_topic(df).alias("first"),
                     prepare.pick_topic(df, selected_topic=True).alias("selected"))


@query("label_pick")
def label_pick(t):
    return t.samples(dialog=False).select("idx", *[
        digest(prepare.pick_label(task)).alias(f"{name}_md5")
        for task, name in (("R", "response"), ("P", "passage"), ("I", "topic"))
    ])


@query("rationale")
def rationale(t):
    return t.samples(False, False).select("idx", text.rationale("topic_cot").alias("topic_reason"),
                                   text.rationale("passage_cot").alias("passage_reason"))


@query("answer_tail")
def answer_tail(t):
    return t.generations("I").select(
        "idx", text.after_last(metrics.joined_beams(), fv.CONCLUSION).alias("conclusion"),
        text.after_last(metrics.joined_beams(), fv.TOPIC_MARKER).alias("topic_tail"),
    )


@query("context_append")
def context_append(t):
    rows = metrics.context_append(prompted_rows(t))
    return rows.select("idx", *text_columns("context", F.col("context")))


@query("attach_output")
def attach_output(t):
    rows = t.samples(False, False).withColumn("label", prepare.pick_label("R"))
    return prepare.with_output(rows).select("idx", *text_columns("output", F.col("output")))


# --- gates and filters ------------------------------------------------------------------------
@query("gate_topic_hit")
def gate_topic_hit(t):
    df = t.samples(False, False)
    return prepare.gate_topic_hit(df, 3).select("idx", "topic", F.lit("normalised").alias("variant")).unionByName(
        prepare.gate_topic_hit(df, 3, inspired=True).select("idx", "topic", F.lit("raw").alias("variant"))
    )


@query("gate_cot")
def gate_cot(t):
    return prepare.gate_cot(t.samples(False, False)).select("idx", "topic")


@query("gate_gpt")
def gate_gpt(t):
    return prepare.gate_gpt(t.samples(dialog=False), "gpt_selection").select("idx", "topic")


@query("gate_force_topic")
def gate_force_topic(t):
    df = t.samples(dialog=False)
    variants = {
        "cot": Settings(prompt="UDGIP2I_cot", topk_topic=3, positive="gpt_selection"),
        "chosen": Settings(prompt="DGIP2P_cot_new", topk_topic=3, positive="gpt_selection"),
        "forced": Settings(prompt="DIP2P_cot", positive="gpt_selection", force_topic=True, inspired=True),
    }
    out = None
    for name, cfg in variants.items():
        kept = prepare.gate_train(df, cfg).select("idx", F.lit(name).alias("variant"))
        out = kept if out is None else out.unionByName(kept)
    return out


def per_list(t: Tables, fn) -> DataFrame:
    """Apply ``fn(passages, topic, i)`` to the passages of every predicted topic."""
    rows = sample_lists(t).select("idx", F.flatten(
        F.transform("predicted_know", lambda l, i: fn(l, F.get("predicted_topic", i), i))
    ).alias("out"))
    return rows.select("idx", *list_columns("passages", F.col("out")))


@query("drop_empty_passages")
def drop_empty_passages(t):
    return per_list(t, lambda l, topic, i: lists.non_empty(l))


@query("passage_mentions")
def passage_mentions(t):
    return per_list(t, lambda l, topic, i: lists.mentions(l, topic))


@query("passage_mentions_refill")
def passage_mentions_refill(t):
    return per_list(t, lambda l, topic, i: lists.mentions_refill(l, topic, 8))


@query("db_check")
def db_check(t):
    samples = t.samples(False, False)
    kept = joins.known_positions(samples, joins.topic_list(samples))
    # Rows meet their narrow positions before their passages, so whole texts are dealt once.
    merged = joins.merge_knowledge(samples.join(kept, "idx", "left"), t.lists())
    checked = joins.keep_positions(merged)
    return checked.select(
        "idx", F.array_join("predicted_topic", "|").alias("topics"),
        F.aggregate("predicted_topic_confidence", F.lit(0.0), lambda a, x: a + x).alias("confidence"),
        *list_columns("passages", F.flatten("predicted_know")),
    )


@query("exclude_topics")
def exclude_topics(t):
    return prepare.exclude_topics(t.samples(False, False)).select("idx", "topic")


@query("substr_flags")
def substr_flags(t):
    return metrics.substring_flags(prompted_rows(t)).select(
        "idx", "contain", "llama_hit", "espresso_hit"
    )


# --- joins and sets ---------------------------------------------------------------------------
@query("merge_knowledge")
def merge_knowledge(t):
    samples, know = t.samples(False, False), t.lists()
    on = joins.merge_knowledge(samples, know, combined=True)
    off = joins.merge_knowledge(samples, know, disable_know=True)
    shape = lambda df, name: df.select(
        "idx", F.lit(name).alias("variant"), "combined", size("predicted_know").alias("n_lists"),
        *list_columns("passages", F.flatten("predicted_know")),
    )
    return shape(on, "with").unionByName(shape(off, "without"))


@query("eval_join")
def eval_join(t):
    samples = t.samples(dialog=False).select("idx", "topic", "goal", "target_knowledge")
    rows = joins.eval_join(t.generations("P"), samples, t.lists())
    return rows.select(
        "idx", "task", "topic", "goal", digest("target_knowledge").alias("target_md5"),
        F.get("beams", F.lit(0)).alias("answer"),
        *list_columns("passages", F.flatten("predicted_know")),
    )


def exploded_topics(t: Tables) -> tuple[DataFrame, DataFrame]:
    samples = t.samples(False, False)
    rows = samples.select("idx", F.posexplode("predicted_topic").alias("pos", "predicted_topic"))
    return rows, samples


@query("topic_semi")
def topic_semi(t):
    rows, samples = exploded_topics(t)
    kept = joins.topic_semi(rows, joins.topic_list(samples))
    return kept.select("idx", F.col("pos").cast("bigint").alias("pos"), "predicted_topic")


@query("negatives_anti")
def negatives_anti(t):
    rows = sample_lists(t, passages=True).select("idx", F.flatten(F.transform(
        "predicted_know", lambda l: lists.negatives(l, "candidate_knowledges_gpt")
    )).alias("out"))
    return rows.select("idx", *list_columns("negatives", F.col("out")))


@query("rerank_anti")
def rerank_anti(t):
    rows = metrics.reranked(t.generations("P"), t.samples(dialog=False), t.lists())
    return rows.select("idx", *list_columns("unpicked", candidates.unpicked("base", "picked")))


@query("topic_list")
def topic_list(t):
    samples = t.samples(False, False)
    return joins.topic_list(samples.where("split = 'train'"), samples.where("split = 'test'"))


@query("union_with_without_know")
def union_with_without_know(t):
    samples, know = t.samples(False, False), t.lists()
    both = joins.union_with_without_know(
        joins.merge_knowledge(samples, know), joins.merge_knowledge(samples, know, disable_know=True)
    )
    return both.select("idx", F.col("copy").cast("bigint").alias("copy"),
                       size(F.flatten("predicted_know")).alias("n_passages"))


# --- metrics ----------------------------------------------------------------------------------
def rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[nine(c, c) for c in df.columns if c not in keys])


@query("hit_at_k")
def hit_at_k(t):
    return rounded(metrics.hit_at_k(scored_rows(t, "I"), by=BY_SPLIT), "split")


@query("hitgen")
def hitgen(t):
    return rounded(metrics.hitgen(scored_rows(t, "I"), by=BY_SPLIT), "split")


@query("bleu_sample")
def bleu_sample(t):
    scored = scored_rows(t, "R").select("idx", bleu_scores(metrics.FIRST_BEAM, "label").alias("b"))
    return scored.select("idx", *[nine(F.get("b", F.lit(k - 1)), f"bleu{k}") for k in metrics.BLEU_KS])


@query("bleu_corpus")
def bleu_corpus(t):
    return rounded(metrics.bleu_corpus(scored_rows(t, "R"), by=BY_SPLIT), "split")


@query("running_metrics")
def running_metrics(t):
    rows = metrics.running_metrics(scored_rows(t, "R"))
    return rows.select("idx", "cnt", *[nine(f"run_{m}", f"run_{m}") for m in metrics.METRICS])


@query("item_hit_inspired")
def item_hit_inspired(t):
    samples = t.samples(False, False).withColumn("label", prepare.pick_label("I"))
    return rounded(metrics.item_hit_inspired(t.generations("I"), samples, by=BY_SPLIT), "split")


@query("item_hit_exact")
def item_hit_exact(t):
    return rounded(metrics.item_hit_exact(t.generations("I"), t.samples(False, False), by=BY_SPLIT), "split")


@query("passage_hit_at_k")
def passage_hit_at_k(t):
    return rounded(metrics.passage_hit_at_k(
        t.generations("P"), t.samples(dialog=False), t.lists(), by=BY_SPLIT), "split")


@query("response_bleu")
def response_bleu(t):
    return rounded(metrics.response_bleu(scored_rows(t, "R")))


@query("row_count")
def row_count(t):
    rows = None
    for task in "IPR":
        part = t.generations(task).select("idx", "task")
        rows = part if rows is None else rows.unionByName(part)
    return metrics.row_count(joins.eval_join(rows, t.samples(False, False).select("idx", "split")),
                             by=("task", "split"))


@query("distinct_n")
def distinct_n(t):
    rows = metrics.distinct_ngrams(scored_rows(t, "R"), by=BY_SPLIT)
    return rows.select("split", "n", nine("dist", "dist"))


# --- prefixes, cuts and draws -----------------------------------------------------------------
@query("confidence_prefix")
def confidence_prefix(t):
    kept = candidates.confidence_prefix("predicted_topic", "predicted_topic_confidence", 5, 0.7)
    return t.samples(False, False).select("idx", F.array_join(kept, "|").alias("topics"))


@query("first_occurrence")
def first_occurrence(t):
    rows, _ = exploded_topics(t)
    kept = joins.first_occurrence(rows, ["idx", "predicted_topic"], "pos")
    return kept.select("idx", F.col("pos").cast("bigint").alias("pos"), "predicted_topic")


@query("topk_topics")
def topk_topics(t):
    return t.samples(False, False).select(
        "idx", F.array_join(lists.topk_topics("predicted_topic", 3), "|").alias("topics"))


@query("topk_passages")
def topk_passages(t):
    return per_list(t, lambda l, topic, i: lists.topk_passages(l, 4))


@query("head_tail")
def head_tail(t):
    return positions.head_tail(t.samples(False, False)).select("idx", "topic")


@query("resume_offset")
def resume_offset(t):
    return positions.resume_from(t.samples(False, False), 100).select("idx", "topic")


@query("shuffle_topics")
def shuffle_topics(t):
    out = seeded.shuffled("predicted_topic", SEED, "idx", "topic")
    return t.samples(False, False).select("idx", F.array_join(out, "|").alias("topics"))


@query("shuffle_passages")
def shuffle_passages(t):
    return per_list(t, lambda l, topic, i: seeded.shuffled(l, SEED, "idx", "passage", i))


@query("random_passages")
def random_passages(t):
    return per_list(t, lambda l, topic, i: seeded.random_passages(lists.non_empty(l), 4, SEED, "idx", i))


@query("random_topic_count")
def random_topic_count(t):
    return t.samples(False, False).select(
        "idx", seeded.random_topic_count(5, SEED, "idx").cast("bigint").alias("k"))


@query("item_random_negative")
def item_random_negative(t):
    places = seeded.item_random_negative("predicted_topic", "topic", 3, 4, SEED, "idx")
    return t.samples(False, False).select("idx", F.array_join(places.cast("array<string>"), "|").alias("places"))


@query("shuffle_rows")
def shuffle_rows(t):
    rows = prepare.shuffle_rows(t.samples(False, False), 42).select("idx", "shuffle_key")
    return positions.hash_positions(rows, "pos", "shuffle_key", "idx")


@query("train_val_split")
def train_val_split(t):
    rows = prepare.train_val_split(t.samples(False, False), 0.2).withColumnRenamed("part", "share_part")
    return prepare.train_val_split(rows, 50).select("idx", "share_part", F.col("part").alias("count_part"))


# --- candidates -------------------------------------------------------------------------------
@query("positive_pick")
def positive_pick(t):
    rows = sample_lists(t, passages=True)
    return rows.select("idx", *[
        digest(candidates.positive_pick(BASE.with_(positive=mode))).alias(f"{mode}_md5")
        for mode in ("pseudo", "highly_relevant", "gpt_selection", "target")
    ])


@query("passage_rerank")
def passage_rerank(t):
    rows = metrics.reranked(t.generations("P"), t.samples(dialog=False), t.lists())
    return rows.select("idx", *list_columns("passages", F.col("reranked")))


@query("passage_rerank_strict")
def passage_rerank_strict(t):
    rows = metrics.reranked(t.generations("P"), t.samples(dialog=False), t.lists(), strict=True)
    return rows.select("idx", *list_columns("passages", F.col("reranked")))


def candidate_lists(t: Tables, cfg: Settings) -> DataFrame:
    rows = candidates.with_candidates(prepared(t, cfg), cfg)
    return rows.select(
        "idx", F.array_join("topics", "|").alias("topics"),
        *list_columns("passages", F.flatten("passage_lists")),
    )


@query("candidates_single")
def candidates_single(t):
    return candidate_lists(t, BASE.with_(prompt="DIP2P_cot", shuffle=True, filtering=True))


@query("candidates_combined")
def candidates_combined(t):
    return candidate_lists(t, BASE.with_(combined=True, shuffle=True, filtering=True))


@query("positives_limit")
def positives_limit(t):
    return t.samples(dialog=False).select(
        "idx", *list_columns("positives", lists.positives_limit("candidate_knowledges_gpt", 2)))


@query("passages_prompt_single")
def passages_prompt_single(t):
    cfg = BASE.with_(prompt="DIP2P", filtering=True)
    rows = prepared(t, cfg)
    plain = render.passages_prompt_single(cfg, prepare.pick_topic(rows))
    target = render.passages_prompt_single(cfg.with_(target=True), prepare.pick_topic(rows))
    out = rows.select("idx", plain.alias("passages"), target.alias("target"))
    return out.select("idx", *text_columns("passages", F.col("passages")),
                      *text_columns("target", F.col("target")))


@query("passages_prompt_combined")
def passages_prompt_combined(t):
    cfg = BASE.with_(combined=True, filtering=True, topic_conf=0.7)
    rows = prepared(t, cfg).withColumn("items", candidates.item_list(cfg))
    forms = {
        "block": cfg, "bare": cfg.with_(all_passages=True),
        "random": cfg.with_(random_passages=True, filtering=False, inspired=True),
    }
    out = rows.select("idx", *[
        render.passages_prompt_combined(c, F.col("items")).alias(name) for name, c in forms.items()
    ])
    return out.select("idx", *[c for name in forms for c in text_columns(name, F.col(name))])


@query("top1_override")
def top1_override(t):
    rows = t.samples(False, False).withColumn("topics", lists.topk_topics("predicted_topic", 3))
    return rows.select(
        "idx", F.array_join(candidates.top1_override(BASE), "|").alias("even_rows"),
        F.array_join(candidates.top1_override(BASE.with_(input_top1=True)), "|").alias("all_rows"),
    )


# --- prompts and labels -----------------------------------------------------------------------
@query("number_list")
def number_list(t):
    return t.samples(False, False).select(
        "idx", lists.number_list(lists.topk_topics("predicted_topic", 3), "Item").alias("lines"))


@query("topic_block")
def topic_block(t):
    rows = sample_lists(t).select("idx", render.topic_block(
        F.slice("predicted_topic", 1, 3), F.slice("predicted_know", 1, 3), "Topic", 4
    ).alias("block"))
    return rows.select("idx", *text_columns("block", F.col("block")))


@query("render_prompt")
def render_prompt(t):
    passages = F.when(F.col("idx") % 2 == 0, F.col("goal")).otherwise(F.lit(""))
    prompt = render.render_prompt(
        fv.TEMPLATES["DP2R_inspired"], instruction=F.col("dialog"), input=passages)
    rows = t.samples(False).select("idx", prompt.alias("prompt"))
    return rows.select("idx", *text_columns("prompt", F.col("prompt")))


PROMPT_SETTINGS = {
    "DIP2I": BASE.with_(prompt="DIP2I", combined=True, inspired=True),
    "DIP2I_cot": RECIPES["inspired_item"],
    "DIP2P": BASE.with_(prompt="DIP2P", filtering=True),
    "DIP2P_cot": RECIPES["inspired_passage"],
    "DP2R_inspired": RECIPES["inspired_response"],
    "UDGIP2I_new": BASE.with_(prompt="UDGIP2I_new", combined=True, filtering=True, query=True),
    "UDGIP2I_cot": RECIPES["durec_item"],
    "DGIP2P_new": BASE.with_(prompt="DGIP2P_new", query=True),
    "DGIP2P_cot_new": RECIPES["durec_passage"],
    "DGP2R": RECIPES["durec_response"],
}


def prompt_query(t: Tables, name: str, **kwargs) -> DataFrame:
    cfg = PROMPT_SETTINGS[name]
    rows = render.build_prompts(prepared(t, cfg), cfg, **kwargs)
    return rows.select("idx", *text_columns("prompt", F.col("prompt")))


for _name in PROMPT_SETTINGS:
    query(f"prompt_{_name}")(lambda t, name=_name: prompt_query(t, name))


@query("append_label")
def append_label(t):
    return prompt_query(t, "UDGIP2I_new", mode="train")


@query("parse_response")
def parse_response(t):
    rows = prompted_rows(t).select("idx", text.parse_response(
        F.concat("prompt", F.lit(" "), metrics.first_beam())).alias("answer"))
    return rows.select("idx", *text_columns("answer", F.col("answer")))


PASSAGE_LABELS = BASE.with_(
    prompt="DIP2P_cot", positive="gpt_selection", candidate_knowledges_gpt=True, shuffle=True)


@query("label_passages")
def label_passages(t):
    single = PASSAGE_LABELS
    many = single.with_(prompt="DIP2I_cot", combined=True, candidate_knowledges_gpt=False)
    a = labels.train_texts(prepared(t, single), single).select(
        "idx", F.lit("positives").alias("variant"), "passage_label", "n_missing_positive")
    b = labels.train_texts(prepared(t, many), many).select(
        "idx", F.lit("target").alias("variant"), "passage_label", "n_missing_positive")
    both = a.unionByName(b)
    return both.select("idx", "variant", *text_columns("label", F.col("passage_label")),
                       F.col("n_missing_positive").cast("bigint").alias("n_missing"))


@query("label_item")
def label_item(t):
    return t.samples(False, False).select(
        "idx", labels.label_item("DIP2I", "Item").alias("plain"),
        labels.label_item("DIP2I_cot", "Item").alias("item"),
        labels.label_item("UDGIP2I_cot", "Topic").alias("topic"))


@query("label_passage_text")
def label_passage_text(t):
    rows = t.samples(dialog=False)
    label = F.when(F.col("gpt_selection") == "", "").otherwise(
        F.concat(F.lit("Passage 1. "), "gpt_selection"))
    return rows.select("idx", *[
        digest(labels.label_passage_text(name, label)).alias(name)
        for name in ("DIP2P", "DIP2P_cot", "DGIP2P_new", "DGIP2P_cot_new")])


@query("label_response")
def label_response(t):
    rows = t.samples(False, False).select("idx", labels.label_response().alias("label"))
    return rows.select("idx", *text_columns("label", F.col("label")))


def train_query(t: Tables, cfg: Settings) -> DataFrame:
    """Gated rows of both splits as examples."""
    rows = labels.train_examples(prepare.gate_train(prepared(t, cfg), cfg), cfg)
    return rows.select(
        "idx", "split", *text_columns("example", F.col("example")),
        size("input_ids").alias("n_ids"), list_digest("labels").alias("labels_md5"),
        F.col("n_missing_positive").cast("bigint").alias("n_missing"))


TRAIN_SETTINGS = {name: cfg.with_(train_only_outputs=True) for name, cfg in RECIPES.items()}


@query("train_examples")
def train_examples(t):
    return train_query(t, BASE.with_(
        prompt="UDGIP2I_new", combined=True, shuffle=True, topic_num_shuffle=True, topk_topic=5,
        item_random_negative=True, item_random_negative_num=5, positive="target",
        force_topic=True, weighted_loss=True))


TRAIN_SETTINGS |= {
    f"{name}_trained": cfg.with_(train_only_outputs=True)
    for name, cfg in TRAIN_RECIPES.items() if cfg != RECIPES[name]
}

for _name, _cfg in TRAIN_SETTINGS.items():
    query(f"train_examples_{_name}")(lambda t, cfg=_cfg: train_query(t, cfg))


# --- tokens -----------------------------------------------------------------------------------
@query("truncate_tail")
def truncate_tail(t):
    return document_texts(t, lambda c: tokens.truncate_tail(c, 128))


@query("truncate_head")
def truncate_head(t):
    return document_texts(t, lambda c: text.strip(tokens.truncate_head(c, 50)))


@query("truncate_profile")
def truncate_profile(t):
    return sample_text(t, "user_profile", lambda c: tokens.truncate_profile(c, 5))


@query("truncate_instructions")
def truncate_instructions(t):
    cfg = PROMPT_SETTINGS["DP2R_inspired"]
    rows = render.build_prompts(prepared(t, cfg), cfg).select(
        "idx", tokens.truncate_instructions("prompt", 100).alias("head"),
        tokens.truncate_instructions("prompt", 100, reverse=True).alias("tail"))
    return rows.select("idx", *text_columns("head", F.col("head")), *text_columns("tail", F.col("tail")))


def tokenized(t: Tables) -> DataFrame:
    rows = t.samples(False).select(
        "idx", text.norm_space(text.dialog_text("dialog")).alias("prompt"),
        text.norm_space(text.response_text("response")).alias("label_text"))
    rows = rows.withColumn("example", F.concat("prompt", F.lit(" "), "label_text"))
    return labels.tokenize_example(rows)


def token_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "idx", *list_columns("ids", F.col("input_ids")), list_digest("labels").alias("labels_md5"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("bigint").alias("mask_sum"))


@query("tokenize_example")
def tokenize_example(t):
    return token_columns(tokenized(t))


@query("mask_prompt_labels")
def mask_prompt_labels(t):
    return token_columns(labels.mask_prompt(tokenized(t)))


@query("alternate_mask")
def alternate_mask(t):
    return token_columns(labels.alternate_mask(tokenized(t)))


@query("pad_batches")
def pad_batches(t):
    rows = metrics.pad_batches(tokenized(t), 16, F.lit("<pad>"))
    return rows.select("idx", F.col("batch").cast("bigint").alias("batch"),
                       *list_columns("ids", F.col("input_ids")),
                       list_digest("attention_mask").alias("mask_md5"))


MERGED = RECIPES["inspired_item"].with_(merge=True, val_set_size=50, train_only_outputs=True)


@query("train_batches")
def train_batches(t):
    """The training part of the final table in dense batches."""
    rows = workflows.training_table(t.samples(), t.lists(), MERGED).where("part = 'train'")
    rows = workflows.training_batches(rows, 16, F.lit("<pad>"))
    return rows.select("idx", F.col("copy").cast("bigint").alias("copy"), "batch", "pos",
                       *list_columns("ids", F.col("input_ids")),
                       *list_columns("labels", F.col("labels")),
                       list_digest("attention_mask").alias("mask_md5"))


@query("train_examples_merge")
def train_examples_merge(t):
    rows = workflows.training_table(t.samples(), t.lists(), MERGED)
    return rows.select("idx", F.col("copy").cast("bigint").alias("copy"), "part", "shuffle_key",
                       *text_columns("example", F.col("example")), size("input_ids").alias("n_ids"),
                       list_digest("labels").alias("labels_md5"))


@query("beam_softmax")
def beam_softmax(t):
    rows = t.generations("I").select("idx", numbers.beam_softmax("sequence_scores").alias("s"))
    return rows.select("idx", size("s").alias("n_beams"),
                       *[nine(F.get("s", F.lit(i)), f"beam{i}") for i in range(5)])


@query("format_scores")
def format_scores(t):
    rows = metrics.running_metrics(scored_rows(t, "R"))
    return rows.select(
        "idx", numbers.format_scores("array(run_hit1, run_hit2, run_hit3, run_hit4, run_hit5)").alias("hits"),
        numbers.format_scores("array(bleu1, bleu2, bleu3, bleu4)", "\t").alias("bleus"))


@query("beams_reshape")
def beams_reshape(t):
    flat = t.generations("I").select("idx", F.posexplode("beams").alias("place", "text"))
    flat = flat.select((F.col("idx") * 5 + F.col("place")).alias("pos"), "text")
    rows = metrics.beams_reshape(flat, 5)
    return rows.select("idx", F.array_join("beams", "|").alias("beams"))


@query("stream_metrics")
def stream_metrics(t):
    path = sinks.scratch_dir(t.spark, "stream")
    t.generations("R").write.parquet(f"{path}/generations")
    labelled = t.samples(False, False).select(
        "idx", "split", "topic", prepare.pick_label("R").alias("label"))
    samples = sinks.written(labelled, "stream-samples")
    # Two triggers, whatever the number of files.
    stream = readers.stream_generations(
        t.spark, f"{path}/generations", files_per_trigger=max(1, t.buckets() // 2))
    running.run_available(
        running.stream_metrics(stream, samples, by=BY_SPLIT), f"{path}/out", f"{path}/checkpoint")
    return rounded(running.latest(t.spark, f"{path}/out"), "split", "cnt")


# --- runs that go on, and orders of any key ----------------------------------------------------
@query("stream_running")
def stream_running(t):
    """Four arrivals in the order of the rows, each a trigger of its own after a restart."""
    path = sinks.scratch_dir(t.spark, "stream-running")
    labelled = t.samples(False, False).select("idx", "split", "topic", prepare.pick_label("R").alias("label"))
    samples = ranges.ranged(labelled, [F.col("idx")]).drop("_part", "_place")
    answers = t.generations("R")
    size_ = answers.agg((F.max("idx") + 1).alias("n")).scalar()
    for quarter in range(4):
        part = answers.where(F.floor(F.col("idx") * 4 / size_) == quarter)
        part.write.mode("append").parquet(f"{path}/answers")
        stream = readers.stream_generations(t.spark, f"{path}/answers", files_per_trigger=1 << 20)
        ordered.run_ordered(stream, samples, f"{path}/out", f"{path}/checkpoint")
    rows = ordered.finished(t.spark, f"{path}/out", "rows")
    return rows.select("idx", "cnt", *[nine(f"run_{m}", f"run_{m}") for m in metrics.METRICS])


@query("sink_committed")
def sink_committed(t):
    """Two epochs of a run; the first is rerun, and another run stops before it publishes."""
    rows = scored_rows(t, "R").withColumn("epoch", F.lit(0).cast("bigint"))
    later = rows.withColumns({"epoch": F.lit(1).cast("bigint"), "beams": F.reverse("beams")})
    both = rows.unionByName(later).withColumn("prompt", F.col("label"))
    records = sinks.written(metrics.scored_records(both, per=["epoch"]), "records")
    path = sinks.scratch_dir(t.spark, "committed")
    for epoch in (0, 1, 0):
        commits.write_committed(records.where(F.col("epoch") == epoch), path, "response", epoch)
    commits.stage(records.where("epoch = 0"), path, "broken-off", 0)
    back = commits.read_committed(
        t.spark, path, "idx bigint, GEN string, hitgen string, hit_scores string, bleu_scores string,"
        " sample_bleu_scores string")
    return back.select("epoch", "idx", digest("GEN").alias("gen_md5"), "hitgen", "hit_scores",
                       "bleu_scores", "sample_bleu_scores")


@query("evaluation_run")
def evaluation_run(t):
    """The test rows' answers in batches as a model leaves them, to committed records."""
    cfg = RECIPES["inspired_response"].with_(num_beams=2)
    prompts = sinks.written(
        workflows.prompt_table(t.samples().where("split = 'test'"), t.lists(), cfg), "prompts")
    per_batch = cfg.eval_batch_size * cfg.num_beams
    told = ranges.range_positions(prompts.select("idx"), "row", [F.col("idx")]).join(t.generations("R"), "idx")
    flat = told.select("row", "sequence_scores", F.posexplode("beams").alias("beam", "text")).select(
        (F.col("row") * cfg.num_beams + F.col("beam")).alias("at"), "text",
        F.get("sequence_scores", F.col("beam")).alias("score"))
    answers = flat.select(F.expr(f"at div {per_batch}").alias("batch"), (F.col("at") % per_batch).alias("place"),
                          "text", "score")
    path = sinks.scratch_dir(t.spark, "evaluation")
    workflows.evaluate(answers, prompts, cfg, path, "response", 1)
    rows = commits.read_committed(
        t.spark, f"{path}/records",
        "idx bigint, CONTEXT string, GEN string, ANSWER string, hitgen string, hit_scores string,"
        " bleu_scores string, sample_bleu_scores string, contain boolean, llama_hit boolean,"
        " beam_scores string, espresso_hit boolean")
    return rows.select(
        "run", "epoch", "idx", digest("CONTEXT").alias("context_md5"), digest("GEN").alias("gen_md5"),
        digest("ANSWER").alias("answer_md5"), "hitgen", "hit_scores", "bleu_scores",
        "sample_bleu_scores", "contain", "llama_hit", "beam_scores", "espresso_hit")


@query("passage_dictionary")
def passage_dictionary(t):
    """Prompts from a dictionary of passages that are cut once each."""
    cfg = PROMPT_SETTINGS["DIP2I_cot"]
    know = t.lists().take(cfg.lists_needed)
    held = know.lists.select(F.array("passages").alias("predicted_know"))
    short = passages.cut_once(sinks.written(passages.dictionary(held), "passages"), cfg.passage_cutoff)
    refs = know.changed(lambda held: passages.references(held).withColumnRenamed(passages.REFS, "predicted_know"))
    lists_ = passages.expand(refs.whole().withColumnRenamed("predicted_know", passages.REFS), short)
    rows = render.build_prompts(prepare.prepare(t.samples(), lists_, cfg, cut=False), cfg)
    return rows.select("idx", *text_columns("prompt", F.col("prompt")))


@query("range_positions")
def range_positions(t):
    """Places by an md5 key, by ids with wide gaps, and running lengths by the key."""
    rows = t.read("documents").select(
        "doc_id", (F.col("doc_id") * 10**12).alias("wide"), F.md5(F.col("doc_id").cast("string")).alias("key"),
        F.length("text").cast("bigint").alias("chars"))
    by_key = ranges.range_positions(rows, "key_pos", [F.col("key")])
    by_id = ranges.range_positions(by_key, "id_pos", [F.col("wide").desc()])
    return ranges.range_running(by_id, {"run_chars": F.col("chars")}, [F.col("key")], unique=True).drop("chars", "wide")


@query("scan_knowledge_split")
def scan_knowledge_split(t):
    path = sinks.scratch_dir(t.spark, "knowledge-arrays")
    sinks.write_knowledge(t.lists(), path, block=1000)
    rows = readers.read_knowledge_split(t.spark, path)
    return rows.select(
        "idx", size("predicted_know").alias("n_lists"),
        *list_columns("passages", F.flatten("predicted_know")),
    )


@query("val_threshold")
def val_threshold(t):
    """The rows of an exact part, and the n-th key that bounds them, for several n."""
    rows = t.samples(False, False).select("idx", F.md5(F.concat_ws("|", F.lit("42"), "idx")).alias("key"))
    flags = {f"in_{n}": selection.among_smallest(rows, n, "key") for n in (1, 50, 1000)}
    return rows.withColumns(flags).drop("key")


@query("length_batches")
def length_batches(t):
    rows = tokenized(t).select("idx", size("input_ids").alias("n_ids"))
    return metrics.length_batches(rows, 16, F.col("n_ids"), 42, mega=8)


@query("distinct_n_sketch")
def distinct_n_sketch(t):
    """Merged sketches of two halves beside the exact shares: are they within five per cent?"""
    rows = scored_rows(t, "R")
    halves = [metrics.distinct_n_sketches(rows.where(F.col("idx") % 2 == i), by=BY_SPLIT) for i in (0, 1)]
    merged = metrics.merge_distinct_n(halves[0].unionByName(halves[1]), by=BY_SPLIT)
    exact = metrics.distinct_ngrams(rows, by=BY_SPLIT).withColumnRenamed("dist", "exact")
    return merged.join(exact, ["split", "n"]).select(
        "split", "n", "grams", (F.abs(F.col("dist") / F.col("exact") - 1) <= 0.05).alias("within"))


@query("merge_observed")
def merge_observed(t):
    """The merged rows' digest, and the counts that the same pass observed."""
    merged, seen = joins.merge_observed(t.samples(False, False), t.knowledge().where("idx % 10 <> 3"))
    rows = merged.select("idx", size("predicted_know").alias("n_lists")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("idx") * (F.coalesce("n_lists", F.lit(0)) + 1)).alias("told"))
    rows = sinks.written(rows, "observed")
    return rows.withColumns({k: F.lit(v).cast("bigint") for k, v in joins.check_observed(seen).items()})


@query("score_cube")
def score_cube(t):
    rows = scored_rows(t, "R").join(t.samples(False, False).select("idx", "goal"), "idx")
    cube = metrics.score_cube(rows, ["split", "goal"])
    return rounded(cube, "split", "goal", "grouping", "cnt")
