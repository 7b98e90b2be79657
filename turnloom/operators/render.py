"""Prompt texts."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from turnloom import fixed_values as fv
from turnloom.functions import seeded
from turnloom.functions.lists import let, number_list
from turnloom.functions.text import append_label, norm_space
from turnloom.operators import candidates
from turnloom.operators.prepare import pick_goal, pick_topic
from turnloom.settings import ALL, Settings

Template = Mapping[str, str]
_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def fill(form: str, values: Mapping[str, Column]) -> Column:
    """One concat of literals and columns.

    The template is cut while planning, so braces inside a dialog are never expanded; a
    placeholder without a value becomes empty.
    """
    parts, end = [], 0
    for hole in _PLACEHOLDER.finditer(form):
        parts.append(F.lit(form[end:hole.start()]))
        parts.append(F.coalesce(values.get(hole.group(1), F.lit("")), F.lit("")))
        end = hole.end()
    parts.append(F.lit(form[end:]))
    return F.concat(*parts)


def render_prompt(template: Template, **cols: Column) -> Column:
    """The full form when ``input`` is non-empty, else the form without input."""
    given = F.coalesce(cols.get("input", F.lit("")), F.lit("")) != F.lit("")
    return F.when(given, fill(template["prompt_input"], cols)).otherwise(
        fill(template["prompt_no_input"], cols)
    )


def first_numbers(passage_lists: Column, n: int) -> Column:
    """The number of each block's first passage: blocks are ``n`` apart, or, when all passages
    are shown, follow each other."""
    if n != ALL:
        return F.transform(passage_lists, lambda _, i: i * n + 1)
    return let(
        F.transform(passage_lists, lambda x: F.size(x)),
        lambda sizes: F.transform(
            sizes,
            lambda _, i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(1), lambda a, x: a + x),
        ),
    )


def topic_block(
    topics: Column, passage_lists: Column, word: str, n: int, heading: bool = True
) -> Column:
    """Per topic a heading, its numbered passages and a blank line."""

    def blocks(z: Column) -> Column:
        def block(t: Column, i: Column) -> Column:
            body = number_list(
                F.coalesce(F.get(z["lists"], i), F.array().cast("array<string>")),
                "Passage", F.get(z["first"], i),
            )
            if not heading:
                return F.concat(body, F.lit("\n\n"))
            title = F.concat(
                F.lit(f"{fv.BLOCK_HEADING}{word} "), (i + 1).cast("string"), F.lit(". "), t
            )
            return F.concat(title, F.lit("\n"), body, F.lit("\n\n"))

        return F.array_join(F.transform(z["topics"], block), "")

    return let(
        F.struct(
            topics.alias("topics"), passage_lists.alias("lists"),
            first_numbers(passage_lists, n).alias("first"),
        ),
        blocks,
    )


def passages_prompt_single(cfg: Settings, topic: Column | str) -> Column:
    """Passages of the first topic for the prompt path."""
    if cfg.target:
        return F.concat(F.lit("Passage 1. "), F.col("target_knowledge"), F.lit("\n"))
    return number_list(candidates.prompt_list_single(topic, cfg), "Passage")


def passages_prompt_combined(cfg: Settings, topics: Column) -> Column:
    """Blocks of all shown topics for the prompt path."""
    return topic_block(
        topics, candidates.prompt_lists(topics, cfg), cfg.item_word, cfg.n_sampled_negative,
        heading=not cfg.all_passages,
    )


def prompt_inputs(cfg: Settings, topics: Column, passages: Column, goal: Column) -> dict[str, Column]:
    """Which text goes into which placeholder, by prompt name."""
    name, dialog = cfg.prompt, F.col("dialog")
    if name in ("DIP2I", "DIP2I_cot"):
        return dict(instruction=dialog, input=number_list(topics, cfg.item_word), input2=passages)
    if name in ("DIP2P", "DIP2P_cot"):
        return dict(instruction=dialog, input=number_list(topics, "Topic"), input2=passages)
    if name == "DP2R_inspired":
        return dict(instruction=dialog, input=passages)
    if name in ("UDGIP2I_new", "UDGIP2I_cot"):
        return dict(instruction=dialog, input=goal, input2=number_list(topics, "Topic"),
                    input3=passages, input4=F.col("user_profile"))
    if name in ("DGIP2P_new", "DGIP2P_cot_new"):
        return dict(instruction=dialog, input=goal, input2=number_list(topics, "Topic"),
                    input3=passages)
    if name == "DGP2R":
        return dict(instruction=dialog, input=goal, input2=passages)
    raise ValueError(f"unknown prompt {name!r}")


def build_prompts(
    df: DataFrame, cfg: Settings, mode: str = "test",
    templates: Mapping[str, Template] = fv.TEMPLATES,
) -> DataFrame:
    """Add ``prompt`` to prepared rows; in train mode the label follows and topics are shuffled."""
    if cfg.prompt not in templates:
        raise ValueError(f"no template for prompt {cfg.prompt!r}")
    staged = df.withColumn("_items", candidates.item_list(cfg)).withColumn(
        "_topic", pick_topic(df, cfg.selected_topic)
    )
    if cfg.combined:
        passages = passages_prompt_combined(cfg, F.col("_items"))
    else:
        passages = passages_prompt_single(cfg, "_topic")
    # Rows past the knowledge table have no passages at all.
    passages = F.when(F.col("predicted_know").isNotNull(), passages).otherwise(F.lit(""))
    shown = F.col("_items")
    if mode == "train":
        shown = seeded.shuffled(shown, cfg.draw_seed, "idx", "topic")
    if cfg.task == "P" and cfg.selected_topic and "selected_topic" in df.columns:
        shown = F.array("selected_topic")
    staged = staged.withColumn("_passages", passages).withColumn("_shown", shown)
    passages = F.col("_passages")
    if cfg.prompt == "DGP2R":
        passages = F.when(passages == F.lit(""), F.lit(" ")).otherwise(passages)
    inputs = prompt_inputs(cfg, F.col("_shown"), passages, pick_goal(df, cfg.query))
    prompt = render_prompt(templates[cfg.prompt], **inputs)
    if mode == "train":
        prompt = append_label(prompt, "label")
    return staged.withColumn("prompt", norm_space(prompt)).drop(
        "_items", "_topic", "_passages", "_shown"
    )
