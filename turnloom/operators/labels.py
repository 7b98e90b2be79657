"""Label texts and complete training examples."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from turnloom import fixed_values as fv
from turnloom.functions import tokens
from turnloom.functions.lists import let, number_list
from turnloom.functions.text import append_label, norm_space, rationale
from turnloom.functions.tokens import Tokenizer
from turnloom.operators import candidates, render
from turnloom.operators.prepare import pick_goal
from turnloom.settings import Settings


def passage_numbers(passage_lists: Column, n: int) -> Column:
    """The numbers shown before the passages, in flattened order."""
    return let(
        F.struct(passage_lists.alias("lists"), render.first_numbers(passage_lists, n).alias("first")),
        lambda z: F.flatten(
            F.transform(z["lists"], lambda l, i: F.transform(l, lambda _, j: F.get(z["first"], i) + j))
        ),
    )


def positive_lines(passages: Column, numbers: Column, positives: Column) -> Column:
    """``Passage {number}. {text}`` per positive that is shown; the others are left out."""
    return let(
        F.struct(passages.alias("shown"), numbers.alias("number")),
        lambda z: F.array_join(
            F.filter(
                F.transform(
                    positives,
                    lambda x: F.concat(
                        F.lit("Passage "),
                        F.get(z["number"], (F.array_position(z["shown"], x) - 1).cast("int"))
                        .cast("string"),
                        F.lit(". "), x,
                    ),
                ),
                lambda line: line.isNotNull(),
            ),
            "\n",
        ),
    )


def n_missing(passages: Column | str, positives: Column | str) -> Column:
    """Positives that are not among the shown passages."""
    return F.size(candidates.unpicked(positives, passages))


def label_passages(cfg: Settings) -> Column:
    """The passage label of a row with candidates (``passage_lists``, ``passages``, ``numbers``,
    ``positives``, ``passages_text``, ``target``)."""
    if cfg.all_passages:
        return F.lit("")
    if cfg.candidate_knowledges_gpt:
        if cfg.random_passages:
            return F.lit("")
        return positive_lines(F.col("passages"), F.col("numbers"), F.col("positives"))
    if cfg.target:
        return F.col("passages_text")
    place = F.array_position("passages", F.col("target"))
    number = F.coalesce(F.get("numbers", (place - 1).cast("int")), F.lit(0))
    if cfg.strict_compat:
        # The lookup is done only for a target that is also a topic.
        number = F.when(F.array_contains("topics", F.col("target")), place).otherwise(F.lit(0))
    return F.concat(
        F.lit("Passage "), number.cast("string"), F.lit(". "), F.coalesce("target", F.lit(""))
    )


def label_item(prompt_name: str, word: str) -> Column:
    """The gold topic, after the rationale for the prompts that ask for one."""
    if prompt_name in ("DIP2I", "UDGIP2I_new"):
        return F.col("topic")
    item = prompt_name == "DIP2I_cot" and word == "Item"
    conclusion = fv.ITEM_CONCLUSION if item else fv.TOPIC_CONCLUSION
    return F.concat(rationale("topic_cot"), F.lit(conclusion), F.col("topic"), F.lit('"'))


def label_passage_text(prompt_name: str, label: Column) -> Column:
    """The passage label in the words of each prompt."""
    nothing = F.lit(fv.NO_RELEVANT_PASSAGE)
    empty = label == F.lit("")
    if prompt_name == "DIP2P":
        return F.when(empty, nothing).otherwise(label)
    if prompt_name == "DGIP2P_new":
        return F.concat(label, F.lit("."))
    reason = rationale("passage_cot")
    if prompt_name == "DIP2P_cot":
        return F.when(empty, nothing).otherwise(
            F.concat(reason, F.lit(fv.PASSAGE_CONCLUSION_DIP2P_COT), label, F.lit("."))
        )
    if prompt_name == "DGIP2P_cot_new":
        return F.concat(reason, F.lit(fv.PASSAGE_CONCLUSION_DGIP2P_COT_NEW), label)
    raise ValueError(f"prompt {prompt_name!r} has no passage label")


def label_response() -> Column:
    return F.col("response")


def label_text(cfg: Settings) -> Column:
    if cfg.task == "I":
        return label_item(cfg.prompt, cfg.item_word)
    if cfg.task == "P":
        return label_passage_text(cfg.prompt, F.col("passage_label"))
    return label_response()


def train_texts(
    df: DataFrame, cfg: Settings, templates: Mapping[str, render.Template] = fv.TEMPLATES
) -> DataFrame:
    """Add ``prompt`` (without label), ``label_text``, ``example`` and ``n_missing_positive``."""
    if cfg.prompt not in templates:
        raise ValueError(f"no template for prompt {cfg.prompt!r}")
    n = cfg.n_sampled_negative
    lists = F.col("passage_lists")
    rows = candidates.with_candidates(df, cfg)
    rows = rows.withColumns({"passages": F.flatten(lists), "numbers": passage_numbers(lists, n)})
    if cfg.strict_compat:
        rows = rows.withColumn("numbers", F.transform("passages", lambda _, i: i + 1))
    if cfg.combined:
        text = render.topic_block(
            F.col("topics"), lists, cfg.item_word, n, heading="P2R" not in cfg.prompt
        )
    else:
        text = number_list("passages", "Passage")
    rows = rows.withColumns({"passages_text": text, "target": candidates.positive_pick(cfg)})
    shown = F.col("topics")
    if cfg.combined_top1 and not cfg.all_passages:
        shown = candidates.top1_override(cfg)
    rows = rows.withColumns({"passage_label": label_passages(cfg), "shown_topics": shown})
    inputs = render.prompt_inputs(
        cfg, F.col("shown_topics"), F.col("passages_text"), pick_goal(df, cfg.query)
    )
    rows = rows.withColumns({
        "prompt": render.render_prompt(templates[cfg.prompt], **inputs),
        "label_text": label_text(cfg),
        "n_missing_positive": n_missing("passages", "positives"),
    })
    full = F.col("prompt") if cfg.train_only_inputs else append_label("prompt", "label_text")
    return rows.withColumns({"example": norm_space(full), "prompt": norm_space("prompt")})


def tokenize_example(
    df: DataFrame, text: str = "example", add_eos: bool = True, tok: Tokenizer | None = None
) -> DataFrame:
    """Add ``input_ids``, ``attention_mask`` and ``labels`` (a copy of the ids)."""
    ids = df.withColumn("input_ids", tokens.input_ids(text, add_eos, tok))
    return ids.withColumns({
        "attention_mask": tokens.attention_mask("input_ids"), "labels": F.col("input_ids"),
    })


def mask_prompt(
    df: DataFrame, prompt: str = "prompt", rows: Column | None = None, tok: Tokenizer | None = None
) -> DataFrame:
    """Ignore the prompt part of ``labels``, on all rows or on some.

    Prompt and example are both normalised, so the lengths belong together.
    """
    n_prompt = F.size(tok.ids(F.col(prompt)) if tok else tokens.tokens(prompt))
    masked = tokens.mask_prompt_labels(
        "input_ids", n_prompt, "int" if tok else "string"
    )
    if rows is not None:
        masked = F.when(rows, masked).otherwise(F.col("labels"))
    return df.withColumn("labels", masked)


def alternate_mask(df: DataFrame, tok: Tokenizer | None = None) -> DataFrame:
    """Mask the prompt on odd rows only."""
    return mask_prompt(df, rows=F.col("idx") % 2 == 1, tok=tok)


def train_examples(
    df: DataFrame, cfg: Settings, tok: Tokenizer | None = None,
    templates: Mapping[str, render.Template] = fv.TEMPLATES,
) -> DataFrame:
    """Prepared and gated rows to tokenized, masked examples."""
    out = tokenize_example(
        train_texts(df, cfg, templates), add_eos=not cfg.train_only_inputs, tok=tok
    )
    if cfg.weighted_loss:
        return alternate_mask(out, tok)
    if cfg.train_only_outputs:
        return mask_prompt(out, tok=tok)
    return out
