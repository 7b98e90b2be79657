"""The runs a user starts: prompts for a test set, training examples, scores, a recorded evaluation.

The first three are one plan each from the input tables to the result, lazy but for ``scored_table``, which
writes its scores first; model training and generation happen elsewhere, between ``prompt_table`` and
``score``. ``evaluate`` takes the answers of one epoch as they were generated and leaves its records.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from turnloom import fixed_values as fv
from turnloom.functions.tokens import Tokenizer
from turnloom.operators import joins, labels, metrics, positions, prepare, render
from turnloom.operators.passages import SharedLists
from turnloom.operators.ranges import range_positions
from turnloom.settings import Settings
from turnloom.sources import commits, sinks


def prompt_table(
    samples: DataFrame, know: DataFrame | SharedLists, cfg: Settings, topics: DataFrame | None = None,
    tok: Tokenizer | None = None, templates: Mapping[str, render.Template] = fv.TEMPLATES,
) -> DataFrame:
    """(idx, topic, label, prompt) of a test set."""
    rows = prepare.prepare(samples, know, cfg, topics, tok)
    return render.build_prompts(rows, cfg, "test", templates).select(
        "idx", "topic", "label", "prompt"
    )


def training_table(
    samples: DataFrame, know: DataFrame | SharedLists, cfg: Settings, topics: DataFrame | None = None,
    tok: Tokenizer | None = None, templates: Mapping[str, render.Template] = fv.TEMPLATES,
) -> DataFrame:
    """Gated, split and tokenized training examples in the random order of the epoch.

    With ``merge`` every row comes twice: with its passages and without, each copy with its own
    draws and place, both in the same part.
    """
    rows = prepare.prepare(samples, know, cfg, topics, tok)
    if cfg.merge:
        bare = prepare.prepare(samples, know, cfg, topics, tok, disable_know=True)
        rows = joins.union_with_without_know(rows, bare)
    kept = prepare.with_output(prepare.gate_train(rows, cfg))
    parts = prepare.train_val_split(kept, cfg.val_set_size, 42)
    if not cfg.merge:
        examples = labels.train_examples(parts, cfg, tok, templates)
    else:
        full, short = [
            labels.train_examples(parts.where(F.col("copy") == copy), cfg.with_(copy=copy), tok, templates)
            for copy in (0, 1)
        ]
        examples = full.unionByName(short)
    return prepare.shuffle_rows(examples, cfg.draw_seed)


def training_batches(
    examples: DataFrame, batch: int, pad: Column, multiple: int = 8,
) -> DataFrame:
    """Rows of ``training_table`` in batches of their final order, ids and labels padded alike.

    Batches are dense: all but the last have ``batch`` rows, whatever rows the gates dropped.
    """
    tie = ["idx", "copy"] if "copy" in examples.columns else ["idx"]
    placed = positions.hash_positions(examples, "pos", "shuffle_key", *tie)
    return metrics.pad_batches(placed, batch, pad, multiple=multiple, idx="pos")


def score(
    generations: DataFrame, samples: DataFrame, know: DataFrame | SharedLists, cfg: Settings,
    by: Sequence[str] = (), per: Sequence[str] = (),
) -> DataFrame:
    """The final metric of a task: item hits, passage hits or BLEU.

    ``per`` names columns of the generations, for example the epoch of the model.
    """
    if cfg.task == "P":
        return metrics.passage_hit_at_k(generations, samples, know, (1, 2, 3), by, per,
                                        cfg.rerank_base, cfg.strict_compat)
    labelled = samples.withColumn("label", prepare.pick_label(cfg.task))
    if cfg.task == "R":
        rows = joins.eval_join(generations, labelled.select("idx", "label", *by))
        return metrics.response_bleu(rows, by=[*per, *by])
    if cfg.task == "I" and cfg.inspired:
        return metrics.item_hit_inspired(generations, labelled, by, per)
    if cfg.task == "I":
        return metrics.item_hit_exact(generations, samples, by=by, per=per)
    raise ValueError(f"task {cfg.task!r} has no score")


def scored_table(
    generations: DataFrame, prompts: DataFrame, per: Sequence[str] = ()
) -> DataFrame:
    """The scored record of every answer, in the order of the prompts; running means start anew
    for every value of ``per``, columns of the answers such as the epoch."""
    rows = joins.eval_join(generations, prompts.select("idx", "topic", "label", "prompt"))
    return metrics.scored_records(rows, per)



SUMMARY = "hitgen string, hit_scores string, bleu_scores string, sample_bleu_scores string"


def evaluate(
    answers: DataFrame, prompts: DataFrame, cfg: Settings, path: str, run: str, epoch: int = 0,
) -> dict[str, str]:
    """Record one epoch of a model: its answers in batches, to scored records and a summary.

    ``answers`` (batch, place, text, score) holds ``num_beams`` answers a prompt in the order of the
    prompts, ``eval_batch_size`` prompts a batch; ``prompts`` is ``prompt_table`` of the same rows. Records
    are committed below ``path/records`` and the final means below ``path/summary``, so the same epoch run
    again replaces what it left. With ``write`` off only the first rows are recorded; the summary, which
    is returned, covers all of them.
    """
    placed = range_positions(prompts.select("idx"), "row", [F.col("idx")])
    beams = metrics.batched_beams(answers, cfg.eval_batch_size, cfg.num_beams)
    rows = sinks.written(beams.join(placed, "row").drop("row"), "answers")
    records = scored_table(rows, prompts)
    if not cfg.write:
        records = records.where(F.col("cnt") <= sinks.FIRST_ROWS)
    commits.write_committed(records, f"{path}/records", run, epoch)
    scored = joins.eval_join(rows, prompts.select("idx", "topic", "label"))
    commits.write_committed(metrics.summary(scored), f"{path}/summary", run, epoch)
    final = commits.read_committed(prompts.sparkSession, f"{path}/summary", SUMMARY, run)
    return final.where(F.col("epoch") == epoch).drop("run", "epoch").first().asDict()
