"""The SQL of every query in the catalog."""

from __future__ import annotations

from oracle import base as b
from turnloom.plans.catalog import (
    BASE, MERGED, PASSAGE_LABELS, PROMPT_SETTINGS, SEED, TRAIN_SETTINGS,
)
from turnloom.settings import RECIPES, Settings

ORACLE: dict[str, str] = {}
PROMPTED = RECIPES["inspired_response"]


def docs(x: str) -> str:
    return f"SELECT doc_id, {b.text_columns('out', 'o')} FROM (SELECT doc_id, {x} AS o FROM documents)"


def sample_text(x: str) -> str:
    return b.sql(f"SELECT idx, {b.text_columns('out', 'o')} FROM (SELECT idx, {x} AS o FROM samples)")


def per_list(fn) -> str:
    out = b.flatten_lists("know", lambda l, i: fn(l, f"predicted_topic[{i}]", i))
    return b.sql(
        f"SELECT idx, {b.list_columns('passages', 'o')} FROM "
        f"(SELECT idx, {out} AS o FROM samples JOIN know USING (idx))"
    )


GEN = "array_to_string(beams, ' | ')"


def prompted(select: str, *ctes: str) -> str:
    """Rows of response answers with their prompts: ``p``."""
    rows = ("p AS (SELECT idx, split, topic, label, prompt, beams FROM prompts "
            "JOIN gen_R USING (idx))")
    return b.sql(select, b.prepared(PROMPTED), b.prompts(PROMPTED), rows, *ctes)


def flags() -> str:
    beam, lab, pro = b.strip("beams[1]"), b.strip("label"), b.strip("prompt")
    return (f"contains({pro}, {beam}) AS contain, contains({beam}, {lab}) AS llama_hit, "
            f"contains({pro}, {lab}) AS espresso_hit")


def nine(*names: str) -> str:
    return ", ".join(f"round({n}, 9) AS {n}" for n in names)


HITS = [f"hit{k}" for k in range(1, 6)]
BLEUS = [f"bleu{k}" for k in range(1, 5)]
RUN_HITS = [f"run_{h}" for h in HITS]
RUN_BLEUS = [f"run_{m}" for m in BLEUS]

# --- sources and sinks ------------------------------------------------------------------------
ORACLE["scan_samples"] = b.sql(
    "SELECT idx, split, topic, md5(dialog) AS dialog_md5, len(predicted_topic) AS n_predicted, "
    "md5(target_knowledge) AS target_md5 FROM samples")
ORACLE["scan_knowledge"] = b.sql(
    f"SELECT idx, len(know) AS n_lists, {b.list_columns('passages', 'flatten(know)')} FROM know")
ORACLE["sink_scored"] = prompted(
    f"""SELECT p.idx, md5(prompt) AS context_md5, md5({GEN}) AS gen_md5, md5(label) AS answer_md5,
    {b.fixed(['run_hitgen'])} AS hitgen, {b.fixed(RUN_HITS)} AS hit_scores,
    {b.fixed(RUN_BLEUS)} AS bleu_scores, {b.fixed(BLEUS)} AS sample_bleu_scores, {flags()},
    printf('%.4f', 1 / (1 + exp(-0.5))) || '|' || printf('%.4f', exp(-0.5) / (1 + exp(-0.5))) AS beam_scores
    FROM p JOIN running USING (idx)""",
    b.row_scores("p"), b.running())
_epoch = "OVER (PARTITION BY epoch ORDER BY idx ROWS UNBOUNDED PRECEDING)"
ORACLE["sink_scored_epochs"] = b.sql(
    f"""SELECT epoch, idx // 2 AS idx, gen_md5, {b.fixed(['run_hitgen'])} AS hitgen,
    {b.fixed(RUN_HITS)} AS hit_scores, {b.fixed(RUN_BLEUS)} AS bleu_scores,
    {b.fixed(BLEUS)} AS sample_bleu_scores
    FROM (SELECT idx, epoch, md5({GEN}) AS gen_md5, {', '.join(BLEUS)},
    {', '.join(f'avg({m}) {_epoch} AS run_{m}' for m in b.METRICS)}
    FROM rows_ JOIN (SELECT idx, epoch, beams FROM ep) USING (idx))""",
    b.scored("R"),
    """ep AS (SELECT s.* REPLACE (idx * 2 + e AS idx,
    CASE WHEN e = 1 THEN list_reverse(beams) ELSE beams END AS beams), e AS epoch
    FROM scored s, range(2) r(e))""", b.row_scores("ep"))
ORACLE["sink_summary"] = b.sql(
    f"""SELECT {b.fixed(['hitgen'])} AS hitgen, {b.fixed(HITS)} AS hit_scores,
    {b.fixed(BLEUS)} AS bleu_scores, {b.fixed([f'last{k}' for k in range(1, 5)])} AS sample_bleu_scores
    FROM (SELECT {', '.join(f'avg({m}) AS {m}' for m in b.METRICS)},
    {', '.join(f'arg_max(bleu{k}, idx) AS last{k}' for k in range(1, 5))} FROM rows_)""",
    b.scored("R"), b.row_scores())
ORACLE["sink_layout"] = b.sql(
    f"""SELECT idx, md5({b.norm_space('topic')}) AS label_md5, md5({GEN}) AS gen_md5, 'base-model' AS model,
    'item_selection' AS run_name, true AS dated FROM gen_I JOIN samples USING (idx)""")
ORACLE["sink_rerank"] = b.sql(
    f"SELECT idx, {b.list_columns('picked', 'picked')} FROM reranked", b.reranked())

# --- projections and normalisation ------------------------------------------------------------
ORACLE["norm_space"] = docs(b.norm_space("text"))
ORACLE["norm_topic"] = docs(b.norm_topic("text"))
ORACLE["norm_answer"] = docs(b.norm_answer("text", drop_quotes=True))
ORACLE["dialog_text"] = sample_text(b.dialog_text("dialog"))
ORACLE["response_text"] = sample_text(b.response_text("response"))
ORACLE["profile_filter"] = b.sql(f"SELECT idx, {b.profile_filter('user_profile')} AS profile FROM samples")
ORACLE["goal_pick"] = b.sql("SELECT idx, goal, query AS refined FROM samples")
ORACLE["topic_pick"] = b.sql(
    "SELECT idx, predicted_topic[1] AS first, selected_topic AS selected FROM samples")
ORACLE["label_pick"] = b.sql(
    f"SELECT idx, md5({b.label('R')}) AS response_md5, md5({b.label('P')}) AS passage_md5, "
    f"md5({b.label('I')}) AS topic_md5 FROM samples")
ORACLE["rationale"] = b.sql(
    f"SELECT idx, {b.rationale('topic_cot')} AS topic_reason, "
    f"{b.rationale('passage_cot')} AS passage_reason FROM samples")
ORACLE["answer_tail"] = b.sql(
    f"SELECT idx, {b.after_last(GEN, 'Therefore')} AS conclusion, "
    f"{b.after_last(GEN, 'topic is ')} AS topic_tail FROM gen_I")
ORACLE["context_append"] = prompted(
    f"SELECT idx, {b.text_columns('context', 'c')} FROM (SELECT idx, prompt || chr(10) || "
    f"{b.after_last(GEN, '###Response:')} AS c FROM p)")
ORACLE["attach_output"] = sample_text(b.label("R")).replace("out_md5", "output_md5").replace(
    "out_length", "output_length")

# --- gates and filters ------------------------------------------------------------------------
ORACLE["gate_topic_hit"] = b.sql(
    f"SELECT idx, topic, 'normalised' AS variant FROM samples WHERE {b.topic_hit(3)} UNION ALL "
    f"SELECT idx, topic, 'raw' AS variant FROM samples WHERE {b.topic_hit(3, True)}")
ORACLE["gate_cot"] = b.sql(f"SELECT idx, topic FROM samples WHERE {b.cot_hit()}")
ORACLE["gate_gpt"] = b.sql("SELECT idx, topic FROM samples WHERE gpt_selection <> ''")
_gates = {
    "cot": Settings(prompt="UDGIP2I_cot", topk_topic=3, positive="gpt_selection"),
    "chosen": Settings(prompt="DGIP2P_cot_new", topk_topic=3, positive="gpt_selection"),
    "forced": Settings(prompt="DIP2P_cot", positive="gpt_selection", force_topic=True, inspired=True),
}
ORACLE["gate_force_topic"] = b.sql(" UNION ALL ".join(
    f"SELECT idx, '{name}' AS variant FROM samples WHERE {b.gate(cfg)}"
    for name, cfg in _gates.items()))
ORACLE["drop_empty_passages"] = per_list(lambda l, t, i: b.non_empty(l))
ORACLE["passage_mentions"] = per_list(lambda l, t, i: b.mentions(l, t))
ORACLE["passage_mentions_refill"] = per_list(lambda l, t, i: b.refill(l, t, 8))
ORACLE["db_check"] = b.sql(
    f"""SELECT s.idx, array_to_string(list(t ORDER BY pos), '|') AS topics,
    sum(conf) AS confidence, {b.list_columns('passages', 'flatten(list(l ORDER BY pos))')}
    FROM samples s JOIN kept USING (idx) GROUP BY s.idx""",
    "dict AS (SELECT DISTINCT " + b.norm_space("topic") + " AS topic FROM samples)",
    """triples AS (SELECT s.idx, r.pos, predicted_topic[r.pos] AS t, s.conf[r.pos] AS conf,
    know[r.pos] AS l FROM samples s JOIN know USING (idx), range(1, 6) r(pos))""",
    f"""known AS (SELECT idx, min(pos) AS pos FROM triples
    WHERE {b.strip('t')} IN (SELECT topic FROM dict) GROUP BY idx, t)""",
    """kept AS (SELECT triples.idx, triples.pos, t, triples.conf, l FROM triples
    WHERE (idx, pos) IN (SELECT (idx, pos) FROM known)
    OR (pos = 1 AND idx NOT IN (SELECT idx FROM known)))""",
).replace("sum(conf) AS", "sum(kept.conf) AS")
ORACLE["exclude_topics"] = b.sql(
    "SELECT idx, topic FROM samples WHERE topic NOT IN ('Q&A', 'Music recommendation')")
ORACLE["substr_flags"] = prompted(f"SELECT idx, {flags()} FROM p")

# --- joins and sets ---------------------------------------------------------------------------
ORACLE["merge_knowledge"] = b.sql(
    f"""SELECT idx, 'with' AS variant, true AS combined, len(know) AS n_lists,
    {b.list_columns('passages', 'flatten(know)')} FROM samples LEFT JOIN know USING (idx) UNION ALL
    SELECT idx, 'without', false, 1, md5(''), 0 FROM samples""")
ORACLE["eval_join"] = b.sql(
    f"""SELECT idx, task, topic, goal, md5(target_knowledge) AS target_md5, beams[1] AS answer,
    {b.list_columns('passages', 'flatten(know)')}
    FROM gen_P JOIN samples USING (idx) JOIN know USING (idx)""")
_exploded = ("ex AS (SELECT idx, r.pos, predicted_topic[r.pos + 1] AS predicted_topic "
             "FROM samples, range(0, 5) r(pos))")
ORACLE["topic_semi"] = b.sql(
    f"SELECT idx, pos, predicted_topic FROM ex WHERE {b.strip('predicted_topic')} IN "
    f"(SELECT {b.norm_space('topic')} FROM samples)", _exploded)
ORACLE["negatives_anti"] = b.sql(
    f"SELECT idx, {b.list_columns('negatives', 'o')} FROM (SELECT idx, "
    f"{b.flatten_lists('know', lambda l, i: b.minus(b.non_empty(l), 'cands'))} AS o "
    "FROM samples JOIN know USING (idx))")
ORACLE["rerank_anti"] = b.sql(
    f"SELECT idx, {b.list_columns('unpicked', 'unpicked')} FROM reranked", b.reranked())
ORACLE["topic_list"] = b.sql(
    "SELECT topic FROM samples WHERE split = 'train' UNION SELECT topic FROM samples WHERE split = 'test'")
ORACLE["union_with_without_know"] = b.sql(
    """SELECT idx, 0::BIGINT AS copy, len(flatten(know)) AS n_passages FROM samples JOIN know USING (idx)
    UNION ALL SELECT idx, 1, 0 FROM samples""")

# --- metrics ----------------------------------------------------------------------------------
ORACLE["hit_at_k"] = b.sql(
    "SELECT split, " + ", ".join(f"round(avg({b.hit(k)}), 9) AS hit{k}" for k in range(1, 6))
    + " FROM scored GROUP BY split", b.scored("I"))
ORACLE["hitgen"] = b.sql(
    f"SELECT split, round(avg({b.HITGEN}), 9) AS hitgen FROM scored GROUP BY split", b.scored("I"))
ORACLE["bleu_sample"] = b.sql(f"SELECT idx, {nine(*BLEUS)} FROM bleu", b.scored("R"), b.bleu())
ORACLE["bleu_corpus"] = b.sql(
    "SELECT split, " + ", ".join(f"round(avg({m}), 9) AS {m}" for m in BLEUS)
    + " FROM rows_ GROUP BY split", b.scored("R"), b.row_scores())
ORACLE["response_bleu"] = b.sql(
    "SELECT " + ", ".join(f"round(avg({m}), 9) AS {m}" for m in BLEUS) + " FROM rows_",
    b.scored("R"), b.row_scores())
ORACLE["running_metrics"] = b.sql(
    f"SELECT idx, cnt, {nine(*[f'run_{m}' for m in b.METRICS])} FROM running",
    b.scored("R"), b.row_scores(), b.running())
ORACLE["item_hit_inspired"] = b.sql(
    f"""SELECT split, round(sum(CASE WHEN contains({b.after_last(GEN, 'Therefore')},
    {b.norm_space('topic')}) THEN 1 ELSE 0 END)::DOUBLE / count(*), 9) AS hit1
    FROM samples LEFT JOIN gen_I USING (idx) GROUP BY split""")
_tail = b.norm_answer(b.after_last(GEN, "topic is "), drop_quotes=True)
ORACLE["item_hit_exact"] = b.sql(
    """SELECT split, round(avg(CASE WHEN regexp_matches(t, 'topic \\d+\\. ')
    THEN regexp_extract(t, 'topic \\d+\\. (.*)$', 1, 's') = gold
    ELSE split(t, ' | ')[1] = gold END::INTEGER), 9) AS hit1 FROM tails GROUP BY split""",
    f"""tails AS (SELECT split, {_tail} AS t, {b.norm_answer('topic')} AS gold
    FROM samples JOIN gen_I USING (idx) WHERE topic NOT IN ('Q&A', 'Music recommendation'))""")
ORACLE["passage_hit_at_k"] = b.sql(
    "SELECT split, " + ", ".join(
        f"round(sum(list_contains(list_concat(picked, unpicked)[1:{k}], target_knowledge)::INTEGER)"
        f"::DOUBLE / count(*), 9) AS hit{k}" for k in range(1, 5))
    + " FROM reranked GROUP BY split", b.reranked())
ORACLE["row_count"] = b.sql(
    "SELECT task, split, count(*) AS cnt FROM (SELECT idx, task FROM gen_I UNION ALL "
    "SELECT idx, task FROM gen_P UNION ALL SELECT idx, task FROM gen_R) "
    "JOIN samples USING (idx) GROUP BY task, split")
ORACLE["distinct_n"] = b.sql(
    """SELECT split, n, round(count(DISTINCT g)::DOUBLE / count(*), 9) AS dist FROM (
    SELECT split, n, unnest(list_transform(range(1, len(w) - n + 2),
    lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g
    FROM (SELECT split, regexp_extract_all(beams[1], """ + b.WORD + """) AS w FROM scored),
    range(1, 5) r(n)) GROUP BY split, n""", b.scored("R"))

# --- prefixes, cuts and draws -----------------------------------------------------------------
ORACLE["confidence_prefix"] = b.sql(
    f"SELECT idx, array_to_string({b.item_list(Settings(topk_topic=5, topic_conf=0.7))}, '|') "
    "AS topics FROM samples")
ORACLE["first_occurrence"] = b.sql(
    "SELECT idx, min(pos) AS pos, predicted_topic FROM ex GROUP BY idx, predicted_topic", _exploded)
ORACLE["topk_topics"] = b.sql(
    "SELECT idx, array_to_string(predicted_topic[1:3], '|') AS topics FROM samples")
ORACLE["topk_passages"] = per_list(lambda l, t, i: b.take(l, 4))
ORACLE["head_tail"] = b.sql(
    "(SELECT idx, topic FROM samples ORDER BY idx LIMIT 50) UNION ALL "
    "(SELECT idx, topic FROM samples ORDER BY idx DESC LIMIT 50)")
ORACLE["resume_offset"] = b.sql("SELECT idx, topic FROM samples WHERE idx >= 100")
ORACLE["shuffle_topics"] = b.sql(
    f"SELECT idx, array_to_string({b.shuffled('predicted_topic', SEED, 'idx', 'topic')}, '|') "
    "AS topics FROM samples")
ORACLE["shuffle_passages"] = per_list(
    lambda l, t, i: b.shuffled(l, SEED, "idx", "passage", f"{i} - 1"))
ORACLE["random_passages"] = per_list(
    lambda l, t, i: b.take(b.shuffled(b.non_empty(l), SEED, "idx", "random", f"{i} - 1"), 4))
ORACLE["random_topic_count"] = b.sql(
    f"SELECT idx, {b.draw(b.key(SEED, 'idx', 'count'), '4')} + 2 AS k FROM samples")
ORACLE["item_random_negative"] = b.sql(
    f"SELECT idx, array_to_string({b.item_random_negative('3', 4, SEED)}, '|') AS places FROM samples")
ORACLE["shuffle_rows"] = b.sql(
    """SELECT idx, h AS shuffle_key, row_number() OVER (ORDER BY h, idx) - 1 AS pos
    FROM (SELECT idx, md5('42|' || idx) AS h FROM samples)""")
ORACLE["train_val_split"] = b.sql(
    f"""SELECT idx, CASE WHEN ('0x' || substr(h, 1, 8))::BIGINT < {int(0.2 * (1 << 32))}
    THEN 'val' ELSE 'train' END AS share_part,
    CASE WHEN row_number() OVER (ORDER BY h, idx) <= 50 THEN 'val' ELSE 'train' END AS count_part
    FROM (SELECT idx, md5('42|' || idx) AS h FROM samples)""")

# --- candidates -------------------------------------------------------------------------------
ORACLE["positive_pick"] = b.sql("SELECT idx, " + ", ".join(
    f"md5({b.positive_pick(mode, BASE)}) AS {mode}_md5"
    for mode in ("pseudo", "highly_relevant", "gpt_selection", "target")
) + " FROM samples JOIN know USING (idx)")
ORACLE["passage_rerank_strict"] = b.sql(
    f"SELECT idx, {b.list_columns('passages', 'list_concat(picked, unpicked)')} FROM reranked",
    b.reranked(number="\\d"))
ORACLE["passage_rerank"] = b.sql(
    f"SELECT idx, {b.list_columns('passages', 'list_concat(picked, unpicked)')} FROM reranked",
    b.reranked())


def candidate_lists(cfg: Settings) -> str:
    return b.sql(
        "SELECT idx, array_to_string(topics_, '|') AS topics, "
        f"{b.list_columns('passages', 'flatten(lists_)')} FROM cand",
        b.prepared(cfg), b.candidates(cfg))


ORACLE["candidates_single"] = candidate_lists(
    BASE.with_(prompt="DIP2P_cot", shuffle=True, filtering=True))
ORACLE["candidates_combined"] = candidate_lists(
    BASE.with_(combined=True, shuffle=True, filtering=True))
ORACLE["positives_limit"] = b.sql(f"SELECT idx, {b.list_columns('positives', 'cands[1:2]')} FROM samples")
_single = BASE.with_(prompt="DIP2P", filtering=True)
ORACLE["passages_prompt_single"] = b.sql(
    f"SELECT idx, {b.text_columns('passages', 'a')}, {b.text_columns('target', 'b')} FROM "
    f"(SELECT idx, {b.prompt_passages(_single, '[]')} AS a, "
    f"{b.prompt_passages(_single.with_(target=True), '[]')} AS b FROM prep)", b.prepared(_single))
_many = BASE.with_(combined=True, filtering=True, topic_conf=0.7)
_forms = {
    "block": _many, "bare": _many.with_(all_passages=True),
    "random": _many.with_(random_passages=True, filtering=False, inspired=True),
}
ORACLE["passages_prompt_combined"] = b.sql(
    "SELECT idx, " + ", ".join(b.text_columns(name, name) for name in _forms) + " FROM (SELECT idx, "
    + ", ".join(f"{b.prompt_passages(cfg, 'it')} AS {name}" for name, cfg in _forms.items())
    + f" FROM (SELECT *, {b.item_list(_many)} AS it FROM prep))", b.prepared(_many))
ORACLE["top1_override"] = b.sql(
    """SELECT idx, CASE WHEN idx % 2 = 0 THEN one ELSE array_to_string(predicted_topic[1:3], '|') END
    AS even_rows, one AS all_rows FROM (SELECT idx, predicted_topic,
    CASE WHEN topic = predicted_topic[1] THEN topic ELSE predicted_topic[2] END AS one FROM samples)""")

# --- prompts and labels -----------------------------------------------------------------------
ORACLE["number_list"] = b.sql(
    f"SELECT idx, {b.number_list('predicted_topic[1:3]', 'Item')} AS lines FROM samples")
ORACLE["topic_block"] = b.sql(
    f"SELECT idx, {b.text_columns('block', 'o')} FROM (SELECT idx, "
    f"{b.block_text('predicted_topic[1:3]', 'know[1:3]', 'Topic', 4)} AS o "
    "FROM samples JOIN know USING (idx))")
_render = b.render("DP2R_inspired", dict(instruction="dialog", input="given"))
ORACLE["render_prompt"] = b.sql(
    f"SELECT idx, {b.text_columns('prompt', 'o')} FROM (SELECT idx, {_render} AS o FROM "
    "(SELECT idx, dialog, CASE WHEN idx % 2 = 0 THEN goal ELSE '' END AS given FROM samples))")


def prompt_sql(name: str, mode: str = "test") -> str:
    cfg = PROMPT_SETTINGS[name]
    return b.sql(f"SELECT idx, {b.text_columns('prompt', 'prompt')} FROM prompts",
                 b.prepared(cfg), b.prompts(cfg, mode))


for _name in PROMPT_SETTINGS:
    ORACLE[f"prompt_{_name}"] = prompt_sql(_name)
ORACLE["scan_templates"] = prompt_sql("DIP2I")
ORACLE["append_label"] = prompt_sql("UDGIP2I_new", "train")
ORACLE["parse_response"] = prompted(
    f"SELECT idx, {b.text_columns('answer', 'o')} FROM (SELECT idx, "
    + b.strip(b.after_last("(prompt || ' ' || beams[1])", "### Response:")) + " AS o FROM p)")
_target_labels = PASSAGE_LABELS.with_(prompt="DIP2I_cot", combined=True, candidate_knowledges_gpt=False)
ORACLE["label_passages"] = b.sql(
    f"""SELECT idx, 'positives' AS variant, {b.text_columns('label', 'plabel_')}, missing AS n_missing
    FROM one_l UNION ALL
    SELECT idx, 'target', {b.text_columns('label', 'plabel_')}, missing FROM two_l""",
    b.prepared(PASSAGE_LABELS, "prep_one"), b.train_texts(PASSAGE_LABELS, "one", "prep_one"),
    b.prepared(_target_labels, "prep_two"), b.train_texts(_target_labels, "two", "prep_two"))
_reason = b.rationale("topic_cot")
ORACLE["label_item"] = b.sql(
    f"""SELECT idx, topic AS plain,
    {_reason} || ' Therefore, the most suitable item is "' || topic || '"' AS item,
    {_reason} || ' Therefore, the most suitable topic is "' || topic || '"' AS topic FROM samples""")
_none = b.lit("None of the passages are relevant for generating a response to the given dialog.")
ORACLE["label_passage_text"] = b.sql(
    "SELECT idx, " + ", ".join(f"md5({x}) AS {name}" for name, x in b.passage_texts("lab", _none).items())
    + " FROM (SELECT idx, passage_cot, CASE WHEN gpt_selection = '' THEN '' ELSE "
    "'Passage 1. ' || gpt_selection END AS lab FROM samples)")
ORACLE["label_response"] = sample_text("response").replace("out_md5", "label_md5").replace(
    "out_length", "label_length")


def token_list(x: str) -> str:
    return f"regexp_extract_all({x}, {b.LEFT_TOKEN})"


def masked(ids: str, n: str) -> str:
    x = b.v()
    return (f"list_concat(list_transform(({ids})[1:{n}], lambda {x}: '-100'), "
            f"({ids})[{n} + 1:])")


def train_sql(cfg: Settings) -> str:
    ids = token_list("example")
    if not cfg.train_only_inputs:
        ids = f"list_append({ids}, '</s>')"
    mask = masked("ids", f"least(len({token_list('prompt')}), len(ids))")
    if cfg.weighted_loss:
        mask = f"CASE WHEN idx % 2 = 1 THEN {mask} ELSE ids END"
    elif not cfg.train_only_outputs:
        mask = "ids"
    return b.sql(
        f"""SELECT idx, split, {b.text_columns('example', 'example')}, len(ids) AS n_ids,
        {b.md5_list(f'({mask})')} AS labels_md5, missing AS n_missing
        FROM (SELECT *, {ids} AS ids FROM train)""",
        b.prepared(cfg), f"gated AS (SELECT * FROM prep WHERE {b.gate(cfg)})",
        b.train_texts(cfg, "train", "gated"))


ORACLE["train_examples"] = train_sql(BASE.with_(
    prompt="UDGIP2I_new", combined=True, shuffle=True, topic_num_shuffle=True, topk_topic=5,
    item_random_negative=True, item_random_negative_num=5, positive="target",
    force_topic=True, weighted_loss=True))
for _name, _cfg in TRAIN_SETTINGS.items():
    ORACLE[f"train_examples_{_name}"] = train_sql(_cfg)

# --- tokens -----------------------------------------------------------------------------------
ORACLE["truncate_tail"] = docs(b.tail("text", 128))
ORACLE["truncate_head"] = docs(b.strip(b.head("text", 50)))
ORACLE["truncate_profile"] = sample_text(b.head("user_profile", 5))
ORACLE["truncate_instructions"] = b.sql(
    f"SELECT idx, {b.text_columns('head', 'h')}, {b.text_columns('tail', 't')} FROM (SELECT idx, "
    f"{b.head('prompt', 100)} AS h, {b.tail('prompt', 100)} AS t FROM prompts)",
    b.prepared(PROMPTED), b.prompts(PROMPTED))
_tokenized = (
    f"texts AS (SELECT idx, {b.norm_space('(' + b.dialog_text('dialog') + ')')} AS prompt, "
    f"{b.norm_space(b.response_text('response'))} AS label_text FROM samples)",
    f"tok AS (SELECT *, list_append({token_list('prompt || chr(32) || label_text')}, '</s>') AS ids "
    "FROM texts)",
)


def tokens_sql(labels: str) -> str:
    return b.sql(
        f"SELECT idx, {b.list_columns('ids', 'ids')}, {b.md5_list(f'({labels})')} AS labels_md5, "
        "len(ids) AS mask_sum FROM tok", *_tokenized)


_mask = masked("ids", f"least(len({token_list('prompt')}), len(ids))")
ORACLE["tokenize_example"] = tokens_sql("ids")
ORACLE["mask_prompt_labels"] = tokens_sql(_mask)
ORACLE["alternate_mask"] = tokens_sql(f"CASE WHEN idx % 2 = 1 THEN {_mask} ELSE ids END")
ORACLE["pad_batches"] = b.sql(
    f"""SELECT idx, batch, {b.list_columns('ids', "list_concat(list_transform(range(gap), lambda q: '<pad>'), ids)")},
    {b.md5_list("list_concat(list_transform(range(gap), lambda q: '0'), list_transform(ids, lambda q: '1'))")} AS mask_md5
    FROM (SELECT *, ((max(len(ids)) OVER (PARTITION BY batch) + 7) // 8 * 8 - len(ids))::BIGINT AS gap
    FROM (SELECT idx, ids, idx // 16 AS batch FROM tok))""", *_tokenized)


def merged(select: str) -> str:
    """Rows ``m`` of both copies: idx, copy, part, shuffle_key, example, ids, labels."""
    parts, ctes = [], []
    for copy in (0, 1):
        cfg, name = MERGED.with_(copy=copy), f"copy{copy}"
        lists = "" if copy == 0 else " REPLACE ([[]::VARCHAR[]] AS know)"
        ctes += [f"gated{copy} AS (SELECT *{lists} FROM prep WHERE {b.gate(cfg)})", b.train_texts(cfg, name, f"gated{copy}")]
        parts.append(f"SELECT idx, {copy}::BIGINT AS copy, example, prompt FROM {name}")
    ids = f"list_append({token_list('example')}, '</s>')"
    return b.sql(
        select, b.prepared(MERGED), *ctes,
        "places AS (SELECT idx, row_number() OVER (ORDER BY md5('42|' || idx), idx) AS place FROM gated0)",
        f"""m AS (SELECT *, {masked('ids', f"least(len({token_list('prompt')}), len(ids))")} AS labels,
        CASE WHEN place <= 50 THEN 'val' ELSE 'train' END AS part,
        md5('{SEED}|' || idx || '|' || copy) AS shuffle_key
        FROM (SELECT *, {ids} AS ids FROM ({' UNION ALL '.join(parts)})) JOIN places USING (idx))""")


ORACLE["train_batches"] = merged(
    f"""SELECT idx, copy, batch, pos, {b.list_columns('ids', "list_concat(list_transform(range(gap), lambda q: '<pad>'), ids)")},
    {b.list_columns('labels', "list_concat(list_transform(range(gap), lambda q: '-100'), labels)")},
    {b.md5_list("list_concat(list_transform(range(gap), lambda q: '0'), list_transform(ids, lambda q: '1'))")} AS mask_md5
    FROM (SELECT *, ((max(len(ids)) OVER (PARTITION BY batch) + 7) // 8 * 8 - len(ids))::BIGINT AS gap
    FROM (SELECT *, pos // 16 AS batch FROM (
    SELECT *, row_number() OVER (ORDER BY shuffle_key, idx, copy) - 1 AS pos FROM m WHERE part = 'train')))""")
ORACLE["train_examples_merge"] = merged(
    f"""SELECT idx, copy, part, shuffle_key, {b.text_columns('example', 'example')}, len(ids) AS n_ids,
    {b.md5_list('labels')} AS labels_md5 FROM m""")
_exp = [f"exp(-0.5 * {i})" for i in range(5)]
ORACLE["beam_softmax"] = b.sql(
    "SELECT idx, len(beams) AS n_beams, " + ", ".join(
        f"round({e} / ({' + '.join(_exp)}), 9) AS beam{i}" for i, e in enumerate(_exp))
    + " FROM gen_I")
ORACLE["format_scores"] = b.sql(
    f"SELECT idx, {b.fixed(RUN_HITS)} AS hits, {b.fixed(BLEUS, chr(9))} AS bleus FROM running",
    b.scored("R"), b.row_scores(), b.running())
ORACLE["beams_reshape"] = b.sql("SELECT idx, array_to_string(beams, '|') AS beams FROM gen_I")
ORACLE["stream_metrics"] = b.sql(
    "SELECT split, count(*) AS cnt, " + ", ".join(f"round(avg({m}), 9) AS {m}" for m in b.METRICS)
    + " FROM rows_ GROUP BY split", b.scored("R"), b.row_scores())

# --- runs that go on, and orders of any key ---------------------------------------------------
ORACLE["stream_running"] = ORACLE["running_metrics"]
ORACLE["sink_committed"] = ORACLE["sink_scored_epochs"]
ORACLE["passage_dictionary"] = ORACLE["prompt_DIP2I_cot"]
ORACLE["range_positions"] = """
    SELECT doc_id, key, row_number() OVER (ORDER BY key) - 1 AS key_pos,
    row_number() OVER (ORDER BY doc_id DESC) - 1 AS id_pos,
    sum(length(text)) OVER (ORDER BY key ROWS UNBOUNDED PRECEDING)::BIGINT AS run_chars
    FROM (SELECT doc_id, text, md5(doc_id::VARCHAR) AS key FROM documents)"""
ORACLE["scan_knowledge_split"] = ORACLE["scan_knowledge"]
ORACLE["val_threshold"] = b.sql(
    "SELECT idx, " + ", ".join(f"place <= {n} AS in_{n}" for n in (1, 50, 1000))
    + " FROM (SELECT idx, row_number() OVER (ORDER BY md5('42|' || idx), idx) AS place FROM samples)")
ORACLE["length_batches"] = b.sql(
    """SELECT idx, n_ids, batch, place FROM cut JOIN (SELECT block, c, row_number() OVER (
    ORDER BY md5('42|' || block || '|' || c), block, c) - 1 AS batch FROM cut WHERE place = 0) USING (block, c)""",
    *_tokenized,
    """blocks AS (SELECT *, (row_number() OVER (ORDER BY h, idx) - 1) // 128 AS block
    FROM (SELECT idx, len(ids) AS n_ids, md5('42|' || idx) AS h FROM tok))""",
    """cut AS (SELECT idx, n_ids, block, r // 16 AS c, r % 16 AS place FROM (SELECT *, row_number() OVER (
    PARTITION BY block ORDER BY n_ids DESC, h, idx) - 1 AS r FROM blocks))""")
ORACLE["distinct_n_sketch"] = b.sql(
    """SELECT split, n, count(*) AS grams, true AS within FROM (
    SELECT split, n, unnest(range(1, len(w) - n + 2)) AS g
    FROM (SELECT split, regexp_extract_all(beams[1], """ + b.WORD + """) AS w FROM scored),
    range(1, 5) r(n)) GROUP BY split, n""", b.scored("R"))
ORACLE["merge_observed"] = b.sql(
    """SELECT count(*) AS n_rows, sum(idx * (1 + CASE WHEN idx % 10 <> 3 THEN len(know) ELSE 0 END))::BIGINT AS told,
    count(*) AS samples, count(*) FILTER (WHERE idx % 10 <> 3) AS knowledge,
    count(*) FILTER (WHERE idx % 10 = 3) AS bare, 0::BIGINT AS unmatched FROM samples JOIN know USING (idx)""")
ORACLE["score_cube"] = b.sql(
    "SELECT split, goal, GROUPING(split, goal)::BIGINT AS grouping, count(*) AS cnt, "
    + ", ".join(f"round(avg({m}), 9) AS {m}" for m in b.METRICS)
    + " FROM rows_ JOIN (SELECT idx, goal FROM samples) USING (idx) GROUP BY CUBE (split, goal)",
    b.scored("R"), b.row_scores())
ORACLE["evaluation_run"] = b.sql(
    f"""SELECT 'response' AS run, 1::BIGINT AS epoch, p.idx, md5(prompt) AS context_md5, md5({GEN}) AS gen_md5,
    md5(label) AS answer_md5, {b.fixed(['run_hitgen'])} AS hitgen, {b.fixed(RUN_HITS)} AS hit_scores,
    {b.fixed(RUN_BLEUS)} AS bleu_scores, {b.fixed(BLEUS)} AS sample_bleu_scores, {flags()},
    printf('%.4f', 1 / (1 + exp(-0.5))) || '|' || printf('%.4f', exp(-0.5) / (1 + exp(-0.5))) AS beam_scores
    FROM p JOIN running USING (idx)""",
    b.prepared(PROMPTED), b.prompts(PROMPTED),
    """p AS (SELECT idx, split, topic, label, prompt, beams FROM prompts JOIN gen_R USING (idx)
    WHERE split = 'test')""", b.row_scores("p"), b.running())
