"""SQL building blocks: the derived tables as CTEs, and text and list expressions.

Written for DuckDB and independently of the Spark expressions: lists are cut by slices, n-grams
are counted by joins, positions by one window.
"""

from __future__ import annotations

from itertools import count

from turnloom.fixed_values import TEMPLATES, WHITESPACE
from turnloom.settings import ALL, Settings

_fresh = count()


def v(name: str = "x") -> str:
    """A new lambda variable."""
    return f"{name}{next(_fresh)}"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


NBSP = "chr(160)"
WS = lit(WHITESPACE)
WORD = lit(f"[^{WHITESPACE}]+")
LEFT_TOKEN = lit(f"[{WHITESPACE}]*[^{WHITESPACE}]+")
RIGHT_TOKEN = lit(f"[^{WHITESPACE}]+[{WHITESPACE}]*")


# --- text -------------------------------------------------------------------------------------
def strip(x):
    return f"trim({x}, {WS})"


def norm_space(x):
    return strip(f"replace(replace({x}, {NBSP}, ' '), '  ', ' ')")


def norm_topic(x):
    return f"lower({norm_space(x)})"


def norm_answer(x, drop_quotes=False):
    out = f"replace(replace({x}, '  ', ' '), {NBSP}, ' ')"
    if drop_quotes:
        out = f"replace({out}, '\"', '')"
    return strip(f"lower({out})")


def dialog_text(x):
    lines = f"replace({x}, '[SEP]', chr(10))"
    return (f"CASE WHEN right({lines}, 1) = chr(10) THEN left({lines}, length({lines}) - 1) "
            f"ELSE {lines} END")


def response_text(x):
    return f"replace({x}, '[SEP]', '')"


def profile_filter(x):
    a, b = v(), v()
    kept = (f"list_filter(split({x}, '|'), lambda {a}: contains(lower({a}), 'accepted') "
            f"OR contains(lower({a}), 'rejected'))")
    joined = strip(f"array_to_string(list_transform({kept}, lambda {b}: {strip(b)}), ' | ')")
    return f"coalesce(nullif({joined}, ''), 'None')"


def before_first(x, marker):
    return f"split({x}, {lit(marker)})[1]"


def after_last(x, marker):
    return f"split({x}, {lit(marker)})[-1]"


def rationale(x):
    return strip(before_first(x, "Therefore"))


def head(x, n):
    t = f"regexp_extract_all({x}, {LEFT_TOKEN})"
    return f"CASE WHEN len({t}) <= {n} THEN {x} ELSE array_to_string(({t})[:{n}], '') END"


def tail(x, n):
    t = f"regexp_extract_all({x}, {RIGHT_TOKEN})"
    return f"CASE WHEN len({t}) <= {n} THEN {x} ELSE array_to_string(({t})[-{n}:], '') END"


def head_list(l, n):
    p = v("p")
    return f"list_transform({l}, lambda {p}: {strip(head(p, n))})"


# --- lists ------------------------------------------------------------------------------------
def take(l, n):
    return f"({l})" if n == ALL else f"({l})[1:greatest({n}, 0)]"


def non_empty(l):
    x = v()
    return f"list_filter({l}, lambda {x}: {x} <> '')"


def minus(l, other):
    x = v()
    return f"list_filter({l}, lambda {x}: NOT list_contains({other}, {x}))"


def mention(p, topic, nbsp=False):
    text = f"replace({p}, {NBSP}, ' ')" if nbsp else p
    return f"contains({strip(f'lower({text})')}, {strip(f'lower({topic})')})"


def mentions(l, topic):
    x = v()
    return f"list_filter({l}, lambda {x}: {mention(x, topic)})"


def refill(l, topic, n, nbsp=False):
    x, y = v(), v()
    hits = f"list_filter({l}, lambda {x}: {mention(x, topic, nbsp)})"
    rest = f"list_filter({l}, lambda {y}: NOT {mention(y, topic, nbsp)})"
    return f"list_concat({hits}, ({rest})[1:greatest(({n}) - len({hits}), 0)])"


def key(seed, idx, stream, *parts):
    texts = [f"'{seed}'", f"{idx}::VARCHAR", f"'{stream}'", *[f"({p})::VARCHAR" for p in parts]]
    return f"md5(concat_ws('|', {', '.join(texts)}))"


def draw(k, modulus):
    return f"(('0x' || substr({k}, 1, 8))::BIGINT % ({modulus}))"


def shuffled(l, seed, idx, stream, *parts):
    x, i, s = v(), v("i"), v("s")
    keyed = (f"list_transform({l}, lambda {x}, {i}: "
             f"{{'k': {key(seed, idx, stream, *parts, f'{i} - 1')}, 'p': {i}, 'v': {x}}})")
    return f"list_transform(list_sort({keyed}), lambda {s}: {s}.v)"


def number_list(l, word, start="1"):
    x, i = v(), v("i")
    return (f"array_to_string(list_transform({l}, lambda {x}, {i}: "
            f"'{word} ' || ({i} - 1 + {start}) || '. ' || {x}), chr(10))")


def md5_list(l):
    return f"md5(array_to_string({l}, '|'))"


def text_columns(name, x):
    return f"md5({x}) AS {name}_md5, length({x}) AS {name}_length"


def list_columns(name, l):
    return f"{md5_list(l)} AS {name}_md5, len({l}) AS n_{name}"


def flatten_lists(know, fn):
    """flatten of fn(passages, 1-based index) over all lists."""
    l, i = v("l"), v("i")
    return f"flatten(list_transform({know}, lambda {l}, {i}: {fn(l, i)}))"


# --- derived tables ---------------------------------------------------------------------------
TABLES = """
n AS (SELECT max(s_suppkey) + 1 AS n FROM supplier),
items AS (SELECT s_suppkey AS ord, s_name AS item FROM supplier),
passages AS (
  SELECT ord, list(CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 3 = 0 THEN text
                        ELSE 'About ' || item || ': ' || text END ORDER BY doc_id) AS passages
  FROM (SELECT doc_id, text, doc_id % (SELECT n FROM n) AS ord FROM documents) d
  JOIN items USING (ord) GROUP BY ord),
base AS (
  SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx, conv_id, turn, text AS reply
  FROM conversations WHERE role = 'assistant' AND turn >= 1),
pred AS (
  SELECT idx, pos, CASE WHEN pos < 0 THEN idx * 7 ELSE idx * 7 +
    ((CASE WHEN pos = 4 AND idx % 4 = 0 THEN 1 ELSE pos END) * 5 + idx) % 7 END
    % (SELECT n FROM n) AS ord
  FROM base, range(-1, 5) r(pos)),
names AS (
  SELECT idx, list(CASE WHEN pos >= 0 AND (idx + pos) % 6 = 5 THEN item || ' II' ELSE item END
                   ORDER BY pos) AS names
  FROM pred JOIN items USING (ord) GROUP BY idx),
dialogs AS (
  SELECT b.idx, string_agg(c.text, '[SEP]' ORDER BY c.turn) AS context
  FROM base b JOIN conversations c
    ON c.conv_id = b.conv_id AND c.turn < b.turn GROUP BY b.idx),
topics AS (
  SELECT idx, names[2:6] AS predicted_topic,
    CASE WHEN idx % 13 = 0 THEN 'Q&A' WHEN idx % 17 = 0 THEN 'Music recommendation'
         ELSE names[1] END AS topic,
    ['Movie recommendation', 'Food recommendation', 'Chat about stars', 'Q&A'][idx % 4 + 1] AS goal
  FROM names),
gold AS (SELECT ord, list_filter(passages, lambda p: p <> '')[1:3] AS golds FROM passages),
samples AS (
  SELECT b.idx, CASE WHEN b.idx % 5 = 0 THEN 'test' ELSE 'train' END AS split,
    context || CASE WHEN b.idx % 2 = 0 THEN '[SEP]' ELSE '' END AS dialog,
    CASE WHEN b.idx % 7 = 0 THEN replace(reply, '. ', '.' || chr(160) || ' ') ELSE reply END
      || CASE WHEN b.idx % 3 = 0 THEN '[SEP]' ELSE '' END AS response,
    goal, 'refined ' || goal AS query, topic, predicted_topic,
    [0.5, 0.25, 0.125, 0.0625, 0.03125]::DOUBLE[] AS conf,
    predicted_topic[b.idx % 2 + 1] AS selected_topic,
    'age: ' || (b.idx % 60) || CASE WHEN b.idx % 5 = 0 THEN '' ELSE
      '|Accepted movies: ' || predicted_topic[1] || ' | rejected music: ' || predicted_topic[2]
      END AS user_profile,
    'Because the user asked. Therefore, the most suitable topic is "' ||
      CASE WHEN b.idx % 4 = 0 THEN predicted_topic[2] ELSE topic END || '"' AS topic_cot,
    'The passages tell more. Therefore, they are relevant.' AS passage_cot,
    coalesce(golds[1], '') AS target_knowledge,
    CASE WHEN b.idx % 6 = 0 THEN '' ELSE coalesce(golds[1], '') END AS gpt_selection,
    coalesce(golds, []::VARCHAR[]) AS cands
  FROM base b JOIN topics USING (idx) JOIN dialogs d ON d.idx = b.idx
  LEFT JOIN gold ON gold.ord = b.idx * 7 % (SELECT n FROM n)),
know AS (
  SELECT idx, list(coalesce(passages, []::VARCHAR[]) ORDER BY pos) AS know
  FROM pred LEFT JOIN passages USING (ord) WHERE pos >= 0 GROUP BY idx),
gen_I AS (
  SELECT idx, 'I' AS task, [CASE idx % 4
    WHEN 0 THEN 'I think so. Therefore, the most suitable topic is "' || topic || '"'
    WHEN 1 THEN 'The most suitable topic is "Topic 1. ' || predicted_topic[1] || '"'
    WHEN 2 THEN 'the topic is ' || predicted_topic[1] ELSE 'I do not know' END,
    predicted_topic[2], predicted_topic[3], predicted_topic[4], predicted_topic[5]] AS beams
  FROM samples),
gen_P AS (
  SELECT idx, 'P' AS task, [CASE idx % 4 WHEN 0 THEN 'Passage 1. x'
    WHEN 1 THEN 'Passage 2. x' || chr(10) || 'Passage 1. y' WHEN 2 THEN 'Passage 9. x'
    ELSE 'None of them.' END] AS beams
  FROM samples),
gen_R AS (
  SELECT idx, 'R' AS task, [CASE idx % 3 WHEN 0 THEN response
    WHEN 1 THEN array_to_string(split(response, ' ')[1:(len(split(response, ' ')) + 1) // 2], ' ')
    ELSE split(dialog, '[SEP]')[-1] END, goal] AS beams
  FROM samples)
"""


def sql(select: str, *ctes: str) -> str:
    """The derived tables, further CTEs and the final query."""
    return "WITH " + ",\n".join([TABLES.strip(), *ctes]) + "\n" + select


# --- prepared rows ----------------------------------------------------------------------------
def label(task, cut=50):
    if task == "R":
        return norm_space(response_text("response"))
    if task == "P":
        return norm_space(strip(head("target_knowledge", cut)))
    return norm_space("topic")


def prepared(cfg: Settings, name: str = "prep") -> str:
    """Cleaned and cut samples with cut passages."""
    n = cfg.passage_cutoff
    l = v("l")
    dialog = dialog_text("dialog")
    return f"""{name} AS (
  SELECT s.idx, split, topic, predicted_topic, conf, goal, query, selected_topic, topic_cot,
    passage_cot, target_knowledge, {label(cfg.task, n)} AS label,
    {tail(f'({dialog})', cfg.cutoff)} AS dialog,
    {head(f'({profile_filter("user_profile")})', 200)} AS user_profile,
    {response_text('response')} AS response,
    {strip(head('gpt_selection', n))} AS gpt_selection,
    {head_list('cands', n)} AS cands,
    list_transform(know, lambda {l}: {head_list(l, n)}) AS know
  FROM samples s JOIN know USING (idx))"""


def item_list(cfg: Settings):
    heads = f"predicted_topic[1:{cfg.topk_topic}]"
    if cfg.topic_conf == 1:
        return heads
    x, i = v(), v("i")
    return (f"list_filter({heads}, lambda {x}, {i}: "
            f"coalesce(list_sum(conf[1:{i} - 1]), 0) < {cfg.topic_conf})")


def fill(form: str, values: dict[str, str]) -> str:
    parts, rest = [], form
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [lit(before), values.get(name, "''")]
    return " || ".join(f"({p})" for p in [*parts, lit(rest)])


def render(name: str, values: dict[str, str]) -> str:
    t = TEMPLATES[name]
    return (f"CASE WHEN {values['input']} <> '' THEN {fill(t['prompt_input'], values)} "
            f"ELSE {fill(t['prompt_no_input'], values)} END")


def block_text(topics, lists, word, n, heading=True):
    """Blocks of a topic list and a parallel list of passage lists."""
    t, i = v("t"), v("i")
    title = f"'Here are the candidate passages about {word} ' || {i} || '. ' || {t} || chr(10) || " if heading else ""
    body = number_list(f"coalesce(({lists})[{i}], []::VARCHAR[])", "Passage", f"({i} - 1) * {n} + 1")
    return (f"array_to_string(list_transform({topics}, lambda {t}, {i}: "
            f"{title}{body} || chr(10) || chr(10)), '')")


def prompt_lists(cfg: Settings, topics):
    n = cfg.n_sampled_negative
    t, i = v("t"), v("i")
    l = non_empty(f"coalesce(know[{i}], []::VARCHAR[])")
    if cfg.random_passages and not cfg.all_passages:
        l = take(shuffled(l, cfg.draw_seed, "idx", "random", f"{i} - 1"), n)
    else:
        if cfg.filtering:
            l = mentions(l, f"predicted_topic[{i}]")
        l = take(l, n)
    return f"list_transform({topics}, lambda {t}, {i}: {l})"


def first_topic(cfg: Settings):
    return "selected_topic" if cfg.selected_topic else "predicted_topic[1]"


def prompt_passages(cfg: Settings, topics):
    n = cfg.n_sampled_negative
    if cfg.combined:
        return block_text(topics, prompt_lists(cfg, topics), cfg.item_word, n, not cfg.all_passages)
    if cfg.target:
        return "'Passage 1. ' || target_knowledge || chr(10)"
    l = non_empty("know[1]")
    if cfg.filtering:
        l = refill(l, first_topic(cfg), n, nbsp=True)
    return number_list(take(l, n), "Passage")


def placeholders(cfg: Settings, items, passages):
    goal = "query" if cfg.query else "goal"
    word = cfg.item_word if cfg.prompt.startswith("DIP2I") else "Topic"
    numbered = number_list(items, word)
    return {
        "DIP2I": dict(input=numbered, input2=passages),
        "DIP2P": dict(input=numbered, input2=passages),
        "DP2R": dict(input=passages),
        "UDGIP2I": dict(input=goal, input2=numbered, input3=passages, input4="user_profile"),
        "DGIP2P": dict(input=goal, input2=numbered, input3=passages),
        "DGP2R": dict(input=goal, input2=passages),
    }[cfg.prompt.split("_")[0]] | {"instruction": "dialog"}


def prompts(cfg: Settings, mode="test", name="prompts", source="prep") -> str:
    """CTEs ending in (idx, split, topic, label, prompt)."""
    shown = "items_"
    if mode == "train":
        shown = shuffled("items_", cfg.draw_seed, "idx", "topic")
    if cfg.task == "P" and cfg.selected_topic:
        shown = "[selected_topic]"
    passages = "passages_"
    if cfg.prompt == "DGP2R":
        passages = "CASE WHEN passages_ = '' THEN ' ' ELSE passages_ END"
    text = render(cfg.prompt, placeholders(cfg, "shown_", passages))
    if mode == "train":
        text = f"({text}) || label"
    return f"""{name}_items AS (SELECT *, {item_list(cfg)} AS items_ FROM {source}),
{name}_texts AS (SELECT *, {shown} AS shown_, {prompt_passages(cfg, 'items_')} AS passages_
  FROM {name}_items),
{name} AS (SELECT idx, split, topic, label, {norm_space(f'({text})')} AS prompt FROM {name}_texts)"""


# --- training examples ------------------------------------------------------------------------
def positions(cfg: Settings):
    """0-based candidate positions in random order."""
    k = f"least({cfg.topk_topic if cfg.combined else 1}, len(predicted_topic))"
    seed = cfg.draw_seed
    if cfg.topic_num_shuffle:
        k = (f"CASE WHEN {k} > 1 THEN {draw(key(seed, 'idx', 'count'), f'greatest({k} - 1, 1)')} + 2 "
             f"ELSE {k} END")
    plain = f"range(0, ({k})::BIGINT)"
    if cfg.item_random_negative:
        plain = item_random_negative(k, cfg.item_random_negative_num, seed)
    return shuffled(plain, seed, "idx", "topic")


def item_random_negative(k, pool, seed):
    x = v()
    gold = "list_position(predicted_topic, topic)"
    others = (f"list_filter(range(0, least({pool}, len(predicted_topic))::BIGINT), "
              f"lambda {x}: {x} <> {gold} - 1)")
    drawn = f"({shuffled(others, seed, 'idx', 'pool')})[1:greatest(({k}) - 1, 0)]"
    return (f"CASE WHEN coalesce({gold}, 0) > 0 THEN list_concat([({gold} - 1)::BIGINT], {drawn}) "
            f"ELSE range(0, least(({k}), len(predicted_topic))::BIGINT) END")


def train_lists(cfg: Settings):
    """The passage lists of a row with ``pos``, ``topics_`` and ``positives``."""
    n, seed = cfg.n_sampled_negative, cfg.draw_seed
    if not cfg.combined:
        hard_n = f"{n} - len(positives)" if cfg.n_hard_negative == ALL else str(cfg.n_hard_negative)
        l = minus(non_empty("know[1]"), "positives")
        if cfg.filtering:
            l = refill(l, "predicted_topic[1]", hard_n)
        l = f"({l})[1:greatest({hard_n}, 0)]"
        if cfg.shuffle:
            l = shuffled(l, seed, "idx", "hard")
        l = take(f"list_concat(positives, {l})", n)
        return f"[{shuffled(l, seed, 'idx', 'mixed') if cfg.shuffle else l}]"
    p, i = v("p"), v("i")
    if cfg.random_passages:
        l = take(shuffled(f"know[{p} + 1]", seed, "idx", "random", f"{i} - 1"), n)
        return f"list_transform(pos, lambda {p}, {i}: {l})"
    l = minus(non_empty(f"coalesce(know[{p} + 1], []::VARCHAR[])"), "positives")
    if cfg.filtering:
        l = refill(l, f"predicted_topic[{p} + 1]", n)
    same = f"{norm_topic('topic')} = {norm_topic(f'topics_[{i}]')}"
    l = f"CASE WHEN {same} THEN list_concat(positives, {l}) ELSE {l} END"
    l = take(l, n)
    if cfg.shuffle:
        l = shuffled(l, seed, "idx", "passage", f"{i} - 1")
    return f"list_transform(pos, lambda {p}, {i}: {l})"


def candidates(cfg: Settings, name="cand", source="prep") -> str:
    p = v("p")
    topics = f"list_transform(pos, lambda {p}: predicted_topic[{p} + 1])"
    places = positions(cfg)
    if cfg.selected_topic:
        topics = "[selected_topic]"
        places = f"[coalesce(list_position(predicted_topic, selected_topic) - 1, ({places})[1], 0)]"
    return f"""{name}_pos AS (SELECT *, {take('cands', cfg.n_sampled_positive)} AS positives,
  {places} AS pos FROM {source}),
{name}_topics AS (SELECT *, {topics} AS topics_ FROM {name}_pos),
{name} AS (SELECT *, {train_lists(cfg)} AS lists_ FROM {name}_topics)"""


def positive_pick(mode, cfg: Settings):
    if mode == "pseudo":
        pool = take("know[1]", cfg.n_pseudo)
    elif mode == "highly_relevant":
        pool = "cands"
    else:
        return {"gpt_selection": "gpt_selection", "target": "target_knowledge"}[mode]
    return f"({pool})[{draw(key(cfg.draw_seed, 'idx', 'target'), f'greatest(len({pool}), 1)')} + 1]"


def train_texts(cfg: Settings, name="train", source="prep") -> str:
    """CTEs ending in rows with prompt_, label_text, passage_label and missing."""
    n = cfg.n_sampled_negative
    l, i, x, j = v("l"), v("i"), v("x"), v("j")
    numbers = f"flatten(list_transform(lists_, lambda {l}, {i}: list_transform({l}, lambda {x}, {j}: ({i} - 1) * {n} + {j})))"
    if cfg.combined:
        text = block_text("topics_", "lists_", cfg.item_word, n, "P2R" not in cfg.prompt)
    else:
        text = number_list("flat_", "Passage")
    y, z = v(), v()
    if cfg.all_passages or (cfg.candidate_knowledges_gpt and cfg.random_passages):
        passage_label = "''"
    elif cfg.candidate_knowledges_gpt:
        passage_label = (
            f"array_to_string(list_transform(list_filter(positives, lambda {y}: list_contains(flat_, {y})), "
            f"lambda {z}: 'Passage ' || numbers_[list_position(flat_, {z})] || '. ' || {z}), chr(10))")
    elif cfg.target:
        passage_label = "text_"
    else:
        passage_label = ("'Passage ' || coalesce(numbers_[list_position(flat_, target_)], 0) || '. ' "
                         "|| coalesce(target_, '')")
    shown = "topics_"
    name_ = cfg.prompt
    reason = rationale("topic_cot")
    conclusion = "item" if name_ == "DIP2I_cot" and cfg.item_word == "Item" else "topic"
    none = lit("None of the passages are relevant for generating a response to the given dialog.")
    labels = {
        "DIP2I": "topic", "UDGIP2I_new": "topic",
        "DIP2I_cot": f"{reason} || ' Therefore, the most suitable {conclusion} is \"' || topic || '\"'",
        "UDGIP2I_cot": f"{reason} || ' Therefore, the most suitable {conclusion} is \"' || topic || '\"'",
        "DP2R_inspired": "response", "DGP2R": "response",
    } | passage_texts("plabel_", none)
    prompt = render(name_, placeholders(cfg, shown, "text_"))
    full = "prompt_" if cfg.train_only_inputs else "prompt_ || label_text"
    return f"""{candidates(cfg, name + '_c', source)},
{name}_f AS (SELECT *, flatten(lists_) AS flat_, {numbers} AS numbers_,
  {positive_pick(cfg.positive, cfg)} AS target_ FROM {name}_c),
{name}_t AS (SELECT *, {text} AS text_ FROM {name}_f),
{name}_p AS (SELECT *, {passage_label} AS plabel_ FROM {name}_t),
{name}_l AS (SELECT *, {prompt} AS prompt_, {labels[name_]} AS label_text,
  len({minus('positives', 'flat_')}) AS missing FROM {name}_p),
{name} AS (SELECT *, {norm_space(f'({full})')} AS example, {norm_space('prompt_')} AS prompt
  FROM {name}_l)"""


def passage_texts(label_, none):
    reason = rationale("passage_cot")
    return {
        "DIP2P": f"CASE WHEN {label_} = '' THEN {none} ELSE {label_} END",
        "DIP2P_cot": f"CASE WHEN {label_} = '' THEN {none} ELSE {reason} || ' Therefore, the most relevant "
                     f"passages are as follows:' || chr(10) || {label_} || '.' END",
        "DGIP2P_new": f"{label_} || '.'",
        "DGIP2P_cot_new": f"{reason} || ' Therefore, the relevant passages are as follow:' || chr(10) || {label_}",
    }


def topic_hit(k, inspired=False):
    if inspired:
        return f"list_contains(predicted_topic[1:{k}], topic)"
    x = v()
    return (f"list_contains(list_transform(predicted_topic[1:{k}], lambda {x}: {norm_topic(x)}), "
            f"{norm_topic('topic')})")


def cot_hit(inspired=False):
    topic = "topic" if inspired else norm_topic("topic")
    return f"contains({strip('lower(' + after_last('topic_cot', 'Therefore') + ')')}, {topic})"


def gate(cfg: Settings):
    chosen = "gpt_selection <> ''" if cfg.positive == "gpt_selection" and not cfg.force_gpt else "true"
    on_hit = cot_hit(cfg.inspired) if cfg.prompt == "UDGIP2I_cot" else chosen
    on_miss = chosen if cfg.force_topic else "false"
    return f"CASE WHEN {topic_hit(cfg.topk_topic, cfg.inspired)} THEN {on_hit} ELSE {on_miss} END"


# --- scores -----------------------------------------------------------------------------------
def scored(task: str, name="scored") -> str:
    """Answers with label, topic and split."""
    return (f"{name} AS (SELECT s.idx, split, topic, {label(task)} AS label, beams "
            f"FROM samples s JOIN gen_{task} USING (idx))")


def hit(k):
    joined = f"array_to_string(beams[1:{k}], '| ')"
    return f"contains(lower({strip(joined)}), lower({strip('label')}))::INTEGER"


HITGEN = "contains(lower(beams[1]), lower(topic))::INTEGER"


def bleu(source="scored", name="bleu") -> str:
    """CTEs ending in (idx, bleu1 … bleu4): n-grams counted by joins."""
    grams = lambda side: f"""SELECT idx, k, unnest(list_transform(range(1, len({side}) - k + 2),
    lambda i: array_to_string({side}[i:i + k - 1], ' '))) AS g FROM {name}_w, range(1, 5) r(k)"""
    score = lambda k: f"""max(CASE WHEN k = {k} THEN CASE WHEN c = 0 THEN 0 ELSE
    CASE WHEN c > r THEN 1 ELSE exp(1 - r / c) END * coalesce(m, 0) / greatest(1, c - k + 1) END END)
    AS bleu{k}"""
    return f"""{name}_w AS (SELECT idx, regexp_extract_all(beams[1], {WORD}) AS p,
  regexp_extract_all(label, {WORD}) AS l FROM {source}),
{name}_pc AS (SELECT idx, k, g, count(*) AS n FROM ({grams('p')}) GROUP BY ALL),
{name}_lc AS (SELECT idx, k, g, count(*) AS n FROM ({grams('l')}) GROUP BY ALL),
{name}_m AS (SELECT idx, k, sum(least(a.n, b.n))::DOUBLE AS m FROM {name}_pc a
  JOIN {name}_lc b USING (idx, k, g) GROUP BY idx, k),
{name} AS (SELECT idx, {', '.join(score(k) for k in (1, 2, 3, 4))}
  FROM (SELECT idx, k, len(p)::DOUBLE AS c, len(l)::DOUBLE AS r FROM {name}_w, range(1, 5) q(k))
  LEFT JOIN {name}_m USING (idx, k) GROUP BY idx)"""


METRICS = [f"hit{k}" for k in range(1, 6)] + ["hitgen"] + [f"bleu{k}" for k in range(1, 5)]


def row_scores(source="scored", name="rows_") -> str:
    return f"""{bleu(source)},
{name} AS (SELECT s.idx, split, {', '.join(f'{hit(k)} AS hit{k}' for k in range(1, 6))},
  {HITGEN} AS hitgen, bleu1, bleu2, bleu3, bleu4 FROM {source} s JOIN bleu USING (idx))"""


def running(source="rows_", name="running") -> str:
    return f"""{name} AS (SELECT idx, bleu1, bleu2, bleu3, bleu4,
  row_number() OVER (ORDER BY idx) AS cnt,
  {', '.join(f'avg({m}) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run_{m}' for m in METRICS)}
  FROM {source})"""


def fixed(names, sep="|"):
    return f" || '{sep}' || ".join(f"printf('%.4f', {n})" for n in names)


def reranked(name="reranked", number="\\d+") -> str:
    d, p, q = v("d"), v("p"), v("q")
    digits = f"regexp_extract_all(beams[1], 'Passage ({number})', 1)"
    place = f"CASE WHEN {d} = '0' THEN len(base_) ELSE TRY_CAST({d} AS INTEGER) END"
    return f"""{name}_b AS (SELECT s.idx, split, target_knowledge, beams,
  ({non_empty('know[1]')})[1:4] AS base_
  FROM samples s LEFT JOIN gen_P USING (idx) LEFT JOIN know USING (idx)),
{name}_p AS (SELECT *, list_filter(list_transform({digits}, lambda {d}: base_[{place}]),
  lambda {p}: {p} IS NOT NULL) AS picked FROM {name}_b),
{name} AS (SELECT *, list_filter(base_, lambda {q}: NOT list_contains(picked, {q})) AS unpicked
  FROM {name}_p)"""
