"""Prompts and labels: exact texts on hand-made rows."""

import pytest
from turnloom import fixed_values as fv
from turnloom.operators import labels, render
from turnloom.settings import Settings

ROW = dict(
    idx=0, dialog="user {input} asks", user_profile="P", response="the reply", topic="B", goal="g",
    query="refined", predicted_goal=["goal", "other"], predicted_topic=["A", "B"],
    predicted_topic_confidence=[0.5, 0.25], predicted_know=[["a1", "", "a2 A"], ["b1"]],
    selected_topic="B", target_knowledge="b1", gpt_selection="b1", candidate_knowledges_gpt=["b1"],
    topic_cot="Since. Therefore, B", passage_cot="As. Therefore, b1", label="L",
)
SCHEMA = (
    "idx bigint, dialog string, user_profile string, response string, topic string, goal string, "
    "query string, predicted_goal array<string>, predicted_topic array<string>, "
    "predicted_topic_confidence array<double>, predicted_know array<array<string>>, "
    "selected_topic string, target_knowledge string, gpt_selection string, "
    "candidate_knowledges_gpt array<string>, topic_cot string, passage_cot string, label string"
)


@pytest.fixture()
def rows(spark):
    return lambda **changes: spark.createDataFrame([{**ROW, **changes}], SCHEMA)


def fill(name, form="prompt_input", **values):
    return fv.TEMPLATES[name][form].replace("{instruction}", "\0").replace("{input4}", values.get("input4", "")).replace(
        "{input3}", values.get("input3", "")).replace("{input2}", values.get("input2", "")).replace(
        "{input}", values.get("input", "")).replace("\0", ROW["dialog"]).replace("  ", " ").strip()


def prompt(df, cfg, mode="test"):
    return render.build_prompts(df, cfg, mode).first().prompt


BLOCKS = ("Here are the candidate passages about {w} 1. A\nPassage 1. a1\nPassage 2. a2 A\n\n"
          "Here are the candidate passages about {w} 2. B\nPassage 4. b1\n\n")


@pytest.mark.parametrize("name", ["DIP2I", "DIP2I_cot"])
def test_item_prompts(rows, name):
    cfg = Settings(prompt=name, combined=True, topk_topic=2)
    assert prompt(rows(), cfg) == fill(name, input="Topic 1. A\nTopic 2. B", input2=BLOCKS.format(w="Topic"))
    cfg = cfg.with_(inspired=True)
    assert prompt(rows(), cfg) == fill(name, input="Item 1. A\nItem 2. B", input2=BLOCKS.format(w="Item"))


@pytest.mark.parametrize("name", ["UDGIP2I_new", "UDGIP2I_cot"])
def test_profile_prompts(rows, name):
    cfg = Settings(prompt=name, combined=True, topk_topic=2, query=True)
    assert prompt(rows(), cfg) == fill(
        name, input="refined", input2="Topic 1. A\nTopic 2. B", input3=BLOCKS.format(w="Topic"), input4="P")


@pytest.mark.parametrize("name", ["DIP2P", "DIP2P_cot"])
def test_passage_prompts(rows, name):
    cfg = Settings(prompt=name)
    want = fill(name, input="Topic 1. A", input2="Passage 1. a1\nPassage 2. a2 A")
    assert prompt(rows(), cfg) == want
    assert prompt(rows(), cfg.with_(selected_topic=True)) == want.replace("Topic 1. A", "Topic 1. B")
    assert prompt(rows(), cfg.with_(target=True)) == fill(name, input="Topic 1. A", input2="Passage 1. b1\n")


@pytest.mark.parametrize("name", ["DGIP2P_new", "DGIP2P_cot_new"])
def test_goal_passage_prompts(rows, name):
    cfg = Settings(prompt=name, selected_topic=True, filtering=True)
    assert prompt(rows(selected_topic="A"), cfg) == fill(
        name, input="goal", input2="Topic 1. A", input3="Passage 1. a1\nPassage 2. a2 A")


def test_response_prompts(rows):
    assert prompt(rows(), Settings(prompt="DP2R_inspired")) == fill(
        "DP2R_inspired", input="Passage 1. a1\nPassage 2. a2 A")
    bare = rows(predicted_know=[[""]])
    assert prompt(bare, Settings(prompt="DP2R_inspired")) == fill("DP2R_inspired", "prompt_no_input")
    assert prompt(rows(), Settings(prompt="DGP2R")) == fill(
        "DGP2R", input="goal", input2="Passage 1. a1\nPassage 2. a2 A")
    assert prompt(bare, Settings(prompt="DGP2R")) == fill("DGP2R", input="goal", input2=" ")
    assert prompt(rows(), Settings(prompt="DGP2R"), "train").endswith("### Response:L")


def test_rows_without_topics_or_knowledge(rows):
    none = rows(predicted_topic=[], predicted_know=[])
    cfg = Settings(prompt="DIP2I", combined=True, topk_topic=2, inspired=True)
    assert prompt(none, cfg) == fill("DIP2I", "prompt_no_input")
    assert prompt(rows(predicted_know=None), Settings(prompt="DP2R_inspired")) == fill(
        "DP2R_inspired", "prompt_no_input")


def test_variants(rows):
    cfg = Settings(prompt="DP2R_inspired", combined=True, topk_topic=2, all_passages=True)
    assert prompt(rows(), cfg) == fill(
        "DP2R_inspired", input="Passage 1. a1\nPassage 2. a2 A\n\nPassage 4. b1\n\n")
    some = rows(predicted_know=[["n1", "n2 A"], ["b1"]])
    only = prompt(some, cfg.with_(filtering=True))
    assert "n1" not in only and "Passage 1. n2 A" in only
    unlimited = prompt(rows(), cfg.with_(n_sampled_negative=-1))
    assert "Passage 2. a2 A\n\nPassage 3. b1" in unlimited
    few = prompt(rows(), Settings(prompt="DIP2I", combined=True, topk_topic=2, topic_conf=0.5))
    assert "Topic 1. A\n\n" in few and "Topic 2." not in few


def test_unknown_prompt(rows):
    with pytest.raises(ValueError):
        prompt(rows(), Settings(prompt="D2P"))
    with pytest.raises(ValueError):
        labels.train_texts(rows(), Settings(prompt="D2P"))
    with pytest.raises(ValueError):
        Settings(prompt="x").task
    assert Settings(prompt="pretrain").task == "pretrain"


def test_own_templates(rows):
    own = {"DIP2I": {"prompt_input": "{instruction}|{input}|{nothing}", "prompt_no_input": "-", "response_split": ""}}
    cfg = Settings(prompt="DIP2I", combined=True)
    assert render.build_prompts(rows(), cfg, templates=own).first().prompt == "user {input} asks|Topic 1. A|"


def train(df, **kw):
    base = dict(positive="gpt_selection", topk_topic=2, n_sampled_negative=3)
    return labels.train_texts(df, Settings(**{**base, **kw})).first()


def test_item_labels(rows):
    r = train(rows(), prompt="DIP2I_cot", combined=True, inspired=True)
    assert r.label_text == 'Since. Therefore, the most suitable item is "B"'
    r = train(rows(), prompt="DIP2I_cot", combined=True)
    assert r.label_text == 'Since. Therefore, the most suitable topic is "B"'
    assert train(rows(), prompt="DIP2I", combined=True).label_text == "B"
    assert train(rows(), prompt="UDGIP2I_new", combined=True).label_text == "B"
    assert train(rows(), prompt="UDGIP2I_cot", combined=True).example.endswith(
        '### Response:Since. Therefore, the most suitable topic is "B"')


def test_passage_labels(rows):
    flags = dict(candidate_knowledges_gpt=True)
    first = "Passage 1. b1"
    assert train(rows(), prompt="DIP2P", **flags).label_text == first
    assert train(rows(), prompt="DIP2P_cot", **flags).label_text == (
        f"As. Therefore, the most relevant passages are as follows:\n{first}.")
    assert train(rows(), prompt="DGIP2P_new", **flags).label_text == f"{first}."
    assert train(rows(), prompt="DGIP2P_cot_new", **flags).label_text == (
        f"As. Therefore, the relevant passages are as follow:\n{first}")
    empty = rows(candidate_knowledges_gpt=[])
    assert train(empty, prompt="DIP2P", **flags).label_text == fv.NO_RELEVANT_PASSAGE
    assert train(empty, prompt="DIP2P_cot", **flags).label_text == fv.NO_RELEVANT_PASSAGE


def test_passage_label_variants(rows):
    r = train(rows(), prompt="DIP2P")
    assert r.passage_label == "Passage 1. b1"
    assert train(rows(), prompt="DIP2P", strict_compat=True).passage_label == "Passage 0. b1"
    assert train(rows(gpt_selection="zz"), prompt="DIP2P").passage_label == "Passage 0. zz"
    assert train(rows(), prompt="DIP2P", target=True).passage_label == r.passages_text
    assert train(rows(), prompt="DIP2P", all_passages=True).passage_label == ""


def test_missing_positives_are_counted(rows):
    r = train(rows(candidate_knowledges_gpt=["b1", "b2"]), prompt="DIP2P", n_sampled_negative=1,
              candidate_knowledges_gpt=True)
    assert (r.passage_label, r.n_missing_positive) == ("Passage 1. b1", 1)


def test_label_number_is_the_shown_one(rows):
    for strict in (False, True):
        r = train(rows(), prompt="DIP2I", combined=True, candidate_knowledges_gpt=True,
                  n_sampled_negative=4, strict_compat=strict)
        if not strict:
            assert r.passage_label in r.passages_text
        else:
            assert r.passage_label == f"Passage {r.passages.index('b1') + 1}. b1"


def test_response_label_and_headings(rows):
    r = train(rows(), prompt="DP2R_inspired", combined=True)
    assert r.label_text == "the reply" and fv.BLOCK_HEADING not in r.passages_text
    r = train(rows(), prompt="DGP2R", n_hard_negative=0)
    assert r.passages_text == "Passage 1. b1" and r.example.endswith("### Response:the reply")


def test_inputs_only(rows):
    out = labels.train_examples(rows(), Settings(
        prompt="DGP2R", positive="target", train_only_inputs=True)).first()
    assert out.example == out.prompt and out.input_ids[-1] != "</s>"


def test_masks(rows):
    cfg = Settings(prompt="DGP2R", positive="target", train_only_outputs=True)
    out = labels.train_examples(rows(), cfg).first()
    n = out.labels.count("-100")
    assert n == len(out.prompt.split()) and out.labels[n:] == out.input_ids[n:]
    assert out.attention_mask == [1] * len(out.input_ids)
    alternate = Settings(prompt="DGP2R", positive="target", weighted_loss=True)
    assert "-100" not in labels.train_examples(rows(idx=2), alternate).first().labels
    assert "-100" in labels.train_examples(rows(idx=3), alternate).first().labels


def test_sampling_follows_seed_and_epoch(rows):
    df = rows(predicted_know=[[f"p{i}" for i in range(9)], ["b1"]])
    cfg = Settings(prompt="DIP2P", positive="target", shuffle=True, n_sampled_negative=8)
    text = lambda c: labels.train_texts(df, c).first().example
    assert text(cfg) == text(cfg)
    assert len({text(cfg.with_(epoch=e)) for e in range(4)}) > 1
