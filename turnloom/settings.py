"""Settings that change what the data work computes."""

from __future__ import annotations

from dataclasses import dataclass, replace

ALL = -1


@dataclass(frozen=True)
class Settings:
    """One run of the data work; every flag is resolved while the plan is built.

    ``strict_compat`` switches back to behaviours which look like mistakes but which a model
    may have been trained on: the target is looked up among the topics instead of the passages,
    label numbers count the flattened list, the filter topic follows the list position, and a
    passage named in an answer is read by one digit.
    """

    prompt: str = "DIP2I_cot"
    # knowledge
    combined: bool = False
    disable_know: bool = False
    merge: bool = False
    db_check: bool = False
    # cuts
    cutoff: int = 256
    passage_cutoff: int = 50
    profile_cutoff: int = 200
    # rows
    debug: bool = False
    test_continue: int = 0
    force_gpt: bool = False
    force_topic: bool = False
    # topics
    inspired: bool = False
    redial: bool = False
    query: bool = False
    selected_topic: bool = False
    topk_topic: int = 1
    topic_conf: float = 1.0
    topic_num_shuffle: bool = False
    item_random_negative: bool = False
    item_random_negative_num: int = 3
    combined_top1: bool = False
    input_top1: bool = False
    # passages
    positive: str = "pseudo"
    n_pseudo: int = 2
    n_hard_negative: int = ALL
    n_sampled_negative: int = 3
    n_sampled_positive: int = 3
    candidate_knowledges_gpt: bool = False
    filtering: bool = False
    shuffle: bool = False
    random_passages: bool = False
    all_passages: bool = False
    target: bool = False
    # examples
    train_only_inputs: bool = False
    train_only_outputs: bool = False
    weighted_loss: bool = False
    val_set_size: int = 0
    # evaluation
    eval_batch_size: int = 1
    num_beams: int = 5
    rerank_base: int = 4  # passages of the first topic that an answer re-ranks
    write: bool = True
    # reproducible sampling: the epoch is part of every draw
    seed: int = 42
    epoch: int = 0
    copy: int = 0  # copies of a merged row draw apart
    strict_compat: bool = False

    @property
    def task(self) -> str:
        """``R``, ``P`` or ``I``: the letter after the 2 of the prompt name, or ``pretrain``."""
        tail = self.prompt.split("2")[-1]
        for letter in "RPI":
            if letter in tail:
                return letter
        if self.prompt == "pretrain":
            return "pretrain"
        raise ValueError(f"prompt {self.prompt!r} names no task")

    @property
    def lists_needed(self) -> int:
        """How many of a row's passage lists, from the first on, can be used at all."""
        if self.db_check:
            return ALL
        if not self.combined:
            return 1
        if self.selected_topic or self.item_random_negative:
            return ALL
        return self.topk_topic

    @property
    def item_word(self) -> str:
        return "Item" if self.inspired or self.redial else "Topic"

    @property
    def draw_seed(self) -> str:
        return f"{self.seed}.{self.epoch}" + (f".{self.copy}" if self.copy else "")

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)


# The flag combinations of the six published recipes (three tasks on two dialog sets).
RECIPES = {
    "inspired_item": Settings(
        prompt="DIP2I_cot", positive="gpt_selection", n_pseudo=1, n_hard_negative=4,
        n_sampled_negative=4, n_sampled_positive=4, topk_topic=3, combined=True, shuffle=True,
        inspired=True, force_gpt=True, cutoff=128, eval_batch_size=4, num_beams=1,
    ),
    "inspired_passage": Settings(
        prompt="DIP2P_cot", positive="gpt_selection", n_pseudo=1, n_sampled_negative=4,
        n_sampled_positive=4, topk_topic=1, shuffle=True, inspired=True, selected_topic=True,
        force_topic=True, force_gpt=True, candidate_knowledges_gpt=True, eval_batch_size=4,
        num_beams=1,
    ),
    "inspired_response": Settings(
        prompt="DP2R_inspired", positive="gpt_selection", n_pseudo=1, n_hard_negative=0,
        n_sampled_negative=4, n_sampled_positive=4, topk_topic=3, inspired=True,
        selected_topic=True, force_topic=True, force_gpt=True, cutoff=128, eval_batch_size=4,
        num_beams=4,
    ),
    "durec_item": Settings(
        prompt="UDGIP2I_cot", positive="gpt_selection", n_pseudo=1, n_hard_negative=4,
        n_sampled_negative=4, topk_topic=3, topic_conf=0.7, combined=True, shuffle=True,
        eval_batch_size=4, num_beams=1,
    ),
    "durec_passage": Settings(
        prompt="DGIP2P_cot_new", positive="gpt_selection", n_pseudo=1, n_sampled_positive=3,
        n_sampled_negative=4, topk_topic=1, shuffle=True, selected_topic=True,
        candidate_knowledges_gpt=True, eval_batch_size=4, num_beams=1,
    ),
    "durec_response": Settings(
        prompt="DGP2R", positive="gpt_selection", n_pseudo=1, n_hard_negative=0,
        n_sampled_negative=4, n_sampled_positive=4, topk_topic=1, selected_topic=True,
        eval_batch_size=4, num_beams=4,
    ),
}

# Where the published training and test commands of a recipe differ.
TRAIN_RECIPES = RECIPES | {
    "inspired_passage": RECIPES["inspired_passage"].with_(force_gpt=False),
    "durec_item": RECIPES["durec_item"].with_(topic_conf=1.0),
}
TEST_RECIPES = RECIPES | {
    "durec_passage": RECIPES["durec_passage"].with_(n_hard_negative=4, n_sampled_positive=4),
}
