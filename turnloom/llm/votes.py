"""Expectation-maximisation for rules that vote good (1), bad (-1) or abstain (0).

The input is one row per pattern of votes with its count, so its size is bounded by 3^rules
whatever the corpus holds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

VOTES = (-1, 0, 1)


@dataclass(frozen=True)
class VoteModel:
    """``prior`` of the good class and, per rule, log P(vote | good) - log P(vote | bad)."""

    prior: float
    evidence: list[dict[int, float]]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of the good class, per row of votes."""
        total = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for r, table in enumerate(self.evidence):
            total += np.array([table[v] for v in VOTES])[votes[:, r].astype(int) + 1]
        return 1 / (1 + np.exp(-total))


def expected(rules: list[tuple[float, float]], abstain: float = 0.1) -> np.ndarray:
    """Expected vote shares from (bad votes in the good class, bad votes in the bad class).

    Entry [c, r, v] is the share of vote v - 1 of rule r in class c (0 bad, 1 good).
    """
    table = np.empty((2, len(rules), 3))
    for r, (alarm, hit) in enumerate(rules):
        table[1, r] = [alarm, abstain * (1 - alarm), (1 - abstain) * (1 - alarm)]
        table[0, r] = [hit, abstain * (1 - hit), (1 - abstain) * (1 - hit)]
    return table


def fit(patterns: np.ndarray, counts: np.ndarray, start: np.ndarray, prior: float = 0.8,
        rounds: int = 60, strength: float = 20.0) -> VoteModel:
    """Estimate how reliable each rule is, from agreement between rules alone.

    ``start`` (see ``expected``) begins the iteration and, as a Dirichlet prior worth ``strength``
    votes, keeps the classes from changing places. Abstentions carry evidence too, as far as they
    depend on the class. An empty table gives the prior model.
    """
    n_rules = start.shape[1]
    patterns = np.asarray(patterns, int).reshape(-1, n_rules)
    counts = np.asarray(counts, float)
    table, share = start.copy(), prior
    rows = np.arange(n_rules)
    for _ in range(rounds if len(counts) else 0):
        log = np.log(table)
        good = np.log(share) + log[1][rows, patterns + 1].sum(axis=1)
        bad = np.log(1 - share) + log[0][rows, patterns + 1].sum(axis=1)
        weight = 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))
        share = (counts @ weight + strength * prior) / (counts.sum() + strength)
        for c, w in ((1, counts * weight), (0, counts * (1 - weight))):
            for r in range(n_rules):
                seen = np.bincount(patterns[:, r] + 1, weights=w, minlength=3)
                table[c, r] = (seen + strength * start[c, r]) / (w.sum() + strength)
    difference = np.log(table[1]) - np.log(table[0])
    return VoteModel(float(share), [{v: float(difference[r, v + 1]) for v in VOTES}
                                    for r in range(n_rules)])
