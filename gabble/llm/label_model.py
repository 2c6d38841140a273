"""A generative model of overlapping voters.

Each voter says 1, -1 or 0 (abstains) with probabilities that depend on the unknown class. Expectation-maximisation
estimates the class share and these probabilities, and with them each voter's accuracy. Voters that agree more than
their accuracies explain are correlated; a correlated voter's evidence is divided by the number of voters that it
repeats, so that copies of one rule don't count as many witnesses.

It works on distinct vote vectors with their counts: at most ``3 ** voters`` rows, whatever the data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class LabelModel:
    prior: float
    #: P(vote | class): voters x classes (0, 1) x votes (-1, 0, 1).
    votes: np.ndarray
    #: Correlation of each pair of voters within a class.
    correlations: np.ndarray
    #: Share of a voter's evidence that counts.
    shares: np.ndarray

    @property
    def accuracies(self) -> np.ndarray:
        """P(vote is right | it doesn't abstain)."""
        right = self.prior * self.votes[:, 1, 2] + (1 - self.prior) * self.votes[:, 0, 0]
        wrong = self.prior * self.votes[:, 1, 0] + (1 - self.prior) * self.votes[:, 0, 2]
        return right / np.maximum(right + wrong, 1e-12)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(class 1) of each vote vector."""
        votes = np.asarray(votes, np.int64).reshape(-1, len(self.shares)) + 1
        at = np.arange(len(self.shares))
        logs = np.log(self.votes)
        odds = np.log(self.prior / (1 - self.prior)) + (
            self.shares * (logs[at, 1, votes] - logs[at, 0, votes])).sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit(patterns: np.ndarray, counts: np.ndarray, prior: float = 0.5, rounds: int = 60,
        correlated: bool = True, start: np.ndarray | None = None) -> LabelModel:
    """Estimate the model from distinct vote vectors and their counts.

    ``start``: first guess of P(class 1) for each vector; without it the majority vote.
    """
    patterns = np.asarray(patterns, np.int64)
    voters = patterns.shape[1] if patterns.ndim == 2 else 0
    counts = np.asarray(counts, float)
    shares = np.ones(voters)
    correlations = np.eye(voters)
    if not voters or not counts.sum():
        return LabelModel(prior, np.full((voters, 2, 3), 1 / 3), correlations, shares)
    if correlated:
        # Before classes are known only voters that nearly always agree look like copies.
        shares = 1 / np.maximum((np.clip(_correlations(patterns, counts[None]), 0, 1) ** 4).sum(1), 1)
    p = 1 / (1 + np.exp(-(patterns @ shares + np.log(prior / (1 - prior))))) if start is None else start
    model = None
    for turn in range(rounds):
        weight = np.stack([counts * (1 - p), counts * p])
        table = np.stack([[np.bincount(patterns[:, j] + 1, weight[c], 3) for c in (0, 1)] for j in range(voters)]) + 0.5
        table /= table.sum(2, keepdims=True)
        share = float(np.clip((weight[1].sum() + 1) / (counts.sum() + 2), 1e-4, 1 - 1e-4))
        if correlated and turn % 10 == 9:
            correlations = _correlations(patterns, weight)
            shares = 1 / np.maximum(np.clip(correlations, 0, 1).sum(1), 1)
        model = LabelModel(share, table, correlations, shares)
        new = model.posterior(patterns)
        if np.abs(new - p).max() < 1e-7 and turn > 10:
            break
        p = new
    return model


def _correlations(patterns: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Correlation of the votes within the classes, averaged by the class shares."""
    total = np.zeros((patterns.shape[1],) * 2)
    for w in weight:
        n = w.sum()
        if n > 1:
            centred = patterns - (w @ patterns) / n
            cov = (centred * w[:, None]).T @ centred / n
            spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            total += n / weight.sum() * cov / np.outer(spread, spread)
    np.fill_diagonal(total, 1)
    return total
