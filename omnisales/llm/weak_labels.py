"""A generative label model over voters, and a linear classifier on its posterior labels.

Voters say one of a few outcomes (0: abstains). The model gives each voter an outcome distribution
for either class; expectation-maximisation estimates these and the class share from counts of vote
patterns. Voters that agree more than the classes explain are correlated: such pairs are joined to
one voter with the product of their outcomes, and the estimation runs again. Input is counts by
pattern, so the work here is bounded by the number of patterns, not by the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class LabelModel:
    parts: list[tuple[int, ...]]
    tables: list[np.ndarray]
    share: float
    outcomes: int

    def _codes(self, votes: np.ndarray, part: tuple[int, ...]) -> np.ndarray:
        code = np.zeros(len(votes), np.int64)
        for v in part:
            code = code * self.outcomes + votes[:, v]
        return code

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(class 1) of each vote pattern."""
        logit = np.full(len(votes), np.log(self.share) - np.log1p(-self.share))
        for part, table in zip(self.parts, self.tables, strict=True):
            code = self._codes(votes, part)
            logit += np.log(table[1, code]) - np.log(table[0, code])
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def _estimate(votes: np.ndarray, n: np.ndarray, parts: list[tuple[int, ...]], outcomes: int, start: np.ndarray,
              share: float, strength: float, rounds: int, trusted: dict[int, float]) -> LabelModel:
    model = LabelModel(parts, [], share, outcomes)
    priors = []
    for part in parts:  # pseudo-counts: a voter says 1 more often in class 1, 2 more often in class 0
        table = np.ones((2, outcomes ** len(part)))
        for code in range(table.shape[1]):
            rest = code
            for _ in part:
                said, rest = rest % outcomes, rest // outcomes
                table[:, code] *= {0: (0.6, 0.6), 1: (0.1, 0.3), 2: (0.3, 0.1)}[said]
        priors.append(strength * table / table.sum(axis=1, keepdims=True))
    p = start
    for _ in range(rounds):
        weight = np.stack([n * (1 - p), n * p])
        model.share = float(np.clip((weight[1].sum() + strength * share) / (n.sum() + strength), 1e-6, 1 - 1e-6))
        model.tables = []
        for part, prior in zip(parts, priors, strict=True):
            if part[0] in trusted:
                right = trusted[part[0]]
                model.tables.append(np.array([[1.0, 1 - right, right], [1.0, right, 1 - right]]))
                continue
            code = model._codes(votes, part)
            table = np.stack([np.bincount(code, w, prior.shape[1]) for w in weight]) + prior
            model.tables.append(table / table.sum(axis=1, keepdims=True))
        new = model.posterior(votes)
        moved = float(np.max(np.abs(new - p), initial=0.0))
        p = new
        if moved < 1e-6:
            break
    return model


def label_model(votes: np.ndarray, n: np.ndarray, share: float, outcomes: int = 3, strength: float = 20.0,
                rounds: int = 200, residual: float = 0.15, copies: float = 0.75,
                trusted: dict[int, float] | None = None) -> LabelModel:
    """``votes``: patterns (rows) by voter; ``n``: how many items have each; ``share``: expected share of class 1.

    ``trusted`` voters keep the accuracy given; whether they vote says nothing about the class.
    """
    trusted = trusted or {}
    voters = votes.shape[1]
    lean = (votes == 1).sum(axis=1) - 0.5 * (votes == 2).sum(axis=1)
    for v in trusted:
        lean = np.where(votes[:, v] == 1, 3.0, np.where(votes[:, v] == 2, -3.0, lean))
    start = 1 / (1 + np.exp(-(2.0 * lean - 1.0)))
    # Voters that nearly repeat each other, and then those that agree more than the classes explain.
    pairs = _pairs(_correlation(votes, [n]), copies, set(trusted))
    model = _estimate(votes, n, _parts(pairs, voters), outcomes, start, share, strength, rounds, trusted)
    p = model.posterior(votes)
    alone = set(trusted) | {v for pair in pairs for v in pair}
    more = _pairs(_correlation(votes, [n * p, n * (1 - p)]), residual, alone)
    if not more:
        return model
    return _estimate(votes, n, _parts(pairs + more, voters), outcomes, p, share, strength, rounds, trusted)


def _correlation(votes: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """Absolute correlation of speaking for class 1, within each weighting, averaged by weight."""
    said = (votes == 1).astype(float)
    left = np.zeros((votes.shape[1],) * 2)
    whole = sum(w.sum() for w in weights)
    for w in weights:
        total = w.sum()
        if total > 1:
            mean = w @ said / total
            cov = (said * w[:, None]).T @ said / total - np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            left += np.abs(cov / np.outer(sd, sd)) * total / whole
    return left


def _pairs(correlation: np.ndarray, least: float, taken: set[int]) -> list[tuple[int, ...]]:
    """Disjoint pairs of voters, the most correlated first."""
    voters, used, found = len(correlation), set(taken), []
    for flat in np.argsort(-np.triu(correlation, 1), axis=None, kind="stable"):
        a, b = divmod(int(flat), voters)
        if a >= b or correlation[a, b] < least:
            break
        if not {a, b} & used:
            found.append((a, b))
            used |= {a, b}
    return found


def _parts(pairs: list[tuple[int, ...]], voters: int) -> list[tuple[int, ...]]:
    used = {v for pair in pairs for v in pair}
    return pairs + [(v,) for v in range(voters) if v not in used]


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float | np.ndarray = 1.0,
               steps: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last coefficient is the intercept (not penalised)."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    beta = np.zeros(x.shape[1])
    ridge = np.append(np.broadcast_to(penalty, x.shape[1] - 1), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (y - p)) - ridge * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hess, grad)
        size = np.abs(step).max(initial=0.0)
        beta += step * min(1.0, 4.0 / max(size, 1e-12))
        if size < 1e-6:
            break
    return beta


def linear_score(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -50, 50)))
