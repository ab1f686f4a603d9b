"""Quality classifier as a sparse rule ensemble.

Shallow boosted trees over text statistics are grown in numpy; every path from a root is a conjunctive rule.
A logistic regression with a lasso penalty gives most rules weight zero; the rest are compiled into one Spark
column expression, so that scoring is arithmetic over the statistics.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .decision_list import Condition, cut_points
from .textstats import RATIOS, fold, label_sample, with_stats

#: At most about this many labelled documents of each class are fetched to learn from.
LEARN_PER_CLASS = 6_000
TREES = 30
DEPTH = 3
THRESHOLD = 0.7


@dataclass(frozen=True)
class Ensemble:
    """Score = sigmoid(intercept + sum of the weights of the rules that apply)."""

    intercept: float
    rules: tuple[tuple[Condition, ...], ...]
    weights: tuple[float, ...]

    def logit(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            meets = rule[0].column()
            for condition in rule[1:]:
                meets = meets & condition.column()
            total = total + F.when(meets, weight).otherwise(0.0)
        return total

    def score(self) -> Column:
        return 1.0 / (1.0 + F.exp(-self.logit()))


def _tree_rules(bins: np.ndarray, cuts: list[np.ndarray], names: Sequence[str], target: np.ndarray,
                rows: np.ndarray, depth: int, least: int) -> tuple[list[tuple[Condition, ...]], np.ndarray]:
    """A regression tree by histograms; its paths (inner nodes too) and its fitted values for all rows."""
    paths: list[tuple[Condition, ...]] = []
    fitted = np.zeros(len(bins))

    def split(inside: np.ndarray, path: tuple[Condition, ...]) -> None:
        used = inside & rows
        if path:
            paths.append(path)
        fitted[inside] = target[used].mean() if used.any() else 0.0
        if len(path) == depth or used.sum() < 2 * least:
            return
        t, best = target[used], (1e-9, -1, -1)
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            b = bins[used, j]
            n = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
            s = np.cumsum(np.bincount(b, weights=t, minlength=len(c) + 1))[:-1]
            ok = (n >= least) & (len(t) - n >= least)
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (t.sum() - s) ** 2 / np.maximum(len(t) - n, 1), -np.inf)
            k = int(np.argmax(gain))
            gained = gain[k] - t.sum() ** 2 / len(t)
            if gained > best[0]:
                best = (gained, j, k)
        if best[1] < 0:
            return
        _, j, k = best
        low = bins[:, j] <= k
        split(inside & low, (*path, Condition(names[j], False, float(cuts[j][k]))))
        split(inside & ~low, (*path, Condition(names[j], True, float(cuts[j][k]))))

    split(np.ones(len(bins), bool), ())
    return paths, fitted


def grow_rules(x: np.ndarray, y: np.ndarray, names: Sequence[str], trees: int = TREES, depth: int = DEPTH,
               seed: int = 5) -> list[tuple[Condition, ...]]:
    """Distinct paths of boosted trees, each grown on a random half of the rows."""
    rng = np.random.default_rng(seed)
    cuts = [cut_points(x[:, j], 32) for j in range(x.shape[1])]
    # a row is in bin k when it lies above k of the cuts
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    logit, found = np.zeros(len(y)), {}
    for _ in range(trees):
        rest = y - 1 / (1 + np.exp(-logit))
        paths, fitted = _tree_rules(bins, cuts, names, rest, rng.random(len(y)) < 0.5, depth, max(5, len(y) // 400))
        logit += 1.5 * fitted
        for path in paths:
            found.setdefault(tuple(sorted(path, key=str)), path)
    return list(found.values())


def apply_rules(x: np.ndarray, names: Sequence[str], rules: Sequence[tuple[Condition, ...]]) -> np.ndarray:
    at = {n: j for j, n in enumerate(names)}
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for c in rule:
            column = x[:, at[c.name]]
            out[:, k] *= (column > c.cut) if c.above else (column <= c.cut)
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, weight: np.ndarray, steps: int = 400,
                   start: tuple[float, np.ndarray] | None = None) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient; the intercept is not penalised."""
    total = weight.sum()
    size = 0.25 * np.linalg.norm(r * np.sqrt(weight / total)[:, None], 2) ** 2 + 0.25
    b, w = start or (0.0, np.zeros(r.shape[1]))
    b0, w0, t = b, w, 1.0
    for _ in range(steps):
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        bz, wz = b + (t - 1) / t1 * (b - b0), w + (t - 1) / t1 * (w - w0)
        off = weight * (1 / (1 + np.exp(-np.clip(bz + r @ wz, -40, 40))) - y) / total
        b0, w0, t = b, w, t1
        b = bz - off.sum() / size
        w = wz - r.T @ off / size
        w = np.sign(w) * np.maximum(np.abs(w) - penalty / size, 0)
    return float(b), w


def learn(x: np.ndarray, y: np.ndarray, names: Sequence[str]) -> Ensemble:
    """The penalty is chosen on every fourth row. With one class only the score is constant: 0.01 or 0.99,
    and one half without any row."""
    y = np.asarray(y, float)
    if len(y) == 0 or y.min() == y.max():
        share = 0.5 if len(y) == 0 else min(max(float(y[0]), 0.01), 0.99)
        return Ensemble(float(np.log(share / (1 - share))), (), ())
    x = np.asarray(x, float)
    check = np.arange(len(y)) % 4 == 3
    if min(y[~check].min(), 1 - y[~check].max()) > 0 or not check.any() or y[~check].min() == y[~check].max():
        check = np.zeros(len(y), bool)
    rules = grow_rules(x[~check], y[~check], names)
    r = apply_rules(x, names, rules)
    weight = np.where(y == 1, 0.5 / max((y == 1).mean(), 1e-9), 0.5 / max((y == 0).mean(), 1e-9))
    best, fit = None, None
    for penalty in (0.02, 0.008, 0.003, 0.001):
        fit = lasso_logistic(r[~check], y[~check], penalty, weight[~check], start=fit)
        judged = check if check.any() else ~check
        z = np.clip(fit[0] + r[judged] @ fit[1], -40, 40)
        loss = float((weight[judged] * np.logaddexp(0, np.where(y[judged] == 1, -z, z))).sum())
        if best is None or loss < 0.98 * best[0]:
            best = (loss, fit)
    b, w = best[1]
    used = np.flatnonzero(np.abs(w) > 1e-6)
    return Ensemble(b, tuple(rules[k] for k in used), tuple(float(w[k]) for k in used))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, held: int = 2,
                   per_class: int = LEARN_PER_CLASS, names: Sequence[str] = RATIOS) -> tuple[DataFrame, Ensemble]:
    """``doc_id``, statistics, ``held_out``, ``score`` and ``predicted`` for every row of ``docs``.

    Labels are learned only outside the fold ``held``; nothing but the text enters a score. Null and empty
    texts are scored by their all-zero statistics. A null ``doc_id`` is in no fold (``held_out`` false) and
    never learned from; repeated rows are scored as often as given.
    """
    stats = stage(with_stats(docs), "quality-stats")
    sample = label_sample(labels.where(fold("doc_id", parts) != held), label, per_class)
    seen = stats.join(F.broadcast(sample), "doc_id").select("doc_id", "y", *names).dropDuplicates().toPandas()
    seen = seen.sort_values(["doc_id", *names], kind="stable")
    model = learn(seen[list(names)].to_numpy(float), seen["y"].to_numpy(int), names)
    scored = stats.withColumn("held_out", F.coalesce(fold("doc_id", parts) == held, F.lit(False))).withColumn(
        "score", model.score())
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")), model
