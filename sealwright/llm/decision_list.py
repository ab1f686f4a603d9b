"""Quality rules as a learned decision list.

Sequential covering in the manner of RIPPER: a rule is grown on two thirds of the labelled rows, one
threshold condition at a time by information gain, pruned on the remaining third, and accepted while it is
precise there; the rows it covers are taken out and the next rule is grown. The result is an ordered list of
conjunctions such as ``repeat_share > 0.4 AND line_words <= 30``, compiled into one Spark ``when`` chain.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .textstats import RATIOS, label_sample, with_stats

#: At most about this many labelled documents of each class are fetched to learn from.
LEARN_PER_CLASS = 6_000
CUTS = 48  # thresholds tried for each statistic
LONGEST = 4  # conditions in a rule
PRECISION = 0.9  # of a rule on the pruning rows


@dataclass(frozen=True)
class Condition:
    """``name > cut`` or ``name <= cut``."""

    name: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.name) > self.cut if self.above else F.col(self.name) <= self.cut

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def cut_points(values: np.ndarray, cuts: int = CUTS) -> np.ndarray:
    """Thresholds midway between neighbouring values at even quantiles."""
    distinct = np.unique(values)
    if len(distinct) < 2:
        return np.empty(0)
    middle = (distinct[1:] + distinct[:-1]) / 2
    if len(middle) <= cuts:
        return middle
    return np.unique(middle[np.linspace(0, len(middle) - 1, cuts).astype(int)].tolist()
                     + [float(c) for c in np.quantile(values, np.linspace(0.02, 0.98, cuts))])


def conditions_of(x: np.ndarray, names: Sequence[str], cuts: int = CUTS) -> tuple[list[Condition], np.ndarray]:
    """All threshold conditions and the rows (as columns of a boolean matrix) that meet them."""
    out, met = [], []
    for j, name in enumerate(names):
        for cut in cut_points(x[:, j], cuts):
            for above in (True, False):
                out.append(Condition(name, above, float(cut)))
                met.append(x[:, j] > cut if above else x[:, j] <= cut)
    return out, np.array(met, bool).T.reshape(len(x), len(out))


def _grow(met: np.ndarray, y: np.ndarray, longest: int) -> list[int]:
    """Adds the condition of the largest FOIL gain until no row of class 0 is covered."""
    rule: list[int] = []
    rows = np.ones(len(y), bool)
    while len(rule) < longest:
        p0, n0 = (rows & (y == 1)).sum(), (rows & (y == 0)).sum()
        if not p0 or not n0:
            break
        p = met[rows & (y == 1)].sum(0, dtype=np.int64)
        n = met[rows & (y == 0)].sum(0, dtype=np.int64)
        gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - np.log2(p0 / (p0 + n0))), 0.0)
        best = int(np.argmax(gain))
        if gain[best] <= 1e-9:
            break
        rule.append(best)
        rows &= met[:, best]
    return rule


def _worth(met: np.ndarray, y: np.ndarray, rule: list[int]) -> tuple[float, int, int]:
    rows = met[:, rule].all(1)
    p, n = int((rows & (y == 1)).sum()), int((rows & (y == 0)).sum())
    return (p - n) / max(p + n, 1), p, n


def learn(x: np.ndarray, y: np.ndarray, names: Sequence[str], *, cuts: int = CUTS, longest: int = LONGEST,
          precision: float = PRECISION, most_rules: int = 40) -> list[Rule]:
    """Ordered rules for class 1. Rows alternate between growing (two of three) and pruning. Without rows of
    both classes there is nothing to separate and the list is empty."""
    y = np.asarray(y)
    if len(y) == 0 or y.min() == y.max():
        return []
    every, met = conditions_of(np.asarray(x, float), names, cuts)
    pruning = np.arange(len(y)) % 3 == 2
    left = np.ones(len(y), bool)
    rules: list[Rule] = []
    while len(rules) < most_rules and (left & ~pruning & (y == 1)).any():
        g, p = left & ~pruning, left & pruning
        rule = _grow(met[g], y[g], longest)
        if not rule:
            break
        # prune from the end while the rule gets no worse on the rows it was not grown on
        tries = [rule[:k] for k in range(1, len(rule) + 1)]
        rule = max(tries, key=lambda r: (_worth(met[p], y[p], r)[0], -len(r)))
        _, hit, miss = _worth(met[p], y[p], rule)
        if hit == 0 or hit / (hit + miss) < precision:
            break
        rules.append(tuple(every[k] for k in rule))
        left &= ~met[:, rule].all(1)
    return rules


def compile_rules(rules: Sequence[Rule]) -> Column:
    """The number of the first rule that applies, from 1, else 0, as one conditional expression."""
    out = None
    for number, rule in enumerate(rules, 1):
        meets = rule[0].column()
        for condition in rule[1:]:
            meets = meets & condition.column()
        out = F.when(meets, number) if out is None else out.when(meets, number)
    return F.lit(0) if out is None else out.otherwise(0)


def quality_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = LEARN_PER_CLASS,
                  names: Sequence[str] = RATIOS) -> tuple[DataFrame, list[Rule]]:
    """Statistics of every document with ``rule`` (the first rule it meets, 0 for none) and ``kept``.

    The rules are learned from labelled documents (label 0: to be dropped), the statistics are computed once
    over all whole texts. ``base_failed`` is the fixed rule: fewer than 50 words, or more than half of the
    words in repeated three-word windows. Null and empty texts have no words and fail it; a null ``doc_id``
    is kept as a row; repeated rows are returned as often as given; without labels only the fixed rule acts.
    """
    stats = stage(with_stats(docs), "quality-stats")
    sample = label_sample(labels, label, per_class)
    seen = stats.join(F.broadcast(sample), "doc_id").select("doc_id", "y", *names).dropDuplicates().toPandas()
    seen = seen.sort_values(["doc_id", *names], kind="stable")
    rules = learn(seen[list(names)].to_numpy(float), 1 - seen["y"].to_numpy(int), names)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("rule", compile_rules(rules)).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0)), rules
