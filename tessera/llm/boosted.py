"""Gradient-boosted trees: fitted on a bounded list of integer features, applied as Spark expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    """A leaf (feature None) has a value; a split sends rows with feature < cut left."""

    value: float = 0.0
    feature: str | None = None
    cut: int = 0
    left: Tree | None = None
    right: Tree | None = None

    def score(self, row: dict) -> float:
        return self.value if self.feature is None else (self.left if row[self.feature] < self.cut else self.right).score(row)

    def column(self, of) -> Column:
        return F.lit(self.value) if self.feature is None else F.when(of(self.feature) < self.cut, self.left.column(of)).otherwise(self.right.column(of))


@dataclass(frozen=True)
class Model:
    trees: tuple[Tree, ...]
    base: float
    threshold: float

    def score(self, row: dict) -> float:
        return self.base + sum(t.score(row) for t in self.trees)

    def total(self, of) -> Column:
        """The sum of the leaves; of(feature) is a feature's column."""
        out = F.lit(self.base)
        for t in self.trees:
            out = out + t.column(of)
        return out

    def chooses(self, of) -> Column:
        """The sum of leaves against the calibrated threshold."""
        return F.lit(False) if math.isinf(self.threshold) else self.total(of) >= self.threshold


NEVER = Model((), 0.0, math.inf)


def _grow(rows: list[dict], at: list[int], g: list[float], h: list[float], cuts: dict[str, list[int]], depth: int, rate: float, least: int) -> Tree:
    total_g, total_h = sum(g[i] for i in at), sum(h[i] for i in at)
    leaf = Tree(rate * total_g / (total_h + 1.0))
    best = (1e-6, None, 0)
    if depth:
        for f, points in cuts.items():
            sums = [[0.0, 0.0, 0] for _ in range(len(points) + 1)]
            for i in at:
                x, k = rows[i][f], 0
                while k < len(points) and x >= points[k]:
                    k += 1
                s = sums[k]
                s[0] += g[i]
                s[1] += h[i]
                s[2] += 1
            lg = lh = ln = 0
            for k, point in enumerate(points):
                lg, lh, ln = lg + sums[k][0], lh + sums[k][1], ln + sums[k][2]
                if ln >= least and len(at) - ln >= least:
                    gain = lg * lg / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - total_g * total_g / (total_h + 1)
                    if gain > best[0]:
                        best = (gain, f, point)
    if best[1] is None:
        return leaf
    _, f, cut = best
    sides = [i for i in at if rows[i][f] < cut], [i for i in at if rows[i][f] >= cut]
    return Tree(0.0, f, cut, *[_grow(rows, s, g, h, cuts, depth - 1, rate, least) for s in sides])


def fit(rows: list[dict], labels: list[bool], held: list[bool], features: list[str], rounds: int = 24, depth: int = 3, rate: float = 0.3, least: int = 5, precision: float = 0.995, bins: int = 10) -> Model:
    """Trees on the rows that aren't held, and on those that are the lowest threshold that reaches the precision."""
    on = [i for i, h in enumerate(held) if not h]
    p = sum(labels[i] for i in on)
    if not p or p == len(on):
        return NEVER
    cuts = {}
    for f in features:
        seen = sorted(rows[i][f] for i in on)
        if points := sorted({seen[len(seen) * k // bins] for k in range(1, bins)} | {v + 1 for v in seen[:1]} | set(seen[-1:])):
            cuts[f] = points
    base = math.log(p / (len(on) - p))
    score, trees = dict.fromkeys(on, base), []
    for _ in range(rounds):
        prob = {i: 1 / (1 + math.exp(-max(-30, min(30, score[i])))) for i in on}
        g, h = [0.0] * len(rows), [0.0] * len(rows)
        for i in on:
            g[i], h[i] = labels[i] - prob[i], prob[i] * (1 - prob[i])
        tree = _grow(rows, on, g, h, cuts, depth, rate, least)
        trees.append(tree)
        for i in on:
            score[i] += tree.score(rows[i])
    model = Model(tuple(trees), base, math.inf)
    test = sorted(((model.score(rows[i]), labels[i]) for i, x in enumerate(held) if x), reverse=True)
    threshold, hits = math.inf, 0
    for k, (s, y) in enumerate(test):
        hits += y
        if hits >= precision * (k + 1) and (k + 1 == len(test) or test[k + 1][0] < s):
            threshold = s
    return Model(model.trees, base, max(threshold, math.log(9)))  # at least nine in ten by the model itself
