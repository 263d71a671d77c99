"""Gradient boosting of small trees over histograms, for two classes or numbers.

Rows with equal bins (and class) are one profile, as in `boosting`: of a number the trees need only its count and sum.
A level of a tree is one job that sums counts and residuals by (node, feature, bin) over the blocks of profiles; the driver
sees those sums, whatever the rows.  Losses, residuals and weights are those of Spark's boosted trees.
"""

from __future__ import annotations

import sys
from functools import partial

import numpy as np
from pyspark import StorageLevel, cloudpickle, keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.ml.boosting import BINS, packed, profiles, thresholds
from plumbline.ml.votes import cell_scores

# Executors need not have this package: the functions travel with their tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Trees between two kept states of the scores.
KEEP_EVERY = 10


def leaves(tree: list[tuple], bins: np.ndarray) -> np.ndarray:
    """The node that each row reaches in a tree of `(feature, last bin on the left, left node, value)`; leaves have feature -1."""
    at = np.zeros(len(bins), dtype="int64")
    feature, last, left = (np.array([node[i] for node in tree], dtype="int64") for i in range(3))
    while True:
        inner = np.flatnonzero(feature[at] >= 0)
        if not len(inner):
            return at
        node = at[inner]
        at[inner] = left[node] + (bins[inner, feature[node]] > last[node])


def score_of(trees: list[tuple[float, list[tuple]]], bins: np.ndarray) -> np.ndarray:
    """The weighted sum of the trees' values."""
    total = np.zeros(len(bins))
    for weight, tree in trees:
        total += weight * np.array([node[3] for node in tree])[leaves(tree, bins)]
    return total


def advanced(trees: list, block: tuple) -> tuple:
    bins, n, y, score = block
    return bins, n, y, score + score_of(trees, bins)


def node_sums(trees: list, tree: list, open_: list[int], deepest: int, classes: int, first: bool, block: tuple) -> np.ndarray:
    """Rows and residuals by (open node, feature, bin); `y` is the class (-1 or 1) or the sum of the numbers."""
    bins, n, y, score = advanced(trees, block)
    if classes:
        residual = n * (y if first else 4 * y / (1 + np.exp(2 * y * score)))
    else:
        residual = y if first else 2 * (y - n * score)
    slot = np.full(len(tree), -1)
    slot[open_] = np.arange(len(open_))
    at = slot[leaves(tree, bins)]
    there = at >= 0
    cells = len(open_) * deepest
    out = np.zeros((2, bins.shape[1], cells))
    for f in range(bins.shape[1]):
        cell = at[there] * deepest + bins[there, f]
        out[0, f], out[1, f] = (np.bincount(cell, v[there], cells) for v in (n, residual))
    return out.reshape(2, bins.shape[1], len(open_), deepest)


def best_splits(sums: np.ndarray) -> list[tuple | None]:
    """For each open node `(feature, last left bin, gain x rows, left mean, right mean)`, or nothing to gain."""
    found = []
    for slot in range(sums.shape[2]):
        rows, total = (s[:, slot].cumsum(axis=1) for s in sums)
        n, s = rows[0, -1], total[0, -1]
        a, b, left, right = rows[:, :-1], n - rows[:, :-1], total[:, :-1], s - total[:, :-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((a > 0) & (b > 0), left**2 / a + right**2 / b - s**2 / n, -1.0)
        scale = abs(s) + s**2 / n
        if not gain.size or gain.max() <= 1e-12 * max(scale, n):
            found.append(None)
            continue
        f, last = np.unravel_index(int(gain.argmax()), gain.shape)
        found.append((int(f), int(last), float(gain[f, last]), float(left[f, last] / a[f, last]), float(right[f, last] / b[f, last])))
    return found


class TreeScores(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds `prediction`, and `probability` for two classes, by a weighted sum of trees; all its numbers are parameters."""

    features = Param(Params._dummy(), "features", "feature of each node, -1 at leaves", TypeConverters.toListInt)
    thresholds = Param(Params._dummy(), "thresholds", "largest value on the left of each node", TypeConverters.toListFloat)
    lefts = Param(Params._dummy(), "lefts", "left node of each node, inside its tree; the right one follows", TypeConverters.toListInt)
    values = Param(Params._dummy(), "values", "value of each node", TypeConverters.toListFloat)
    sizes = Param(Params._dummy(), "sizes", "nodes of each tree", TypeConverters.toListInt)
    weights = Param(Params._dummy(), "weights", "weight of each tree", TypeConverters.toListFloat)
    classes = Param(Params._dummy(), "classes", "number of classes, 0 for numbers", TypeConverters.toInt)

    @keyword_only
    def __init__(self, features=None, thresholds=None, lefts=None, values=None, sizes=None, weights=None, classes=0):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        features, cuts, lefts, values, sizes, weights = (
            self.getOrDefault(p) for p in (self.features, self.thresholds, self.lefts, self.values, self.sizes, self.weights)
        )
        used = {f: sorted({t for g, t in zip(features, cuts) if g == f}) for f in sorted({f for f in features if f >= 0})}
        column = {f: i for i, f in enumerate(used)}
        nodes = [(column[f], used[f].index(t), l, v) if f >= 0 else (-1, 0, 0, v) for f, t, l, v in zip(features, cuts, lefts, values)]
        ends = np.cumsum(sizes).tolist()
        trees = [(w, nodes[end - size : end]) for w, size, end in zip(weights, sizes, ends)]
        scored = dataset.withColumn("_score", cell_scores("features", used, lambda cells: score_of(trees, cells)[:, None])[0])
        if not self.getOrDefault(self.classes):
            return scored.withColumnRenamed("_score", "prediction")
        p = 1 / (1 + F.exp(-2 * F.col("_score")))
        both = scored.withColumn("probability", array_to_vector(F.array(1 - p, p)))
        return both.withColumn("prediction", (F.col("_score") > 0).cast("double")).drop("_score")


class BoostedTrees(PipelineModel):
    """The scoring stage, and what each feature gained."""

    slot_weights: np.ndarray


def boosted_trees(df: DataFrame, width: int, classes: int, rounds: int, learning_rate: float, max_depth: int, bins: int = BINS) -> BoostedTrees:
    """`classes` is 2, or 0 for numbers; the first tree has weight 1, the others the learning rate."""
    if rounds < 1 or max_depth < 0 or not 0 < learning_rate <= 1:
        raise ValueError("boosting needs a round, a depth of 0 or more, and a learning rate up to 1")
    cuts = thresholds(df, width, bins)
    deepest = max(map(len, cuts), default=0) + 1
    table = profiles(df, cuts, numbers=not classes)
    if classes:
        table = table.select("bins", "n", (2.0 * F.col("label") - 1).alias("y"))
    kept = packed(table)
    state = kept.map(lambda block: (*block, np.zeros(len(block[1])))).persist(StorageLevel.MEMORY_AND_DISK)
    held, since, trees, gained = [state], [], [], np.zeros(width)
    for i in range(rounds):
        tree, open_ = [(-1, 0, 0, 0.0)], [0]
        for depth in range(max(1, max_depth)):
            sums = held[-1].map(partial(node_sums, list(since), tree, open_, deepest, classes, not trees)).treeReduce(np.add)
            for old in held[:-1]:
                old.unpersist()
            held = held[-1:]
            if not depth:
                tree[0] = (-1, 0, 0, float(sums[1, 0].sum() / sums[0, 0].sum()))
            fresh = []
            for node, split in zip(open_, best_splits(sums) if max_depth else []):
                if split is not None:
                    feature, last, gain, low, high = split
                    gained[feature] += gain
                    tree[node] = (feature, last, len(tree), tree[node][3])
                    fresh += [len(tree), len(tree) + 1]
                    tree += [(-1, 0, 0, low), (-1, 0, 0, high)]
            open_ = fresh
            if not open_:
                break
        trees.append((learning_rate if trees else 1.0, tree))
        since.append(trees[-1])
        if len(since) == KEEP_EVERY:
            held.append(held[-1].map(partial(advanced, since)).persist(StorageLevel.MEMORY_AND_DISK))
            since = []
    for old in [kept, *held]:
        old.unpersist()
    nodes = [node for _, tree in trees for node in tree]
    stage = TreeScores(
        features=[f for f, *_ in nodes],
        thresholds=[cuts[f][last] if f >= 0 else 0.0 for f, last, *_ in nodes],
        lefts=[left for _, _, left, _ in nodes],
        values=[v for *_, v in nodes],
        sizes=[len(tree) for _, tree in trees],
        weights=[w for w, _ in trees],
        classes=classes,
    )
    model = BoostedTrees([stage])
    model.slot_weights = gained
    return model
