"""Decision trees and random forests over histograms of profiles.

Rows with equal bins (and class) are one profile, as in `boosting`.  Rows of a tree are drawn with replacement by Poisson
numbers, whose sum over the n rows of a profile is a Poisson number of mean n: one draw a profile and tree, seeded by
the profile itself, so it depends on no partitioning.  A level of all trees is one job: weights are summed by (tree, node,
feature, bin, class) over the blocks of profiles and shuffled by tree, and only the best split of each node reaches the
driver.  Impurities, feature subsets, the merging of leaves of one class and importances are those of Spark's trees.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import partial
from math import ceil, sqrt

import numpy as np
from pyspark import StorageLevel, cloudpickle, keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.ml.boosting import BINS, packed, profiles, thresholds
from plumbline.ml.votes import with_cell_scores

# Executors need not have this package: the functions travel with their tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Numbers in one piece of the sums that a task sends; the open nodes of a tree are cut into such pieces.
PIECE_NUMBERS = 500_000
#: Profiles in one block; each is looked at by every tree.
BLOCK_ROWS = 5_000
#: Rows of a profile up to which its draws are looked up in a table.
TABLE_ROWS = 500


class Tree:
    """Nodes as lists; a leaf has feature -1, the right child follows the left one, `sums` are the weights of the classes or
    the rows and the sum of their numbers."""

    def __init__(self):
        self.feature, self.last, self.left, self.gain, self.sums, self.open = [-1], [0], [0], [0.0], [None], [0]

    def shape(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        return np.array(self.feature, "int32"), np.array(self.last, "int32"), np.array(self.left, "int32"), self.open

    def split(self, node: int, feature: int, last: int, gain: float, sides: tuple[np.ndarray, np.ndarray]) -> list[int]:
        at = len(self.feature)
        self.feature[node], self.last[node], self.left[node], self.gain[node] = feature, last, at, gain
        for side in sides:
            for values, value in ((self.feature, -1), (self.last, 0), (self.left, 0), (self.gain, 0.0), (self.sums, side)):
                values.append(value)
        return [at, at + 1]

    def merged(self) -> None:
        """Leaves of one node with the same class become one; what they leave behind is dropped."""
        for node in reversed(range(len(self.feature))):
            a = self.left[node]
            if self.feature[node] >= 0 and self.feature[a] < 0 and self.feature[a + 1] < 0 and self.sums[a].argmax() == self.sums[a + 1].argmax():
                self.feature[node], self.gain[node] = -1, 0.0
        kept, at = [0], 0
        while at < len(kept):
            if self.feature[kept[at]] >= 0:
                kept += [self.left[kept[at]], self.left[kept[at]] + 1]
            at += 1
        place = {node: i for i, node in enumerate(kept)}
        self.left = [place[self.left[n]] if self.feature[n] >= 0 else 0 for n in kept]
        self.feature, self.last, self.gain, self.sums = ([values[n] for n in kept] for values in (self.feature, self.last, self.gain, self.sums))


def reached(feature: np.ndarray, last: np.ndarray, left: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The node in which each row ends."""
    at = np.zeros(len(bins), dtype="int32")
    rows = np.arange(len(bins))
    while len(rows):
        node = at[rows]
        f = feature[node]
        inner = f >= 0
        rows, node, f = rows[inner], node[inner], f[inner]
        at[rows] = left[node] + (bins[rows, f] > last[node])
    return at


def uniform(key: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A number between 0 and 1 for each key, by the finalizer of SplitMix64."""
    with np.errstate(over="ignore"):
        x = key + np.uint64((seed * 2**32 + tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)) * 2.0**-53


def drawn(trees: int, seed: int, block: tuple) -> tuple:
    """`(bins, class, draws of each tree)` of a block with the rows of each profile and its key: how often rows of it are drawn."""
    bins, label, n, key = block
    key, counts = key.view("uint64"), np.empty((trees, len(n)), dtype="uint32")
    order = np.argsort(n, kind="stable")
    sizes, starts = np.unique(n[order], return_index=True)
    for size, at in zip(sizes.tolist(), np.split(order, starts[1:])):
        if size > TABLE_ROWS:
            for i in at.tolist():
                counts[:, i] = np.random.Generator(np.random.Philox(key=[int(key[i]), seed])).poisson(size, trees)
            continue
        k = np.arange(1, size + 12 * ceil(sqrt(size)) + 30)
        share = np.exp(np.concatenate([[0.0], np.cumsum(np.log(size / k))]) - size).cumsum()
        for tree in range(trees):
            counts[tree, at] = np.searchsorted(share, uniform(key[at], seed, tree))
    return bins, label, counts


def subsets(seed: int, tree: int, depth: int, nodes: int, width: int, taken: int) -> np.ndarray:
    """The features that each open node may be split by, in order."""
    if taken >= width:
        return np.tile(np.arange(width), (nodes, 1))
    chosen = np.random.default_rng([seed, tree, depth]).random((nodes, width)).argsort(axis=1)[:, :taken]
    return np.sort(chosen, axis=1)


def piece_nodes(taken: int, deepest: int, kinds: int) -> int:
    """Open nodes of one piece."""
    return max(1, PIECE_NUMBERS // (taken * deepest * kinds))


def level_sums(trees: list[tuple], depth: int, seed: int, taken: int, deepest: int, classes: int, block: tuple) -> Iterator[tuple]:
    """((tree, first open node of the piece), places and values of the sums other than 0 by (feature taken, node, bin, class)); of
    numbers, rows and their sum."""
    bins, label, weights = block
    width, kinds = bins.shape[1], classes or 2
    step = piece_nodes(taken, deepest, kinds)
    for number, (feature, last, left, open_) in enumerate(trees):
        if not open_:
            continue
        w = weights[number]
        rows = np.flatnonzero(w)
        slot = np.full(len(feature), -1, dtype="int32")
        slot[open_] = np.arange(len(open_))
        at = slot[reached(feature, last, left, bins[rows])]
        rows, at = rows[at >= 0], at[at >= 0]
        features = subsets(seed, number, depth, len(open_), width, taken)
        for start in range(0, len(open_), step):
            size = min(step, len(open_) - start)
            inside = (at >= start) & (at < start + size)
            r, a = rows[inside], at[inside]
            if not len(r):
                continue
            cells, sums = size * deepest * kinds, []
            for j in range(taken):
                cell = ((a - start).astype("int64") * deepest + bins[r, features[a, j]]) * kinds
                if classes:
                    sums.append(np.bincount(cell + label[r], w[r], cells))
                else:
                    sums.append(np.bincount(cell, w[r], cells) + np.bincount(cell + 1, label[r], cells))
            sums = np.concatenate(sums)
            there = np.flatnonzero(sums)
            yield (number, start), (there.astype("int32"), sums[there])


def best_splits(seed: int, depth: int, width: int, taken: int, deepest: int, open_: list[int], classes: int, min_leaf: int, piece: tuple) -> tuple:
    """((tree, start), [(node, its sums, feature, last left bin, gain, sums on the left) or (node, its sums)])."""
    (number, start), parts = piece
    kinds = classes or 2
    size = min(piece_nodes(taken, deepest, kinds), open_[number] - start)
    sums = np.zeros(taken * size * deepest * kinds)
    for there, values in parts:
        sums[there] += values
    sums = sums.reshape(taken, size, deepest, kinds)
    features = subsets(seed, number, depth, open_[number], width, taken)
    found: list[tuple] = []
    rows = (lambda s: s.sum(axis=-1)) if classes else (lambda s: s[..., 0])
    square = (lambda s: (s**2).sum(axis=-1)) if classes else (lambda s: s[..., 1] ** 2)
    left = sums.cumsum(axis=2)
    whole = left[:, :, -1:]
    right, left = whole - left[:, :, :-1], left[:, :, :-1]
    a, b, n = rows(left), rows(right), rows(whole)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = square(left) / a + square(right) / b - square(whole) / n
        gain = np.where((a >= max(min_leaf, 1)) & (b >= max(min_leaf, 1)), gain, -1.0)
        # sums of numbers are equal up to their order only
        scale = square(whole) / n
        gain = np.where(gain > 1e-12 * np.maximum(scale, 1.0), gain, -1.0)
        gain = np.where(gain > 0, np.round(gain / np.maximum(scale, 1.0), 13) * np.maximum(scale, 1.0), gain)
    for i in range(sums.shape[1]):
        total = whole[0, i, 0]
        if not gain.shape[2] or gain[:, i].max() <= 0:
            found.append((start + i, total))
            continue
        j, last = np.unravel_index(int(gain[:, i].argmax()), gain[:, i].shape)
        found.append((start + i, total, int(features[start + i, j]), int(last), float(gain[j, i, last]), left[j, i, last]))
    return (number, start), found


class TreeVotes(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds `prediction`, and `probability` for classes, by the mean of trees; all its numbers are parameters."""

    features = Param(Params._dummy(), "features", "feature of each node, -1 at leaves", TypeConverters.toListInt)
    thresholds = Param(Params._dummy(), "thresholds", "largest value on the left of each node", TypeConverters.toListFloat)
    lefts = Param(Params._dummy(), "lefts", "left node of each node, inside its tree; the right one follows", TypeConverters.toListInt)
    values = Param(Params._dummy(), "values", "value of each leaf, or its shares of the classes, leaf by leaf", TypeConverters.toListFloat)
    sizes = Param(Params._dummy(), "sizes", "nodes of each tree", TypeConverters.toListInt)
    classes = Param(Params._dummy(), "classes", "number of classes, 0 for numbers", TypeConverters.toInt)

    @keyword_only
    def __init__(self, features=None, thresholds=None, lefts=None, values=None, sizes=None, classes=0):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        features, cuts, lefts, values, sizes, classes = (
            self.getOrDefault(p) for p in (self.features, self.thresholds, self.lefts, self.values, self.sizes, self.classes)
        )
        feature, cut, left = np.array(features), np.array(cuts), np.array(lefts, dtype="int32")
        inner = feature >= 0
        used = {int(f): np.unique(cut[feature == f]).tolist() for f in np.unique(feature[inner])}
        column, last = np.full(len(feature), -1, dtype="int32"), np.zeros(len(feature), dtype="int32")
        for i, (f, known) in enumerate(used.items()):
            there = feature == f
            column[there], last[there] = i, np.searchsorted(known, cut[there])
        outcome = np.zeros((len(feature), classes or 1))
        outcome[~inner] = np.array(values).reshape(-1, classes or 1)
        ends = np.cumsum(sizes).tolist()
        trees = [tuple(part[end - size : end] for part in (column, last, left, outcome)) for size, end in zip(sizes, ends)]

        def mean(cells: np.ndarray) -> np.ndarray:
            total = np.zeros((len(cells), classes or 1))
            for column, last, left, outcome in trees:
                total += outcome[reached(column, last, left, cells)]
            return total / len(trees)

        scored = with_cell_scores(dataset, "_votes", "features", used, mean)
        if not classes:
            return scored.withColumn("prediction", F.col("_votes")[0]).drop("_votes")
        pick = (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double")
        return scored.withColumn("prediction", pick).withColumn("probability", array_to_vector("_votes")).drop("_votes")


class Forest(PipelineModel):
    """The scoring stage, and what each feature gained."""

    slot_weights: np.ndarray


def grown(
    df: DataFrame, width: int, classes: int, trees: int = 1, max_depth: int = 10, min_leaf: int = 1, bootstrap: bool = False, seed: int = 42, bins: int = BINS
) -> Forest:
    """One tree of all rows and features, or trees of drawn rows, each node with the root of the features; `classes` is 0 for numbers.

    Numbers are not drawn: the sum of drawn numbers does not follow from how many rows of a profile are drawn.
    """
    if trees < 1 or not 0 <= max_depth <= 30 or min_leaf < 1 or (bootstrap and not classes):
        raise ValueError("a forest needs a tree, a depth of 0 to 30 and a row a leaf; numbers are not drawn")
    cuts = thresholds(df, width, bins, rare=True)
    deepest = max(map(len, cuts), default=0) + 1
    table = profiles(df, cuts, numbers=not classes)
    if classes:
        table = table.select("bins", "label", "n", F.xxhash64("bins", "label").alias("key"))
        kept = packed(table, BLOCK_ROWS)
        weighted = partial(drawn, trees, seed) if bootstrap else (lambda block: (block[0], block[1], block[2][None, :]))
    else:
        kept = packed(table.select("bins", "y", "n"), BLOCK_ROWS)
        weighted = lambda block: (block[0], block[1], block[2][None, :])
    state = kept.map(weighted).persist(StorageLevel.MEMORY_AND_DISK)
    taken = ceil(sqrt(width)) if bootstrap else width
    grove = [Tree() for _ in range(trees)]
    for depth in range(max_depth + 1):
        # a root that can't be split still needs its sums
        if depth == max_depth and depth:
            break
        if not any(tree.open for tree in grove):
            break
        pieces = state.flatMap(partial(level_sums, [t.shape() for t in grove], depth, seed, taken, deepest, classes)).groupByKey()
        sizes = [len(t.open) for t in grove]
        done = sorted(pieces.map(partial(best_splits, seed, depth, width, taken, deepest, sizes, classes, min_leaf)).collect(), key=lambda piece: piece[0])
        fresh: list[list[int]] = [[] for _ in grove]
        for (number, _), found in done:
            tree = grove[number]
            for slot, total, *split in found:
                node = tree.open[slot]
                tree.sums[node] = total
                if split and max_depth:
                    feature, last, gain, low = split
                    fresh[number] += tree.split(node, feature, last, gain, (low, total - low))
        for tree, nodes in zip(grove, fresh):
            tree.open = nodes
    state.unpersist()
    kept.unpersist()
    gained = np.zeros(width)
    grove = [tree for tree in grove if tree.sums[0] is not None]  # a tree may have drawn no row
    if not grove:
        raise ValueError("no tree has drawn a row")
    for tree in grove:
        if classes:
            tree.merged()
        own = np.bincount([f for f in tree.feature if f >= 0], [g for f, g in zip(tree.feature, tree.gain) if f >= 0], width)
        gained += own / own.sum() if own.sum() > 0 else own
    nodes = [(tree, i) for tree in grove for i in range(len(tree.feature))]
    ends = [tree.sums[i] for tree, i in nodes if tree.feature[i] < 0]
    values = [float(x) for s in ends for x in (s / s.sum() if classes else [s[1] / s[0]])]
    stage = TreeVotes(
        features=[tree.feature[i] for tree, i in nodes],
        thresholds=[cuts[tree.feature[i]][tree.last[i]] if tree.feature[i] >= 0 else 0.0 for tree, i in nodes],
        lefts=[tree.left[i] for tree, i in nodes],
        values=values,
        sizes=[len(tree.feature) for tree in grove],
        classes=classes,
    )
    model = Forest([stage])
    model.slot_weights = gained
    return model
