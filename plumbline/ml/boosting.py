"""Multi-class boosting of stumps over histograms.

Features are cut into bins once; rows with equal bins and label are one profile with a count, as boosting never tells
them apart.  The profiles are kept as arrays, a block a task.  A round is one job: each task lifts its weights by the
stumps so far and sums them over (feature, bin, label), and the best stump is read from the total; no tree is grown on
rows.  The driver sees features x bins x labels numbers a round, whatever the rows.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from math import exp, log

import numpy as np
from pyspark import RDD, StorageLevel, cloudpickle, keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.ml.votes import cell_scores
from plumbline.session import checkpoint_dir

# Executors need not have this package: the functions of the rounds travel with their tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 32
#: Quantiles asked for in one aggregate.
SLOTS_AT_A_TIME = 200
#: Profiles in one partition of the kept table.
ROWS_PER_TASK = 20_000


@dataclass(frozen=True)
class Stump:
    """Rows whose feature is at most the threshold are `left`, others `right`."""

    feature: int
    threshold: float
    left: int
    right: int


def thresholds(df: DataFrame, width: int, bins: int = BINS, rare: bool = False) -> list[list[float]]:
    """The cuts of each feature: quantiles below its largest value.

    With `rare`, the values of a feature that has few are all cuts, down to those of one row in 32 x `bins`.
    """
    finer = 32 if rare else 1
    # as text: a literal made in Python is a call each
    shares = ", ".join(f"{i / (bins * finer)!r}D" for i in range(bins * finer))
    values = df.select(vector_to_array("features").alias("v"))
    out: list[list[float]] = []
    for start in range(0, width, SLOTS_AT_A_TIME):
        slots = range(start, min(width, start + SLOTS_AT_A_TIME))
        row = values.agg(*[x for i in slots for x in (F.expr(f"percentile_approx(v[{i}], array({shares}))"), F.max(F.col("v")[i]))]).first()
        for j in range(len(slots)):
            found = [q for q in row[2 * j] or [] if q < row[2 * j + 1]]
            out.append(sorted(set(found) if len(set(found)) < bins else set(found[::finer])))
    return out


def profiles(df: DataFrame, cuts: list[list[float]], numbers: bool = False) -> DataFrame:
    """(bins, label, n): how many rows share their bins and label; of `numbers` (bins, n, y), the rows and the sum of their labels."""
    table = F.from_json(F.lit(json.dumps(cuts)), "array<array<double>>")
    binned = F.zip_with(vector_to_array("features"), table, lambda x, c: F.size(F.filter(c, lambda t: x > t)))
    if numbers:
        return df.select(binned.alias("bins"), "label").groupBy("bins").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y"))
    return df.select(binned.alias("bins"), F.col("label").cast("int").alias("label")).groupBy("bins", "label").agg(F.count(F.lit(1)).alias("n"))


def blocks(table: DataFrame) -> RDD:
    """Each task's rows as arrays, a tuple of them in the order of the columns; `bins` comes first."""

    def pack(rows: Iterator) -> Iterator[tuple]:
        columns = list(zip(*sorted(map(tuple, rows))))  # sums repeat: the shuffle leaves the order open
        if columns:
            yield (np.array(columns[0], dtype="int16").reshape(len(columns[1]), -1), *map(np.array, columns[1:]))

    return table.rdd.mapPartitions(pack)


def packed(table: DataFrame, rows: int = ROWS_PER_TASK) -> RDD:
    """The blocks of profiles, about `rows` in each."""
    table = table.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        kept = blocks(table.coalesce(max(1, table.count() // rows))).persist(StorageLevel.MEMORY_AND_DISK)
        if not kept.count():
            kept.unpersist()
            raise ValueError("there are no rows to learn from")
        return kept
    finally:
        table.unpersist()


def lifted(moves: list[tuple], block: tuple) -> tuple:
    """A block `(bins, label, n, power)` after the rounds of `moves`; a weight is exp(power)."""
    bins, label, n, power = block
    for feature, last, left, right, lift, mean in moves:
        power = power + lift * (np.where(bins[:, feature] <= last, left, right) != label) - mean
    return bins, label, n, power


def label_sums(moves: list[tuple], deepest: int, classes: int, block: tuple) -> np.ndarray:
    """Weights by (feature, bin, label)."""
    bins, label, n, power = lifted(moves, block)
    weight = n * np.exp(power)
    cells = deepest * classes
    sums = [np.bincount(b.astype("int64") * classes + label, weight, cells) for b in bins.T]
    return np.array(sums).reshape(-1, deepest, classes)


def best_stump(sums: np.ndarray, cuts: list[list[float]]) -> tuple[Stump, int, float]:
    """From weights by (feature, bin, label): the stump of least Gini impurity, its last left bin, and its error."""
    total = sums[0].sum(axis=0)
    whole = total.sum()
    left = sums.cumsum(axis=1)[:, :-1]
    right = total - left
    a, b = left.sum(axis=2), right.sum(axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        purity = (left**2).sum(axis=2) / a + (right**2).sum(axis=2) / b
    purity = np.where((a > 1e-12 * whole) & (b > 1e-12 * whole), np.round(purity / whole, 12), -1.0)
    if not purity.size or purity.max() < 0:  # all rows alike
        most = int(total.argmax())
        return Stump(0, 0.0, most, most), sums.shape[1], float(1 - total[most] / whole)
    f, cut = np.unravel_index(int(purity.argmax()), purity.shape)
    one, two = left[f, cut], right[f, cut]
    return Stump(int(f), cuts[f][cut], int(one.argmax()), int(two.argmax())), int(cut), float(1 - (one.max() + two.max()) / whole)


class StumpVotes(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds `prediction` and `probability` by the weighted votes of stumps; all its numbers are parameters."""

    slots = Param(Params._dummy(), "slots", "feature of each stump", TypeConverters.toListInt)
    thresholds = Param(Params._dummy(), "thresholds", "largest value on the left of each stump", TypeConverters.toListFloat)
    sides = Param(Params._dummy(), "sides", "classes on the left and right of each stump, left ones first", TypeConverters.toListInt)
    weights = Param(Params._dummy(), "weights", "weight of each stump", TypeConverters.toListFloat)
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)

    @keyword_only
    def __init__(self, slots=None, thresholds=None, sides=None, weights=None, classes=2):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        slots, cuts, sides, weights, k = (self.getOrDefault(p) for p in (self.slots, self.thresholds, self.sides, self.weights, self.classes))
        n, whole = len(slots), sum(weights)
        used = {f: sorted({t for g, t in zip(slots, cuts) if g == f}) for f in sorted(set(slots))}
        column = {f: i for i, f in enumerate(used)}
        rules = [(column[f], used[f].index(t), left, right, w / whole) for f, t, left, right, w in zip(slots, cuts, sides[:n], sides[n:], weights)]

        def votes(cells: np.ndarray) -> np.ndarray:
            out = np.zeros((len(cells), k))
            for at, last, left, right, w in rules:
                out[np.arange(len(cells)), np.where(cells[:, at] <= last, left, right)] += w
            return out

        voted = dataset.withColumn("_votes", cell_scores("features", used, votes))
        pick = (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double")
        return voted.withColumn("prediction", pick).withColumn("probability", array_to_vector("_votes")).drop("_votes")


class BoostedStumps(PipelineModel):
    """The voting stage, and how often each feature was cut."""

    slot_weights: np.ndarray


def boosted_stumps(df: DataFrame, width: int, classes: int, rounds: int, learning_rate: float = 1.0, checkpoint_every: int = 20, bins: int = BINS) -> BoostedStumps:
    """Exponential reweighting of misses; stops when no stump is better than chance, or one has no error."""
    checkpoint_dir(df.sparkSession)
    cuts = thresholds(df, width, bins)
    deepest = max(map(len, cuts), default=0) + 1
    kept = packed(profiles(df, cuts))
    state = kept.map(lambda block: (*block, np.zeros(len(block[1]))))
    held, moves, votes, chosen, rows = [state.persist(StorageLevel.MEMORY_AND_DISK)], [], {}, np.zeros(width), None
    for i in range(rounds):
        sums = held[-1].map(partial(label_sums, list(moves), deepest, classes)).treeReduce(np.add)
        for old in held[:-1]:
            old.unpersist()
        held = held[-1:]
        total = float(sums[0].sum())
        rows = total if rows is None else rows
        stump, last, error = best_stump(sums, cuts)
        if error >= 1 - 1 / classes:
            break
        alpha = learning_rate * (log(max(1 - error, 1e-10) / max(error, 1e-10)) + log(classes - 1))
        votes[stump] = votes.get(stump, 0.0) + alpha
        chosen[stump.feature] += 1
        if error <= 1e-12:
            break
        # weights average 1, so they neither vanish nor overflow over many rounds
        lift = min(alpha, 60.0)
        mean = total * (1 - error + error * exp(lift)) / rows
        moves.append((stump.feature, last, stump.left, stump.right, lift, log(mean)))
        if (i + 1) % checkpoint_every == 0:
            held.append(held[-1].map(partial(lifted, moves)).persist(StorageLevel.MEMORY_AND_DISK))
            held[-1].checkpoint()
            moves = []
    for old in [kept, *held]:
        old.unpersist()
    if not votes:
        raise ValueError("no stump is better than chance")
    stumps = list(votes)
    stage = StumpVotes(slots=[s.feature for s in stumps], thresholds=[s.threshold for s in stumps], sides=[s.left for s in stumps] + [s.right for s in stumps], weights=list(votes.values()), classes=classes)
    model = BoostedStumps([stage])
    model.slot_weights = chosen
    return model
