"""Scores of models that only compare features with thresholds.

Rows between the same thresholds have the same scores, so a batch is cut into cells and each cell is scored once.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Executors need not have this package: the functions travel with their tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Cells whose scores a task remembers.
REMEMBERED = 100_000
#: Cells up to which all scores are computed beforehand, so that rows need no Python.
GRID_CELLS = 8192


def cells_of(x: np.ndarray, cuts: dict[int, np.ndarray]) -> np.ndarray:
    """How many thresholds of each feature lie below each row's value, a column a feature; NaN is above all."""
    return np.array([np.searchsorted(c, x[:, f]) for f, c in cuts.items()], dtype="int64").reshape(len(cuts), len(x)).T


def cell_scores(features: str, thresholds: dict[int, Sequence[float]], evaluate: Callable[[np.ndarray], np.ndarray]) -> Column:
    """`evaluate`, from cells (rows x the features of `thresholds`) to scores (rows x any), as an array for each row."""
    cuts = {f: np.array(c, dtype=float) for f, c in thresholds.items()}
    sizes = [len(c) + 1 for c in cuts.values()]
    # one number a cell, unless there are too many to count
    countable = float(np.prod(np.array(sizes, dtype=float))) < 2**62
    steps = np.cumprod([1, *sizes[:-1]], dtype="int64") if countable and sizes else np.array([], dtype="int64")

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[int, np.ndarray] = {}
        for x in batches:
            if not len(x):
                yield pd.Series([], dtype=object)
                continue
            cells = cells_of(np.stack(x.to_numpy()), cuts)
            if not countable:
                _, first, back = np.unique(cells, axis=0, return_index=True, return_inverse=True)
                yield pd.Series(list(evaluate(cells[first])[back.ravel()]))
                continue
            number, first, back = np.unique(cells @ steps, return_index=True, return_inverse=True)
            fresh = [i for i, k in enumerate(number.tolist()) if k not in known]
            if fresh:
                if len(known) + len(fresh) > REMEMBERED:
                    known, fresh = {}, list(range(len(number)))
                known.update(zip(number[fresh].tolist(), evaluate(cells[first[fresh]])))
            yield pd.Series(list(np.array([known[k] for k in number.tolist()])[back]))

    return score(vector_to_array(features))


def _cell_number(x: Column, cuts: Sequence[float], low: int, high: int) -> Column:
    """How many of the sorted `cuts` lie below `x`, by halving."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(x > cuts[middle], _cell_number(x, cuts, middle + 1, high)).otherwise(_cell_number(x, cuts, low, middle))


def with_cell_scores(df: DataFrame, name: str, features: str, thresholds: dict[int, Sequence[float]], evaluate: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """`df` with `cell_scores` as a column; those of a small grid are a table inside the plan."""
    sizes = [len(c) + 1 for c in thresholds.values()]
    if np.prod(np.array(sizes, dtype=float)) > GRID_CELLS:
        return df.withColumn(name, cell_scores(features, thresholds, evaluate))
    grid = np.indices(sizes).reshape(len(sizes), -1).T if sizes else np.zeros((1, 0), dtype="int64")
    table = F.from_json(F.lit(json.dumps(evaluate(grid).tolist())), "array<array<double>>")
    placed = df.withColumn("_x", vector_to_array(features))
    number = F.lit(0)
    for (feature, cuts), size in zip(thresholds.items(), sizes):
        number = number * size + _cell_number(F.col("_x")[feature], [float(c) for c in cuts], 0, len(cuts))
    return placed.withColumn("_cell", number).withColumn(name, table[F.col("_cell")]).drop("_x", "_cell")
