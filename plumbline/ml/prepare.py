"""Model preparation: impute, scale and encode, learned from the training part only.

What is learned is a few numbers per column; it becomes literals in a saved pipeline, so
applying it is one projection and one vector assembly.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import sqrt

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expr import quoted
from plumbline.functions.typing import columns_of, normalised, numeric_columns
from plumbline.operators.quantiles import column_quantiles
from plumbline.operators.stats import value_frequencies

# Most levels a text feature may have, and the fill of an all-null text feature.
MAX_LEVELS = 50
NO_MODE = "unknown"
SURE_FACTOR = 4


def _name(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _text(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def low_cardinality(df: DataFrame, columns: Sequence[str], limit: int = MAX_LEVELS) -> list[str]:
    """Columns with at most `limit` distinct values.

    A sketch drops the clearly crowded ones first, so long texts are never grouped; the
    others are counted exactly.
    """
    columns = list(columns)
    if not columns:
        return []
    guess = df.agg(*[F.approx_count_distinct(quoted(c)).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    near = [c for i, c in enumerate(columns) if guess[f"d{i}"] <= limit * SURE_FACTOR]
    if not near:
        return []
    freq = value_frequencies(df, near).filter(F.col("value").isNotNull())
    kept = {r["column"] for r in freq.groupBy("column").count().filter(F.col("count") <= limit).collect()}
    # a column of nulls only has no level, hence stays
    some = {r["column"] for r in freq.select("column").distinct().collect()}
    return [c for c in near if c in kept or c not in some]


@dataclass
class Preparation:
    """Learned fills, scales and levels."""

    numeric: dict[str, tuple[float, float, float]]  # median, mean, population deviation (after filling)
    texts: dict[str, tuple[str, list[str]]]  # mode, sorted levels

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.texts]

    def filled_and_scaled(self, df: DataFrame) -> DataFrame:
        """The numeric part as columns `<name>_scaled`, for inspection."""
        return SQLTransformer(statement=self._statement()).transform(df)

    def _statement(self) -> str:
        parts = ["*"]
        for c, (median, mean, std) in self.numeric.items():
            x = f"nullif(cast({_name(c)} as double), double('NaN'))"
            parts.append(f"(coalesce({x}, {median!r}D) - {mean!r}D) / {std!r}D AS {_name(c + '_scaled')}")
        for c, (mode, _) in self.texts.items():
            parts.append(f"coalesce(cast({_name(c)} as string), {_text(mode)}) AS {_name(c + '_text')}")
        return f"SELECT {', '.join(parts)} FROM __THIS__"

    def model(self, df: DataFrame) -> PipelineModel:
        """The preparation as a saveable pipeline producing `features`."""
        stages = [SQLTransformer(statement=self._statement())]
        inputs = [c + "_scaled" for c in self.numeric]
        encoded = [c for c, (_, levels) in self.texts.items() if levels]
        if encoded:
            # one indexer per column: label lists of different length cannot share one
            for c in encoded:
                index = StringIndexerModel.from_labels(
                    self.texts[c][1], inputCol=c + "_text", outputCol=c + "_index", handleInvalid="keep"
                )
                stages.append(index)
            # the dropped last slot is the bucket of unseen levels, which so encode as all zeros
            hot = OneHotEncoder(inputCols=[c + "_index" for c in encoded], outputCols=[c + "_hot" for c in encoded], dropLast=True)
            stages.append(hot.fit(PipelineModel(stages).transform(df.limit(0))))
            inputs += [c + "_hot" for c in encoded]
        stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
        return PipelineModel(stages)

    def slots(self) -> list[tuple[str, str]]:
        """`(encoded name, source column)` of every position of the feature vector."""
        out = [(c, c) for c in self.numeric]
        for c, (_, levels) in self.texts.items():
            out += [(f"{c}={level}", c) for level in levels]
        return out


def fit_preparation(df: DataFrame, target: str, features: Sequence[str] | None = None, exact: bool = True) -> Preparation:
    """Learn medians, modes, means, deviations and levels from `df` (the training part).

    Datetime columns and texts with more than 50 levels are left out.
    """
    df = normalised(df)
    skip = [target]
    chosen = set(features) if features is not None else set(df.columns)
    numeric = [c for c in numeric_columns(df, exclude=skip) if c in chosen]
    texts = [c for c in columns_of(df, "categorical", "boolean", exclude=skip) if c in chosen]
    texts = low_cardinality(df, texts)
    exprs = [F.count("*").alias("rows")]
    for i, c in enumerate(numeric):
        x = quoted(c).cast("double")
        exprs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    row = df.agg(*exprs).first()
    medians = column_quantiles(df, numeric, (0.5,), exact)
    learned = {}
    for i, c in enumerate(numeric):
        n, total = row[f"n{i}"], row["rows"]
        if not n:
            continue  # nothing to learn from an empty column
        mean, var, median = row[f"m{i}"], row[f"v{i}"], medians[c][0]
        gaps = total - n
        filled = (n * mean + gaps * median) / total
        spread = (n * (var + (mean - filled) ** 2) + gaps * (median - filled) ** 2) / total
        learned[c] = (median, filled, sqrt(spread) if spread > 0 else 1.0)
    levels: dict[str, list[tuple[str, int]]] = {c: [] for c in texts}
    if texts:
        for r in value_frequencies(df, texts).filter(F.col("value").isNotNull()).collect():  # at most 50 per column
            levels[r["column"]].append((r["value"], r["n"]))
    kept = {}
    for c, found in levels.items():
        mode = min(found, key=lambda f: (-f[1], f[0]))[0] if found else NO_MODE
        kept[c] = (mode, sorted(v for v, _ in found))
    if not learned and not any(v[1] for v in kept.values()):
        raise ValueError("no usable features")
    return Preparation(learned, kept)


def label_levels(df: DataFrame, target: str, limit: int = 10_000) -> list[str]:
    """Sorted distinct labels as text."""
    rows = df.select(quoted(target).cast("string").alias("v")).filter(F.col("v").isNotNull()).distinct().orderBy("v").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"target '{target}' has more than {limit} classes")
    return [r["v"] for r in rows]


def encode_label(df: DataFrame, target: str, labels: Sequence[str] | None) -> DataFrame:
    """Adds `label`: the position of the class in sorted order, or the number itself for regression."""
    if labels is None:
        return df.withColumn("label", quoted(target).cast("double"))
    index = StringIndexerModel.from_labels(list(labels), inputCol="__label_text", outputCol="label", handleInvalid="error")
    return index.transform(df.withColumn("__label_text", quoted(target).cast("string"))).drop("__label_text")


def decode_label(column: str, labels: Sequence[str]):
    """Class text of a predicted position."""
    return F.array(*[F.lit(x) for x in labels])[F.col(column).cast("int")]


def dummy_encode(df: DataFrame, target: str, exact: bool = True) -> DataFrame:
    """Numeric columns filled by their median, then one 0/1 column per text level, the first level left out."""
    df = normalised(df)
    numeric = numeric_columns(df, exclude=[target])
    texts = low_cardinality(df, columns_of(df, "categorical", "boolean", exclude=[target]))
    medians = column_quantiles(df, numeric, (0.5,), exact)
    out = [F.coalesce(quoted(c).cast("double"), F.lit(medians[c][0] if medians[c] else None)).alias(c) for c in numeric]
    if texts:
        levels: dict[str, list[str]] = {c: [] for c in texts}
        for r in value_frequencies(df, texts).filter(F.col("value").isNotNull()).select("column", "value").collect():
            levels[r["column"]].append(r["value"])
        for c in texts:
            for level in sorted(levels[c])[1:]:
                hit = F.coalesce(quoted(c).cast("string") == level, F.lit(False))
                out.append(hit.cast("int").alias(f"{c}_{level}"))
    return df.select(*out, quoted(target))
