"""Explanations: exact Shapley values of linear models, sampled Shapley values and local surrogates of any model.

Perturbed rows are built by joins and explodes, scored in one pass of the pipeline, and
regrouped by key.  Their number is instances x samples x features, all chosen by the caller.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.expr import quoted
from plumbline.functions.typing import normalised, numeric_columns
from plumbline.operators.registry import align_features
from plumbline.operators.split import sample_rows
from plumbline.session import bounded_broadcast
from plumbline.sources.bundles import ModelBundle

TOP_CONTRIBUTIONS = 10


def linear_contributions(df: DataFrame, key: str, coefficients: dict[str, float]) -> DataFrame:
    """`(key, feature, contribution)`: coef * (x - mean x), the exact Shapley values of a linear model.

    The means come from one aggregate; the rest is a projection.  Missing values count as the mean.
    """
    df = normalised(df)
    names = list(coefficients)
    row = df.agg(*[F.avg(quoted(c).cast("double")).alias(f"m{i}") for i, c in enumerate(names)]).first()
    parts = []
    for i, c in enumerate(names):
        mean = row[f"m{i}"] or 0.0
        centred = F.coalesce(quoted(c).cast("double"), F.lit(mean)) - F.lit(mean)
        parts.append(F.struct(F.lit(c).alias("feature"), (centred * F.lit(float(coefficients[c]))).alias("contribution")))
    return df.select(quoted(key), F.inline(F.array(*parts)))


def global_importance(local: DataFrame) -> DataFrame:
    """`(feature, mean_abs_contribution, rank)` over all explained rows."""
    per = local.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))
    # one row per feature
    return per.withColumn("rank", F.row_number().over(W.orderBy(F.col("mean_abs_contribution").desc(), "feature")))


def rank_local(local: DataFrame, key: str) -> DataFrame:
    """Adds size, direction and the rank of each contribution inside its row."""
    order = W.partitionBy(quoted(key)).orderBy(F.abs("contribution").desc(), "feature")
    return local.select(
        "*",
        F.abs("contribution").alias("abs_contribution"),
        F.when(F.col("contribution") >= 0, "positive").otherwise("negative").alias("direction"),
        F.row_number().over(order).alias("rank"),
    )


def signed_top(local: DataFrame, key: str, k: int = TOP_CONTRIBUTIONS) -> DataFrame:
    """Top k positive and top k negative contributions of each row."""
    signed = local.withColumn("direction", F.when(F.col("contribution") >= 0, "positive").otherwise("negative"))
    order = W.partitionBy(quoted(key), "direction").orderBy(F.abs("contribution").desc(), "feature")
    return signed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def model_output(scored: DataFrame, bundle: ModelBundle, positive: int | None = None) -> Column:
    """The number that is explained: the prediction, or the probability of one class (the last by default)."""
    if bundle.task == "regression":
        return F.col("prediction").cast("double")
    at = len(bundle.labels) - 1 if positive is None else positive
    if "probability" in scored.columns:
        return vector_to_array("probability")[at]
    return (F.col("prediction") == at).cast("double")


def sampled_shapley(
    instances: DataFrame,
    background: DataFrame,
    bundle: ModelBundle,
    key: str,
    background_key: str,
    permutations: int = 20,
    positive: int | None = None,
    seed: int = 42,
    max_instances: int | None = None,
) -> DataFrame:
    """`(key, feature, contribution, base_value)` by permutation sampling.

    For each instance and each sampled permutation, one background row is turned into the
    instance feature by feature; a feature's contribution is the mean change of the output
    at its step.  Contributions of a row sum to its output minus `base_value` exactly.
    """
    names = [f for f, _ in bundle.features]
    d = len(names)
    spark = instances.sparkSession
    # feature columns a table lacks count as missing
    instances, background = (align_features(t, [(k, dict(t.dtypes)[k]), *bundle.features]) for t, k in ((instances, key), (background, background_key)))
    chosen = instances if max_instances is None else sample_rows(instances, key, max_instances)
    # `permutations` background rows, one per permutation: a small table by construction
    drawn = sample_rows(background, background_key, permutations)
    ground = drawn.select(
        (F.row_number().over(W.orderBy(quoted(background_key))) - 1).alias("perm"),
        F.struct(*[quoted(n).cast(t).alias(n) for n, t in bundle.features]).alias("ground"),
    )
    rng = np.random.default_rng(seed)
    # position of every feature in each permutation; row k of a walk has the first k features replaced
    ranks = spark.createDataFrame([(i, [int(p) for p in rng.permutation(d)]) for i in range(permutations)], "perm int, at array<int>")
    plan = ranks.join(F.broadcast(ground), "perm")
    subject = F.struct(*[quoted(n).cast(t).alias(n) for n, t in bundle.features]).alias("subject")
    walks = chosen.select(quoted(key).alias("__key"), subject, F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("perm"))
    steps = walks.join(F.broadcast(plan), "perm").select("*", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("step"))
    mixed = steps.select(
        "__key",
        "perm",
        "at",
        "step",
        *[F.when(F.col("at")[i] < F.col("step"), F.col("subject")[n]).otherwise(F.col("ground")[n]).alias(n) for i, n in enumerate(names)],
    )
    scored = bundle.pipeline.transform(mixed)
    # the rows of an instance lie together, so its sums are one row a task before the shuffle: the step at which a feature is
    # replaced adds its output, and the step before takes its own away
    out = model_output(scored, bundle, positive)
    first = F.when(F.col("step") == 0, F.col("__out"))
    moved = [F.when(F.col("at")[i] == F.col("step") - 1, F.col("__out")).when(F.col("at")[i] == F.col("step"), -F.col("__out")) for i in range(d)]
    sums = scored.select("__key", "at", "step", out.alias("__out")).groupBy("__key").agg(
        F.count(first).alias("walks"), F.avg(first).alias("base_value"), *[F.sum(m).alias(f"sum{i}") for i, m in enumerate(moved)]
    )
    parts = [F.struct(F.lit(n).alias("feature"), (F.col(f"sum{i}") / F.col("walks")).alias("contribution")) for i, n in enumerate(names)]
    return sums.filter(F.col("__key").isNotNull()).select(F.col("__key").alias(key), "base_value", F.inline(F.array(*parts))).select(
        quoted(key), "feature", "contribution", "base_value"
    )


#: Cells of the unit interval by which a draw finds its level.
CELLS = 1024


def _level_bounds(background: DataFrame, column: str) -> DataFrame:
    """`(level, low, high, cell)`: every level's part of the unit interval, commonest first, cut into cells.

    One row for each level and each cell that it reaches into.
    """
    counts = background.filter(quoted(column).isNotNull()).select(quoted(column).cast("string").alias("level")).groupBy("level").count()
    ahead = W.orderBy(F.col("count").desc(), "level")
    shares = counts.select(
        "level",
        F.coalesce(F.sum("count").over(ahead.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("count").over(ahead.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("upto"),
        F.sum("count").over(W.partitionBy()).alias("all"),
    )
    bounds = shares.select("level", (F.col("before") / F.col("all")).alias("low"), (F.col("upto") / F.col("all")).alias("high"))
    last = F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1))
    return bounds.select("*", F.explode(F.sequence(F.floor(F.col("low") * CELLS), last)).alias("cell"))


def _drawn_level(rows: DataFrame, bounds: DataFrame, u: Column, name: str) -> DataFrame:
    """`rows` with the level in whose part of the unit interval `u` falls; null if there is no level."""
    placed = rows.withColumn("__u", u).withColumn("__cell", F.floor(F.col("__u") * CELLS))
    inside = (F.col("__cell") == F.col("cell")) & (F.col("__u") >= F.col("low")) & (F.col("__u") < F.col("high"))
    return placed.join(bounds, inside, "left").withColumn(name, F.col("level")).drop("__u", "__cell", "level", "low", "high", "cell")


def local_surrogate(
    instances: DataFrame,
    background: DataFrame,
    bundle: ModelBundle,
    key: str,
    samples: int = 500,
    top: int = 12,
    override: dict | None = None,
    positive: int | None = None,
    seed: int = 42,
    max_instances: int | None = None,
) -> DataFrame:
    """`(key, feature, weight, abs_weight, direction, rank)` of a weighted linear fit around each instance.

    Numeric features are perturbed by their spread, text ones switched to a draw from the
    background's levels.  The fit uses standardised offsets (numeric) and same-as-instance
    indicators (text), with an exponential kernel; the normal equations are summed per
    instance by `groupBy`, and one small solve per instance finishes.
    """
    names = [f for f, _ in bundle.features]
    types = dict(bundle.features)
    background = normalised(align_features(background, bundle.features))
    instances = align_features(instances, [(key, dict(instances.dtypes)[key]), *bundle.features])
    numbers = [n for n in numeric_columns(background) if n in types]
    texts = [n for n in names if n not in numbers]
    stats = background.agg(
        *[F.stddev_pop(quoted(n).cast("double")).alias(f"s{i}") for i, n in enumerate(numbers)],
        *[F.avg(quoted(n).cast("double")).alias(f"m{i}") for i, n in enumerate(numbers)],
    ).first() if numbers else {}
    spread = {n: (stats[f"s{i}"] or 1.0) for i, n in enumerate(numbers)}
    centre = {n: (stats[f"m{i}"] or 0.0) for i, n in enumerate(numbers)}
    # levels are few, and drawn rows must not be shuffled by cell
    pools = {n: bounded_broadcast(_level_bounds(background, n)) for n in texts}
    chosen = instances if max_instances is None else sample_rows(instances, key, max_instances)
    for c, v in (override or {}).items():
        if c in types:
            chosen = chosen.withColumn(c, F.lit(v).cast(types[c]))
    rows = chosen.select(quoted(key).alias("__key"), *[quoted(n).cast(types[n]).alias(n) for n in names]).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(samples))).alias("__draw")
    )
    # draws follow (key, draw, feature), so they do not depend on partitioning
    uniform = lambda tag: (F.pmod(F.xxhash64("__key", "__draw", F.lit(f"{seed}-{tag}")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    columns, offsets = [], []
    for n in numbers:
        normal = F.sqrt(-2 * F.ln(uniform(n + "-r"))) * F.cos(2 * np.pi * uniform(n + "-a"))
        start = F.coalesce(quoted(n).cast("double"), F.lit(centre[n]))
        z = F.when(F.col("__draw") == 0, 0.0).otherwise(normal)
        columns.append((start + z * F.lit(spread[n])).cast(types[n]).alias(n))
        offsets.append(z)
    drawn = rows
    for i, n in enumerate(texts):
        drawn = _drawn_level(drawn, pools[n], uniform(n + "-t"), f"__level{i}")
        value = F.when(F.col("__draw") == 0, quoted(n).cast("string")).otherwise(F.coalesce(f"__level{i}", F.lit("")))
        columns.append(value.cast(types[n]).alias(n))
        offsets.append((value == quoted(n).cast("string")).cast("double"))
    order = numbers + texts
    perturbed = drawn.select("__key", "__draw", F.array(*[F.coalesce(o, F.lit(0.0)) for o in offsets]).alias("__z"), *columns)
    scored = bundle.pipeline.transform(perturbed)
    flat = np.array([0.0] * len(numbers) + [1.0] * len(texts))
    origin = F.array(*[F.lit(float(v)) for v in flat])
    distance = F.aggregate(F.zip_with("__z", origin, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)
    width = 0.75 * float(np.sqrt(len(order)))
    ready = scored.select("__key", "__z", model_output(scored, bundle, positive).alias("__y"), F.exp(-distance / (2 * width * width)).alias("__w"))
    # normal equations: the upper triangle per instance, combined per task before the shuffle
    padded = ready.select("__key", "__y", "__w", F.concat(F.array(F.lit(1.0)), "__z").alias("x"))
    d = len(order) + 1
    sums = padded.groupBy("__key").agg(
        F.array(*[F.sum(F.col("__w") * F.col("x")[i] * F.col("x")[j]) for i in range(d) for j in range(i, d)]).alias("a"),
        F.array(*[F.sum(F.col("__w") * F.col("x")[i] * F.col("__y")) for i in range(d)]).alias("b"),
    )

    @F.pandas_udf("array<double>")
    def solve(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for left, right in zip(a, b):
            m = np.zeros((d, d))
            m[np.triu_indices(d)] = left
            m = m + np.triu(m, 1).T + 1e-6 * np.eye(d)
            out.append(np.linalg.solve(m, np.array(right, dtype=float))[1:])
        return pd.Series(out)

    weights = sums.select("__key", F.posexplode(solve("a", "b")).alias("i", "contribution"))
    labelled = weights.select(F.col("__key").alias(key), F.array(*[F.lit(n) for n in order])[F.col("i")].alias("feature"), "contribution")
    ranked = rank_local(labelled, key).filter(F.col("rank") <= top)
    return ranked.select(
        quoted(key), "feature", F.col("contribution").alias("weight"), F.col("abs_contribution").alias("abs_weight"), "direction", "rank"
    )

