"""Drift baselines, standardised mean shift between two tables, and model health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expr import at_least_one, quoted
from plumbline.functions.typing import normalised, numeric_columns, other_columns
from plumbline.operators.profile import top_value_rates
from plumbline.operators.stats import _summary, missing_counts, unfold
from plumbline.session import settled

# Baseline quantiles, drift levels, stability levels.
BASELINE_QUANTILES = (0.05, 0.5, 0.95)
FLAT_STD = 1e-9
DRIFT_LEVELS = (0.5, 1.0)
STABILITY_LEVELS = (0.03, 0.08)


def numeric_baseline(df: DataFrame, target: str | None = None, exact: bool = True) -> DataFrame:
    """`(feature, mean, std, q05, q50, q95, missing_rate)` of numeric columns, the target left out."""
    df = normalised(df)
    columns = numeric_columns(df, exclude=[target] if target else [])
    summary = _summary(df, columns, exact, BASELINE_QUANTILES, ("q05", "q50", "q95"))
    missing = missing_counts(df, columns)
    return missing.join(F.broadcast(summary), "column", "left").select(
        F.col("column").alias("feature"),
        "mean",
        "std",
        "q05",
        "q50",
        "q95",
        (F.col("missing") / at_least_one("rows")).alias("missing_rate"),
    )


def categorical_baseline(df: DataFrame, target: str | None = None, k: int = 10) -> DataFrame:
    """`(feature, rank, value, rate, missing_rate)`: top rates of the other columns (booleans included)."""
    columns = other_columns(df, exclude=[target] if target else [])
    rates = top_value_rates(df, columns, k)
    missing = missing_counts(df, columns).select("column", (F.col("missing") / at_least_one("rows")).alias("missing_rate"))
    return rates.join(F.broadcast(missing), "column").select(
        F.col("column").alias("feature"), "rank", "value", "rate", "missing_rate"
    )


def _moments(df: DataFrame, columns: list[str], tag: str) -> DataFrame:
    df = normalised(df)
    exprs = []
    for i, c in enumerate(columns):
        x = quoted(c).cast("double")
        exprs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}")]
    parts = [
        (F.lit(c).alias("feature"), F.col(f"n{i}").alias(f"{tag}_n"), F.col(f"m{i}").alias(f"{tag}_mean"), F.col(f"s{i}").alias(f"{tag}_std"))
        for i, c in enumerate(columns)
    ]
    return unfold(df.agg(*exprs), parts)


def saved_moments(train: DataFrame, target: str | None = None) -> DataFrame:
    """The moments of a table's numeric features, computed once: one row per feature, for `mean_shift(moments=...)`."""
    return settled(_moments(train, numeric_columns(train, exclude=[target] if target else []), "train"))


def mean_shift(train: DataFrame, current: DataFrame, target: str | None = None, limit: int | None = None, moments: DataFrame | None = None) -> DataFrame:
    """`(feature, train_mean, current_mean, z_drift)` of the numeric features both tables have.

    One aggregate per table, or for `current` alone if the moments of `train` are given; the join has one row per
    feature.  A feature that is empty on either side is skipped; a flat training column divides by 1.
    """
    skip = [target] if target else []
    there = set(numeric_columns(current, exclude=skip))
    columns = [c for c in numeric_columns(train, exclude=skip) if c in there][:limit]
    if not columns:
        return train.sparkSession.createDataFrame([], "feature string, train_mean double, current_mean double, z_drift double")
    both = (_moments(train, columns, "train") if moments is None else moments).join(F.broadcast(_moments(current, columns, "current")), "feature")
    scale = F.when(F.col("train_std") > FLAT_STD, F.col("train_std")).otherwise(1.0)
    return both.filter((F.col("train_n") > 0) & (F.col("current_n") > 0)).select(
        "feature",
        "train_mean",
        "current_mean",
        F.round(F.abs(F.col("current_mean") - F.col("train_mean")) / scale, 4).alias("z_drift"),
    )


def drift_summary(shift: DataFrame) -> DataFrame:
    """One row: features compared, mean drift, level."""
    average = F.coalesce(F.avg("z_drift"), F.lit(0.0))
    low, high = DRIFT_LEVELS
    return shift.agg(F.count("*").alias("features_compared"), average.alias("drift")).select(
        "features_compared",
        F.round("drift", 4).alias("avg_z_drift"),
        F.when(F.col("drift") < low, "low").when(F.col("drift") < high, "medium").otherwise("high").alias("drift_level"),
    )


def top_drift(shift: DataFrame, k: int = 10) -> DataFrame:
    return shift.orderBy(F.col("z_drift").desc(), "feature").limit(k)


def model_health(models: DataFrame) -> DataFrame:
    """Per model: mean and population deviation of its fold scores, and a stability label.

    Works inside each row's score array, so nothing is shuffled.
    """
    scores = F.filter("cv_scores", lambda s: s.isNotNull())
    n = F.size(scores)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    mean = F.when(n > 0, total(scores) / n)
    named = models.select("*", scores.alias("__scores"), mean.alias("cv_mean"))
    spread = F.sqrt(total(F.transform("__scores", lambda s: (s - F.col("cv_mean")) * (s - F.col("cv_mean")))) / F.size("__scores"))
    out = named.withColumn("cv_std", F.when(F.size("__scores") > 0, spread)).drop("__scores")
    stable, moderate = STABILITY_LEVELS
    label = (
        F.when(F.col("cv_std").isNull(), "unknown")
        .when(F.col("cv_std") < stable, "stable")
        .when(F.col("cv_std") < moderate, "moderate")
        .otherwise("unstable")
    )
    return out.withColumn("stability", label)
