"""Target leakage: names that overlap, values that match, correlation that is too good."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expr import name_tokens, quoted
from plumbline.functions.typing import normalised, numeric_columns, type_groups
from plumbline.operators.stats import correlation_pairs, unfold

# Thresholds and weights of the three signals.
NAME_WEIGHT = 0.2
MATCH_WEIGHT = 0.9
CORRELATION_WEIGHT = 0.8
MATCH_RATE = 0.98
CORRELATION = 0.98
MIN_TOKEN = 3


def name_overlap(df: DataFrame, target: str) -> DataFrame:
    """`(feature, name_overlap)`: a token of the target name (3+ characters) occurs in the feature name."""
    rows = [(c,) for c in df.columns if c != target]
    names = df.sparkSession.createDataFrame(rows, "feature string")
    tokens = name_tokens(F.lit(target), MIN_TOKEN)
    return names.select("feature", F.exists(tokens, lambda t: F.contains(F.lower("feature"), t)).alias("name_overlap"))


def match_rates(df: DataFrame, target: str) -> DataFrame:
    """`(feature, pairs, match_rate)`: share of complete pairs equal as text; one aggregate."""
    df = normalised(df)
    y = quoted(target).cast("string")
    features = [c for c in df.columns if c != target]
    # a comparison with null is null, so count and avg see complete pairs only
    same = [(quoted(c).cast("string") == y) for c in features]
    row = df.agg(
        *[F.count(s).alias(f"n{i}") for i, s in enumerate(same)],
        *[F.avg(s.cast("int")).alias(f"e{i}") for i, s in enumerate(same)],
    )
    parts = [
        (F.lit(c).alias("feature"), F.col(f"n{i}").alias("pairs"), F.col(f"e{i}").alias("match_rate"))
        for i, c in enumerate(features)
    ]
    return unfold(row, parts)


def target_correlations(df: DataFrame, target: str) -> DataFrame:
    """`(feature, correlation)` of numeric features with a numeric target; empty for other targets."""
    if type_groups(df)[target] != "numeric":
        return df.sparkSession.createDataFrame([], "feature string, correlation double")
    pairs = correlation_pairs(df, numeric_columns(df), against=target)
    return pairs.select(F.col("feature_a").alias("feature"), "correlation")


def leakage_ranking(df: DataFrame, target: str, k: int = 20) -> DataFrame:
    """`(feature, risk_score, reasons)`: summed weights capped at 1, score above 0, best first."""
    if target not in df.columns:
        raise ValueError(f"target column '{target}' is missing")
    return rank_signals(name_overlap(df, target), match_rates(df, target), target_correlations(df, target), k)


def rank_signals(names: DataFrame, matches: DataFrame, correlations: DataFrame, k: int = 20) -> DataFrame:
    """The ranking from the three column-sized tables of signals."""
    signals = names.join(F.broadcast(matches), "feature", "left").join(F.broadcast(correlations), "feature", "left")
    match = F.coalesce(F.col("match_rate") >= MATCH_RATE, F.lit(False))
    strong = F.coalesce(F.abs("correlation") >= CORRELATION, F.lit(False))
    score = (
        F.when(F.col("name_overlap"), NAME_WEIGHT).otherwise(0.0)
        + F.when(match, MATCH_WEIGHT).otherwise(0.0)
        + F.when(strong, CORRELATION_WEIGHT).otherwise(0.0)
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("name_overlap"), "name_overlap"),
            F.when(match, "equals_target"),
            F.when(strong, "correlates_with_target"),
        )
    )
    scored = signals.select("feature", F.round(F.least(score, F.lit(1.0)), 4).alias("risk_score"), reasons.alias("reasons"))
    return scored.filter(F.col("risk_score") > 0).orderBy(F.col("risk_score").desc(), "feature").limit(k)
