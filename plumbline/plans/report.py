"""Composed reports as one long table `(chart_id, section, row_no, key, value)`.

Each chart is a small table from an operator; its rows are numbered in a stated order and
its columns stacked as text.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.expr import quoted
from plumbline.functions.typing import detect_task, numeric_columns, other_columns
from plumbline.operators import drift, evaluate, profile, relations, stats
from plumbline.operators.cells import TableCells


def long_rows(table: DataFrame, chart_id: str, section: str, order: Sequence[Column | str]) -> DataFrame:
    """Stack a small table.  Charts are bounded lists, so numbering them in one task is safe."""
    numbered = table.withColumn("row_no", F.row_number().over(W.orderBy(*order)).cast("int"))
    cells = []
    for name, kind in table.dtypes:
        c = quoted(name)
        cells.append((F.to_json(c) if kind.startswith(("array", "map", "struct")) else c.cast("string")).alias(name))
    stacked = numbered.select("row_no", *cells).unpivot(["row_no"], [quoted(c) for c in table.columns], "key", "value")
    return stacked.select(F.lit(chart_id).alias("chart_id"), F.lit(section).alias("section"), "row_no", "key", "value")


def _join(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def exploration_overview(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row: size, missing cells, duplicates, columns by kind, and advice codes."""
    cells = TableCells(df, target)
    return _overview(cells, cells.correlations())


def _related(pairs: DataFrame, threshold: float = 0.75, k: int = 30) -> DataFrame:
    # equal up to rounding is equal: names then decide
    return pairs.filter(F.abs("correlation") >= threshold).orderBy(F.round(F.abs("correlation"), 9).desc(), "feature_a", "feature_b").limit(k)


def _overview(cells: TableCells, pairs: DataFrame) -> DataFrame:
    one = F.lit(1).alias("one")
    missing = sum(cells.rows - cells.fact("n", c) for c in cells.columns)
    joined = cells.duplicate_rows().select("rows", F.col("duplicates").alias("duplicate_rows"), F.lit(missing).cast("long").alias("missing_cells"), one)
    related = _related(pairs).agg(F.count("*").alias("related"))
    joined = joined.join(F.broadcast(related.select("*", one)), "one")
    if cells.target is not None:
        leaks = cells.leakage_ranking(pairs).agg(F.count("*").alias("leaks"))
        joined = joined.join(F.broadcast(leaks.select("*", one)), "one")
    else:
        joined = joined.withColumn("leaks", F.lit(0))
    advice = F.array_compact(
        F.array(
            F.when(F.col("missing_cells") > 0, "impute_missing"),
            F.when(F.col("duplicate_rows") > 0, "drop_duplicates"),
            F.when(F.col("related") > 0, "review_correlated"),
            F.when(F.col("leaks") > 0, "investigate_leakage"),
        )
    )
    return joined.select(
        "rows",
        F.lit(len(cells.columns)).alias("columns"),
        "missing_cells",
        "duplicate_rows",
        F.lit(len(cells.numeric)).alias("numeric_columns"),
        F.lit(len(cells.columns) - len(cells.numeric)).alias("other_columns"),
        F.when(F.size(advice) == 0, F.array(F.lit("ready"))).otherwise(advice).alias("advice"),
    )


def exploration_report(df: DataFrame, target: str | None = None, exact: bool = True) -> DataFrame:
    """Overview, numeric and text summaries, related pairs, leakage, types and drift baseline.

    Reads the table three times (facts, cells, correlations), and once more for rows whose hash repeats.
    """
    cells = TableCells(df, target, exact=exact)
    pairs = cells.correlations()
    numeric, texts = cells.numeric, other_columns(df)
    probs = sorted({*stats.QUARTILES, *drift.BASELINE_QUANTILES})
    found = cells.quantiles(numeric, probs)
    pick = lambda wanted: {c: [q[probs.index(p)] for p in wanted] for c, q in found.items()}
    section = "exploratory"
    parts = [long_rows(_overview(cells, pairs), "overview", section, [F.lit(1)])]
    if numeric:
        parts.append(long_rows(cells.summary(numeric, pick(stats.QUARTILES), ("q1", "median", "q3")), "numeric_summary", section, ["column"]))
        parts.append(long_rows(cells.histogram(numeric), "histograms", section, ["column", "bin"]))
    if texts:
        parts.append(long_rows(cells.top_values(texts), "top_values", section, ["column", "rank"]))
    if len(numeric) > 1:
        parts.append(long_rows(_related(pairs), "high_correlations", section, [F.round(F.abs("correlation"), 9).desc(), "feature_a", "feature_b"]))
    if target is not None:
        parts.append(long_rows(cells.leakage_ranking(pairs), "leakage", section, [F.col("risk_score").desc(), "feature"]))
    parts.append(long_rows(cells.semantic_types(), "semantic_types", section, ["position"]))
    if [c for c in numeric if c != target]:
        parts.append(long_rows(cells.numeric_baseline(pick(drift.BASELINE_QUANTILES)), "drift_baseline_numeric", section, ["feature"]))
    if [c for c in texts if c != target]:
        parts.append(long_rows(cells.categorical_baseline(), "drift_baseline_categorical", section, ["feature", "rank"]))
    return _join(parts)


def analytics_report(
    df: DataFrame, target: str, key: Sequence[str], task: str | None = None, scored: DataFrame | None = None, exact: bool = True
) -> DataFrame:
    """The exploratory tables of the task, and the evaluation tables when `scored` is given.

    `key` orders samples and is not a feature.  `scored` has `(y_true, y_pred)` and the key.
    A table that the columns do not allow is simply absent.  All but the samples, the correlations and the information
    about a target of numbers (one scan each) is read off the two scans of `TableCells`.
    """
    if target not in df.columns:
        raise ValueError(f"target column '{target}' is missing")
    task = task if task in ("classification", "regression") else detect_task(df, target).first()["task_type"]
    view = df.select(*[quoted(c) for c in df.columns if c not in set(key) or c == target])
    numeric, texts = numeric_columns(view, exclude=[target]), other_columns(view, exclude=[target])
    cells = TableCells(view, target, task == "classification", exact)
    add: list[DataFrame] = []

    def chart(name: str, table: DataFrame, order: Sequence[Column | str], section: str = "exploratory") -> None:
        add.append(long_rows(table, name, section, order))

    chart("type_composition", profile.type_composition(view), ["type"])
    if numeric or texts:
        chart("unique_density", cells.unique_density(), ["feature"])
    if numeric:
        moments = cells.moment_profile(numeric)
        skew = moments.filter(F.col("skewness").isNotNull()).select(F.col("column").alias("feature"), "skewness")
        spread = moments.filter(F.col("variance").isNotNull()).select(F.col("column").alias("feature"), "variance")
        chart("numeric_skewness", skew, [F.abs("skewness").desc(), "feature"])
        chart("numeric_variance", spread, [F.col("variance").desc(), "feature"])
    if texts:
        chart("categorical_concentration", cells.categorical_concentration(), ["feature"])
    missing = cells.missing_counts().select("column", "missing").orderBy(F.col("missing").desc(), "column").limit(20)
    chart("missing_by_column", missing, [F.col("missing").desc(), "column"])
    if numeric:
        chart("feature_histograms", cells.histogram(numeric, 15), ["column", "bin"])
    if len(numeric) > 1:
        matrix = stats.mirrored(cells.correlations(numeric), {c: (cells.fact("var", c) or 0.0) > 0 for c in numeric})
        chart("correlation_matrix", matrix, ["feature_a", "feature_b"])
        chart("pair_sample", relations.pair_sample(df, target, key, numeric[:2]), ["x", "y", "group"])
    chart("feature_ranking", cells.mutual_information(), [F.round("score", 9).desc(), "feature"])
    if numeric:
        chart("outliers", cells.outlier_counts(numeric, cells.quantiles(numeric, (0.25, 0.75))), ["feature"])
    if task == "classification":
        chart("class_distribution", cells.class_distribution(), ["rank"])
        if numeric:
            chart("quartiles_by_class", cells.quartiles_by_class(numeric[0]), ["class"])
        if texts:
            chart("class_rates", cells.class_rates(texts[0]), ["category", "class"])
    else:
        counted = target in cells.numeric
        histogram = cells.histogram([target], rows_per_bin=50, bounds=(8, 25)) if counted else profile.target_histogram(view, target)
        chart("target_histogram", histogram, ["bin"])
        if numeric:
            chart("target_sample", relations.target_sample(df, target, key, numeric[0]), ["x", "y"])
        if texts and counted:
            chart("mean_target", cells.mean_target(texts[0]), ["category"])
    if scored is not None:
        section = "model_evaluation"
        if task == "classification":
            chart("confusion_matrix", evaluate.confusion_matrix(scored), ["y_true", "y_pred"], section)
            chart("class_report", evaluate.class_report(scored), ["label"], section)
            chart("metrics", evaluate.classification_metrics(scored), [F.lit(1)], section)
        else:
            chart("residual_histogram", evaluate.residual_histogram(scored), ["bin"], section)
            sample = evaluate.residual_sample(scored, key)
            chart("residuals_vs_predicted", sample.select("predicted", "residual"), ["predicted", "residual"], section)
            chart("actual_vs_predicted", sample.select("actual", "predicted"), ["actual", "predicted"], section)
            chart("metrics", evaluate.regression_metrics(scored, exact), [F.lit(1)], section)
            chart("residual_summary", evaluate.residual_summary(scored, exact), [F.lit(1)], section)
    return _join(add)
