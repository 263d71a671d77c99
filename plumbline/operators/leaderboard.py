"""Leaderboard, metric catalog and run summaries over a table of trained models.

A models table has `model_id, job_id, model_name, task_type, training_time, is_deployed`,
the flat metric columns below, `metrics map<string,double>` and `cv_scores array<double>`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.expr import finite_or_null, merge_maps, quoted

# Flat metric columns, the primary metric of each task, the score of a missing one.
FLAT_METRICS = ("accuracy", "f1_score", "roc_auc", "rmse", "mae", "r2_score")
PRIMARY = {"classification": "accuracy", "regression": "r2_score"}
NO_SCORE = -1e9


def primary_metric(task: Column | str = "task_type") -> Column:
    task = F.col(task) if isinstance(task, str) else task
    return F.when(task == "classification", PRIMARY["classification"]).otherwise(PRIMARY["regression"])


def merged_metrics(models: DataFrame) -> DataFrame:
    """Replaces `metrics`: the flat columns win over the map; nulls and non-finite values are dropped."""
    flat = F.create_map(*[x for m in FLAT_METRICS if m in models.columns for x in (F.lit(m), quoted(m).cast("double"))])
    base = F.map_filter(F.coalesce("metrics", F.create_map().cast("map<string,double>")), lambda _, v: v.isNotNull())
    clean = F.transform_values(flat, lambda _, v: finite_or_null(v))
    return models.withColumn("metrics", merge_maps(base, clean))


def leaderboard(models: DataFrame) -> DataFrame:
    """`(job_id, rank, model_id, model_name, metric_name, primary_metric)`: best first in each job, missing last."""
    merged = merged_metrics(models).withColumn("metric_name", primary_metric())
    scored = merged.withColumn("primary_metric", F.try_element_at("metrics", F.col("metric_name")))
    best_first = W.partitionBy("job_id").orderBy(F.coalesce("primary_metric", F.lit(NO_SCORE)).desc(), "model_id")
    return scored.select(
        "job_id",
        F.row_number().over(best_first).alias("rank"),
        "model_id",
        "model_name",
        "metric_name",
        "primary_metric",
        "training_time",
        "is_deployed",
    )


def metric_values(models: DataFrame) -> DataFrame:
    """Long form `(job_id, model_id, model_name, metric, value)` of the merged metrics."""
    return merged_metrics(models).select("job_id", "model_id", "model_name", F.explode("metrics").alias("metric", "value"))


def metric_catalog(models: DataFrame) -> DataFrame:
    """Sorted distinct metric names over all models."""
    names = merged_metrics(models).select(F.explode(F.map_keys("metrics")).alias("metric"))
    return names.distinct().orderBy("metric")


def metric_comparison(models: DataFrame, model_names: Sequence[str], fill: float | None = None) -> DataFrame:
    """One row per metric, one column per model name; missing values are null, or `fill` in the chart form."""
    wide = metric_values(models).groupBy("metric").pivot("model_name", list(model_names)).agg(F.max("value"))
    if fill is None:
        return wide
    return wide.select("metric", *[F.coalesce(quoted(m), F.lit(fill)).alias(m) for m in model_names])


def run_summary(models: DataFrame) -> DataFrame:
    """Per job: primary metric, best model and score, models trained and failed (a failed row has `error`)."""
    ok = F.col("error").isNull() if "error" in models.columns else F.lit(True)
    merged = merged_metrics(models).withColumn("metric_name", primary_metric())
    score = F.try_element_at("metrics", F.col("metric_name"))
    # ties go to the lower id: a struct orders by score, then by the negated id
    order = F.struct(F.coalesce(score, F.lit(NO_SCORE)).alias("s"), (-F.col("model_id")).alias("i"))
    rows = merged.select("job_id", "metric_name", "model_name", score.alias("score"), ok.alias("ok"), order.alias("by"))
    best = lambda c: F.max_by(F.when(F.col("ok"), F.col(c)), F.when(F.col("ok"), F.col("by")))
    return rows.groupBy("job_id").agg(
        F.max("metric_name").alias("primary_metric"),
        best("model_name").alias("best_model"),
        best("score").alias("best_score"),
        F.count_if("ok").alias("models_trained"),
        F.count_if(~F.col("ok")).alias("failed_models"),
    )


def synced_best(results: DataFrame, task: str) -> DataFrame:
    """Per job, the best synced result; regression looks for `r2`, then `r2_score`."""
    keys = ["accuracy"] if task == "classification" else ["r2"]
    score = F.coalesce(*[F.try_element_at("metrics", F.lit(k)) for k in [*keys, "r2_score"]])
    order = F.struct(F.coalesce(score, F.lit(NO_SCORE)).alias("s"), (-F.col("model_id")).alias("i"))
    return results.select("job_id", "model_name", score.alias("score"), order.alias("by")).groupBy("job_id").agg(
        F.max_by("model_name", "by").alias("best_model"),
        F.max_by("score", "by").alias("best_score"),
        F.count("*").alias("models_trained"),
    )


def confusion_chart(models: DataFrame) -> DataFrame:
    """Stored confusion matrices in long form, with row-normalised rates (an empty row gives 0)."""
    rows = models.select("model_id", F.posexplode("confusion_matrix").alias("row", "cells"))
    total = F.aggregate("cells", F.lit(0).cast("long"), lambda a, x: a + x)
    cells = rows.select("model_id", "row", total.alias("total"), F.posexplode("cells").alias("col", "n"))
    rate = F.round(F.coalesce(F.try_divide(F.col("n"), F.col("total")), F.lit(0.0)), 6)
    return cells.select("model_id", "row", "col", "n", rate.alias("rate"))


def roc_chart(models: DataFrame) -> DataFrame:
    """Stored ROC curves in long form; curves whose lists differ in length are left out."""
    roc = F.col("roc")
    usable = models.filter((F.size(roc["fpr"]) > 0) & (F.size(roc["fpr"]) == F.size(roc["tpr"])))
    # lists of different length would pair wrongly, so thresholds are used only when they match
    matched = F.when(F.size(roc["thresholds"]) == F.size(roc["fpr"]), roc["thresholds"])
    lists = usable.select("model_id", roc["fpr"].alias("fpr"), roc["tpr"].alias("tpr"), matched.alias("threshold"))
    points = lists.select("model_id", F.posexplode(F.col("fpr")).alias("point", "fpr"), "tpr", "threshold")
    zero = lambda c: F.coalesce(finite_or_null(c), F.lit(0.0))
    return points.select(
        "model_id",
        "point",
        zero("fpr").alias("fpr"),
        zero(F.col("tpr")[F.col("point")]).alias("tpr"),
        F.col("threshold")[F.col("point")].alias("threshold"),
    )
