import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from plumbline.operators import evaluate as V
from plumbline.operators import leaderboard as B
from plumbline.operators import registry as G
from plumbline.sources import artifacts, catalog
from plumbline.sources.files import load_table, save_csv


def test_confusion_is_filled_with_zeros(spark):
    # c is never predicted, d is never true
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "d")], "y_true string, y_pred string")
    got = {(r["y_true"], r["y_pred"]): (r["n"], r["rate"]) for r in V.confusion_matrix(df).collect()}
    assert len(got) == 16 and got[("a", "a")] == (1, 1.0) and got[("d", "d")] == (0, 0.0)
    report = {r["label"]: r for r in V.class_report(df).collect()}
    assert report["c"]["precision"] == 0.0 and report["d"]["recall"] == 0.0 and report["d"]["support"] == 0
    assert V.classification_metrics(df).first()["balanced_accuracy"] == pytest.approx(1 / 3)


def test_fifteen_flipped_predictions(spark):
    df = spark.range(240).select(F.when(F.col("id") % 2 == 0, "yes").otherwise("no").alias("y_true"), "id")
    df = df.withColumn("y_pred", F.when(F.col("id") >= 15, F.col("y_true")).when(F.col("y_true") == "yes", "no").otherwise("yes"))
    assert V.classification_metrics(df).first()["accuracy"] == 0.9375


@pytest.mark.parametrize("buckets", [1, 5])
def test_auc_counts_ties_half(spark, buckets):
    df = spark.createDataFrame([("1", 0.5), ("0", 0.5), ("1", 0.9), ("0", 0.1), ("0", 0.5), ("1", 0.1)], "y_true string, score double")
    pos, neg = [0.5, 0.9, 0.1], [0.5, 0.1, 0.5]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert V.roc_auc(df, "1", buckets=buckets).first()[0] == pytest.approx(want)
    last = V.roc_curve(df, "1", buckets=buckets).orderBy("threshold").first()
    assert (last["fpr"], last["tpr"]) == (1.0, 1.0)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([("1", 0.5), ("1", 0.2)], "y_true string, score double")
    assert V.roc_auc(df, "1").first()[0] is None


def test_regression_metrics_match_numpy(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(size=260)
    p = y + rng.normal(0, 0.25, 260)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "row_id long, y_true double, y_pred double")
    m, e = V.regression_metrics(df).first(), y - p
    assert m["rmse"] == pytest.approx(np.sqrt((e**2).mean())) and m["r2_score"] == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())
    assert m["median_ae"] == pytest.approx(np.median(abs(e))) and m["explained_variance"] == pytest.approx(1 - e.var() / y.var())
    assert V.residual_summary(df).first()["large_residual_count"] == (abs(e) >= np.percentile(abs(e), 95)).sum()
    assert V.residual_histogram(df).agg(F.sum("n"), F.count("*")).first()[:] == (260, 10)
    assert V.residual_sample(df, ["row_id"], 200).count() == 200


@pytest.fixture(scope="module")
def one_model(spark):
    row = (1, "job", "Random Forest", "classification", 1.2, False, 0.91, 0.9, 0.95, None, None, None, {"accuracy": 0.5, "precision": 0.8, "gone": None}, [[8, 1], [2, 9]],
           ([0.0, 0.2, 1.0], [0.0, 0.8, 1.0], [1.5, 0.5, 0.0]), [0.9, 0.92])
    return spark.createDataFrame(
        [row],
        "model_id long, job_id string, model_name string, task_type string, training_time double, is_deployed boolean, accuracy double, f1_score double, roc_auc double, rmse double, "
        "mae double, r2_score double, metrics map<string,double>, confusion_matrix array<array<bigint>>, roc struct<fpr:array<double>,tpr:array<double>,thresholds:array<double>>, cv_scores array<double>",
    )


def test_stored_model_metrics(one_model):
    top = B.leaderboard(one_model).first()
    assert (top["rank"], top["metric_name"], top["primary_metric"]) == (1, "accuracy", 0.91)
    assert [r["metric"] for r in B.metric_catalog(one_model).collect()] == ["accuracy", "f1_score", "precision", "roc_auc"]
    assert rows(B.confusion_chart(one_model), "row", "col")[:2] == [(1, 0, 0, 8, 0.888889), (1, 0, 1, 1, 0.111111)]
    assert rows(B.roc_chart(one_model), "point")[1] == (1, 1, 0.2, 0.8, 0.5)


def test_metric_comparison(spark):
    df = spark.createDataFrame([(1, "j", "A", "classification", 0.8), (2, "j", "B", "classification", 0.9)], "model_id long, job_id string, model_name string, task_type string, accuracy double")
    df = df.withColumn("metrics", F.lit(None).cast("map<string,double>"))
    assert rows(B.metric_comparison(df, ("A", "B", "C"), 0.0)) == [("accuracy", 0.8, 0.9, 0.0)]


def test_failed_models_are_counted_and_missing_scores_come_last(spark):
    df = spark.createDataFrame(
        [(1, "j", "A", "regression", None, None), (2, "j", "B", "regression", -5.0, None), (3, "j", "C", "regression", 0.9, "boom")],
        "model_id long, job_id string, model_name string, task_type string, r2_score double, error string",
    ).withColumn("metrics", F.lit(None).cast("map<string,double>"))
    row = B.run_summary(df).first()
    assert (row["best_model"], row["best_score"], row["models_trained"], row["failed_models"]) == ("B", -5.0, 2, 1)


def test_replace_by_job_is_idempotent(spark, tmp_path):
    root = str(tmp_path)
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "model_id long, job_id string, model_name string")
    catalog.replace_by_job(old, root)
    new = spark.createDataFrame([(3, "a", "z")], "model_id long, job_id string, model_name string")
    for _ in range(2):
        catalog.replace_by_job(new, root)
    stored = catalog.read(spark, root, "trained_models")
    assert rows(stored.select("model_id", "job_id"), "model_id") == [(2, "b"), (3, "a")]
    assert rows(G.replace_jobs(old, new), "model_id") == [(2, "b", "y"), (3, "a", "z")]


def test_deploy_is_exclusive(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "b", True)], "model_id long, job_id string, is_deployed boolean")
    assert rows(G.deploy(df, 2), "model_id") == [(1, "a", False), (2, "a", True), (3, "b", True)]
    assert rows(G.undeploy(df, 1), "model_id")[0] == (1, "a", False)
    with pytest.raises(ValueError):
        G.deploy(df, 9)


def test_csv_round_trip_and_charts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, None)], "k int, t string, x double")
    save_csv(df, str(tmp_path / "t.csv"))
    assert rows(load_table(spark, str(tmp_path / "t.csv")), "k") == rows(df, "k")
    report = spark.createDataFrame([("c1", "exploratory", 1, "k", "v"), ("c2", "exploratory", 1, "k", "v")], "chart_id string, section string, row_no int, key string, value string")
    refs = artifacts.save_charts(report, str(tmp_path / "charts"))
    assert [r["chart_id"] for r in refs.orderBy("chart_id").collect()] == ["c1", "c2"]


@pytest.mark.parametrize("error", [0.3, 0.05, 1e-4])
def test_thinned_curve_keeps_its_area(spark, error):
    draw = random.Random(6)
    rows = [(str(int(draw.random() < x)), x) for x in (round(draw.random(), 3) for _ in range(3000))]
    df = spark.createDataFrame(rows, "y_true string, score double")
    points = V.roc_points(df, "1", error).orderBy(F.col("threshold").desc_nulls_first()).collect()
    curve = [(p["fpr"], p["tpr"]) for p in points]
    whole = sorted((r["fpr"], r["tpr"]) for r in V.roc_curve(df, "1").collect())
    area = lambda c: sum((x2 - x1) * (y1 + y2) / 2 for (x1, y1), (x2, y2) in zip(c, c[1:]))
    assert curve[0] == (0.0, 0.0) and curve[-1] == (1.0, 1.0) and curve == sorted(curve) and set(curve[1:]) <= set(whole)
    assert abs(area(curve) - V.roc_auc(df, "1").first()[0]) < error * (1 + error / 2) and len(curve) <= 4 / error + 3


def test_no_curve_without_both_classes(spark):
    df = spark.createDataFrame([("1", 0.5), ("1", 0.7)], "y_true string, score double")
    assert V.roc_points(df, "1").count() == 0


def test_confusion_rates_keep_null_labels(spark):
    from plumbline.operators.evaluate import confusion_rates

    scored = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "b"), (None, "b"), (None, None)], "y_true string, y_pred string")
    got = {(r["y_true"], r["y_pred"]): tuple(r)[2:] for r in confusion_rates(scored).collect()}
    assert got == {("a", "a"): (1, 3, 1, 1 / 3, 1.0), ("a", "b"): (2, 3, 3, 2 / 3, 2 / 3), (None, "b"): (1, 2, 3, 0.5, 1 / 3), (None, None): (1, 2, 1, 0.5, 1.0)}
