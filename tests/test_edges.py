"""Both sides of the switches, and inputs at the edges."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.operators import drift as D
from plumbline.operators import evaluate as V
from plumbline.operators import ranks as K
from plumbline.operators import relations as R
from plumbline.operators import stats as S
from plumbline.sources import catalog


@pytest.mark.parametrize("heap", [3, 1000])
def test_row_at_on_any_key(spark, heap):
    big = 1 << 60
    rows = [(big + i, f"k{i:03d}") for i in range(50)] + [(None, None)]
    df = spark.createDataFrame(rows, "key long, name string").repartition(5)
    assert K.row_at(df, "key", 0, heap).first()["name"] is None
    for i in (1, 17, 50):
        assert [tuple(r) for r in K.row_at(df, "key", i, heap).collect()] == [(big + i - 1, f"k{i - 1:03d}")]
        assert [r["key"] for r in K.row_at(df, "name", i, heap).collect()] == [big + i - 1]
    with pytest.raises(IndexError):
        K.row_at(df, "key", 51, heap)


@pytest.mark.parametrize("buckets", [1, 4])
def test_auc_leaves_nan_out(spark, buckets):
    rows = [("1", 0.9), ("1", 0.4), ("0", 0.4), ("0", 0.1), ("1", math.nan), ("0", None), ("0", math.nan)]
    df = spark.createDataFrame(rows, "y_true string, score double")
    assert V.roc_auc(df, "1", buckets=buckets).first()[0] == pytest.approx(0.875)
    assert V.roc_curve(df, "1", buckets=buckets).count() == 3
    wide = df.withColumn("scores", F.array(1 - F.col("score"), F.col("score")))
    assert V.roc_auc_multiclass(wide, ("0", "1"), buckets=buckets).first()[0] == pytest.approx(0.875)


def test_metrics_leave_nan_out(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, math.nan), (None, 1.0), (4.0, 5.0)], "y_true double, y_pred double")
    got = V.regression_metrics(df).first()
    assert got["mae"] == pytest.approx(2 / 3) and not any(v is not None and math.isnan(v) for v in got)
    assert V.residual_summary(df).first()["mean_residual_bias"] == pytest.approx(-2 / 3)


def test_histogram_of_finite_values(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(math.inf,), (-math.inf,), (None,), (math.nan,)], "x double")
    got = S.histogram_table(df, ["x"], bins=5).collect()
    assert sum(r["n"] for r in got) == 10 and got[0]["low"] == 0.0 and max(r["high"] for r in got) == 9.0
    assert S.histogram_table(df.filter("x = double('infinity')"), ["x"]).count() == 0


def test_small_steps_on_a_large_level(spark):
    rows = [(1000 + 1e-9 * ((i * 37) % 101), float((i * 53) % 97)) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double")
    n = len(rows)
    ma, mb = sum(a - 1000 for a, _ in rows) / n, sum(b for _, b in rows) / n
    cov = sum((a - 1000 - ma) * (b - mb) for a, b in rows)
    want = cov / math.sqrt(sum((a - 1000 - ma) ** 2 for a, _ in rows) * sum((b - mb) ** 2 for _, b in rows))
    narrow = S.correlation_pairs(df).first()["correlation"]
    wide = df.select("*", *[(F.col("b") * (i + 2)).alias(f"c{i}") for i in range(6)])
    matrix = S.correlation_pairs(wide).filter("feature_a = 'a' AND feature_b = 'b'").first()["correlation"]
    assert narrow == pytest.approx(want, abs=2e-6) and matrix == pytest.approx(want, abs=2e-6)


def test_information_of_crowded_columns(spark):
    df = spark.range(300).select(
        F.concat(F.lit("id"), F.col("id").cast("string")).alias("a_id"), F.when(F.col("id") % 3 == 0, "yes").otherwise("no").alias("z_copy"), (F.col("id") % 7).alias("x"), F.when(F.col("id") % 3 == 0, "yes").otherwise("no").alias("target")
    )
    best = R.mutual_information(df, "target", "classification").first()
    assert best["feature"] == "z_copy_yes" and best["score"] == pytest.approx(-(math.log(1 / 3) / 3 + 2 * math.log(2 / 3) / 3))
    assert R.mutual_information(df, "target", "classification", k=1000).filter("feature LIKE 'a_id_%'").count() == 299


def test_wide_tables_keep_all_columns(spark):
    wide = spark.range(20).select(*[(F.col("id") * (i + 1)).cast("double").alias(f"c{i:02d}") for i in range(45)])
    assert S.moment_profile(wide).count() == 45
    shift = D.mean_shift(wide, wide.select(*[(F.col(c) + 1).alias(c) for c in wide.columns]))
    assert shift.count() == 45 and shift.filter("z_drift = 0").count() == 0
    saved = D.saved_moments(wide)
    assert D.mean_shift(wide, wide, moments=saved).filter("z_drift = 0").count() == 45


def test_catalog_takes_both_ways_of_writing(spark, tmp_path):
    root = str(tmp_path)
    models = lambda *rows: spark.createDataFrame(rows, "model_id long, job_id string, accuracy double")
    catalog.append(models((1, "a", 0.1), (2, "b", 0.2)), root, "trained_models")
    for _ in range(2):
        catalog.replace_by_job(models((3, "a", 0.3)), root)
    catalog.append(models((4, "c", 0.4)), root, "trained_models")
    assert sorted((r["model_id"], r["job_id"], r["accuracy"]) for r in catalog.read(spark, root, "trained_models").collect()) == [(2, "b", 0.2), (3, "a", 0.3), (4, "c", 0.4)]
    catalog.replace_by_job(models((5, "z", 0.5)), str(tmp_path / "fresh"))
    assert catalog.read(spark, str(tmp_path / "fresh"), "trained_models").count() == 1
