import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from plumbline.operators import drift as D
from plumbline.operators import leakage as L
from plumbline.operators import quality as Q
from plumbline.plans.curation import clean_and_save


@pytest.fixture(scope="module")
def messy(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"x": np.round(rng.normal(10, 2, 200), 1), "n": rng.integers(0, 40, 200).astype(float), "t": rng.choice(["a", "b", "c"], 200)})
    pdf.loc[::11, "x"] = np.nan
    pdf.loc[5, "x"], pdf.loc[6, "n"] = 500.0, 900.0
    pdf.loc[::13, "t"] = None
    pdf = pd.concat([pdf, pdf.iloc[:20]])
    return pdf, spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "x double, n double, t string")


def _cleaned(pdf):
    out = pdf.drop_duplicates().copy()
    for c in ("x", "n"):
        out[c] = out[c].fillna(out[c].median())
    out["t"] = out.t.fillna(out.t.mode().iloc[0])
    for c in ("x", "n"):
        q1, q3 = out[c].quantile([0.25, 0.75])
        out[c] = out[c].clip(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return out


def test_cleaning_matches_pandas(messy):
    pdf, df = messy
    got = Q.clean_table(df).toPandas().sort_values(["x", "n", "t"]).reset_index(drop=True)
    want = _cleaned(pdf).sort_values(["x", "n", "t"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
    assert not got.isna().any().any()


def test_cleaning_log_counts(messy):
    pdf, df = messy
    log = {(r["step"], r["column"]): r["n"] for r in Q.cleaning_log(df).collect()}
    unique = pdf.drop_duplicates()
    assert log[("drop_duplicates", "")] == len(pdf) - len(unique)
    assert log[("fill_median", "x")] == unique.x.isna().sum() and log[("fill_mode", "t")] == unique.t.isna().sum()
    assert log[("clip", "x")] >= 1 and log[("clip", "n")] >= 1


def test_all_null_text_becomes_unknown(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "x double, t string")
    assert {r["t"] for r in Q.clean_table(df).collect()} == {"unknown"}


def test_clip_keeps_nulls(spark):
    plan = Q.CleaningPlan(fences={"x": (0.0, 1.0)})
    assert rows(plan.apply(spark.createDataFrame([(None,), (5.0,), (-5.0,)], "x double"))) == [(None,), (1.0,), (0.0,)]


def test_quality_score(spark):
    clean = spark.range(50).select(F.col("id").cast("double").alias("x"))
    row = Q.quality_score(clean).first()
    assert row["quality_score"] == 100.0 and row["advice"] == ["clean"]
    spoiled = clean.unionByName(clean).withColumn("y", F.lit(None).cast("double"))
    row = Q.quality_score(spoiled).first()
    assert row["quality_score"] == 100 - 25 - 20 and row["advice"] == ["impute_missing", "drop_duplicates"]


def test_constant_and_short_columns_have_no_outliers(spark):
    df = spark.createDataFrame([(1.0, None)] * 9 + [(1.0, 900.0)], "c double, s double")
    assert rows(Q.outlier_counts(df)) == [("c", 0)]


def test_clean_and_save(messy, tmp_path):
    pdf, df = messy
    described, entry = clean_and_save(df, str(tmp_path / "out"))
    assert entry.first()["num_rows"] == len(pdf.drop_duplicates()) and described.count() == 2


def test_leakage(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("sale_flag"), (F.col("id") % 2).alias("flag_copy"), (F.col("id") % 2 * 3 + 1).alias("scaled"), F.rand(1).alias("noise"))
    got = {r["feature"]: (r["risk_score"], r["reasons"]) for r in L.leakage_ranking(df, "sale_flag").collect()}
    assert got == {"flag_copy": (1.0, ["name_overlap", "equals_target", "correlates_with_target"]), "scaled": (0.8, ["correlates_with_target"])}
    with pytest.raises(ValueError):
        L.leakage_ranking(df, "nope")


def test_drift(spark):
    train = spark.range(100).select(F.col("id").cast("double").alias("a"), F.lit(2.0).alias("flat"), F.lit(None).cast("double").alias("empty"), F.lit("t").alias("t"))
    current = train.select((F.col("a") + 1000).alias("a"), (F.col("flat") + 0.25).alias("flat"), "empty", "t")
    shift = D.mean_shift(train, current)
    got = {r["feature"]: r["z_drift"] for r in shift.collect()}
    assert got == {"a": round(1000 / np.std(range(100), ddof=1), 4), "flat": 0.25}
    assert D.drift_summary(shift).first()["drift_level"] == "high"
    assert D.drift_summary(D.mean_shift(train, train)).first()["drift_level"] == "low"
    assert D.top_drift(shift, 1).first()["feature"] == "a"


def test_baseline_treats_booleans_as_categories(spark):
    df = spark.createDataFrame([(True, 1.0), (True, None), (None, 3.0), (False, 4.0)], "b boolean, x double")
    assert [r["feature"] for r in D.numeric_baseline(df).collect()] == ["x"]
    top = D.categorical_baseline(df).orderBy("rank").first()
    assert (top["value"], top["rate"], top["missing_rate"]) == ("true", 0.5, 0.25)


def test_model_health(spark):
    df = spark.createDataFrame([(1, [0.9, 0.92]), (2, []), (3, [0.1, 0.9])], "model_id int, cv_scores array<double>")
    got = {r["model_id"]: r for r in D.model_health(df).collect()}
    assert got[1]["cv_mean"] == pytest.approx(0.91) and got[1]["cv_std"] == pytest.approx(0.01) and got[1]["stability"] == "stable"
    assert got[2]["cv_mean"] is None and got[2]["stability"] == "unknown" and got[3]["stability"] == "unstable"
