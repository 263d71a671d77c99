import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from plumbline.functions import expr as X
from plumbline.functions.typing import detect_task, normalised, type_group
from plumbline.operators import profile as P
from plumbline.operators import relations as R
from plumbline.operators import stats as S


def test_four_row_profile(tiny):
    assert P.table_shape(tiny).first().asDict() == {"rows": 4, "columns": 3}
    over = P.missing_overview(tiny).first()
    assert over["missing_cells"] == 2 and over["missing_rate"] == round(2 / 12, 8)
    assert S.duplicate_rows(tiny).first()["duplicates"] == 0
    assert P.target_distribution(tiny, "target").agg(F.sum("n")).first()[0] == 4
    prof = {r["column"]: r for r in P.column_profile(tiny, "a").collect()}
    assert prof["a"]["median"] == 2.0 and prof["b"]["distinct"] == 2 and prof["target"]["missing"] == 0
    assert prof["b"]["semantic_type"] == "ordinal_or_nominal_low_cardinality"


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, b string")
    assert P.missing_overview(df).first()["missing_cells"] == 0
    assert S.numeric_summary(df).count() == 0
    assert S.duplicate_rows(df).first()["duplicates"] == 0
    assert S.histogram_table(df, ["a"]).count() == 0
    assert {r["column"]: r["unique_rate"] for r in P.unique_rates(df).collect() if r["unique_rate"]} == {}


def test_all_null_and_constant_columns(spark):
    df = spark.createDataFrame([(None, 5.0, None)] * 6, "n double, c double, t string")
    assert [r["column"] for r in S.numeric_summary(df).collect()] == ["c"]
    hist = S.histogram_table(df, ["n", "c"], bins=5).collect()
    assert {r["column"] for r in hist} == {"c"}
    assert min(r["low"] for r in hist) == 4.5 and max(r["high"] for r in hist) == 5.5 and sum(r["n"] for r in hist) == 6
    assert {r["feature_a"]: r["correlation"] for r in S.correlation_pairs(df, ["n", "c"]).collect()} == {"n": 0.0}
    assert {r["column"]: r["skewness"] for r in S.moment_profile(df, ["c"]).collect()} == {"c": 0.0}


def test_nan_is_missing_and_infinity_is_not_finite(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-0.0,), (1.0,)], "x double")
    assert S.missing_counts(df).first()["missing"] == 1
    assert normalised(df).filter(X.is_finite("x")).count() == 2
    clean = [r[0] for r in X.finite_frame(df).collect()]
    assert clean[:2] == [None, None]


def test_single_row_has_no_deviation(spark):
    df = spark.createDataFrame([(3.0,)], "x double")
    assert S.numeric_summary(df).first()["std"] is None


def test_duplicates_compare_nulls_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "a"), (None, "a"), (None, "a"), (2, "b")], "k int, v string")
    assert S.duplicate_rows(df).first()["duplicates"] == 3


def test_ties_go_to_the_lowest_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "v string")
    assert [(r["rank"], r["value"]) for r in P.top_values(df, ["v"], 4).orderBy("rank").collect()] == [(1, "a"), (2, "b"), (3, P.MISSING_LABEL), (4, "c")]


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.gamma(2, 3, 500), 2)
    counts, edges = np.histogram(v, bins=20)
    got = S.histogram_table(spark.createDataFrame(pd.DataFrame({"x": v})), ["x"]).orderBy("bin").collect()
    assert [r["n"] for r in got] == counts.tolist()
    np.testing.assert_allclose([r["low"] for r in got], edges[:-1])
    assert got[0]["label"] == f"{round(edges[0], 4)} to {round(edges[1], 4)}"


def test_moments_and_correlations_match_pandas(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.gamma(2, 2, (300, 7)), columns=list("abcdefg"))
    pdf["b"] = pdf.a * 2 + rng.normal(0, 1, 300)
    pdf.iloc[::7, 2] = np.nan
    pdf["flat"] = 3.3
    df = spark.createDataFrame(pdf)
    skew = {r["column"]: r["skewness"] for r in S.moment_profile(df).collect()}
    for c in "abcdefg":
        assert skew[c] == pytest.approx(pdf[c].skew(), rel=1e-9)
    want = pdf.corr().fillna(0.0)
    narrow = S._pair_aggregate(normalised(df), [(a, b) for i, a in enumerate(pdf) for b in list(pdf)[i + 1 :]])
    for table in (S.correlation_pairs(df), narrow):
        for r in table.collect():
            assert r["correlation"] == pytest.approx(want.loc[r["feature_a"], r["feature_b"]], abs=1e-9)


def test_semantic_and_task_rules(spark):
    df = spark.range(200).select(
        F.col("id").cast("double").alias("wide"), (F.col("id") % 3).alias("code"), F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0")).alias("day"), F.col("id").cast("string").alias("name")
    )
    kinds = {r["column"]: r["semantic_type"] for r in P.semantic_types(df).collect()}
    assert kinds == {"wide": "continuous", "code": "ordinal_numeric", "day": "datetime_like", "name": "nominal"}
    assert detect_task(df, "code").first()["task_type"] == "classification"
    assert detect_task(df, "wide").first()["task_type"] == "regression"
    assert detect_task(df, "name").first()["task_type"] == "classification"
    with pytest.raises(ValueError):
        detect_task(df, "absent")


def test_dates_in_several_layouts(spark):
    df = spark.createDataFrame([("2024-02-03",), ("2024-02-03T10:11:12Z",), ("03/02/2024",), ("2024/02/03",), ("03 Feb 2024",), ("12345",), ("abc",)], "d string")
    assert [r[0] for r in df.select(X.lenient_timestamp("d").isNotNull()).collect()] == [True] * 5 + [False] * 2


def test_nested_types_are_refused(spark):
    with pytest.raises(TypeError):
        type_group(spark.createDataFrame([([1],)], "a array<int>").schema["a"].dataType)


def test_mutual_information_finds_the_signal(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=600)
    pdf = pd.DataFrame({"x": x, "noise": rng.normal(size=600), "kind": np.where(x > 0.5, "up", "down"), "y": np.where(x > 0, "p", "n")})
    got = rows(R.mutual_information(spark.createDataFrame(pdf), "y", "classification"))
    assert got[0][0] == "x" and got[0][1] > 0.5 and dict(got)["noise"] < 0.05 and "kind_up" in dict(got)


def test_sample_values_of_sparse_columns(spark):
    df = spark.range(500).select("id", F.when(F.col("id") >= 400, F.col("id")).alias("late"))
    got = {r["column"]: r["samples"] for r in P.sample_values(df, "id").collect()}
    assert got == {"id": ["0", "1", "2", "3", "4"], "late": ["400", "401", "402", "403", "404"]}


def test_summary_is_one_scan_with_pruned_columns(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") * 2.0).alias("x"), F.lit("text").alias("t")).write.parquet(str(tmp_path / "t"))
    plan = S.numeric_summary(spark.read.parquet(str(tmp_path / "t")), ["x"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "ReadSchema: struct<x:double>" in plan


def test_moments_of_wide_tables_by_tasks(spark, monkeypatch):
    """Beyond a few columns tasks sum arrays; both ways agree on gaps, constants, large offsets and infinities."""
    x = F.col("id").cast("double")
    wide = spark.range(500).repartition(5).select(
        x.alias("a"), (x * x).alias("b"), F.when(F.col("id") % 3 == 0, x).alias("gaps"), F.lit(2.0).alias("same"), F.lit(None).cast("double").alias("none"),
        F.when(F.col("id") < 2, x).alias("two"), (F.sqrt(x) + 1e9).alias("far"), F.when(F.col("id") == 7, float("inf")).otherwise(x).alias("open"), F.when(F.col("id") == 7, float("nan")).otherwise(x).alias("nan"),
    )
    asked = []
    by_tasks = S._moments_by_tasks
    monkeypatch.setattr(S, "_moments_by_tasks", lambda *a: asked.append(1) or by_tasks(*a))
    one = {r["column"]: r for r in S.moment_profile(wide).collect()}
    monkeypatch.setattr(S, "FUSED_MOMENTS", 3)
    two = {r["column"]: r for r in S.moment_profile(wide).collect()}
    assert asked == [1] and set(one) == set(two) == set(wide.columns)
    for c in one:
        assert one[c]["count"] == two[c]["count"]
        for k in ("skewness", "variance"):
            a, b = one[c][k], two[c][k]
            assert (a is None and b is None) or a == pytest.approx(b, rel=1e-6, abs=1e-9, nan_ok=True), (c, k, a, b)
