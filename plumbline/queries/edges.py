"""Queries at the edges: crowded text columns, wide tables, NaN and infinite values, keys beyond 2^53, mixed catalog writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import drift as D
from plumbline.operators import evaluate as V
from plumbline.operators import ranks as K
from plumbline.operators import relations as R
from plumbline.operators import stats as S
from plumbline.queries.base import query, r, read, rounds
from plumbline.queries.evaluation import BINARY_SQL, REGRESSION_SQL, binary_scores, regression_scores
from plumbline.queries.profile import hist_sql
from plumbline.queries.relations import _mi_sql
from plumbline.session import scratch_path
from plumbline.sources import catalog

# ---- a text column with far more levels than classes, and a copy of the target -------


@query(
    "mutual_information_crowded",
    _mi_sql(
        "crowded AS (SELECT o_totalprice, o_custkey::VARCHAR AS customer, o_orderstatus AS status_copy, o_orderstatus FROM orders)",
        "crowded",
        ("o_totalprice",),
        ("customer", "status_copy"),
        "o_orderstatus",
        "true",
    ),
)
def mutual_information_crowded(spark, folder):
    o = read(spark, folder, "orders")
    df = o.select("o_totalprice", F.col("o_custkey").cast("string").alias("customer"), F.col("o_orderstatus").alias("status_copy"), "o_orderstatus")
    return rounds(R.mutual_information(df, "o_orderstatus", "classification"))


# ---- forty numeric columns -----------------------------------------------------------

WIDE = [f"x{i:02d}" for i in range(40)]
_CELL = "(l_quantity * ({i} + 1) + l_linenumber * l_linenumber * {i})::DOUBLE"
_WIDE_SQL = "wide AS (SELECT l_shipdate, " + ", ".join(f"{_CELL.format(i=i)} AS {c}" for i, c in enumerate(WIDE)) + " FROM lineitem)"


def wide_lines(spark, folder):
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    return read(spark, folder, "lineitem").select("l_shipdate", *[(q * (i + 1) + n * n * i).alias(c) for i, c in enumerate(WIDE)])


def _halves(spark, folder):
    wide, middle = wide_lines(spark, folder), F.lit("1995-06-17").cast("timestamp")
    return wide.filter(F.col("l_shipdate") < middle), wide.filter(F.col("l_shipdate") >= middle)


@query(
    "mean_shift_wide_table",
    f"WITH {_WIDE_SQL}, m AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg({c}) FILTER (l_shipdate < TIMESTAMP '1995-06-17') AS a, avg({c}) FILTER (l_shipdate >= TIMESTAMP '1995-06-17') AS b, "
        f"stddev_samp({c}) FILTER (l_shipdate < TIMESTAMP '1995-06-17') AS s FROM wide"
        for c in WIDE
    )
    + f") SELECT feature, {r('a', 4)} AS train_mean, {r('b', 4)} AS current_mean, {r('abs(b - a) / s', 4)} AS z_drift FROM m",
)
def mean_shift_wide_table(spark, folder):
    return rounds(D.mean_shift(*_halves(spark, folder)), 4)


@query(
    "moments_wide_table",
    f"WITH {_WIDE_SQL} "
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", {r(f'skewness({c})', 4)} AS skewness, {r(f'var_pop({c})', 2)} AS variance FROM wide" for c in WIDE),
)
def moments_wide_table(spark, folder):
    return rounds(S.moment_profile(wide_lines(spark, folder)), 4, variance=2)


# ---- NaN and infinities --------------------------------------------------------------

_NAN = "CASE WHEN doc_id % 7 = 0 THEN 'NaN'::DOUBLE ELSE score END"


def _auc_sql(where):
    rank = "(SELECT count(*) FILTER (n.s < p.s) + 0.5 * count(*) FILTER (n.s = p.s) FROM t n WHERE n.y_true <> '1')"
    return f"WITH {BINARY_SQL}, t AS (SELECT y_true, score AS s FROM scored WHERE {where}) SELECT round((sum({rank}) / ((SELECT count(*) FROM t WHERE y_true <> '1') * count(*)))::DOUBLE, 6) AS roc_auc FROM t p WHERE y_true = '1'"


def _scores_with_nan(spark, folder):
    return binary_scores(spark, folder).withColumn("score", F.when(F.col("doc_id") % 7 == 0, float("nan")).otherwise(F.col("score")))


@query("roc_auc_with_nan", _auc_sql("doc_id % 7 <> 0"))
def roc_auc_with_nan(spark, folder):
    return rounds(V.roc_auc(_scores_with_nan(spark, folder), "1"))


@query("roc_auc_with_nan_bucketed", _auc_sql("doc_id % 7 <> 0"))
def roc_auc_with_nan_bucketed(spark, folder):
    return rounds(V.roc_auc(_scores_with_nan(spark, folder), "1", buckets=8))


@query(
    "regression_metrics_with_nan",
    f"WITH {REGRESSION_SQL}, t AS (SELECT * FROM scored WHERE l_linenumber <> 3) SELECT round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, "
    "round(1 - avg(e * e) / var_pop(y_true), 6) AS r2_score, round(median(abs(e)), 4) AS median_ae FROM t",
)
def regression_metrics_with_nan(spark, folder):
    scored = regression_scores(spark, folder).withColumn("y_pred", F.when(F.col("l_linenumber") == 3, float("nan")).otherwise(F.col("y_pred")))
    return rounds(V.regression_metrics(scored).select("rmse", "mae", "r2_score", "median_ae"), 4, r2_score=6)


@query("histogram_with_infinities", hist_sql(("l_extendedprice",), 20, "(SELECT CASE WHEN l_linenumber < 3 THEN NULL ELSE l_extendedprice END AS l_extendedprice FROM lineitem)"))
def histogram_with_infinities(spark, folder):
    price = F.when(F.col("l_linenumber") == 1, float("inf")).when(F.col("l_linenumber") == 2, float("-inf")).otherwise(F.col("l_extendedprice"))
    return rounds(S.histogram_table(read(spark, folder, "lineitem").select(price.alias("l_extendedprice")), ("l_extendedprice",)))


# ---- row selection by keys that a double can't hold ----------------------------------


@query("row_at_big_key", "SELECT o_orderkey + 1152921504606846976 AS key, o_totalprice FROM orders ORDER BY 1 LIMIT 1 OFFSET 1200")
def row_at_big_key(spark, folder):
    big = read(spark, folder, "orders").select((F.col("o_orderkey") + F.lit(1 << 60)).alias("key"), "o_totalprice")
    return K.row_at(big, "key", 1200, heap_rows=500)


@query("row_at_text_key", "SELECT c_name, c_acctbal FROM customer ORDER BY c_name LIMIT 1 OFFSET 120")
def row_at_text_key(spark, folder):
    return K.row_at(read(spark, folder, "customer").select("c_name", "c_acctbal"), "c_name", 120, heap_rows=50)


# ---- a catalog table that is appended to, then replaced in part -----------------------


def _runs(spark, folder, factor):
    return read(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("model_id"), F.concat(F.lit("job"), F.col("s_nationkey").cast("string")).alias("job_id"), (F.col("s_acctbal") * factor).alias("accuracy")
    )


@query(
    "catalog_append_and_replace",
    "WITH new AS (SELECT * FROM supplier WHERE s_nationkey < 5 AND s_suppkey % 2 = 0) "
    "SELECT s_suppkey AS model_id, 'job' || s_nationkey AS job_id, round(s_acctbal, 2) + 0.0 AS accuracy FROM supplier WHERE s_nationkey NOT IN (SELECT s_nationkey FROM new) "
    "UNION ALL SELECT s_suppkey, 'job' || s_nationkey, round(s_acctbal * 2, 2) + 0.0 FROM new",
)
def catalog_append_and_replace(spark, folder):
    """Jobs are appended in two goes; some are then replaced, twice, by fewer models."""
    root = scratch_path(spark, "catalog")
    once = _runs(spark, folder, 1)
    catalog.append(once.filter("model_id % 3 = 0"), root, "trained_models")
    catalog.append(once.filter("model_id % 3 <> 0"), root, "trained_models")
    fresh = _runs(spark, folder, 2).filter("model_id % 2 = 0 AND job_id IN ('job0', 'job1', 'job2', 'job3', 'job4')")
    for _ in range(2):
        catalog.replace_by_job(fresh, root)
    return rounds(catalog.read(spark, root, "trained_models").select("model_id", "job_id", "accuracy"), 2)


