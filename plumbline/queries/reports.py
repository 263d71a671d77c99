"""Composed reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.plans import report as R
from plumbline.queries.base import GAPPY_SQL, LEAKY_SQL, LINE_KEY, LINE_NUMERIC, LINEITEM, gappy_lines, leaky_lines, per_column, query, read
from plumbline.queries.evaluation import _CLASSES, MULTI_SQL, REGRESSION_SQL, multi_scores, regression_scores
from plumbline.queries.profile import _HIST, short
from plumbline.queries.quality import _corr, fences_cte
from plumbline.queries.relations import _mi_sql

_OVERVIEW_COLUMNS = ("l_quantity", "l_extendedprice", "price_copy", "l_returnflag", "returnflag_copy")


@query(
    "exploration_overview",
    f"WITH {LEAKY_SQL}, t AS (SELECT {', '.join(_OVERVIEW_COLUMNS)} FROM leaky) SELECT count(*) AS rows, 5::INTEGER AS columns, 0::BIGINT AS missing_cells, "
    "count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS duplicate_rows, 3::INTEGER AS numeric_columns, 2::INTEGER AS other_columns, "
    "concat_ws(',', CASE WHEN count(*) > (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) THEN 'drop_duplicates' END, "
    "CASE WHEN abs(corr(l_extendedprice, price_copy)) >= 0.75 THEN 'review_correlated' END, CASE WHEN avg((l_returnflag = returnflag_copy)::INT) >= 0.98 THEN 'investigate_leakage' END) AS advice FROM t",
)
def exploration_overview(spark, folder):
    out = R.exploration_overview(leaky_lines(spark, folder).select(*_OVERVIEW_COLUMNS), "l_returnflag")
    return out.withColumn("advice", F.array_join("advice", ","))


# ---- whole reports, value by value ---------------------------------------------------


def _values(report):
    """`(chart_id, section, row_no, key, text, number)`: numbers rounded by their size."""
    x = F.col("value").try_cast("double")
    number = F.when(F.abs(x) < 100, F.round(x, 6)).when(F.abs(x) < 1e6, F.round(x, 4)).otherwise(F.round(x)) + F.lit(0.0)
    return report.select("chart_id", "section", "row_no", "key", F.when(x.isNull(), F.col("value")).alias("text"), number.alias("number"))


def _chart(name, order, columns, sql, section="exploratory"):
    """One chart's SQL, numbered by `order`, with a row for each of its columns."""
    cells = " UNION ALL ".join(f"SELECT row_no, '{c}' AS key, \"{c}\"::VARCHAR AS value FROM n" for c in columns.split())
    return f"SELECT '{name}' AS chart_id, '{section}' AS section, row_no, key, value FROM (WITH t0 AS ({sql}), n AS (SELECT *, (row_number() OVER (ORDER BY {order}))::INTEGER AS row_no FROM t0) {cells})"


def _report_sql(ctes, charts):
    return (
        f"WITH {ctes}, v AS (SELECT *, try_cast(value AS DOUBLE) AS x FROM ({' UNION ALL '.join(charts)})) SELECT chart_id, section, row_no, key, "
        "CASE WHEN x IS NULL THEN value END AS text, CASE WHEN abs(x) < 100 THEN round(x, 6) WHEN abs(x) < 1e6 THEN round(x, 4) ELSE round(x) END + 0.0 AS number FROM v"
    )


def _hist(columns, k, source):
    parts = per_column(columns, _HIST.format(c="{c}", k=k, source=source))
    return f'SELECT "column", bin, low, high, n, {short("low")} || \' to \' || {short("high")} AS label FROM ({parts})'


def _tops(columns, source, k):
    counts = per_column(columns, f"SELECT '{{c}}' AS \"column\", coalesce({{c}}::VARCHAR, '<missing>') AS value, count(*) AS n, (SELECT count(*) - count({{c}}) FROM {source}) AS gaps FROM {source} GROUP BY ALL")
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS rank, sum(n) OVER (PARTITION BY \"column\") AS total FROM ({counts})) WHERE rank <= {k}"


def _pairs(columns, source):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {_corr(a, b, source)} AS correlation FROM {source}" for i, a in enumerate(columns) for b in columns[i + 1 :]
    )


_LINES_SQL = f"{GAPPY_SQL}, lines AS (SELECT *, l_extendedprice * 2 AS price_copy, l_returnflag AS returnflag_copy FROM gappy)"
_LINES = (*LINEITEM, "price_copy", "returnflag_copy")
_LINES_NUMERIC = (*LINE_NUMERIC, "price_copy")
_LINES_OTHER = ("l_returnflag", "l_linestatus", "l_shipdate", "returnflag_copy")


def report_lines(spark, folder):
    """Line items with gaps and two columns that follow others, the date kept."""
    return gappy_lines(spark, folder).withColumn("price_copy", F.col("l_extendedprice") * 2).withColumn("returnflag_copy", F.col("l_returnflag"))


def _exploration_sql():
    group = {c: "numeric" for c in _LINES_NUMERIC} | {"l_shipdate": "datetime"}
    gaps = " + ".join(f"count(*) - count({c})" for c in _LINES)
    types = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {i} AS position, '{group.get(c, 'categorical')}' AS dtype_group, count(DISTINCT {c}) AS \"distinct\", count(DISTINCT {c}) / count(*) AS unique_rate, "
        f"{'1.0' if c == 'l_shipdate' else '0.0'}::DOUBLE AS date_share FROM lines"
        for i, c in enumerate(_LINES)
    )
    kind = (
        "CASE WHEN dtype_group = 'numeric' THEN CASE WHEN unique_rate > 0.1 THEN 'continuous' ELSE 'ordinal_numeric' END "
        "WHEN dtype_group = 'datetime' THEN 'datetime' WHEN \"distinct\" <= 20 THEN 'ordinal_or_nominal_low_cardinality' ELSE 'nominal' END"
    )
    q = lambda p: f"quantile_cont({{c}}::DOUBLE, {p})"
    return _report_sql(
        _LINES_SQL,
        [
            _chart(
                "overview", "1", "rows columns missing_cells duplicate_rows numeric_columns other_columns advice",
                f"WITH o AS (SELECT count(*) AS rows, 13 AS columns, {gaps} AS missing_cells, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lines)) AS duplicate_rows, "
                "9 AS numeric_columns, 4 AS other_columns FROM lines) SELECT *, '[\"impute_missing\",' || CASE WHEN duplicate_rows > 0 THEN '\"drop_duplicates\",' ELSE '' END || "
                "'\"review_correlated\",\"investigate_leakage\"]' AS advice FROM o",
            ),
            _chart(
                "numeric_summary", '"column"', "column count mean std min q1 median q3 max",
                per_column(_LINES_NUMERIC, f"SELECT '{{c}}' AS \"column\", count({{c}}) AS count, avg({{c}}) AS mean, stddev_samp({{c}}) AS std, min({{c}})::DOUBLE AS min, {q(0.25)} AS q1, {q(0.5)} AS median, {q(0.75)} AS q3, max({{c}})::DOUBLE AS max FROM lines"),
            ),
            _chart("histograms", '"column", bin', "column bin low high n label", _hist(_LINES_NUMERIC, 20, "lines")),
            _chart("top_values", '"column", rank', "column rank value n", _tops(_LINES_OTHER, "lines", 20)),
            _chart(
                "high_correlations", "round(abs(correlation), 9) DESC, feature_a, feature_b", "feature_a feature_b correlation",
                f"SELECT * FROM ({_pairs(_LINES_NUMERIC, 'lines')}) WHERE abs(correlation) >= 0.75",
            ),
            _chart(
                "leakage", "risk_score DESC, feature", "feature risk_score reasons",
                "SELECT 'returnflag_copy' AS feature, 1.0::DOUBLE AS risk_score, '[\"name_overlap\",\"equals_target\"]' AS reasons FROM lines HAVING avg((returnflag_copy = l_returnflag)::INT) >= 0.98",
            ),
            _chart(
                "semantic_types", "position", "column position dtype_group distinct unique_rate date_share semantic_type", f"SELECT *, {kind} AS semantic_type FROM ({types})"
            ),
            _chart(
                "drift_baseline_numeric", "feature", "feature mean std q05 q50 q95 missing_rate",
                per_column(_LINES_NUMERIC, f"SELECT '{{c}}' AS feature, avg({{c}}) AS mean, stddev_samp({{c}}) AS std, {q(0.05)} AS q05, {q(0.5)} AS q50, {q(0.95)} AS q95, (count(*) - count({{c}})) / count(*) AS missing_rate FROM lines"),
            ),
            _chart(
                "drift_baseline_categorical", "feature, rank", "feature rank value rate missing_rate",
                f"SELECT \"column\" AS feature, rank, value, n / total AS rate, gaps / total AS missing_rate FROM ({_tops(_LINES_OTHER[1:], 'lines', 10)})",
            ),
        ],
    )


@query("exploration_report", _exploration_sql())
def exploration_report(spark, folder):
    return _values(R.exploration_report(report_lines(spark, folder), "l_returnflag"))


def _analytics_sql(ctes, source, columns, numeric, texts, target, charts):
    """The charts that both tasks have, and `charts`."""
    features = [*numeric, *texts]
    moments = lambda f: per_column(numeric, f"SELECT '{{c}}' AS feature, {f} FROM {source}")
    pairs = _pairs(numeric, source)
    key = "md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber))"
    fenced = per_column(numeric, f"SELECT '{{c}}' AS feature, coalesce(sum((iqr <> 0 AND ({{c}} < lo OR {{c}} > hi))::INT), 0)::BIGINT AS outliers FROM {source}, f_{{c}}")
    counted = sum(c in LINE_NUMERIC for c in columns)
    return _report_sql(
        ctes,
        [
            _chart("type_composition", "type", "type count", f"SELECT * FROM (VALUES ('numeric', {counted}), ('categorical', {len(columns) - counted}), ('total', {len(columns)})) v(type, count)"),
            _chart("unique_density", "feature", "feature unique_values unique_ratio", per_column(features, f"SELECT '{{c}}' AS feature, count(DISTINCT {{c}}) AS unique_values, round(count(DISTINCT {{c}}) / count(*), 6) AS unique_ratio FROM {source}")),
            _chart("numeric_skewness", "abs(skewness) DESC, feature", "feature skewness", moments("coalesce(skewness({c}), 0) AS skewness")),
            _chart("numeric_variance", "variance DESC, feature", "feature variance", moments("var_pop({c}) AS variance")),
            _chart(
                "categorical_concentration", "feature", "feature top_category_share distinct_categories non_null_rows",
                per_column(texts, f"SELECT '{{c}}' AS feature, round(max(n) / sum(n), 6) AS top_category_share, count(*) AS distinct_categories, sum(n)::BIGINT AS non_null_rows FROM (SELECT {{c}}, count(*) AS n FROM {source} WHERE {{c}} IS NOT NULL GROUP BY 1)"),
            ),
            _chart("missing_by_column", "missing DESC, \"column\"", "column missing", per_column(columns, f"SELECT '{{c}}' AS \"column\", count(*) - count({{c}}) AS missing FROM {source}")),
            _chart("feature_histograms", '"column", bin', "column bin low high n label", _hist(numeric, 15, source)),
            _chart(
                "correlation_matrix", "feature_a, feature_b", "feature_a feature_b correlation",
                f"WITH p AS ({pairs}) SELECT * FROM p UNION ALL SELECT feature_b, feature_a, correlation FROM p UNION ALL " + " UNION ALL ".join(f"SELECT '{c}', '{c}', 1.0" for c in numeric),
            ),
            _chart(
                "pair_sample", "x, y, \"group\"", "x y group",
                f"SELECT {numeric[0]} AS x, {numeric[1]} AS y, {target}::VARCHAR AS \"group\" FROM {source} WHERE {numeric[0]} IS NOT NULL AND {numeric[1]} IS NOT NULL AND {target} IS NOT NULL ORDER BY {key} LIMIT 800",
            ),
            _chart("outliers", "feature", "feature outliers", f"WITH {fences_cte(numeric, source)} {fenced}"),
            *charts,
        ],
    )


_REPORTED = LINEITEM[4:]
_GRID_SQL = f"WITH {MULTI_SQL}, {_CLASSES}"
_CLASS_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_CLASS_SQL = _analytics_sql(
    GAPPY_SQL, "gappy", _REPORTED, _CLASS_NUMERIC, ("l_linestatus", "l_shipdate"), "l_returnflag",
    [
        _chart(
            "feature_ranking", "round(score, 9) DESC, feature", "feature score",
            _mi_sql(GAPPY_SQL, "gappy", _CLASS_NUMERIC, ("l_linestatus",), "l_returnflag", "l_discount IS NOT NULL AND l_returnflag IS NOT NULL").replace("round(score, 6) + 0.0", "score"),
        ),
        _chart("class_distribution", "rank", "label n rank", "SELECT coalesce(l_returnflag, '<missing>') AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) AS rank FROM gappy GROUP BY 1"),
        _chart(
            "quartiles_by_class", "class", "class q1 median q3",
            "SELECT l_returnflag AS class, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.75) AS q3 FROM gappy WHERE l_returnflag IS NOT NULL GROUP BY 1",
        ),
        _chart(
            "class_rates", "category, class", "category class total rate",
            "SELECT l_linestatus AS category, l_returnflag AS class, (sum(count(*)) OVER (PARTITION BY l_linestatus))::BIGINT AS total, count(*) / sum(count(*)) OVER (PARTITION BY l_linestatus) AS rate FROM gappy WHERE l_returnflag IS NOT NULL GROUP BY 1, 2",
        ),
        _chart("confusion_matrix", "y_true, y_pred", "y_true y_pred n rate", f"{_GRID_SQL} SELECT y_true, y_pred, n, coalesce(n / nullif(sum(n) OVER (PARTITION BY y_true), 0), 0) AS rate FROM m", "model_evaluation"),
        _chart(
            "class_report", "label", "label precision recall f1 support",
            f"{_GRID_SQL} SELECT label, precision, recall, f1, support FROM f UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM f UNION ALL "
            "SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM f",
            "model_evaluation",
        ),
        _chart(
            "metrics", "1", "accuracy precision recall f1_score balanced_accuracy",
            f"{_GRID_SQL} SELECT sum(hits) / sum(support) AS accuracy, sum(precision * support) / sum(support) AS precision, sum(recall * support) / sum(support) AS recall, "
            "sum(f1 * support) / sum(support) AS f1_score, avg(recall) FILTER (support > 0) AS balanced_accuracy FROM f",
            "model_evaluation",
        ),
    ],
)


@query("analytics_report_classes", _CLASS_SQL)
def analytics_report_classes(spark, folder):
    return _values(R.analytics_report(gappy_lines(spark, folder), "l_returnflag", LINE_KEY, "classification", multi_scores(spark, folder)))


_PRICE_NUMERIC = ("l_quantity", "l_discount", "l_tax")
_PRICE_SQL = "li AS (SELECT * REPLACE (l_tax + 0 AS l_tax, l_discount + 0 AS l_discount) FROM lineitem)"
_SAMPLED = f"WITH {REGRESSION_SQL} SELECT y_true AS actual, y_pred AS predicted, e AS residual FROM scored ORDER BY md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber)) LIMIT 2000"
_REGRESSION_REPORT_SQL = _analytics_sql(
    _PRICE_SQL, "li", _REPORTED, _PRICE_NUMERIC, ("l_returnflag", "l_linestatus", "l_shipdate"), "l_extendedprice",
    [
        _chart(
            "feature_ranking", "round(score, 9) DESC, feature", "feature score",
            _mi_sql(
                _PRICE_SQL, "li", _PRICE_NUMERIC, ("l_returnflag", "l_linestatus"),
                "len(list_filter((SELECT list_distinct(quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) FROM li), lambda q: q < b.l_extendedprice))::VARCHAR", "true",
            ).replace("round(score, 6) + 0.0", "score"),
        ),
        _chart("target_histogram", "bin", "column bin low high n label", _hist(("l_extendedprice",), "(SELECT least(greatest(count(l_extendedprice) // 50, 8), 25) FROM li)", "li")),
        _chart("target_sample", "x, y", "x y", "SELECT l_quantity AS x, l_extendedprice AS y FROM li WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL ORDER BY md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber)) LIMIT 1200"),
        _chart("mean_target", "category", "category target_mean", "SELECT l_returnflag AS category, avg(l_extendedprice) AS target_mean FROM li GROUP BY 1"),
        _chart(
            "residual_histogram", "bin", "column bin low high n label",
            "SELECT * REPLACE ('residual' AS \"column\") FROM (" + f"WITH {REGRESSION_SQL} " + _hist(("e",), "(SELECT least(greatest(count(e) // 50, 10), 25) FROM scored)", "scored") + ")",
            "model_evaluation",
        ),
        _chart("residuals_vs_predicted", "predicted, residual", "predicted residual", _SAMPLED, "model_evaluation"),
        _chart("actual_vs_predicted", "actual, predicted", "actual predicted", _SAMPLED, "model_evaluation"),
        _chart(
            "metrics", "1", "rmse mse mae r2_score explained_variance median_ae mape",
            f"WITH {REGRESSION_SQL} SELECT sqrt(avg(e * e)) AS rmse, avg(e * e) AS mse, avg(abs(e)) AS mae, 1 - avg(e * e) / var_pop(y_true) AS r2_score, "
            "1 - var_pop(e) / var_pop(y_true) AS explained_variance, quantile_cont(abs(e), 0.5) AS median_ae, avg(abs(e) / greatest(abs(y_true), 1e-8)) AS mape FROM scored",
            "model_evaluation",
        ),
        _chart(
            "residual_summary", "1", "mean_residual_bias large_residual_limit large_residual_count",
            f"WITH {REGRESSION_SQL}, p AS (SELECT quantile_cont(abs(e), 0.95) AS p95 FROM scored) SELECT avg(e) AS mean_residual_bias, any_value(p95) AS large_residual_limit, count(*) FILTER (abs(e) >= p95) AS large_residual_count FROM scored, p",
            "model_evaluation",
        ),
    ],
)


@query("analytics_report_regression", _REGRESSION_REPORT_SQL)
def analytics_report_regression(spark, folder):
    return _values(R.analytics_report(read(spark, folder, "lineitem"), "l_extendedprice", LINE_KEY, "regression", regression_scores(spark, folder)))


@query("exploration_report_charts", f"SELECT chart_id, count(DISTINCT row_no) AS rows FROM ({_exploration_sql()}) GROUP BY 1")
def exploration_report_charts(spark, folder):
    """How many rows each chart of the exploratory report has."""
    report = R.exploration_report(report_lines(spark, folder), "l_returnflag")
    return report.groupBy("chart_id").agg(F.count_distinct("row_no").alias("rows"))
