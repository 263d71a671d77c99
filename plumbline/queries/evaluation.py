"""Evaluation of scored tables.

Binary: quality label of documents, scored by length.  Three classes: return flag of
line items, predicted from quantity.  Regression: price predicted as 1500 x quantity.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import drift as D
from plumbline.operators import evaluate as V
from plumbline.operators import ranks as K
from plumbline.operators import split as SP
from plumbline.queries.base import LINE_KEY, query, read, rounds
from plumbline.queries.profile import hist_sql

BINARY_SQL = (
    "scored AS (SELECT doc_id, quality::VARCHAR AS y_true, least(n_chars / 5000.0::DOUBLE, 1.0::DOUBLE) AS score, "
    "(least(n_chars / 5000.0::DOUBLE, 1.0::DOUBLE) >= 0.5)::INT::VARCHAR AS y_pred FROM labels JOIN documents USING (doc_id))"
)
MULTI_SQL = (
    "scored AS (SELECT l_returnflag AS y_true, CASE WHEN l_quantity < 20 THEN 'A' WHEN l_quantity < 40 THEN 'N' ELSE 'X' END AS y_pred, l_quantity AS q FROM lineitem)"
)
REGRESSION_SQL = (
    "scored AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice AS y_true, 1500.0::DOUBLE * l_quantity AS y_pred, "
    "l_extendedprice - 1500.0::DOUBLE * l_quantity AS e FROM lineitem)"
)


def binary_scores(spark, folder):
    score = F.least(F.col("n_chars") / F.lit(5000.0), F.lit(1.0))
    truth = read(spark, folder, "labels").select("doc_id", F.col("quality").cast("string").alias("y_true"))
    guess = read(spark, folder, "documents").select("doc_id", score.alias("score"), (score >= 0.5).cast("int").cast("string").alias("y_pred"))
    return V.align(truth, guess, "doc_id")


def multi_scores(spark, folder):
    q = F.col("l_quantity")
    pred = F.when(q < 20, "A").when(q < 40, "N").otherwise("X")
    scores = F.array(q / 50, 1 - q / 50, F.abs(q - 25) / 25)
    return read(spark, folder, "lineitem").select(F.col("l_returnflag").alias("y_true"), pred.alias("y_pred"), scores.alias("scores"))


def regression_scores(spark, folder):
    return read(spark, folder, "lineitem").select(*LINE_KEY, F.col("l_extendedprice").alias("y_true"), (F.col("l_quantity") * 1500.0).alias("y_pred"))


@query("align_predictions", f"WITH {BINARY_SQL} SELECT doc_id, y_true, y_pred, round(score, 6) AS score FROM scored")
def align_predictions(spark, folder):
    return rounds(binary_scores(spark, folder))


_GRID = (
    "labels_ AS (SELECT y_true AS l FROM scored UNION SELECT y_pred FROM scored), g AS (SELECT a.l AS y_true, b.l AS y_pred FROM labels_ a, labels_ b), "
    "c AS (SELECT y_true, y_pred, count(*) AS n FROM scored GROUP BY ALL), m AS (SELECT g.y_true, g.y_pred, coalesce(n, 0)::BIGINT AS n FROM g LEFT JOIN c USING (y_true, y_pred))"
)


@query(
    "confusion_of_many_labels",
    "WITH s AS (SELECT o_custkey::VARCHAR AS y_true, (o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 ELSE 0 END)::VARCHAR AS y_pred FROM orders), "
    "c AS (SELECT y_true, y_pred, count(*) AS n FROM s GROUP BY ALL), m AS (SELECT *, (sum(n) OVER (PARTITION BY y_true))::BIGINT AS support, "
    "(sum(n) OVER (PARTITION BY y_pred))::BIGINT AS predicted FROM c) "
    "SELECT *, round(n / support, 6) + 0.0 AS of_true, round(n / predicted, 6) + 0.0 AS of_pred FROM m",
)
def confusion_of_many_labels(spark, folder):
    """A label a customer: the occurring cells with their marginals, no grid."""
    shift = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 7).otherwise(0)
    scored = read(spark, folder, "orders").select(F.col("o_custkey").alias("y_true"), (F.col("o_custkey") + shift).alias("y_pred"))
    return rounds(V.confusion_rates(scored))


@query(
    "confusion_matrix",
    f"WITH {MULTI_SQL}, {_GRID} SELECT y_true, y_pred, n, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY y_true), 0), 0), 6) + 0.0 AS rate FROM m",
)
def confusion_matrix(spark, folder):
    return rounds(V.confusion_matrix(multi_scores(spark, folder)))


@query("label_union", f"WITH {MULTI_SQL} SELECT y_true AS label FROM scored UNION SELECT y_pred FROM scored")
def label_union(spark, folder):
    return V.label_union(V.confusion_cells(multi_scores(spark, folder)))


_CLASSES = (
    f"{_GRID}, k AS (SELECT l AS label, (SELECT sum(n) FROM m WHERE y_true = l) AS support, (SELECT sum(n) FROM m WHERE y_pred = l) AS predicted, "
    "(SELECT sum(n) FROM m WHERE y_true = l AND y_pred = l) AS hits FROM labels_), p AS (SELECT label, support::BIGINT AS support, hits, coalesce(hits / nullif(predicted, 0), 0) AS precision, "
    "coalesce(hits / nullif(support, 0), 0) AS recall FROM k), f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM p)"
)
_REPORT = (
    "SELECT label, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall, round(f1, 6) + 0.0 AS f1, support FROM f UNION ALL "
    "SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM f UNION ALL "
    "SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), "
    "round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM f"
)
_METRICS = (
    "SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall, "
    "round(sum(f1 * support) / sum(support), 6) AS f1_score, round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy FROM f"
)


@query("class_report", f"WITH {MULTI_SQL}, {_CLASSES} {_REPORT}")
def class_report(spark, folder):
    return rounds(V.class_report(multi_scores(spark, folder)))


@query("class_report_binary", f"WITH {BINARY_SQL}, {_CLASSES} {_REPORT}")
def class_report_binary(spark, folder):
    return rounds(V.class_report(binary_scores(spark, folder)))


@query("classification_metrics", f"WITH {MULTI_SQL}, {_CLASSES} {_METRICS}")
def classification_metrics(spark, folder):
    return rounds(V.classification_metrics(multi_scores(spark, folder)))


@query("classification_metrics_binary", f"WITH {BINARY_SQL}, {_CLASSES} {_METRICS}")
def classification_metrics_binary(spark, folder):
    return rounds(V.classification_metrics(binary_scores(spark, folder)))


_ROC = (
    f"WITH {BINARY_SQL}, c AS (SELECT score, sum((y_true = '1')::INT) AS pos, sum((y_true <> '1')::INT) AS neg FROM scored GROUP BY 1), "
    "w AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM c) "
    "SELECT round(score, 6) AS threshold, round(fp / n, 6) + 0.0 AS fpr, round(tp / p, 6) + 0.0 AS tpr FROM w"
)


@query("roc_curve", _ROC)
def roc_curve(spark, folder):
    return rounds(V.roc_curve(binary_scores(spark, folder), "1"))


@query("roc_curve_bucketed", _ROC)
def roc_curve_bucketed(spark, folder):
    """The bucket-by-bucket running totals that large tables use, forced."""
    return rounds(V.roc_curve(binary_scores(spark, folder), "1", buckets=16))


def _auc(rows, positive):
    return (
        f"(SELECT (sum(r) FILTER (y_true = '{positive}') - count(*) FILTER (y_true = '{positive}') * (count(*) FILTER (y_true = '{positive}') + 1) / 2.0) / "
        f"(count(*) FILTER (y_true = '{positive}')::DOUBLE * count(*) FILTER (y_true <> '{positive}')) FROM (SELECT y_true, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM ({rows})))"
    )


@query("roc_auc", f"WITH {BINARY_SQL} SELECT round({_auc('SELECT y_true, score AS s FROM scored', '1')}::DOUBLE, 6) AS roc_auc")
def roc_auc(spark, folder):
    return rounds(V.roc_auc(binary_scores(spark, folder), "1"))


@query("roc_auc_bucketed", f"WITH {BINARY_SQL} SELECT round({_auc('SELECT y_true, score AS s FROM scored', '1')}::DOUBLE, 6) AS roc_auc")
def roc_auc_bucketed(spark, folder):
    return rounds(V.roc_auc(binary_scores(spark, folder), "1", buckets=16))


_OVR = {"A": "q / 50", "N": "1 - q / 50", "R": "abs(q - 25) / 25"}
_OVR_SQL = (
    f"WITH {MULTI_SQL} SELECT round((("
    + " + ".join(f"{_auc(f'SELECT y_true, {e} AS s FROM scored', c)} * (SELECT count(*) FROM scored WHERE y_true = '{c}')" for c, e in _OVR.items())
    + ") / (SELECT count(*) FROM scored))::DOUBLE, 6) AS roc_auc"
)


@query("roc_auc_multiclass", _OVR_SQL)
def roc_auc_multiclass(spark, folder):
    return rounds(V.roc_auc_multiclass(multi_scores(spark, folder), tuple(_OVR)))


@query("roc_auc_multiclass_bucketed", _OVR_SQL)
def roc_auc_multiclass_bucketed(spark, folder):
    return rounds(V.roc_auc_multiclass(multi_scores(spark, folder), tuple(_OVR), buckets=8))


@query(
    "regression_metrics",
    f"WITH {REGRESSION_SQL} SELECT round(sqrt(avg(e * e)), 3) AS rmse, round(avg(e * e), 1) AS mse, round(avg(abs(e)), 3) AS mae, "
    "round(1 - avg(e * e) / var_pop(y_true), 6) AS r2_score, round(1 - var_pop(e) / var_pop(y_true), 6) AS explained_variance, "
    "round(quantile_cont(abs(e), 0.5), 3) AS median_ae, round(avg(abs(e) / greatest(abs(y_true), 1e-8)), 6) AS mape FROM scored",
)
def regression_metrics(spark, folder):
    out = V.regression_metrics(regression_scores(spark, folder))
    return rounds(out, 3, rmse=3, mse=1, r2_score=6, explained_variance=6, mape=6)


@query(
    "residual_summary",
    f"WITH {REGRESSION_SQL}, p AS (SELECT quantile_cont(abs(e), 0.95) AS p95 FROM scored) SELECT round(avg(e), 4) AS mean_residual_bias, "
    "round(any_value(p95), 4) AS large_residual_limit, count(*) FILTER (abs(e) >= p95) AS large_residual_count FROM scored, p",
)
def residual_summary(spark, folder):
    return rounds(V.residual_summary(regression_scores(spark, folder)), 4)


@query(
    "residual_histogram",
    hist_sql(("e",), "(SELECT least(greatest(count(e) // 50, 10), 25) FROM scored)", "scored", REGRESSION_SQL).replace('SELECT "column", bin', "SELECT 'residual' AS \"column\", bin"),
)
def residual_histogram(spark, folder):
    return rounds(V.residual_histogram(regression_scores(spark, folder)))


@query(
    "residual_sample",
    f"WITH {REGRESSION_SQL} SELECT y_true AS actual, y_pred AS predicted, round(e, 6) AS residual FROM scored ORDER BY md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber)) LIMIT 2000",
)
def residual_sample(spark, folder):
    return rounds(V.residual_sample(regression_scores(spark, folder), LINE_KEY))


_FOLD_SQL = "ntile(5) OVER (PARTITION BY {y} ORDER BY md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber))) - 1"


@query(
    "fold_scores_regression",
    f"WITH f AS (SELECT l_extendedprice AS y, l_extendedprice - 1500.0::DOUBLE * l_quantity AS e, ({_FOLD_SQL.format(y='1')})::INTEGER AS fold FROM lineitem) "
    "SELECT fold, round(1 - avg(e * e) / var_pop(y), 6) AS score FROM f GROUP BY 1",
)
def fold_scores_regression(spark, folder):
    return rounds(V.fold_scores(SP.assign_folds(regression_scores(spark, folder), LINE_KEY), "regression"))


_FOLDED = (
    "f AS (SELECT doc_id, y_true, y_pred, (ntile(5) OVER (PARTITION BY y_true ORDER BY md5(doc_id::VARCHAR)) - 1)::INTEGER AS fold FROM scored), "
    "s AS (SELECT fold, avg((y_true = y_pred)::INT) AS score FROM f GROUP BY 1)"
)


@query("fold_scores_classification", f"WITH {BINARY_SQL}, {_FOLDED} SELECT fold, round(score, 6) AS score FROM s")
def fold_scores_classification(spark, folder):
    return rounds(V.fold_scores(SP.assign_folds(binary_scores(spark, folder), "doc_id", 5, "y_true"), "classification"))


@query(
    "cross_validation_summary",
    f"WITH {BINARY_SQL}, {_FOLDED} SELECT count(*) AS folds, round(avg(score), 6) AS cv_mean, round(stddev_pop(score), 6) AS cv_std FROM s",
)
def cross_validation_summary(spark, folder):
    return rounds(V.fold_summary(V.fold_scores(SP.assign_folds(binary_scores(spark, folder), "doc_id", 5, "y_true"), "classification")))


@query("folds", "SELECT o_orderkey, o_orderpriority, (ntile(5) OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey::VARCHAR)) - 1)::INTEGER AS fold FROM orders")
def folds(spark, folder):
    df = read(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return SP.assign_folds(df, "o_orderkey", 5, "o_orderpriority")


_SPLIT = "row_number() OVER (PARTITION BY {y} ORDER BY md5({k})) <= ceil(count(*) OVER (PARTITION BY {y}) * 0.2::DOUBLE)"


@query("train_test_split", f"SELECT o_orderkey, o_orderpriority, {_SPLIT.format(y='o_orderpriority', k='o_orderkey::VARCHAR')} AS is_test FROM orders")
def train_test_split(spark, folder):
    df = read(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return SP.train_test_split(df, "o_orderkey", "o_orderpriority")


@query(
    "train_test_split_plain",
    f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_SPLIT.format(y='1', k='concat_ws(chr(124), l_orderkey, l_partkey, l_suppkey, l_linenumber)')} AS is_test FROM lineitem",
)
def train_test_split_plain(spark, folder):
    return SP.train_test_split(read(spark, folder, "lineitem").select(*LINE_KEY), LINE_KEY)


@query("sample_rows", "SELECT event_id, event_type FROM events ORDER BY md5(event_id::VARCHAR) LIMIT 300")
def sample_rows(spark, folder):
    return SP.sample_rows(read(spark, folder, "events"), "event_id", 300).select("event_id", "event_type")


@query("union_rows", "SELECT s_suppkey AS key, s_acctbal AS balance FROM supplier UNION ALL SELECT c_custkey, c_acctbal FROM customer")
def union_rows(spark, folder):
    s = read(spark, folder, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    c = read(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    return SP.union_rows(s, c)


@query("row_at_index", "SELECT * FROM customer ORDER BY c_custkey LIMIT 1 OFFSET 137")
def row_at_index(spark, folder):
    return K.row_at(read(spark, folder, "customer"), "c_custkey", 137)


@query("row_at_index_selected", "SELECT * FROM customer ORDER BY c_custkey LIMIT 1 OFFSET 137")
def row_at_index_selected(spark, folder):
    """The selection form that far rows of large tables use, forced."""
    return K.row_at(read(spark, folder, "customer"), "c_custkey", 137, heap_rows=1)


@query(
    "share_in_group",
    "SELECT o_orderpriority AS \"group\", o_orderstatus AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS share FROM orders GROUP BY 1, 2",
)
def share_in_group(spark, folder):
    return rounds(V.prediction_shares(read(spark, folder, "orders"), "o_orderpriority", "o_orderstatus"))


@query(
    "running_totals",
    "SELECT o_orderkey, o_orderpriority, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1)::BIGINT AS one_before FROM orders",
)
def running_totals(spark, folder):
    df = read(spark, folder, "orders").select("o_orderkey", "o_orderpriority", F.lit(1).cast("long").alias("one"))
    return K.running_totals(df, "o_orderkey", ["one"], ["o_orderpriority"], buckets=12).drop("one")


_MODEL_SCORES_SQL = (
    "cv AS (SELECT o_custkey AS model_id, o_totalprice / 500000 AS s FROM orders), h AS (SELECT model_id, avg(s) AS m, stddev_pop(s) AS d FROM cv GROUP BY 1)"
)


@query(
    "model_health",
    f"WITH {_MODEL_SCORES_SQL} SELECT model_id, round(m, 6) AS cv_mean, round(d, 6) + 0.0 AS cv_std, "
    "CASE WHEN d < 0.03 THEN 'stable' WHEN d < 0.08 THEN 'moderate' ELSE 'unstable' END AS stability FROM h",
)
def model_health(spark, folder):
    scores = F.collect_list(F.col("o_totalprice") / 500000).alias("cv_scores")
    models = read(spark, folder, "orders").groupBy(F.col("o_custkey").alias("model_id")).agg(scores)
    return rounds(D.model_health(models).drop("cv_scores"))
