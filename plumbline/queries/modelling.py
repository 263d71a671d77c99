"""Preparation, training, scoring and explanation on labelled documents and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.ml import explain as X
from plumbline.ml import prepare as P
from plumbline.ml import score as SC
from plumbline.ml.estimators import ridge, shape_of
from plumbline.ml.train import ROC_ERROR, as_models_table, evaluations_table, train_models
from plumbline.operators.leaderboard import confusion_chart, leaderboard, metric_values, roc_chart
from plumbline.queries.base import GAPPY_SQL, LINE_KEY, gappy_lines, query, read, rounds
from plumbline.session import scratch_path
from plumbline.sources.bundles import ModelBundle


def training_documents(spark, folder):
    """Labelled documents: language, length and toxicity against the quality label."""
    docs = read(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(read(spark, folder, "labels"), "doc_id")


def pricing(spark, folder):
    """Orders with their number of lines and total quantity, to predict the price."""
    lines = read(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    orders = read(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


_SCALED = ", ".join(
    f"round((coalesce({c}, med_{c}) - avg(coalesce({c}, med_{c})) OVER ()) / stddev_pop(coalesce({c}, med_{c})) OVER (), 6) + 0.0 AS {c}_scaled"
    for c in ("l_quantity", "l_discount")
)


@query(
    "fill_and_scale",
    f"WITH {GAPPY_SQL}, m AS (SELECT quantile_cont(l_quantity, 0.5) AS med_l_quantity, quantile_cont(l_discount, 0.5) AS med_l_discount FROM gappy), "
    "o AS (SELECT l_returnflag AS mode FROM gappy WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) "
    f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_SCALED}, coalesce(l_returnflag, mode) AS l_returnflag_text FROM gappy, m, o",
)
def fill_and_scale(spark, folder):
    df = gappy_lines(spark, folder)
    prep = P.fit_preparation(df, "l_extendedprice", ("l_quantity", "l_discount", "l_returnflag"))
    return rounds(prep.filled_and_scaled(df).select(*LINE_KEY, "l_quantity_scaled", "l_discount_scaled", "l_returnflag_text"))


@query("low_cardinality_columns", "SELECT 'o_orderstatus' AS column_name FROM orders HAVING count(DISTINCT o_orderstatus) <= 50 UNION ALL SELECT 'o_orderpriority' FROM orders HAVING count(DISTINCT o_orderpriority) <= 50 UNION ALL SELECT 'o_orderkey' FROM orders HAVING count(DISTINCT o_orderkey) <= 50")
def low_cardinality_columns(spark, folder):
    df = read(spark, folder, "orders")
    kept = P.low_cardinality(df, ("o_orderstatus", "o_orderpriority", "o_orderkey"))
    return spark.createDataFrame([(c,) for c in kept], "column_name string")


@query(
    "dummy_encoding",
    f"WITH {GAPPY_SQL}, m AS (SELECT quantile_cont(l_discount, 0.5) AS med FROM gappy) SELECT l_orderkey::DOUBLE AS l_orderkey, round(coalesce(l_discount, med), 6) + 0.0 AS l_discount, "
    "coalesce((l_returnflag = 'N')::INT, 0)::INTEGER AS \"l_returnflag_N\", (l_linestatus = 'O')::INT::INTEGER AS \"l_linestatus_O\", l_quantity FROM gappy, m",
)
def dummy_encoding(spark, folder):
    df = gappy_lines(spark, folder).select("l_orderkey", "l_discount", "l_returnflag", "l_linestatus", "l_quantity")
    return rounds(P.dummy_encode(df, "l_quantity"))


@query("label_encoding", "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::DOUBLE AS label, o_orderpriority AS decoded FROM orders")
def label_encoding(spark, folder):
    df = read(spark, folder, "orders")
    labels = P.label_levels(df, "o_orderpriority")
    return P.encode_label(df, "o_orderpriority", labels).select("o_orderkey", "label", P.decode_label("label", labels).alias("decoded"))


@query(
    "ridge_regression",
    "WITH s AS (SELECT (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS x, l_extendedprice AS y FROM lineitem) "
    "SELECT round(sum(x * (y - (SELECT avg(y) FROM s))) / (sum(x * x) + 1000), 2) AS coefficient, round(avg(y), 2) AS intercept FROM s",
)
def ridge_regression(spark, folder):
    df = read(spark, folder, "lineitem").select("l_quantity", "l_extendedprice")
    prep = P.fit_preparation(df, "l_extendedprice")
    ready = P.encode_label(prep.model(df).transform(df), "l_extendedprice", None).select("features", "label")
    model = ridge(ready, shape_of(ready, 1, 0), alpha=1000.0).stages[-1]
    return spark.createDataFrame([(round(float(model.coefficients[0]), 2), round(float(model.intercept), 2))], "coefficient double, intercept double")


_PHI = (
    "phi AS (SELECT o_orderkey, 'o_totalprice' AS feature, 0.002::DOUBLE * (o_totalprice - avg(o_totalprice) OVER ()) AS c FROM orders "
    "UNION ALL SELECT o_orderkey, 'o_custkey', -0.5::DOUBLE * (o_custkey - avg(o_custkey) OVER ()) FROM orders)"
)


def _phi(spark, folder):
    return X.linear_contributions(read(spark, folder, "orders"), "o_orderkey", {"o_totalprice": 0.002, "o_custkey": -0.5})


@query("linear_shapley", f"WITH {_PHI} SELECT o_orderkey, feature, round(c, 6) + 0.0 AS contribution FROM phi")
def linear_shapley(spark, folder):
    return rounds(_phi(spark, folder))


@query(
    "linear_shapley_global",
    f"WITH {_PHI}, g AS (SELECT feature, avg(abs(c)) AS m FROM phi GROUP BY 1) SELECT feature, round(m, 6) AS mean_abs_contribution, (row_number() OVER (ORDER BY m DESC, feature))::INTEGER AS rank FROM g",
)
def linear_shapley_global(spark, folder):
    return rounds(X.global_importance(_phi(spark, folder)))


@query(
    "ranked_contributions",
    f"WITH {_PHI} SELECT o_orderkey, feature, round(c, 6) + 0.0 AS contribution, round(abs(c), 6) + 0.0 AS abs_contribution, CASE WHEN c >= 0 THEN 'positive' ELSE 'negative' END AS direction, "
    "(row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(c) DESC, feature))::INTEGER AS rank FROM phi",
)
def ranked_contributions(spark, folder):
    return rounds(X.rank_local(_phi(spark, folder), "o_orderkey"))


@query(
    "signed_top_contributions",
    f"WITH {_PHI}, s AS (SELECT *, CASE WHEN c >= 0 THEN 'positive' ELSE 'negative' END AS direction FROM phi), "
    "k AS (SELECT *, (row_number() OVER (PARTITION BY o_orderkey, direction ORDER BY abs(c) DESC, feature))::INTEGER AS rank FROM s) "
    "SELECT o_orderkey, feature, round(c, 6) + 0.0 AS contribution, direction, rank FROM k WHERE rank <= 1",
)
def signed_top_contributions(spark, folder):
    return rounds(X.signed_top(_phi(spark, folder), "o_orderkey", 1))


def _number_template(c):
    return (
        f"SELECT '{c}' AS feature, 'number' AS input_kind, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
        f"bool_and(abs({c} - round({c})) <= 1e-9) AS integer_like, NULL::VARCHAR AS options, CASE WHEN bool_and(abs({c} - round({c})) <= 1e-9) THEN round(avg({c}))::BIGINT::VARCHAR "
        f"ELSE round(avg({c}), 6)::VARCHAR END AS default_value FROM lineitem"
    )


@query(
    "inference_template",
    " UNION ALL ".join(_number_template(c) for c in ("l_quantity", "l_extendedprice"))
    + " UNION ALL SELECT 'l_returnflag', 'select', NULL, NULL, NULL, NULL, NULL, (SELECT string_agg(f, ',' ORDER BY n DESC, f) FROM (SELECT l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1)), "
    "(SELECT l_returnflag FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    " UNION ALL SELECT 'not_there', 'text', NULL, NULL, NULL, NULL, NULL, NULL, ''",
)
def inference_template(spark, folder):
    out = SC.inference_template(read(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_returnflag", "not_there"])
    return rounds(out.withColumn("options", F.array_join("options", ",")), 4, "mean", "std")


@query("inference_template_random")
def inference_template_random(spark, folder):
    return SC.inference_template(read(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_returnflag"], seed=7).drop("options")


# ---- fits: no SQL twin -------------------------------------------------------------


def _trained(*args, **options):
    """A training run of which every model is there: what failed would be missing from the results below without a word."""
    return train_models(*args, **options).whole()


def _board(run, df):
    table = as_models_table(run, df, "job")
    long = metric_values(table)
    best = leaderboard(table).select("model_id", "rank")
    return long.join(best, "model_id").select("model_name", "rank", "metric", "value")


@query("train_classifiers")
def train_classifiers(spark, folder):
    df = training_documents(spark, folder)
    names = ("Logistic Regression", "Decision Tree", "Random Forest", "KNN")
    run = _trained(df, "quality", "doc_id", "classification", names)
    return _board(run, df)


@query("train_margin_and_boosted_classifiers")
def train_margin_and_boosted_classifiers(spark, folder):
    df = training_documents(spark, folder)
    names = ("Linear SVM", "RBF SVM", "AdaBoost", "Gradient Boosting", "MLP Neural Net")
    return _board(_trained(df, "quality", "doc_id", "classification", names), df)


PRICED = "(SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"


@query(
    "boosted_stump_facts",
    f"SELECT 'rows scored' AS fact, {PRICED} AS n UNION ALL SELECT 'rows with a known class', {PRICED} UNION ALL SELECT 'rows whose votes add up to 1', {PRICED} "
    "UNION ALL SELECT 'folds', 5 UNION ALL SELECT 'importances that add up to 1', 1 UNION ALL SELECT 'no worse than the largest class', 1",
)
def boosted_stump_facts(spark, folder):
    """What must hold for 160 rounds of boosting on the orders, whatever stumps were chosen."""
    df = pricing(spark, folder)
    run = _trained(df, "o_orderstatus", "o_orderkey", "classification", ("AdaBoost",))
    model, known = run.models[0], [str(x) for x in run.labels]
    scored = SC.score(df, ModelBundle.of(run, model, df), ["o_orderkey", "o_orderstatus"])
    total = F.aggregate(F.map_values("probability"), F.lit(0.0), lambda a, b: a + b)
    row = scored.agg(F.count("*"), F.count_if(F.col("prediction").isin(known)), F.count_if(F.abs(total - 1) < 1e-9), F.count_if(F.col("prediction") == F.col("o_orderstatus"))).first()
    largest = df.groupBy("o_orderstatus").count().agg(F.max("count")).first()[0]
    facts = ("rows scored", "rows with a known class", "rows whose votes add up to 1", "folds", "importances that add up to 1", "no worse than the largest class")
    values = (row[0], row[1], row[2], len(model.fold_scores), int(abs(sum(model.importance.values()) - 1) < 1e-9), int(row[3] >= 0.99 * largest))
    return spark.createDataFrame(list(zip(facts, values)), "fact string, n long")


@query(
    "stored_evaluation_facts",
    "SELECT 'models' AS fact, 2::BIGINT AS n UNION ALL SELECT 'cells of both grids', 2 * count(DISTINCT quality) * count(DISTINCT quality) FROM labels JOIN documents USING (doc_id) "
    "UNION ALL SELECT 'grids that hold the test rows', 2 UNION ALL SELECT 'accuracies on the diagonal', 2 UNION ALL SELECT 'curves from (0, 0) to (1, 1)', 2 "
    "UNION ALL SELECT 'curves with the area of the metric', 2 UNION ALL SELECT 'lines of both reports', 2 * (count(DISTINCT quality) + 2) FROM labels JOIN documents USING (doc_id)",
)
def stored_evaluation_facts(spark, folder):
    """What must hold for the confusion grids and ROC curves kept with two trained models, read through the charts."""
    df = training_documents(spark, folder)
    run = _trained(df, "quality", "doc_id", "classification", ("Logistic Regression", "Decision Tree"), folds=0)
    kept, tested = evaluations_table(run, df, "job").persist(), run.test.count()
    grid = confusion_chart(kept)
    sums = {r["model_id"]: r for r in grid.groupBy("model_id").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("row") == F.col("col"), F.col("n"))).alias("hits")).collect()}
    points = roc_chart(kept).orderBy("model_id", "point").collect()
    curves = {i: [(p["fpr"], p["tpr"]) for p in points if p["model_id"] == i] for i in sums}
    area = lambda c: sum((x2 - x1) * (y1 + y2) / 2 for (x1, y1), (x2, y2) in zip(c, c[1:]))
    metrics = [m.metrics for m in run.models]
    facts = [
        ("models", kept.count()),
        ("cells of both grids", grid.count()),
        ("grids that hold the test rows", sum(s["n"] == tested for s in sums.values())),
        ("accuracies on the diagonal", sum(abs(s["hits"] / s["n"] - metrics[i]["accuracy"]) < 1e-9 for i, s in sums.items())),
        ("curves from (0, 0) to (1, 1)", sum(c[0] == (0.0, 0.0) and c[-1] == (1.0, 1.0) for c in curves.values())),
        ("curves with the area of the metric", sum(abs(area(c) - metrics[i]["roc_auc"]) < ROC_ERROR for i, c in curves.items())),
        ("lines of both reports", kept.select(F.explode("class_report")).count()),
    ]
    return spark.createDataFrame(facts, "fact string, n long")


@query("train_multiclass")
def train_multiclass(spark, folder):
    df = pricing(spark, folder)
    return _board(_trained(df, "o_orderstatus", "o_orderkey", None, ("Decision Tree", "Random Forest")), df)


@query("train_regressors")
def train_regressors(spark, folder):
    df = pricing(spark, folder)
    names = ("Linear Regression", "Decision Tree", "Gradient Boosting")
    return _board(_trained(df, "o_totalprice", "o_orderkey", "regression", names), df)


@query("tune_model")
def tune_model(spark, folder):
    df = pricing(spark, folder)
    run = _trained(df, "o_totalprice", "o_orderkey", "regression", ("Linear Regression",), tune=True)
    rows = [(m.name, k, float(v)) for m in run.models for k, v in m.params.items()]
    return spark.createDataFrame(rows, "model_name string, parameter string, value double")


def _forest(spark, folder):
    df = training_documents(spark, folder)
    run = _trained(df, "quality", "doc_id", "classification", ("Random Forest",))
    return df, run


@query("feature_importance")
def feature_importance(spark, folder):
    _, run = _forest(spark, folder)
    return spark.createDataFrame(list(run.models[0].importance.items()), "feature string, importance double")


@query("batch_scoring")
def batch_scoring(spark, folder):
    """Fit, save the bundle, load it, score every document - labelled or not."""
    df, run = _forest(spark, folder)
    path = scratch_path(spark, "bundle")
    ModelBundle.of(run, run.models[0], df).save(spark, path)
    scored = SC.score(read(spark, folder, "documents"), ModelBundle.load(spark, path), ["doc_id"])
    return scored.select("doc_id", "prediction", F.col("probability")["1"].alias("p_1"), "confidence")


@query("sampled_shapley")
def sampled_shapley(spark, folder):
    df, run = _forest(spark, folder)
    bundle = ModelBundle.of(run, run.models[0], df)
    return X.sampled_shapley(read(spark, folder, "documents"), df, bundle, "doc_id", "doc_id")


@query("local_surrogate")
def local_surrogate(spark, folder):
    df, run = _forest(spark, folder)
    bundle = ModelBundle.of(run, run.models[0], df)
    return X.local_surrogate(read(spark, folder, "documents"), df, bundle, "doc_id")


@query(
    "forest_facts",
    "SELECT 'rows scored' AS fact, count(*) AS n FROM documents UNION ALL SELECT 'scores with a class and a probability', count(*) FROM documents "
    "UNION ALL SELECT 'importances that add up to 1', 1 UNION ALL SELECT 'features with an importance', 3 "
    "UNION ALL SELECT 'contributions', 3 * count(*) FROM documents UNION ALL SELECT 'rows whose contributions add up', count(*) FROM documents",
)
def forest_facts(spark, folder):
    """What must hold for a forest, its scores and its explanations, whatever trees were grown."""
    df, run = _forest(spark, folder)
    docs, bundle = read(spark, folder, "documents"), ModelBundle.of(run, run.models[0], df)
    scored = SC.score(docs, bundle, ["doc_id"]).select("doc_id", "prediction", F.col("probability")["1"].alias("p"))
    parts = X.sampled_shapley(docs, df, bundle, "doc_id", "doc_id")
    sums = parts.groupBy("doc_id").agg((F.sum("contribution") + F.first("base_value")).alias("out"))
    fine = F.col("prediction").isin("0", "1") & F.col("p").between(0.0, 1.0)
    facts = scored.agg(F.count("*"), F.count_if(fine)).first()
    added = sums.join(scored, "doc_id").filter(F.abs(F.col("out") - F.col("p")) < 1e-9).count()
    importance = run.models[0].importance
    rows = [
        ("rows scored", facts[0]),
        ("scores with a class and a probability", facts[1]),
        ("importances that add up to 1", int(abs(sum(importance.values()) - 1) < 1e-9)),
        ("features with an importance", len(importance)),
        ("contributions", parts.count()),
        ("rows whose contributions add up", added),
    ]
    return spark.createDataFrame(rows, "fact string, n long")
