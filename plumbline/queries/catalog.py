"""Catalog operators on tables derived from the test tables.

datasets <- customer, jobs and runs <- orders, models <- lineitem.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import leaderboard as B
from plumbline.operators import registry as G
from plumbline.queries.base import GAPPY_SQL, gappy_lines, query, read, rounds
from plumbline.sources import artifacts, catalog
from plumbline.sources.files import load_table, save_csv

DATASETS_SQL = (
    "datasets AS (SELECT c_custkey AS dataset_id, c_name AS name, lower(c_name) || '.csv' AS filename, c_mktsegment AS target_column, "
    "CASE WHEN c_acctbal > 4000 THEN 'classification' ELSE 'regression' END AS task_type, c_acctbal < 0 AS is_example FROM customer)"
)
JOBS_SQL = (
    "jobs AS (SELECT o_orderkey AS job_id, o_custkey AS dataset_id, o_orderpriority AS target_column, "
    "CASE WHEN o_totalprice > 250000 THEN 'classification' ELSE 'regression' END AS job_task, "
    "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'running' END AS status, o_orderdate AS created_at FROM orders)"
)
_METRIC = "nullif(l_discount, 0)"
MODELS_SQL = (
    "numbered AS (SELECT ((l_orderkey * 1000000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS model_id, l_orderkey AS job_id, "
    "CASE l_returnflag WHEN 'A' THEN 'Forest' WHEN 'N' THEN 'Linear' ELSE 'Boosting' END AS model_name, "
    "CASE WHEN l_linestatus = 'O' THEN 'classification' ELSE 'regression' END AS task_type, l_quantity AS training_time, l_linenumber = 1 AS is_deployed, "
    f"{_METRIC} AS accuracy, CASE WHEN l_tax > 0.04 THEN l_tax END AS r2_score, l_tax + 0 AS map_r2, l_discount + 0 AS map_accuracy, l_suppkey, "
    "CASE WHEN l_quantity > 48 THEN 'failed to fit' END AS error FROM lineitem), "
    "models AS (SELECT *, CASE WHEN accuracy IS NOT NULL THEN accuracy ELSE map_accuracy END AS m_accuracy, coalesce(r2_score, map_r2) AS m_r2 FROM numbered)"
)


def datasets(spark, folder):
    return read(spark, folder, "customer").select(
        F.col("c_custkey").alias("dataset_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lower("c_name"), F.lit(".csv")).alias("filename"),
        F.col("c_mktsegment").alias("target_column"),
        F.when(F.col("c_acctbal") > 4000, "classification").otherwise("regression").alias("task_type"),
        (F.col("c_acctbal") < 0).alias("is_example"),
    )


def jobs(spark, folder):
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "completed").otherwise("running")
    return read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("dataset_id"),
        F.col("o_orderpriority").alias("target_column"),
        F.when(F.col("o_totalprice") > 250000, "classification").otherwise("regression").alias("task_type"),
        status.alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )


def models(spark, folder):
    li = read(spark, folder, "lineitem")
    return li.select(
        (((F.col("l_orderkey") * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).alias("model_id"),
        F.col("l_orderkey").alias("job_id"),
        F.when(F.col("l_returnflag") == "A", "Forest").when(F.col("l_returnflag") == "N", "Linear").otherwise("Boosting").alias("model_name"),
        F.lit("tabular").alias("model_type"),
        F.when(F.col("l_linestatus") == "O", "classification").otherwise("regression").alias("task_type"),
        F.col("l_quantity").alias("training_time"),
        (F.col("l_linenumber") == 1).alias("is_deployed"),
        F.nullif("l_discount", F.lit(0.0)).alias("accuracy"),
        F.when(F.col("l_tax") > 0.04, F.col("l_tax")).alias("r2_score"),
        F.create_map(F.lit("accuracy"), F.col("l_discount") + 0.0, F.lit("r2_score"), F.col("l_tax") + 0.0, F.lit("depth"), F.col("l_linenumber").cast("double")).alias("metrics"),
        F.when(F.col("l_quantity") > 48, "failed to fit").alias("error"),
    )


_PRIMARY = "CASE WHEN task_type = 'classification' THEN m_accuracy ELSE m_r2 END"


@query(
    "leaderboard",
    f"WITH {MODELS_SQL} SELECT job_id, (row_number() OVER (PARTITION BY job_id ORDER BY coalesce({_PRIMARY}, -1e9) DESC, model_id))::INTEGER AS rank, model_id, model_name, "
    f"CASE WHEN task_type = 'classification' THEN 'accuracy' ELSE 'r2_score' END AS metric_name, {_PRIMARY} + 0.0 AS primary_metric, training_time, is_deployed FROM models",
)
def leaderboard(spark, folder):
    return rounds(B.leaderboard(models(spark, folder)), 9)


@query("metric_catalog", "SELECT unnest(['accuracy', 'depth', 'r2_score']) AS metric FROM (SELECT count(*) AS n FROM lineitem) WHERE n > 0")
def metric_catalog(spark, folder):
    return B.metric_catalog(models(spark, folder))


@query(
    "metric_comparison",
    f"WITH {MODELS_SQL}, l AS (SELECT model_name, 'accuracy' AS metric, m_accuracy AS v FROM models UNION ALL SELECT model_name, 'r2_score', m_r2 FROM models "
    "UNION ALL SELECT model_name, 'depth', (model_id % 10)::DOUBLE FROM models) SELECT metric, max(v) FILTER (model_name = 'Forest') AS \"Forest\", "
    "max(v) FILTER (model_name = 'Linear') AS \"Linear\", coalesce(max(v) FILTER (model_name = 'Absent'), 0.0)::DOUBLE AS \"Absent\" FROM l GROUP BY 1",
)
def metric_comparison(spark, folder):
    return B.metric_comparison(models(spark, folder), ("Forest", "Linear", "Absent"), fill=0.0)


@query(
    "merged_metrics",
    f"WITH {MODELS_SQL} SELECT model_id, m_accuracy + 0.0 AS accuracy, m_r2 + 0.0 AS r2_score FROM models",
)
def merged_metrics(spark, folder):
    merged = B.merged_metrics(models(spark, folder))
    return merged.select("model_id", F.col("metrics")["accuracy"].alias("accuracy"), F.col("metrics")["r2_score"].alias("r2_score"))


_BEST = "{agg}({v}, {{'s': coalesce(" + _PRIMARY + ", -1e9), 'i': -model_id}}) FILTER (error IS NULL)"


@query(
    "run_summary",
    f"WITH {MODELS_SQL} SELECT job_id, max(CASE WHEN task_type = 'classification' THEN 'accuracy' ELSE 'r2_score' END) AS primary_metric, "
    + _BEST.format(agg="max_by", v="model_name")
    + " AS best_model, "
    + _BEST.format(agg="max_by", v=_PRIMARY)
    + " + 0.0 AS best_score, count(*) FILTER (error IS NULL) AS models_trained, count(*) FILTER (error IS NOT NULL) AS failed_models FROM models GROUP BY 1",
)
def run_summary(spark, folder):
    return rounds(B.run_summary(models(spark, folder)), 9)


@query(
    "synced_best",
    f"WITH {MODELS_SQL} SELECT job_id, max_by(model_name, {{'s': coalesce(map_r2, -1e9), 'i': -model_id}}) AS best_model, "
    "max_by(map_r2, {'s': coalesce(map_r2, -1e9), 'i': -model_id}) + 0.0 AS best_score, count(*) AS models_trained FROM models GROUP BY 1",
)
def synced_best(spark, folder):
    return rounds(B.synced_best(models(spark, folder), "regression"), 9)


@query(
    "models_with_context",
    f"WITH {DATASETS_SQL}, {JOBS_SQL}, {MODELS_SQL} SELECT m.model_id, m.model_name, j.job_id, j.status, d.dataset_id, d.name FROM models m JOIN jobs j USING (job_id) LEFT JOIN datasets d USING (dataset_id)",
)
def models_with_context(spark, folder):
    j = jobs(spark, folder).select("job_id", "dataset_id", "status")
    d = datasets(spark, folder).select("dataset_id", "name")
    m = models(spark, folder).select("model_id", "model_name", "job_id")
    return G.models_with_context(m, j, d)


@query(
    "runs_with_jobs",
    f"WITH {JOBS_SQL}, runs AS (SELECT l_orderkey AS job_id, max(l_shipdate) AS started_at FROM lineitem GROUP BY 1) "
    "SELECT job_id, status, strftime(started_at, '%Y-%m-%d') AS started FROM runs JOIN jobs USING (job_id)",
)
def runs_with_jobs(spark, folder):
    runs = read(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.max("l_shipdate").alias("started_at"))
    return G.runs_with_jobs(runs, jobs(spark, folder)).select("job_id", "status", F.date_format("started_at", "yyyy-MM-dd").alias("started"))


@query("failed_jobs", f"WITH {JOBS_SQL} SELECT job_id, dataset_id FROM jobs WHERE status = 'failed'")
def failed_jobs(spark, folder):
    return G.filtered(jobs(spark, folder), status="failed").select("job_id", "dataset_id")


@query("deployed_models", f"WITH {MODELS_SQL} SELECT model_id, job_id FROM models WHERE is_deployed")
def deployed_models(spark, folder):
    return G.filtered(models(spark, folder), deployed=True).select("model_id", "job_id")


@query("models_of_job", f"WITH {MODELS_SQL} SELECT model_id FROM models WHERE job_id = 7")
def models_of_job(spark, folder):
    return G.filtered(models(spark, folder), job_id=7).select("model_id")


@query("example_datasets", f"WITH {DATASETS_SQL} SELECT dataset_id, name FROM datasets WHERE is_example")
def example_datasets(spark, folder):
    return G.filtered(datasets(spark, folder), examples=True).select("dataset_id", "name")


def _search_sql(q):
    like = lambda *cols: " OR ".join(f"contains(lower(coalesce({c}::VARCHAR, '')), '{q}')" for c in cols)
    return (
        f"WITH {DATASETS_SQL}, {JOBS_SQL}, {MODELS_SQL}, h AS (SELECT 'jobs' AS entity, job_id AS id FROM jobs WHERE {like('job_id', 'target_column', 'job_task', 'status')} "
        f"UNION ALL SELECT 'datasets', dataset_id FROM datasets WHERE {like('name', 'filename', 'target_column', 'task_type')} "
        f"UNION ALL SELECT 'models', model_id FROM models WHERE {like('model_name', chr(39) + 'tabular' + chr(39), 'task_type', 'job_id')}), "
        "k AS (SELECT *, (row_number() OVER (PARTITION BY entity ORDER BY id))::INTEGER AS rank, count(*) OVER (PARTITION BY entity) AS total FROM h) SELECT * FROM k WHERE rank <= 20"
    )


@query("catalog_search", _search_sql("11"))
def catalog_search(spark, folder):
    return G.search(" 11 ", jobs(spark, folder), datasets(spark, folder), models(spark, folder))


@query("catalog_search_text", _search_sql("auto"))
def catalog_search_text(spark, folder):
    return G.search("AUTO", jobs(spark, folder), datasets(spark, folder), models(spark, folder))


@query(
    "dashboard_counts",
    f"WITH {DATASETS_SQL}, {JOBS_SQL}, {MODELS_SQL} SELECT 'total_datasets' AS label, count(*) AS value FROM datasets UNION ALL SELECT 'total_jobs', count(*) FROM jobs "
    "UNION ALL SELECT 'completed_jobs', count(*) FROM jobs WHERE status = 'completed' UNION ALL SELECT 'failed_jobs', count(*) FROM jobs WHERE status = 'failed' "
    "UNION ALL SELECT 'total_models', count(*) FROM models UNION ALL SELECT 'deployed_models', count(*) FROM models WHERE is_deployed",
)
def dashboard_counts(spark, folder):
    return G.dashboard_counts(jobs(spark, folder), models(spark, folder), datasets(spark, folder))


@query("newest_first", f"WITH {JOBS_SQL} SELECT job_id, strftime(created_at, '%Y-%m-%d') AS created FROM jobs ORDER BY created_at DESC, job_id LIMIT 50")
def newest_first(spark, folder):
    return G.newest_first(jobs(spark, folder), "created_at", "job_id", 50).select("job_id", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query(
    "deploy_model",
    f"WITH {MODELS_SQL}, t AS (SELECT model_id AS t_id, job_id AS t_job FROM models ORDER BY model_id LIMIT 1) SELECT model_id, job_id, "
    "CASE WHEN model_id = t_id THEN true WHEN job_id = t_job THEN false ELSE is_deployed END AS is_deployed FROM models, t",
)
def deploy_model(spark, folder):
    m = models(spark, folder)
    first = m.agg(F.min("model_id")).first()[0]
    return G.deploy(m, first).select("model_id", "job_id", "is_deployed")


@query("shared_names", "SELECT o_custkey AS name FROM orders INTERSECT SELECT c_custkey FROM customer")
def shared_names(spark, folder):
    a = read(spark, folder, "orders").select(F.col("o_custkey").alias("name"))
    return G.shared_names(a, read(spark, folder, "customer").select(F.col("c_custkey").alias("name")))


@query("missing_names", "SELECT o_orderkey AS name FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def missing_names(spark, folder):
    a = read(spark, folder, "orders").select(F.col("o_orderkey").alias("name"))
    return G.missing_names(a, read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("name")))


_SYNCED = "synced AS (SELECT model_id + 1 AS model_id, job_id, model_name FROM models WHERE training_time > 45)"


@query(
    "replace_jobs",
    f"WITH {MODELS_SQL}, {_SYNCED} SELECT model_id, job_id, model_name FROM models WHERE job_id NOT IN (SELECT job_id FROM synced) UNION ALL SELECT * FROM synced",
)
def replace_jobs(spark, folder):
    m = models(spark, folder)
    synced = m.filter(F.col("training_time") > 45).select((F.col("model_id") + 1).alias("model_id"), "job_id", "model_name")
    return G.replace_jobs(m.select("model_id", "job_id", "model_name"), synced)


@query("align_features", "SELECT l_tax + 0 AS l_tax, NULL::DOUBLE AS absent, l_linenumber::DOUBLE AS l_linenumber FROM lineitem")
def align_features(spark, folder):
    out = G.align_features(read(spark, folder, "lineitem"), (("l_tax", "double"), ("absent", "double"), ("l_linenumber", "double")))
    return out.withColumn("l_tax", F.col("l_tax") + 0.0)


@query("csv_round_trip", f"WITH {GAPPY_SQL} SELECT l_orderkey::INTEGER AS l_orderkey, l_quantity, l_discount, l_returnflag FROM gappy")
def csv_round_trip(spark, folder):
    from plumbline.session import scratch_path

    path = scratch_path(spark, "lines") + ".csv"
    save_csv(gappy_lines(spark, folder).select("l_orderkey", "l_quantity", "l_discount", "l_returnflag"), path)
    return load_table(spark, path)


@query(
    "catalog_round_trip",
    f"WITH {MODELS_SQL} SELECT model_id, job_id::VARCHAR AS job_id, model_name, accuracy, map_accuracy, NULL::DOUBLE AS rmse FROM models",
)
def catalog_round_trip(spark, folder):
    from plumbline.session import scratch_path

    root = scratch_path(spark, "catalog")
    catalog.append(models(spark, folder), root, "trained_models")
    back = catalog.read(spark, root, "trained_models")
    return back.select("model_id", "job_id", "model_name", "accuracy", F.col("metrics")["accuracy"].alias("map_accuracy"), "rmse")


_REPORT = "SELECT 'status_' || o_orderstatus AS chart_id, 'exploratory' AS section, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority))::INTEGER AS row_no, o_orderpriority AS key, count(*)::DOUBLE AS value FROM orders GROUP BY o_orderstatus, o_orderpriority"


@query("chart_artifacts", f"SELECT chart_id, count(*) AS rows FROM ({_REPORT}) GROUP BY 1")
def chart_artifacts(spark, folder):
    from plumbline.session import scratch_path

    counts = read(spark, folder, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").cast("double").alias("value"))
    report = counts.select(
        F.concat(F.lit("status_"), "o_orderstatus").alias("chart_id"), F.lit("exploratory").alias("section"), F.lit(1).alias("row_no"), F.col("o_orderpriority").alias("key"), "value"
    )
    return artifacts.save_charts(report, scratch_path(spark, "charts")).drop("path")
