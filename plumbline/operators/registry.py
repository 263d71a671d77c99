"""Catalog operators: datasets, training jobs, trained models and experiment runs as tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expr import quoted
from plumbline.operators.ranks import top_per_group

# What each entity is searched by, its id, and how many hits are listed.
SEARCH_FIELDS = {
    "jobs": ("job_id", ("job_id", "target_column", "task_type", "status")),
    "datasets": ("dataset_id", ("name", "filename", "target_column", "task_type")),
    "models": ("model_id", ("model_name", "model_type", "task_type", "job_id")),
}
LISTED_HITS = 20


def models_with_context(models: DataFrame, jobs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Models with their job (required) and its dataset (optional).

    Join strategy is left to the optimizer: it broadcasts a side by its measured size.
    """
    return models.join(jobs, "job_id").join(datasets, "dataset_id", "left")


def runs_with_jobs(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    return runs.join(jobs, "job_id")


def filtered(
    table: DataFrame, job_id=None, status: str | None = None, deployed: bool = False, examples: bool = False
) -> DataFrame:
    """Catalog filters; each is pushed to the scan."""
    if job_id is not None:
        table = table.filter(F.col("job_id") == F.lit(job_id))
    if status is not None:
        table = table.filter(F.col("status") == status)
    if deployed:
        table = table.filter(F.col("is_deployed"))
    if examples:
        table = table.filter(F.col("is_example"))
    return table


def newest_first(table: DataFrame, time: str = "created_at", key: str = "id", n: int | None = None) -> DataFrame:
    ordered = table.orderBy(quoted(time).desc(), quoted(key))
    return ordered if n is None else ordered.limit(n)


def search(query: str, jobs: DataFrame, datasets: DataFrame, models: DataFrame) -> DataFrame:
    """Case-insensitive substring search over four fields of each entity.

    `(entity, id, rank, total)`: the first 20 hits in id order and the number of all hits.
    An empty query matches everything.
    """
    q = query.strip().lower()
    hits = []
    for entity, table in (("jobs", jobs), ("datasets", datasets), ("models", models)):
        key, fields = SEARCH_FIELDS[entity]
        text = lambda f: F.lower(F.coalesce(quoted(f).cast("string"), F.lit("")))
        matches = reduce(lambda a, b: a | b, [F.contains(text(f), F.lit(q)) for f in fields])
        hits.append(table.filter(matches).select(F.lit(entity).alias("entity"), quoted(key).cast("long").alias("id")))
    found = reduce(DataFrame.unionByName, hits)
    totals = found.groupBy("entity").agg(F.count("*").alias("total"))
    listed = top_per_group(found, ["entity"], [F.col("id")], LISTED_HITS)
    # at most one row per entity on the broadcast side
    return listed.join(F.broadcast(totals), "entity").select("entity", "id", "rank", "total")


def dashboard_counts(jobs: DataFrame, models: DataFrame, datasets: DataFrame) -> DataFrame:
    """`(label, value)` rows: datasets, jobs, completed, failed, models, deployed."""
    row = lambda label: F.lit(label).alias("label")
    number = lambda c: c.cast("long").alias("value")
    job_counts = jobs.agg(
        F.count("*").alias("j"), F.count_if(F.col("status") == "completed").alias("c"), F.count_if(F.col("status") == "failed").alias("f")
    )
    model_counts = models.agg(F.count("*").alias("m"), F.count_if(F.col("is_deployed")).alias("d"))
    as_rows = lambda df, names: df.select(F.inline(F.array(*[F.struct(row(label), number(F.col(c))) for label, c in names])))
    return (
        as_rows(datasets.agg(F.count("*").alias("n")), [("total_datasets", "n")])
        .unionByName(as_rows(job_counts, [("total_jobs", "j"), ("completed_jobs", "c"), ("failed_jobs", "f")]))
        .unionByName(as_rows(model_counts, [("total_models", "m"), ("deployed_models", "d")]))
    )


def deploy(models: DataFrame, model_id: int) -> DataFrame:
    """Marks one model of its job as deployed and the others of that job as not."""
    target = models.filter(F.col("model_id") == model_id).select("job_id").limit(1).collect()
    if not target:
        raise ValueError(f"model {model_id} does not exist")
    flag = F.when(F.col("model_id") == model_id, True).when(F.col("job_id") == F.lit(target[0][0]), False)
    return models.withColumn("is_deployed", F.coalesce(flag, F.col("is_deployed")))


def undeploy(models: DataFrame, model_id: int) -> DataFrame:
    return models.withColumn("is_deployed", F.col("is_deployed") & (F.col("model_id") != model_id))


def shared_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names present in both one-column tables."""
    return a.intersect(b)


def missing_names(wanted: DataFrame, available: DataFrame) -> DataFrame:
    """Names asked for but not available (unsupported or incompatible), in order."""
    return wanted.subtract(available).orderBy(wanted.columns[0])


def replace_jobs(stored: DataFrame, synced: DataFrame, key: str = "job_id") -> DataFrame:
    """Stored rows of every job in `synced` give way to the synced rows (safe to repeat)."""
    kept = stored.join(synced.select(key).distinct(), key, "left_anti")
    return kept.select(*map(quoted, stored.columns)).unionByName(synced)


def align_features(df: DataFrame, features: Sequence[tuple[str, str]]) -> DataFrame:
    """Exactly the listed `(name, type)` columns in order: missing ones null, extras dropped."""
    have = set(df.columns)
    return df.select(*[(quoted(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in features])
