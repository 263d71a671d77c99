"""Catalog tables: schemas, writing, and idempotent replacement by job."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import stage

# The catalog schemas.
SCHEMAS = {
    "datasets": (
        "dataset_id long, name string, filename string, file_path string, file_size long, num_rows long, num_columns int, "
        "columns_info array<struct<name:string,dtype:string,null_count:long,unique_count:long,sample_values:array<string>>>, "
        "target_column string, task_type string, is_example boolean, preview_data array<map<string,string>>, "
        "created_at timestamp, updated_at timestamp"
    ),
    "training_jobs": (
        "job_id string, dataset_id long, task_type string, target_column string, status string, progress int, "
        "error_message string, config map<string,string>, created_at timestamp, completed_at timestamp"
    ),
    "trained_models": (
        "model_id long, job_id string, model_name string, model_type string, task_type string, file_path string, "
        "is_deployed boolean, accuracy double, f1_score double, roc_auc double, rmse double, mae double, r2_score double, "
        "metrics map<string,double>, feature_importance map<string,double>, confusion_matrix array<array<bigint>>, "
        "roc struct<fpr:array<double>,tpr:array<double>,thresholds:array<double>>, cv_scores array<double>, "
        "training_time double, created_at timestamp"
    ),
    "experiment_runs": (
        "run_id string, job_id string, dataset_id long, target_column string, task_type string, status string, "
        "config map<string,string>, summary_metrics map<string,string>, best_model_name string, best_score double, "
        "error_message string, started_at timestamp, completed_at timestamp"
    ),
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of the catalog schema in order: missing ones null, extras dropped, types cast."""
    from pyspark.sql.types import _parse_datatype_string

    have = set(df.columns)
    fields = _parse_datatype_string(SCHEMAS[table]).fields
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def empty_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


#: Job tables are cut by a hash of the job, not by the job itself: many jobs make no more folders than this.
BUCKETS = 16


def _bucketed(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(BUCKETS)).cast("int"))


def append(df: DataFrame, root: str, table: str) -> None:
    out, path = conform(df, table), os.path.join(root, table)
    if "job_id" in out.columns:
        _bucketed(out).write.mode("append").partitionBy("bucket").parquet(path)
    else:
        out.write.mode("append").parquet(path)


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    bucket = ", bucket int" if "job_id" in empty_table(spark, table).columns else ""
    return spark.read.schema(SCHEMAS[table] + bucket).parquet(os.path.join(root, table)).drop("bucket")


def replace_by_job(df: DataFrame, root: str, table: str = "trained_models") -> None:
    """The rows of exactly the jobs in `df` give way to it; repeating the call changes nothing.

    Only the buckets of these jobs are rewritten: their other jobs' rows are read, staged and written back with the new.
    """
    spark, path = df.sparkSession, os.path.join(root, table)
    fresh = _bucketed(conform(df, table))
    try:
        old = _bucketed(read(spark, root, table))
    except AnalysisException:  # nothing was written yet
        old = fresh.limit(0)
    jobs = fresh.select("job_id", "bucket").distinct()
    others = old.join(F.broadcast(jobs.select("bucket").distinct()), "bucket", "left_semi").join(jobs.select("job_id"), "job_id", "left_anti")
    kept = stage(fresh.unionByName(others), "catalog", small=False)
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
