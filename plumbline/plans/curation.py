"""Clean a table, store it, and describe what was stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.quality import clean_table
from plumbline.operators.stats import numeric_summary
from plumbline.sources.files import load_table


def clean_and_save(df: DataFrame, path: str, name: str = "cleaned", exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """Writes the cleaned table as parquet; returns its numeric summary and its catalog row.

    Later passes read the stored file, so cleaning runs once.
    """
    target = path.rstrip("/") + ".parquet"
    clean_table(df, exact).write.mode("overwrite").parquet(target)
    stored = load_table(df.sparkSession, target)
    entry = stored.agg(F.count("*").alias("num_rows")).select(
        F.lit(name).alias("name"), F.lit(target).alias("file_path"), "num_rows", F.lit(len(stored.columns)).alias("num_columns")
    )
    return numeric_summary(stored, exact=exact), entry
