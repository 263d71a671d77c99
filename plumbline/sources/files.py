"""Table sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions.typing import normalised


def load_table(spark: SparkSession, path: str, schema: str | None = None, **options: str) -> DataFrame:
    """A table by file type: parquet, ORC, JSON lines, else CSV with a header.

    CSV types are inferred unless `schema` is given; give it for large files, since
    inference reads them twice.  NaN is read as missing.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.options(**options)
    if kind in ("parquet", "orc", "json"):
        reader = reader.schema(schema) if schema else reader
        return normalised(reader.format(kind).load(path))
    reader = reader.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return normalised(reader.csv(path))


def save_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, one file per partition; empty strings stay distinct from nulls."""
    df.write.mode("overwrite").option("header", True).option("emptyValue", '""').csv(path)
