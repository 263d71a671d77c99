"""Report artifacts: long chart rows, one JSON folder per chart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chart_reference(root: str):
    """Where a chart's rows are written."""
    return F.concat(F.lit(root.rstrip("/") + "/chart_id="), F.col("chart_id"))


def save_charts(report: DataFrame, root: str) -> DataFrame:
    """Writes long chart rows partitioned by `chart_id`; returns one reference per chart, with its number of rows.

    The rows are read back with the report's own schema, so the reference tells what was written.
    """
    report.write.mode("overwrite").partitionBy("chart_id").json(root)
    back = report.sparkSession.read.schema(report.schema).json(root)
    per = back.groupBy("chart_id").agg(F.count("*").alias("rows"))
    return per.select("chart_id", "rows", chart_reference(root).alias("path"))


def charts_as_json(report: DataFrame) -> DataFrame:
    """One JSON text per chart row."""
    return report.select("chart_id", F.to_json(F.struct("section", "row_no", "key", "value")).alias("document"))
