"""Seeded synthetic tables with known structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def weighted_choice(u: Column, options: list, weights: list[float]) -> Column:
    """Pick by a uniform draw against running weights."""
    out, reached = F.lit(options[-1]), sum(weights[:-1])
    for option, weight in zip(reversed(options[:-1]), reversed(weights[:-1])):
        out = F.when(u < reached, F.lit(option)).otherwise(out)
        reached -= weight
    return out


def blank_exactly(df: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """Null in exactly n seeded rows (the n lowest draws, found by a bounded heap)."""
    drawn = df.withColumn("__u", F.rand(seed))
    lowest = drawn.orderBy("__u", "row_id").limit(n).select("row_id", F.lit(True).alias("__gap"))
    return (
        drawn.join(F.broadcast(lowest), "row_id", "left")
        .withColumn(column, F.when(F.col("__gap").isNull(), F.col(column)))
        .drop("__u", "__gap")
    )


def passengers(spark: SparkSession, n: int = 891, seed: int = 42) -> DataFrame:
    """Passenger table: weighted categories, clipped draws, 177 + 2 gaps per 891 rows, rule-based target."""
    # Category weights, distribution parameters and survival rule.
    classes, class_w = [1, 2, 3], [0.24, 0.21, 0.55]
    sexes, sex_w = ["male", "female"], [0.65, 0.35]
    siblings, sibling_w = [0, 1, 2, 3, 4, 5, 8], [0.68, 0.23, 0.03, 0.02, 0.02, 0.01, 0.01]
    parents, parent_w = [0, 1, 2, 3, 4, 5, 6], [0.76, 0.13, 0.09, 0.005, 0.004, 0.004, 0.003]
    ports, port_w = ["S", "C", "Q"], [0.72, 0.19, 0.09]
    base = spark.range(n).withColumnRenamed("id", "row_id").select(
        "row_id",
        weighted_choice(F.rand(seed), classes, class_w).alias("pclass"),
        weighted_choice(F.rand(seed + 1), sexes, sex_w).alias("sex"),
        F.greatest(F.lit(1.0), F.least(F.lit(80.0), F.randn(seed + 2) * 14.5 + 29.7)).alias("age"),
        weighted_choice(F.rand(seed + 3), siblings, sibling_w).alias("sibsp"),
        weighted_choice(F.rand(seed + 4), parents, parent_w).alias("parch"),
        F.greatest(F.lit(3.2), F.least(F.lit(512.0), F.exp(F.randn(seed + 5) * 1.2 + 3.2))).alias("fare"),
        weighted_choice(F.rand(seed + 6), ports, port_w).alias("embarked"),
        F.rand(seed + 9).alias("__draw"),
    )
    gaps = blank_exactly(base, "age", round(177 * n / 891), seed + 7)
    gaps = blank_exactly(gaps, "embarked", round(2 * n / 891), seed + 8)
    odds = (
        F.lit(0.1)
        + F.when(F.col("sex") == "female", 0.3).otherwise(0.0)
        + F.when(F.col("pclass") == 1, 0.25).when(F.col("pclass") == 2, 0.1).otherwise(0.0)
        - F.when(F.coalesce("age", F.lit(30.0)) > 60, 0.1).otherwise(0.0)
    )
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), odds))
    return gaps.withColumn("survived", (F.col("__draw") < bounded).cast("int")).drop("__draw")


def classification_frame(spark: SparkSession, n: int = 240, seed: int = 1) -> DataFrame:
    rows = spark.range(n).select(
        F.col("id").alias("row_id"),
        F.randn(seed).alias("x1"),
        (F.randn(seed + 1) * 2 + 1).alias("x2"),
        F.when(F.rand(seed + 2) < 0.5, "A").otherwise("B").alias("cat"),
    )
    score = F.col("x1") + 0.4 * F.col("x2") + F.when(F.col("cat") == "A", 1.0).otherwise(0.0)
    return rows.withColumn("target", F.when(score > 0.8, "yes").otherwise("no"))


def regression_frame(spark: SparkSession, n: int = 260, seed: int = 2) -> DataFrame:
    rows = spark.range(n).select(
        F.col("id").alias("row_id"),
        F.randn(seed).alias("x1"),
        (F.randn(seed + 1) * 1.5 + 2).alias("x2"),
        F.when(F.rand(seed + 2) < 0.4, "east").otherwise("west").alias("region"),
        (F.randn(seed + 3) * 0.5).alias("noise"),
    )
    value = 3.2 * F.col("x1") - 1.1 * F.col("x2") + F.when(F.col("region") == "east", 0.7).otherwise(0.0) + F.col("noise")
    return rows.withColumn("target", value).drop("noise")

