"""Type groups, semantic types and task types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.expr import as_column, at_least_one, quoted

# Thresholds of the typing rules.
CONTINUOUS_RATE = 0.1
DATE_SHARE = 0.8
LOW_CARDINALITY = 20
HIGH_CARDINALITY_RATE = 0.3
MAX_CLASSES = 20
TASK_RATES = {"report": 0.2, "training": 0.05}


def type_group(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "categorical"
    raise TypeError(f"columns of type {dtype.simpleString()} are not tabular; flatten or drop them")


def type_groups(df: DataFrame) -> dict[str, str]:
    return {f.name: type_group(f.dataType) for f in df.schema.fields}


def columns_of(df: DataFrame, *groups: str, exclude: Sequence[str] = ()) -> list[str]:
    """Column names of the given type groups, in schema order."""
    return [c for c, g in type_groups(df).items() if g in groups and c not in set(exclude)]


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return columns_of(df, "numeric", exclude=exclude)


def other_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return columns_of(df, "datetime", "boolean", "categorical", exclude=exclude)


def normalised(df: DataFrame) -> DataFrame:
    """One notion of missing: NaN becomes null.  Negative zero becomes zero."""
    out = []
    for f in df.schema.fields:
        c = quoted(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = (F.when(~F.isnan(c), c) + F.lit(0.0)).cast(f.dataType).alias(f.name)
        out.append(c)
    return df.select(*out)


def semantic_type(group: Column | str, distinct: Column | str, rows: Column | str, date_share: Column | str) -> Column:
    """Semantic type from the type group, the distinct rate and the share of date-like text."""
    group, distinct = as_column(group), as_column(distinct)
    rate = distinct / at_least_one(rows)
    return (
        F.when(group == "numeric", F.when(rate > CONTINUOUS_RATE, "continuous").otherwise("ordinal_numeric"))
        .when(group.isin("datetime", "boolean"), group)
        .when(as_column(date_share) >= DATE_SHARE, "datetime_like")
        .when(distinct <= LOW_CARDINALITY, "ordinal_or_nominal_low_cardinality")
        .otherwise("nominal")
    )


def task_type(group: Column | str, distinct: Column | str, rows: Column | str, rule: str = "report") -> Column:
    """`classification` or `regression`.

    The report rule counts non-null rows and allows a rate up to 0.2; the training
    rule counts all rows and asks for a rate below 0.05.
    """
    group, distinct = as_column(group), as_column(distinct)
    rate = distinct / at_least_one(rows)
    few = (rate <= TASK_RATES["report"]) if rule == "report" else (rate < TASK_RATES["training"])
    return F.when((group != "numeric") | ((distinct <= MAX_CLASSES) & few), "classification").otherwise("regression")


def detect_task(df: DataFrame, target: str, rule: str = "report") -> DataFrame:
    """One row `(target, distinct, rows, task_type)`."""
    if target not in df.columns:
        raise ValueError(f"target column '{target}' is missing")
    group = type_groups(df.select(quoted(target)))[target]
    y = normalised(df.select(quoted(target))).select(quoted(target).alias("y"))
    # distinct count through a grouped count: the hot class is combined before the shuffle
    counts = y.groupBy("y").agg(F.count("*").alias("n"))
    rows = F.sum("n") if rule == "training" else F.sum(F.when(F.col("y").isNotNull(), F.col("n")))
    stats = counts.agg(F.count("y").alias("distinct"), F.coalesce(rows, F.lit(0)).alias("rows"))
    return stats.select(
        F.lit(target).alias("target"),
        "distinct",
        "rows",
        task_type(F.lit(group), "distinct", "rows", rule).alias("task_type"),
    )
