"""Column and table profiles, read off the shared passes in `stats`."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.expr import at_least_one, lenient_timestamp, quoted, rounded
from plumbline.functions.typing import (
    HIGH_CARDINALITY_RATE,
    columns_of,
    normalised,
    numeric_columns,
    other_columns,
    semantic_type,
    type_groups,
)
from plumbline.operators.stats import (
    distinct_counts,
    duplicate_rows,
    group_of,
    histogram_table,
    missing_counts,
    numeric_summary,
    ranked_values,
    unfold,
    value_frequencies,
)
from plumbline.session import several_passes, settled

# Label of a missing category, and list sizes of the reports.
MISSING_LABEL = "<missing>"
TOP_VALUES = 20
SAMPLE_VALUES = 5
LEAD_ROWS = 64


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).select("rows", F.lit(len(df.columns)).alias("columns"))


def missing_rates(df: DataFrame) -> DataFrame:
    """`(column, position, missing, rows, missing_rate)`."""
    return missing_counts(df).withColumn("missing_rate", F.col("missing") / at_least_one("rows"))


def missing_overview(df: DataFrame) -> DataFrame:
    """One row: total missing cells and their share of all cells."""
    total = missing_counts(df).agg(F.sum("missing").alias("missing_cells"), F.max("rows").alias("rows"))
    cells = at_least_one(F.col("rows") * F.lit(max(len(df.columns), 1)))
    return total.select("missing_cells", rounded(F.col("missing_cells") / cells, 8).alias("missing_rate"))


def missing_ranking(df: DataFrame, k: int | None = None) -> DataFrame:
    ranked = missing_counts(df).select("column", "missing").orderBy(F.col("missing").desc(), "column")
    return ranked if k is None else ranked.limit(k)


def unique_rates(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """`(column, distinct, unique_rate)`."""
    counts = distinct_counts(df, columns, exact)
    rows = missing_counts(df, columns).select("column", "rows")
    return counts.join(F.broadcast(rows), "column").select(
        "column", "distinct", (F.col("distinct") / at_least_one("rows")).alias("unique_rate")
    )


def unique_density(df: DataFrame, target: str | None = None, limit: int | None = None) -> DataFrame:
    features = [c for c in df.columns if c != target][:limit]
    return unique_rates(df, features).select(
        F.col("column").alias("feature"), F.col("distinct").alias("unique_values"), rounded("unique_rate").alias("unique_ratio")
    )


def sample_values(df: DataFrame, key: str | Sequence[str], k: int = SAMPLE_VALUES, columns: Sequence[str] | None = None) -> DataFrame:
    """`(column, samples array<string>)`: first k non-null values in key order.

    The first rows of the table settle every column that is mostly filled, in one scan with
    a bounded heap; only the sparse columns get a scan of their own.
    """
    df = normalised(df)
    keys = [key] if isinstance(key, str) else list(key)
    columns = list(columns or df.columns)
    order = [quoted(n).alias(f"__k{i}") for i, n in enumerate(keys)]
    sort_keys = [f"__k{i}" for i in range(len(keys))]
    text = {c: quoted(c).cast("string") for c in columns}
    lead = df.select(*[t.alias(c) for c, t in text.items()], *order).orderBy(*sort_keys).limit(LEAD_ROWS).collect()
    found: dict[str, list[str]] = {}
    for c in columns:
        values = [r[c] for r in lead if r[c] is not None][:k]
        if len(values) < k and len(lead) == LEAD_ROWS:
            sparse = df.select(text[c].alias("value"), *order).filter(F.col("value").isNotNull())
            values = [r["value"] for r in sparse.orderBy(*sort_keys).limit(k).collect()]
        found[c] = values
    return df.sparkSession.createDataFrame(list(found.items()), "column string, samples array<string>")


def date_shares(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """`(column, date_share)`: share of non-null text that parses as a date, over all rows."""
    columns = list(columns if columns is not None else columns_of(df, "categorical"))
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, date_share double")
    parsed = [F.avg(F.when(quoted(c).isNotNull(), lenient_timestamp(quoted(c)).isNotNull().cast("double"))) for c in columns]
    row = df.agg(*[p.alias(f"p{i}") for i, p in enumerate(parsed)])
    return unfold(
        row,
        [(F.lit(c).alias("column"), F.coalesce(F.col(f"p{i}"), F.lit(0.0)).alias("date_share")) for i, c in enumerate(columns)],
    )


def semantic_types(df: DataFrame, exact: bool = True, limit: int | None = None) -> DataFrame:
    """`(column, dtype_group, distinct, unique_rate, date_share, semantic_type)`."""
    df = df.select(*map(quoted, df.columns[:limit]))
    base = missing_counts(df).select("column", "position", "rows")
    joined = (
        base.join(F.broadcast(group_of(df).select("column", "dtype_group")), "column")
        .join(F.broadcast(distinct_counts(df, exact=exact)), "column")
        .join(F.broadcast(date_shares(df)), "column", "left")
    )
    share = F.when(F.col("dtype_group") == "datetime", 1.0).otherwise(F.coalesce("date_share", F.lit(0.0)))
    return joined.select(
        "column",
        "position",
        "dtype_group",
        "distinct",
        (F.col("distinct") / at_least_one("rows")).alias("unique_rate"),
        rounded(share, 4).alias("date_share"),
        semantic_type("dtype_group", "distinct", "rows", share).alias("semantic_type"),
    )


def column_catalog(df: DataFrame, key: str | Sequence[str], exact: bool = True) -> DataFrame:
    """Stored description of a table: dtype, nulls, distinct values, five samples, five statistics."""
    with several_passes(df) as d:
        stats = numeric_summary(d, exact=exact).select("column", "min", "max", "mean", "std", "median")
        return settled(
            group_of(d).select("column", "position", "dtype")
            .join(F.broadcast(missing_counts(d).select("column", "missing")), "column")
            .join(F.broadcast(distinct_counts(d, exact=exact)), "column")
            .join(F.broadcast(sample_values(d, key)), "column")
            .join(F.broadcast(stats), "column", "left")
        )


def column_profile(df: DataFrame, key: str | Sequence[str], exact: bool = True) -> DataFrame:
    """Everything known about each column, one row per column (all joins are column-sized)."""
    with several_passes(df) as d:
        summary = numeric_summary(d, exact=exact).drop("count")
        return settled(
            group_of(d).select("column", "dtype")
            .join(F.broadcast(missing_rates(d).select("column", "missing", "missing_rate")), "column")
            .join(F.broadcast(semantic_types(d, exact)), "column")
            .join(F.broadcast(sample_values(d, key)), "column")
            .join(F.broadcast(summary), "column", "left")
        )


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = TOP_VALUES) -> DataFrame:
    """`(column, rank, value, n)`; nulls count as a category."""
    columns = list(columns if columns is not None else other_columns(df))
    return ranked_values(value_frequencies(df, columns, MISSING_LABEL), k).select("column", "rank", "value", "n")


def top_value_rates(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """`(column, rank, value, rate)`."""
    columns = list(columns if columns is not None else other_columns(df))
    top = top_values(df, columns, k)
    rows = missing_counts(df, columns).select("column", "rows")
    return top.join(F.broadcast(rows), "column").select(
        "column", "rank", "value", (F.col("n") / at_least_one("rows")).alias("rate")
    )


def categorical_concentration(df: DataFrame, target: str | None = None, limit: int | None = None) -> DataFrame:
    """`(feature, top_category_share, distinct_categories, non_null_rows)`."""
    features = other_columns(df, exclude=[target] if target else [])[:limit]
    return concentration(group_of(df.select(*map(quoted, features))).select("column"), value_frequencies(df, features))


def concentration(all_columns: DataFrame, freq: DataFrame) -> DataFrame:
    """The rows of `categorical_concentration` from `(column, value, n)`."""
    per = freq.filter(F.col("value").isNotNull()).groupBy("column").agg(
        (F.max("n") / F.sum("n")).alias("share"), F.count("*").alias("distinct"), F.sum("n").alias("rows")
    )
    # a column of nulls only keeps a row: share 0, no categories, denominator 1
    return all_columns.join(per, "column", "left").select(
        F.col("column").alias("feature"),
        rounded(F.coalesce("share", F.lit(0.0))).alias("top_category_share"),
        F.coalesce("distinct", F.lit(0)).alias("distinct_categories"),
        F.coalesce("rows", F.lit(1)).alias("non_null_rows"),
    )


def class_distribution(df: DataFrame, target: str, k: int = 25) -> DataFrame:
    return top_values(df, [target], k).select(F.col("value").alias("label"), "n", "rank")


def target_distribution(df: DataFrame, target: str, bins: int = 20) -> DataFrame:
    """`(kind, position, label, n)`: a histogram of a numeric target, else its top 20 values."""
    if type_groups(df)[target] == "numeric":
        hist = histogram_table(df, [target], bins)
        return hist.select(F.lit("numeric").alias("kind"), F.col("bin").alias("position"), "label", "n")
    top = top_values(df, [target], TOP_VALUES)
    return top.select(F.lit("categorical").alias("kind"), (F.col("rank") - 1).alias("position"), F.col("value").alias("label"), "n")


def target_histogram(df: DataFrame, target: str) -> DataFrame:
    """Number of bins follows the row count: one per 50 rows, from 8 to 25.  Text is read as numbers."""
    numbers = df.select(quoted(target).try_cast("double").alias(target))
    return histogram_table(numbers, [target], rows_per_bin=50, bounds=(8, 25))


def feature_histograms(df: DataFrame, target: str | None = None, limit: int | None = None, bins: int = 15) -> DataFrame:
    features = numeric_columns(df, exclude=[target] if target else [])[:limit]
    return histogram_table(df, features, bins)


def type_composition(df: DataFrame) -> DataFrame:
    """`(type, count)` rows: numeric, categorical (all other), total."""
    numeric = len(numeric_columns(df))
    rows = [("numeric", numeric), ("categorical", len(df.columns) - numeric), ("total", len(df.columns))]
    return df.sparkSession.createDataFrame(rows, "type string, count int")


def typing_tally(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row: columns per group (date-like text counts as datetime) and high-cardinality names."""
    types = semantic_types(df, exact)
    crowded = F.when((F.col("dtype_group") == "categorical") & (F.col("unique_rate") > HIGH_CARDINALITY_RATE), F.struct("position", "column"))
    counted = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    group = F.col("dtype_group")
    return types.agg(
        counted(group == "numeric").alias("numeric"),
        counted(group == "categorical").alias("categorical"),
        counted((group == "datetime") | (F.col("semantic_type") == "datetime_like")).alias("datetime"),
        counted(group == "boolean").alias("boolean"),
        F.slice(F.transform(F.array_sort(F.collect_list(crowded)), lambda s: s["column"]), 1, 20).alias("high_cardinality"),
    )


def table_bytes(df: DataFrame) -> DataFrame:
    """One row: estimated size as fixed widths times rows plus text lengths."""
    fixed, texts = 0, []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            texts.append(F.coalesce(F.sum(F.octet_length(quoted(f.name))), F.lit(0)))
        elif isinstance(f.dataType, T.BooleanType):
            fixed += 1
        elif isinstance(f.dataType, (T.IntegerType, T.FloatType, T.DateType)):
            fixed += 4
        elif isinstance(f.dataType, T.DecimalType):
            fixed += 16
        else:
            fixed += 8
    total = reduce(lambda a, b: a + b, texts, F.count("*") * F.lit(fixed))
    return df.agg(total.cast("long").alias("bytes"))


def summary_cards(df: DataFrame) -> DataFrame:
    """`(label, value)`: rows, columns, missing cells, missing rate %, duplicate rows, size in MB."""
    shape = duplicate_rows(df)
    parts = missing_counts(df).agg(F.sum("missing").alias("missing_cells"))
    cells = at_least_one(F.col("rows") * F.lit(max(len(df.columns), 1)))
    one = F.lit(1)
    joined = (
        shape.withColumn("one", one)
        .join(F.broadcast(parts.withColumn("one", one)), "one")
        .join(F.broadcast(table_bytes(df).withColumn("one", one)), "one")
    )
    cards: list[tuple[str, Column]] = [
        ("rows", F.col("rows")),
        ("columns", F.lit(len(df.columns))),
        ("missing_cells", F.col("missing_cells")),
        ("missing_rate_percent", F.round(F.col("missing_cells") / cells * 100, 2)),
        ("duplicate_rows", F.col("duplicates")),
        ("size_mb", F.round(F.col("bytes") / (1024 * 1024), 2)),
    ]
    return unfold(joined, [(F.lit(k).alias("label"), v.cast("double").alias("value")) for k, v in cards])


def preview(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """First n rows in key order as text, nulls as the empty string."""
    head = df.orderBy(*map(quoted, order)).limit(n)
    return head.select(*[F.coalesce(quoted(c).cast("string"), F.lit("")).alias(c) for c in df.columns])

