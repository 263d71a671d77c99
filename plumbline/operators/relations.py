"""Feature-to-target relations: quartiles by class, class rates, samples, mutual information."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.expr import is_finite, quoted
from plumbline.functions.typing import columns_of, normalised, numeric_columns, other_columns, type_groups
from plumbline.operators.quantiles import column_quantiles, group_quantiles
from plumbline.operators.split import sample_rows
from plumbline.operators.stats import QUARTILES, value_frequencies
from plumbline.session import stage

# Fixed value: length of the ranking.
RANKING = 15
MIN_ROWS = 5


def complete_pairs(df: DataFrame, *columns: str) -> DataFrame:
    """The given columns of rows in which none of them is missing."""
    return normalised(df.select(*map(quoted, columns))).na.drop()


def first_numeric(df: DataFrame, target: str, k: int = 1) -> list[str]:
    return numeric_columns(df, exclude=[target])[:k]


def quartiles_by_class(df: DataFrame, target: str, feature: str | None = None, exact: bool = True) -> DataFrame:
    """`(class, q1, median, q3)` of a numeric feature (the first one by default)."""
    feature = feature or first_numeric(df, target)[0]
    q = group_quantiles(complete_pairs(df, feature, target), target, feature, QUARTILES, exact)
    return q.select(F.col("grp").alias("class"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


def top_categories(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent non-null values, ties by value: at most k rows."""
    freq = value_frequencies(df, [column]).filter(F.col("value").isNotNull())
    return freq.orderBy(F.col("n").desc(), "value").limit(k).select("value")


def keep_top_categories(df: DataFrame, column: str, k: int) -> DataFrame:
    """Rows whose category is among the k most frequent (a semi join with k rows)."""
    top = F.broadcast(top_categories(df, column, k))
    return df.join(top, quoted(column).cast("string") == F.col("value"), "left_semi")


def class_rates_by_category(df: DataFrame, target: str, feature: str | None = None, k: int = 8) -> DataFrame:
    """`(category, class, total, rate)`: share of each class inside each of the top categories."""
    feature = feature or other_columns(df, exclude=[target])[0]
    # one grouped count; everything after it works on (categories x classes) rows
    counts = (
        complete_pairs(df, feature, target)
        .groupBy(quoted(feature).cast("string").alias("category"), quoted(target).cast("string").alias("class"))
        .agg(F.count("*").alias("n"))
    )
    return rates_of(counts, k)


def rates_of(counts: DataFrame, k: int = 8) -> DataFrame:
    """The rows of `class_rates_by_category` from `(category, class, n)`."""
    totals = counts.groupBy("category").agg(F.sum("n").alias("total")).orderBy(F.col("total").desc(), "category").limit(k)
    return counts.join(F.broadcast(totals), "category").select(
        "category", "class", "total", (F.col("n") / F.col("total")).alias("rate")
    )


def class_rates_wide(df: DataFrame, target: str, classes: Sequence[str], feature: str | None = None, k: int = 8) -> DataFrame:
    """One row per category, one `rate_<class>` column per class; absent classes are null."""
    long = class_rates_by_category(df, target, feature, k)
    wide = long.groupBy("category", "total").pivot("class", list(classes)).agg(F.first("rate"))
    return wide.select("category", "total", *[quoted(c).alias(f"rate_{c}") for c in classes])


def mean_target_by_category(df: DataFrame, target: str, feature: str | None = None, k: int = 12) -> DataFrame:
    """`(category, target_mean)` for the k categories with most rows."""
    feature = feature or other_columns(df, exclude=[target])[0]
    per = (
        complete_pairs(df, feature, target)
        .groupBy(quoted(feature).cast("string").alias("category"))
        .agg(F.count("*").alias("n"), F.avg(quoted(target).cast("double")).alias("target_mean"))
    )
    return per.orderBy(F.col("n").desc(), "category").limit(k).select("category", "target_mean")


def pair_sample(df: DataFrame, target: str, key: Sequence[str], features: Sequence[str] | None = None, n: int = 800) -> DataFrame:
    """`(x, y, group)` of n complete rows sampled by their key's hash; rows with infinities are then dropped."""
    a, b = features or first_numeric(df, target, 2)
    head = normalised(df).filter(quoted(a).isNotNull() & quoted(b).isNotNull() & quoted(target).isNotNull())
    head = sample_rows(head, key, n)
    rows = head.select(quoted(a).cast("double").alias("x"), quoted(b).cast("double").alias("y"), quoted(target).cast("string").alias("group"))
    return rows.filter(is_finite("x") & is_finite("y"))


def target_sample(df: DataFrame, target: str, key: Sequence[str], feature: str | None = None, n: int = 1200) -> DataFrame:
    """`(x, y)` of n complete rows sampled by their key's hash."""
    feature = feature or first_numeric(df, target)[0]
    head = sample_rows(normalised(df).filter(quoted(feature).isNotNull() & quoted(target).isNotNull()), key, n)
    return head.select(quoted(feature).cast("double").alias("x"), quoted(target).cast("double").alias("y"))


def _bin_column(column: str, cuts: Sequence[float]):
    x = quoted(column).cast("double")
    code = F.lit(0)
    for c in cuts:
        code = code + (x > F.lit(c)).cast("int")
    return code


def mutual_information(
    df: DataFrame, target: str, task: str, bins: int = 10, k: int = RANKING, exact: bool = True, cuts: dict[str, list[float]] | None = None
) -> DataFrame:
    """`(feature, score)`: plug-in mutual information with the target, in nats, best first.

    Numeric features (and a regression target) are cut at their exact deciles; text
    features enter as one indicator per level, each column's first level left out.  Every
    column and every level is scored, on complete rows; one grouped count serves all features,
    and nothing afterwards gathers a column's levels in one task.  Known `cuts` (deciles of the complete rows) save scans.
    """
    df = normalised(df)
    numeric = numeric_columns(df, exclude=[target])
    texts = columns_of(df, "categorical", "boolean", exclude=[target])
    needed = [*numeric, target]
    rows = df.select(*map(quoted, [*numeric, *texts, target]))
    for c in needed:
        rows = rows.filter(quoted(c).isNotNull())
    grid = [i / bins for i in range(1, bins)]
    binned = [*numeric, *([target] if task == "regression" else [])]
    if task == "regression" and type_groups(df)[target] != "numeric":
        raise ValueError("a regression target must be numeric")
    cuts = column_quantiles(rows, binned, grid, exact) if cuts is None else cuts
    cuts = {c: sorted(set(q)) for c, q in cuts.items() if q}
    if not cuts and binned:
        return df.sparkSession.createDataFrame([], "feature string, score double")
    y = _bin_column(target, cuts[target]).cast("string") if task == "regression" else quoted(target).cast("string")
    cells = [_bin_column(c, cuts[c]).cast("string").alias(c) for c in numeric]
    cells += [quoted(c).cast("string").alias(c) for c in texts]
    if not cells:
        return df.sparkSession.createDataFrame([], "feature string, score double")
    counts = stage(
        rows.select(y.alias("__y"), *cells)
        .unpivot(["__y"], [quoted(c) for c in [*numeric, *texts]], "column", "x")
        .groupBy("column", "x", F.col("__y").alias("y"))
        .agg(F.count("*").alias("nxy")),
        "information",
    )
    return information(counts, numeric, texts, k)


def information(counts: DataFrame, numeric: Sequence[str], texts: Sequence[str], k: int = RANKING) -> DataFrame:
    """The ranking from joint counts `(column, x, y, nxy)` of the complete rows."""
    # every feature sees the same rows, so one feature's counts give the target's
    one = [*numeric, *texts][0]
    by_class = counts.filter(F.col("column") == one).groupBy("y").agg(F.sum("nxy").cast("double").alias("ny"))
    n = by_class.agg(F.sum("ny")).first()[0] or 0.0
    if n < MIN_ROWS:
        return counts.sparkSession.createDataFrame([], "feature string, score double")
    # a window holds one level's classes, never a whole column
    level_rows = F.sum("nxy").over(W.partitionBy("column", "x")).cast("double")
    cells = counts.join(by_class, counts["y"].eqNullSafe(by_class["y"])).select("column", "x", "nxy", F.lit(n).alias("n"), level_rows.alias("nx"), "ny")
    term = lambda joint, nx: F.when(joint > 0, joint / F.col("n") * F.ln(joint * F.col("n") / (nx * F.col("ny")))).otherwise(0.0)
    joint = F.col("nxy").cast("double")
    whole = cells.filter(F.col("column").isin(*numeric) if numeric else F.lit(False)).groupBy("column").agg(F.sum(term(joint, F.col("nx"))).alias("score"))
    rest = F.col("n") - F.col("nx")
    # classes that never meet the level contribute only to the "other" side
    absent = F.try_divide(F.max("n") - F.sum("ny"), F.max("n")) * F.coalesce(F.ln(F.try_divide(F.max("n"), F.max(rest))), F.lit(0.0))
    named = cells.filter((~F.col("column").isin(*numeric) if numeric else F.lit(True)) & F.col("x").isNotNull())
    first = named.groupBy("column").agg(F.min("x").alias("x"))
    level = (
        named.join(F.broadcast(first), ["column", "x"], "left_anti")
        .groupBy("column", "x")
        .agg((F.sum(term(joint, F.col("nx")) + term(F.col("ny") - joint, rest)) + absent).alias("score"))
        .select(F.concat_ws("_", "column", "x").alias("feature"), "score")
    )
    scores = whole.select(F.col("column").alias("feature"), "score").unionByName(level)
    clipped = scores.select("feature", F.greatest("score", F.lit(0.0)).alias("score"))
    return clipped.orderBy(F.round("score", 9).desc(), "feature").limit(k)
