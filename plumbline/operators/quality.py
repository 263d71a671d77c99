"""Quality score and cleaning."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expr import at_least_one, clamp, quoted
from plumbline.functions.typing import columns_of, normalised, numeric_columns
from plumbline.operators.quantiles import column_quantiles, order_stats
from plumbline.operators.stats import duplicate_rows, missing_counts, unfold, value_frequencies
from plumbline.session import settled, several_passes, stage

# Penalties of the quality score, and the fence rule.
MAX_MISSING_PENALTY = 25.0
MAX_DUPLICATE_PENALTY = 20.0
MAX_OUTLIER_PENALTY = 20.0
FENCE_FACTOR = 1.5
MIN_FENCE_ROWS = 5
EMPTY_MODE = "unknown"


def iqr_fences(df: DataFrame, columns: Sequence[str], exact: bool = True) -> dict[str, tuple[float, float]]:
    """Fences per column; columns with fewer than five values or no spread have none."""
    return fences_of(order_stats(df, columns, (0.25, 0.75), exact))


def fences_of(quartiles_of: dict[str, tuple]) -> dict[str, tuple[float, float]]:
    """Fences from `(values, [q1, q3])` per column."""
    fences = {}
    for c, (n, quartiles) in quartiles_of.items():
        if n < MIN_FENCE_ROWS:
            continue
        q1, q3 = quartiles
        spread = q3 - q1
        if spread != 0:
            fences[c] = (q1 - FENCE_FACTOR * spread, q3 + FENCE_FACTOR * spread)
    return fences


def outlier_counts(
    df: DataFrame, columns: Sequence[str] | None = None, limit: int | None = None, keep_zero: bool = True, exact: bool = True
) -> DataFrame:
    """`(feature, outliers)` outside the IQR fences.

    The report form keeps zeros; the quality form keeps only columns with outliers.
    """
    df = normalised(df)
    columns = list(columns if columns is not None else numeric_columns(df))[:limit]
    fences = iqr_fences(df, columns, exact)
    counted, parts = [F.lit(1).alias("one")], []
    for i, c in enumerate(columns):
        x = quoted(c).cast("double")
        lo, hi = fences.get(c, (None, None))
        outside = F.lit(0) if lo is None else F.count_if((x < F.lit(lo)) | (x > F.lit(hi)))
        counted += [outside.cast("long").alias(f"o{i}"), F.count(x).alias(f"n{i}")]
        parts.append((F.lit(c).alias("feature"), F.col(f"o{i}").alias("outliers"), F.col(f"n{i}").alias("n")))
    if not parts:
        return df.sparkSession.createDataFrame([], "feature string, outliers long")
    table = unfold(df.agg(*counted), parts).filter(F.col("n") >= MIN_FENCE_ROWS).select("feature", "outliers")
    return table if keep_zero else table.filter(F.col("outliers") > 0)


def quality_score(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row: size, missing cells, duplicates, outliers, score and advice codes."""
    with several_passes(df) as d:
        return settled(_quality_row(d, exact))


def _quality_row(df: DataFrame, exact: bool) -> DataFrame:
    one = F.lit(1).alias("one")
    missing = missing_counts(df).agg(F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_cells")).select("*", one)
    outside = outlier_counts(df, keep_zero=False, exact=exact).agg(F.coalesce(F.sum("outliers"), F.lit(0)).alias("outlier_cells"))
    joined = (
        duplicate_rows(df).select("rows", F.col("duplicates").alias("duplicate_rows"), one)
        .join(F.broadcast(missing), "one")
        .join(F.broadcast(outside.select("*", one)), "one")
    )
    cells = at_least_one(F.col("rows") * F.lit(len(df.columns)))
    rows = at_least_one("rows")
    penalty = (
        F.least(F.lit(MAX_MISSING_PENALTY), F.col("missing_cells") / cells * 100)
        + F.least(F.lit(MAX_DUPLICATE_PENALTY), F.col("duplicate_rows") / rows * 100)
        + F.least(F.lit(MAX_OUTLIER_PENALTY), F.col("outlier_cells") / rows * 100)
    )
    advice = F.array_compact(
        F.array(
            F.when(F.col("missing_cells") > 0, "impute_missing"),
            F.when(F.col("duplicate_rows") > 0, "drop_duplicates"),
            F.when(F.col("outlier_cells") > 0, "cap_outliers"),
        )
    )
    return joined.select(
        "rows",
        F.lit(len(df.columns)).alias("columns"),
        "missing_cells",
        "duplicate_rows",
        "outlier_cells",
        F.round(F.greatest(F.lit(0.0), F.lit(100.0) - penalty), 2).alias("quality_score"),
        F.when(F.size(advice) == 0, F.array(F.lit("clean"))).otherwise(advice).alias("advice"),
    )


@dataclass
class CleaningPlan:
    """What cleaning will do to a table: a few numbers per column."""

    medians: dict[str, float | None] = field(default_factory=dict)
    modes: dict[str, object] = field(default_factory=dict)
    fences: dict[str, tuple[float, float]] = field(default_factory=dict)
    columns: tuple[str, ...] = ()

    def filled(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            x = quoted(c)
            if c in self.medians:
                x = F.coalesce(x.cast("double"), F.lit(self.medians[c]).cast("double"))
            elif c in self.modes:
                x = F.coalesce(x, F.lit(self.modes[c]).cast(df.schema[c].dataType))
            out.append(x.alias(c))
        return df.select(*out)

    def apply(self, df: DataFrame) -> DataFrame:
        """Fill and clip: a projection, so any number of rows streams through it."""
        filled = self.filled(normalised(df))
        return filled.select(
            *[clamp(quoted(c), *map(float, self.fences[c])).alias(c) if c in self.fences else quoted(c) for c in filled.columns]
        )


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent text of each column, the lowest on ties; None where all is null."""
    if not columns:
        return {}
    freq = value_frequencies(df, columns).filter(F.col("value").isNotNull())
    best = freq.groupBy("column").agg(F.min_by("value", F.struct((-F.col("n")).alias("n"), F.col("value"))).alias("mode"))
    got = {r["column"]: r["mode"] for r in best.collect()}
    return {c: got.get(c) for c in columns}


def fit_cleaning(df: DataFrame, exact: bool = True) -> CleaningPlan:
    """Learn fills and fences from an already de-duplicated table (fences after filling)."""
    df = normalised(df)
    numeric = numeric_columns(df)
    texts = columns_of(df, "categorical", "boolean")
    holes = {r["column"] for r in missing_counts(df).filter(F.col("missing") > 0).collect()}
    medians = {c: (q[0] if q else None) for c, q in column_quantiles(df, [c for c in numeric if c in holes], (0.5,), exact).items()}
    modes = {}
    for c, mode in column_modes(df, [c for c in texts if c in holes]).items():
        boolean = df.schema[c].dataType.simpleString() == "boolean"
        modes[c] = (mode == "true" if mode is not None else None) if boolean else (mode if mode is not None else EMPTY_MODE)
    plan = CleaningPlan(medians, {c: m for c, m in modes.items() if m is not None}, {}, tuple(df.columns))
    plan.fences = iqr_fences(plan.filled(df), numeric, exact)
    return plan


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Distinct rows; copies combine inside each task first, so a hot row is one row per task."""
    return normalised(df).dropDuplicates()


def clean_table(df: DataFrame, exact: bool = True) -> DataFrame:
    """De-duplicate, fill (median, mode), clip to the IQR fences - in that order."""
    distinct = stage(drop_duplicates(df), "distinct")
    return fit_cleaning(distinct, exact).apply(distinct)


def cleaning_log(df: DataFrame, exact: bool = True) -> DataFrame:
    """`(step, column, n)`: rows dropped, cells filled and cells clipped by `clean_table`; zeros left out."""
    distinct = stage(drop_duplicates(df), "distinct")
    plan = fit_cleaning(distinct, exact)
    filled = plan.filled(distinct)
    before = df.agg(F.count("*").alias("n"))
    after = distinct.agg(F.count("*").alias("n"), *[F.count(quoted(c)).alias(f"k{i}") for i, c in enumerate(distinct.columns)])
    clipped = [
        F.count_if((quoted(c).cast("double") < F.lit(lo)) | (quoted(c).cast("double") > F.lit(hi))).alias(f"c{i}")
        for i, (c, (lo, hi)) in enumerate(plan.fences.items())
    ]
    row = lambda step, column, n: (F.lit(step).alias("step"), F.lit(column).alias("column"), n.cast("long").alias("n"))
    fills = [c for c in distinct.columns if c in plan.medians or c in plan.modes]
    position = {c: i for i, c in enumerate(distinct.columns)}
    one = F.lit(1).alias("one")
    counts = before.select(F.col("n").alias("all_rows"), one).join(F.broadcast(after.select("*", one)), "one")
    log = unfold(
        counts,
        [
            row("drop_duplicates", "", F.col("all_rows") - F.col("n")),
            *[row("fill_median" if c in plan.medians else "fill_mode", c, F.col("n") - F.col(f"k{position[c]}")) for c in fills],
        ],
    )
    if clipped:
        cut = unfold(filled.agg(*clipped), [row("clip", c, F.col(f"c{i}")) for i, c in enumerate(plan.fences)])
        log = log.unionByName(cut)
    return log.filter(F.col("n") > 0)


def clean_preview(df: DataFrame, order: Sequence[str], n: int = 10, exact: bool = True) -> DataFrame:
    """First n rows of the cleaned table as text, with the number of rows after cleaning beside them."""
    from plumbline.operators.profile import preview

    cleaned = clean_table(df, exact)
    rows = cleaned.agg(F.count("*").alias("rows_after_cleaning")).withColumn("one", F.lit(1))
    head = preview(cleaned, order, n).withColumn("one", F.lit(1))
    return head.join(F.broadcast(rows), "one").drop("one")
