"""The shared passes: one aggregate over all columns, one frequency table, histograms, correlation.

Every report in the package is read off these small tables.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.expr import finite_or_null, quoted, range_label
from plumbline.functions.typing import normalised, numeric_columns, type_groups
from plumbline.operators.quantiles import PERCENTILE_BYTES, percentile_column, quantiles_in_two_scans
from plumbline.session import is_small, several_passes

QUARTILES = (0.25, 0.5, 0.75)
# beyond this many pairs one fused aggregate no longer compiles well, and matrix products win
FUSED_PAIRS = 15
# beyond this many columns one aggregate of moments no longer compiles, and sums of arrays by tasks win
FUSED_MOMENTS = 12


def unfold(row: DataFrame, parts: Sequence[Sequence[Column]]) -> DataFrame:
    """Turn a one-row aggregate into one row per entry of `parts` (struct fields share names)."""
    return row.select(F.inline(F.array(*[F.struct(*p) for p in parts])))


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """`(column, position, missing, rows)` from a single aggregate."""
    df = normalised(df)
    columns = list(columns or df.columns)
    # every field is aliased: inline() needs one struct type
    agg = df.agg(F.count("*").alias("rows"), *[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(columns)])
    return unfold(
        agg,
        [
            (
                F.lit(c).alias("column"),
                F.lit(i).alias("position"),
                (F.col("rows") - F.col(f"n{i}")).alias("missing"),
                F.col("rows").alias("rows"),
            )
            for i, c in enumerate(columns)
        ],
    )


def numeric_summary(
    df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True, limit: int | None = None
) -> DataFrame:
    """`(column, count, mean, std, min, q1, median, q3, max)` of numeric columns in one pass.

    `std` is the sample form.  Columns without values are left out.
    """
    df = normalised(df)
    columns = list(columns if columns is not None else numeric_columns(df))[:limit]
    return _summary(df, columns, exact, QUARTILES, ("q1", "median", "q3"))


def _summary(df: DataFrame, columns: Sequence[str], exact: bool, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    if not columns:
        fields = ["column string", "count long", "mean double", "std double", "min double"]
        return df.sparkSession.createDataFrame([], ", ".join(fields + [f"{n} double" for n in names] + ["max double"]))
    x = {c: quoted(c).cast("double") for c in columns}
    moments = [
        (F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"), F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}"))
        for i, v in enumerate(x.values())
    ]
    order = ("column", "count", "mean", "std", "min", *names, "max")
    numbers = df.select(*[v.alias(c) for c, v in x.items()])
    if exact and not is_small(numbers, PERCENTILE_BYTES):
        with several_passes(numbers) as d:
            _, got, row = quantiles_in_two_scans(d, columns, probs, [e for group in moments for e in group])
        rows = [
            (c, row[f"n{i}"], row[f"m{i}"], row[f"s{i}"], row[f"a{i}"], *got[c], row[f"b{i}"])
            for i, c in enumerate(columns)
            if row[f"n{i}"]
        ]
        return df.sparkSession.createDataFrame(rows, ", ".join(f"{k} {'string' if k == 'column' else 'long' if k == 'count' else 'double'}" for k in order))
    # tiny inputs and sketches: percentiles ride along in the one aggregate
    exprs = [e for i, group in enumerate(moments) for e in (*group, percentile_column(columns[i], probs, exact).alias(f"q{i}"))]
    parts = [
        (
            F.lit(c).alias("column"),
            F.col(f"n{i}").alias("count"),
            F.col(f"m{i}").alias("mean"),
            F.col(f"s{i}").alias("std"),
            F.col(f"a{i}").alias("min"),
            *[F.col(f"q{i}").getItem(j).alias(name) for j, name in enumerate(names)],
            F.col(f"b{i}").alias("max"),
        )
        for i, c in enumerate(columns)
    ]
    return unfold(df.agg(*exprs), parts).filter(F.col("count") > 0)


def moment_profile(df: DataFrame, columns: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """`(column, count, skewness, variance)`: bias-corrected skewness (n >= 3), population variance (n >= 2)."""
    df = normalised(df)
    columns = list(columns if columns is not None else numeric_columns(df))[:limit]
    if len(columns) > FUSED_MOMENTS:
        return _moments_by_tasks(df, columns)
    exprs = []
    for i, c in enumerate(columns):
        x = quoted(c).cast("double")
        exprs += [F.count(x).alias(f"n{i}"), F.skewness(x).alias(f"g{i}"), F.var_pop(x).alias(f"v{i}")]

    def skew(i: int) -> Column:
        n = F.col(f"n{i}").cast("double")
        return F.when(n >= 3, F.coalesce(F.col(f"g{i}") * F.sqrt(n * (n - 1)) / (n - 2), F.lit(0.0)))

    return unfold(
        df.agg(*exprs),
        [
            (
                F.lit(c).alias("column"),
                F.col(f"n{i}").alias("count"),
                skew(i).alias("skewness"),
                F.when(F.col(f"n{i}") >= 2, F.col(f"v{i}")).alias("variance"),
            )
            for i, c in enumerate(columns)
        ],
    )


def _moments_by_tasks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`moment_profile` of a wide table: counts, means and central sums of each Arrow batch, put together by task and then by column."""

    def joined(parts: list[np.ndarray]) -> np.ndarray:
        """Rows (count, mean, second and third central sum) of the union of parts, about the common mean."""
        n, mean, m2, m3 = np.stack(parts, axis=1)
        total = n.sum(axis=0)
        with np.errstate(invalid="ignore", over="ignore"):
            middle = np.where(n > 0, n * mean, 0.0).sum(axis=0) / np.maximum(total, 1)
            d = np.where(n > 0, mean - middle, 0.0)
            return np.stack([total, middle, (m2 + n * d**2).sum(axis=0), (m3 + 3 * d * m2 + n * d**3).sum(axis=0)])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = np.zeros((4, len(columns)))
        for batch in batches:
            found = np.zeros((4, len(columns)))
            for i, column in enumerate(batch.columns):
                x = column.drop_null().to_numpy(zero_copy_only=False)
                if len(x):
                    with np.errstate(invalid="ignore", over="ignore"):
                        mean = x.mean()
                        d = x - mean
                        square = d * d
                        found[:, i] = len(x), mean, square.sum(), (square * d).sum()
            so_far = joined([so_far, found])
        arrays = [pa.array(range(len(columns)), pa.int32()), *[pa.array(row, pa.float64()) for row in so_far]]
        yield pa.RecordBatch.from_arrays(arrays, ["position", "n", "mean", "m2", "m3"])

    tasks = df.select(*[quoted(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(sums, "position int, n double, mean double, m2 double, m3 double")
    none = df.sparkSession.createDataFrame([(i, 0.0, 0.0, 0.0, 0.0) for i in range(len(columns))], tasks.schema)  # also of a table without partitions
    each = tasks.unionAll(none).groupBy("position").agg(F.collect_list(F.struct("n", "mean", "m2", "m3")).alias("parts"))  # a part a task
    total = lambda value: F.aggregate(F.filter("parts", lambda p: p["n"] > 0), F.lit(0.0), lambda s, p: s + value(p))
    counted = each.select("position", "parts", total(lambda p: p["n"]).alias("n"), total(lambda p: p["n"] * p["mean"]).alias("sum"))
    d, n = (lambda p: p["mean"] - F.col("sum") / F.col("n")), F.col("n")
    whole = counted.select("position", "n", total(lambda p: p["m2"] + p["n"] * d(p) * d(p)).alias("m2"), total(lambda p: p["m3"] + 3 * d(p) * p["m2"] + p["n"] * d(p) * d(p) * d(p)).alias("m3"))
    m2 = F.col("m2")
    plain = F.when(m2 != 0, F.sqrt(n) * F.col("m3") / F.sqrt(m2 * m2 * m2))
    skew = F.when(n >= 3, F.coalesce(plain * F.sqrt(n * (n - 1)) / (n - 2), F.lit(0.0)))
    name = F.array(*map(F.lit, columns))[F.col("position")]
    return whole.select(name.alias("column"), n.cast("long").alias("count"), skew.alias("skewness"), F.when(n >= 2, m2 / n).alias("variance"))


def _storage_class(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "long"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    return "string"


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """`(column, distinct)` of non-null values.

    Exact: columns of one storage type are stacked and grouped once, so values travel in
    their native type and each pass reads only its own columns.  Otherwise HyperLogLog.
    """
    df = normalised(df)
    columns = list(columns or df.columns)
    if not exact:
        row = df.agg(*[F.approx_count_distinct(quoted(c)).alias(f"d{i}") for i, c in enumerate(columns)])
        return unfold(row, [(F.lit(c).alias("column"), F.col(f"d{i}").alias("distinct")) for i, c in enumerate(columns)])
    classes: dict[str, list[str]] = {}
    for c in columns:
        classes.setdefault(_storage_class(df.schema[c].dataType), []).append(c)
    out = None
    for kind, names in classes.items():
        wide = df.select(*[quoted(c).cast(kind).alias(c) for c in names])
        cells = wide.unpivot([], [quoted(c) for c in names], "column", "value")
        part = cells.groupBy("column", "value").agg(F.lit(1).alias("one")).groupBy("column").agg(F.count("value").alias("distinct"))
        out = part if out is None else out.unionByName(part)
    return out


def value_frequencies(df: DataFrame, columns: Sequence[str], missing: str | None = None) -> DataFrame:
    """`(column, value, n)` on the string form; nulls stay null, or become the `missing` label."""
    df = normalised(df)
    texts = [quoted(c).cast("string") for c in columns]
    if missing is not None:
        texts = [F.coalesce(t, F.lit(missing)) for t in texts]
    wide = df.select(*[t.alias(c) for t, c in zip(texts, columns)])
    cells = wide.unpivot([], [quoted(c) for c in columns], "column", "value")
    # partial counts combine in each task, so a value held by a third of all rows is one row per task
    return cells.groupBy("column", "value").agg(F.count("*").alias("n"))


def histogram_table(
    df: DataFrame,
    columns: Sequence[str],
    bins: int = 20,
    rows_per_bin: int | None = None,
    bounds: tuple[int, int] = (5, 30),
    digits: int = 4,
) -> DataFrame:
    """`(column, bin, low, high, n, label)`: equal-width bins, the last one closed, empty bins kept.

    `rows_per_bin` derives the number of bins from the row count.  Bins are clamped to
    `bounds`.  A constant column is widened by half a unit to each side.  Infinite values have no
    place on the axis: they are left out, like missing ones.
    """
    df = normalised(df).select(*[finite_or_null(quoted(c).cast("double")).alias(c) for c in columns])
    spark = df.sparkSession
    exprs = []
    for i, c in enumerate(columns):
        x = quoted(c).cast("double")
        exprs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
    row = df.agg(*exprs).first()
    fences = histogram_fences([(c, row[f"n{i}"], row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(columns)], bins, rows_per_bin, bounds)
    if not fences:
        return spark.createDataFrame([], HISTOGRAM)
    limits = spark.createDataFrame(fences, HISTOGRAM_FENCES)
    placed = []
    for c, lo, hi, k in fences:
        x = quoted(c).cast("double")
        cell = F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(k))
        # least() skips nulls, so missing values are kept apart
        placed.append(F.when(x.isNotNull(), F.least(cell, F.lit(k - 1))).cast("int").alias(c))
    names = [f[0] for f in fences]
    cells = df.select(*placed).unpivot([], [quoted(c) for c in names], "column", "bin").filter(F.col("bin").isNotNull())
    return histogram_rows(limits, cells.groupBy("column", "bin").agg(F.count("*").alias("n")), digits)


HISTOGRAM = "column string, bin int, low double, high double, n long, label string"
HISTOGRAM_FENCES = "column string, lo double, hi double, k int"


def histogram_fences(ends: Sequence[tuple], bins: int, rows_per_bin: int | None, bounds: tuple[int, int]) -> list[tuple]:
    """`(column, low end, high end, bins)` from `(column, values, min, max)`; columns without values have none."""
    fences = []
    for c, n, lo, hi in ends:
        if not n:
            continue
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        k = n // rows_per_bin if rows_per_bin else bins
        fences.append((c, lo, hi, int(min(max(k, bounds[0]), bounds[1]))))
    return fences


def histogram_rows(limits: DataFrame, counts: DataFrame, digits: int = 4) -> DataFrame:
    """All bins of the fences with their counts `(column, bin, n)`; absent ones are 0."""
    grid = limits.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bin"))
    step = (F.col("hi") - F.col("lo")) / F.col("k")
    low = F.col("lo") + step * F.col("bin")
    high = F.when(F.col("bin") == F.col("k") - 1, F.col("hi")).otherwise(F.col("lo") + step * (F.col("bin") + 1))
    return F.broadcast(grid).join(counts, ["column", "bin"], "left").select(
        "column",
        "bin",
        low.alias("low"),
        high.alias("high"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        range_label(low, high, digits).alias("label"),
    )


def _means(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """The mean of each column's finite values; 0 where there are none."""
    row = df.agg(*[F.avg(finite_or_null(quoted(c).cast("double"))).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return {c: 0.0 if row[f"m{i}"] is None else row[f"m{i}"] for i, c in enumerate(columns)}


def _pair_aggregate(df: DataFrame, pairs: Sequence[tuple[str, str]], means: dict[str, float] | None = None) -> DataFrame:
    # regr_* skip a row when either side is null: pairwise-complete moments without masks.
    # Columns are shifted by their means first: small steps on a large level keep their digits.
    shift = means or _means(df, sorted({c for pair in pairs for c in pair}))
    exprs = []
    for i, (a, b) in enumerate(pairs):
        x, y = quoted(a).cast("double") - F.lit(shift[a]), quoted(b).cast("double") - F.lit(shift[b])
        exprs += [F.regr_sxy(x, y).alias(f"c{i}"), F.regr_sxx(x, y).alias(f"x{i}"), F.regr_syy(x, y).alias(f"y{i}")]

    def r(i: int) -> Column:
        return F.coalesce(
            F.try_divide(F.col(f"c{i}"), F.sqrt(F.col(f"x{i}")) * F.sqrt(F.col(f"y{i}"))), F.lit(0.0)
        )

    parts = [
        (F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), r(i).alias("correlation")) for i, (a, b) in enumerate(pairs)
    ]
    return unfold(df.agg(*exprs), parts)


def _pair_matrix(df: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[str, str]], means: dict[str, float] | None = None) -> DataFrame:
    """Masked cross-product matrices, one per task, summed by pair: for wide tables."""
    means = means or _means(df, columns)
    shift = np.array([means[c] for c in columns])
    index = {c: i for i, c in enumerate(columns)}
    left = np.array([index[a] for a, _ in pairs])
    right = np.array([index[b] for _, b in pairs])

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, len(pairs)))
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            seen = (~np.isnan(x)).astype(float)
            x = np.where(seen > 0, x - shift, 0.0)
            sq = x * x
            blocks = (seen.T @ seen, x.T @ seen, seen.T @ x, x.T @ x, sq.T @ seen, seen.T @ sq)
            total += np.stack([b[left, right] for b in blocks])
        yield pd.DataFrame(
            {"pair": np.arange(len(pairs)), **{k: total[j] for j, k in enumerate(("n", "sx", "sy", "sxy", "sxx", "syy"))}}
        )

    parts = df.select(*[quoted(c).cast("double").alias(c) for c in columns]).mapInPandas(
        moments, "pair int, n double, sx double, sy double, sxy double, sxx double, syy double"
    )
    sums = parts.groupBy("pair").agg(*[F.sum(k).alias(k) for k in ("n", "sx", "sy", "sxy", "sxx", "syy")])
    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n"))
    vx = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), F.col("n"))
    vy = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), F.col("n"))
    # a constant column leaves rounding noise instead of an exact zero; compare with its own scale
    flat = (vx <= F.col("sxx") * 1e-14) | (vy <= F.col("syy") * 1e-14)
    r = F.when(flat, 0.0).otherwise(F.coalesce(F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)), F.lit(0.0)))
    names = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, feature_a string, feature_b string")
    return sums.join(F.broadcast(names), "pair").select("feature_a", "feature_b", r.alias("correlation"))


def correlation_pairs(
    df: DataFrame, columns: Sequence[str] | None = None, against: str | None = None, means: dict[str, float] | None = None
) -> DataFrame:
    """Pearson correlation `(feature_a, feature_b, correlation)` of pairwise-complete rows; undefined is 0.

    All upper-triangle pairs, or every column against one.  Narrow tables use built-in
    aggregates, wide ones per-task matrix products.  Known `means` of the columns save a scan.
    """
    df = normalised(df)
    columns = list(columns if columns is not None else numeric_columns(df))
    if against is not None:
        pairs = [(c, against) for c in columns if c != against]
    else:
        pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, correlation double")
    if len(pairs) <= FUSED_PAIRS:
        return _pair_aggregate(df, pairs, means)
    return _pair_matrix(df, columns if against is None else [*[a for a, _ in pairs], against], pairs, means)


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """All ordered pairs, the diagonal included (0 where a column has no spread)."""
    df = normalised(df)
    columns = list(columns if columns is not None else numeric_columns(df))
    row = df.agg(*[F.var_pop(quoted(c).cast("double")).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    return mirrored(correlation_pairs(df, columns), {c: (row[f"v{i}"] or 0.0) > 0 for i, c in enumerate(columns)})


def mirrored(upper: DataFrame, spread: dict[str, bool]) -> DataFrame:
    """All ordered pairs from the upper triangle, and the diagonal of the columns of `spread`."""
    flipped = upper.select(F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), "correlation")
    diagonal = [(c, c, 1.0 if some else 0.0) for c, some in spread.items()]
    return upper.unionByName(flipped).unionByName(upper.sparkSession.createDataFrame(diagonal, upper.schema))


def high_correlations(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.75, k: int = 30) -> DataFrame:
    pairs = correlation_pairs(df, columns).filter(F.abs("correlation") >= threshold)
    return pairs.orderBy(F.abs("correlation").desc(), "feature_a", "feature_b").limit(k)


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row `(rows, duplicates)`; nulls compare equal.

    Only rows that share a 64-bit hash can be copies, so the first pass shuffles hashes
    (combined per task), and full rows travel only for hashes seen more than once.
    """
    df = normalised(df)
    columns = list(columns or df.columns)
    seen = df.select(F.xxhash64(*map(quoted, columns)).alias("__h")).groupBy("__h").agg(F.count("*").alias("__n"))
    suspects = copies_among(df, seen.filter(F.col("__n") > 1).select("__h"), columns)
    copies = suspects.agg(F.lit(0).cast("long").alias("rows"), F.coalesce(F.sum("copies"), F.lit(0)).alias("duplicates"))
    rows = df.agg(F.count("*").alias("rows"), F.lit(0).cast("long").alias("duplicates"))
    return rows.unionByName(copies).agg(F.sum("rows").alias("rows"), F.sum("duplicates").alias("duplicates"))


def copies_among(df: DataFrame, shared: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """`copies` beyond the first of each distinct row whose hash is in `shared` (`__h`)."""
    columns = list(columns or df.columns)
    hashed = df.select(*map(quoted, columns), F.xxhash64(*map(quoted, columns)).alias("__h"))
    # copies are combined per task before the shuffle: a row repeated everywhere stays one row per task
    suspects = hashed.join(shared, "__h", "left_semi").groupBy("__h", *map(quoted, columns)).agg(F.count("*").alias("__n"))
    return suspects.select((F.col("__n") - 1).alias("copies"))


def ranked_values(freq: DataFrame, k: int) -> DataFrame:
    """Top k values per column of a frequency table: count first, then value."""
    window = W.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    return freq.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def group_of(df: DataFrame) -> DataFrame:
    """`(column, position, dtype, dtype_group)` from the schema; no job."""
    groups = type_groups(df)
    rows = [(f.name, i, f.dataType.simpleString(), groups[f.name]) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "column string, position int, dtype string, dtype_group string")
