"""A table read once for many charts: its values as counted cells, and a row of facts a column.

`TableCells` makes two scans.  The first is one aggregate: counts, moments, bounds and matches with the
target.  The second turns each row into cells and counts them by `(position, value, class, complete)`; copies combine in
each task before the shuffle.  The counted cells are staged, so distinct values, frequent values, date shares, histograms, quantiles,
outliers, class tables, mutual information and repeated rows are read off them, not off the table.

A value keeps its storage type (`whole`, `real` or `text`).  Position -1 holds the hash of the row, so that only rows
whose hash occurs twice are looked at again for duplicates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expr import at_least_one, finite_or_null, lenient_timestamp, quoted, rounded
from plumbline.functions.typing import columns_of, normalised, numeric_columns, other_columns, semantic_type, type_groups
from plumbline.operators import leakage, profile, quality, relations, stats
from plumbline.operators.quantiles import INF, column_quantiles, group_quantiles, quantiles_by_selection
from plumbline.session import stage

ROW_HASH = -1


def _cell(position: int, kind: str, value: Column) -> Column:
    fields = [
        (value.cast(t) if kind == k else F.lit(None).cast(t)).alias(name)
        for name, k, t in (("whole", "long", "long"), ("real", "double", "double"), ("text", "string", "string"))
    ]
    return F.struct(F.lit(position).alias("position"), *fields)


class TableCells:
    """The two scans of a table and what is read off them.

    `classes` splits the cells by the target's text form, for tables of a classification target; otherwise the sums of
    a numeric target are kept beside the counts.
    """

    def __init__(self, df: DataFrame, target: str | None = None, classes: bool = False, exact: bool = True):
        self.exact = exact
        self.df = normalised(df)
        self.spark = df.sparkSession
        self.columns = list(df.columns)
        self.position = {c: i for i, c in enumerate(self.columns)}
        self.groups = type_groups(df)
        self.numeric = numeric_columns(df)
        self.target = target
        self.classes = classes and target is not None
        self.facts = self._facts()
        self.rows = self.facts["rows"]
        self.cells = stage(self._count(), "cells")

    def _facts(self) -> dict:
        sums = [F.count("*").alias("rows")]
        y = quoted(self.target).cast("string") if self.target is not None else None
        for i, c in enumerate(self.columns):
            v = quoted(c)
            sums.append(F.count(v).alias(f"n{i}"))
            if y is not None and c != self.target:
                same = v.cast("string") == y
                sums += [F.count(same).alias(f"pairs{i}"), F.avg(same.cast("int")).alias(f"match{i}")]
            if self.groups[c] == "numeric":
                x = v.cast("double")
                finite = finite_or_null(x)
                sums += [F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"), F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
                sums += [F.skewness(x).alias(f"skew{i}"), F.var_pop(x).alias(f"var{i}"), F.avg(finite).alias(f"level{i}")]
                sums += [F.count(finite).alias(f"finite{i}"), F.min(finite).alias(f"lo{i}"), F.max(finite).alias(f"hi{i}")]
                sums += [F.count_if(x == -INF).alias(f"low{i}"), F.count_if(x == INF).alias(f"high{i}")]
        return self.df.agg(*sums).first().asDict()

    def _count(self) -> DataFrame:
        cells = [_cell(ROW_HASH, "long", F.xxhash64(*map(quoted, self.columns)))]
        for i, f in enumerate(self.df.schema.fields):
            cells.append(_cell(i, stats._storage_class(f.dataType), quoted(f.name)))
        y = quoted(self.target) if self.target is not None else F.lit(None).cast("double")
        whole = F.lit(True)
        if self.classes or self.target is not None:
            for c in dict.fromkeys([*self.numeric, self.target]):
                whole = whole & quoted(c).isNotNull()
        group = y.cast("string") if self.classes else F.lit(None).cast("string")
        number = y.cast("double") if self.target in self.numeric and not self.classes else F.lit(None).cast("double")
        rows = self.df.select(group.alias("class"), whole.alias("complete"), number.alias("y"), F.inline(F.array(*cells)))
        return rows.groupBy("position", "whole", "real", "text", "class", "complete").agg(
            F.count("*").alias("n"), F.count("y").alias("y_rows"), F.sum("y").alias("y_sum")
        )

    def fact(self, name: str, column: str):
        return self.facts[f"{name}{self.position[column]}"]

    def table(self, rows: list[tuple], schema: str) -> DataFrame:
        """A column-sized table of known facts."""
        return self.spark.createDataFrame(rows, schema)

    def _named(self, columns: Sequence[str]) -> DataFrame:
        names = F.broadcast(self.table([(self.position[c], c) for c in columns], "position int, column string"))
        return self.cells.join(names, "position")

    def numbers(self, columns: Sequence[str]) -> DataFrame:
        """`(grp, value, class, complete, n)`: non-null cells of numeric columns."""
        value = F.coalesce("real", F.col("whole").cast("double"), F.col("text").try_cast("double"))
        return self._named(columns).select(F.col("column").alias("grp"), value.alias("value"), "class", "complete", "n").filter(F.col("value").isNotNull())

    def frequencies(self, columns: Sequence[str], missing: str | None = None) -> DataFrame:
        """`(column, value, n)` of columns that are not numeric; nulls stay null, or become the `missing` label."""
        text = F.col("text") if missing is None else F.coalesce("text", F.lit(missing))
        return self._named(columns).groupBy("column", text.alias("value")).agg(F.sum("n").alias("n"))

    # ---- tables read off the facts -------------------------------------------------

    def missing_counts(self, columns: Sequence[str] | None = None) -> DataFrame:
        rows = [(c, i, self.rows - self.fact("n", c), self.rows) for i, c in enumerate(columns or self.columns)]
        return self.table(rows, "column string, position int, missing long, rows long")

    def moment_profile(self, columns: Sequence[str]) -> DataFrame:
        rows = []
        for c in columns:
            n, skew, var = self.fact("n", c), self.fact("skew", c), self.fact("var", c)
            corrected = None if n < 3 else 0.0 if skew is None else skew * (n * (n - 1)) ** 0.5 / (n - 2)
            rows.append((c, n, corrected, var if n >= 2 else None))
        return self.table(rows, "column string, count long, skewness double, variance double")

    def match_rates(self) -> DataFrame:
        rows = [(c, self.fact("pairs", c), self.fact("match", c)) for c in self.columns if c != self.target]
        return self.table(rows, "feature string, pairs long, match_rate double")

    # ---- tables read off the cells -------------------------------------------------

    def distinct_counts(self, columns: Sequence[str] | None = None) -> DataFrame:
        """`(column, distinct)` of non-null values."""
        cells = self._named(columns or self.columns)
        if self.target is not None:
            # a value may be split by class and completeness
            cells = cells.groupBy("column", "whole", "real", "text").agg(F.lit(1).alias("one"))
        there = F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("text").isNotNull()
        return cells.groupBy("column").agg(F.count_if(there).alias("distinct"))

    def quantiles(self, columns: Sequence[str], probs: Sequence[float], complete: bool = False) -> dict[str, list[float]]:
        """Quantiles per column, read off the cells (or sketched, in one more scan); columns without values have none."""
        if not columns:
            return {}
        if not self.exact:
            rows = self.df
            for c in dict.fromkeys([*self.numeric, self.target]) if complete else ():
                rows = rows.filter(quoted(c).isNotNull())
            return {c: q for c, q in column_quantiles(rows, columns, probs, False).items() if q}
        cells = self.numbers(columns)
        if complete:
            return quantiles_by_selection(cells.filter("complete"), probs, weight="n")
        bounds = {c: tuple(self.fact(k, c) for k in ("finite", "lo", "hi", "low", "high")) for c in columns}
        return quantiles_by_selection(cells, probs, bounds, weight="n")

    def summary(self, columns: Sequence[str], quantiles: dict[str, list[float]], names: Sequence[str]) -> DataFrame:
        """`(column, count, mean, std, min, *names, max)`; columns without values are left out."""
        rows = [
            (c, self.fact("n", c), self.fact("mean", c), self.fact("std", c), self.fact("min", c), *quantiles[c], self.fact("max", c))
            for c in columns
            if self.fact("n", c)
        ]
        fields = ["column string", "count long", "mean double", "std double", "min double", *[f"{n} double" for n in names], "max double"]
        return self.table(rows, ", ".join(fields))

    def histogram(self, columns: Sequence[str], bins: int = 20, rows_per_bin: int | None = None, bounds: tuple[int, int] = (5, 30)) -> DataFrame:
        ends = [(c, self.fact("finite", c), self.fact("lo", c), self.fact("hi", c)) for c in columns]
        fences = stats.histogram_fences(ends, bins, rows_per_bin, bounds)
        if not fences:
            return self.table([], stats.HISTOGRAM)
        limits = self.table(fences, stats.HISTOGRAM_FENCES)
        cells = self.numbers([f[0] for f in fences]).filter(F.abs("value") != INF).withColumnRenamed("grp", "column")
        placed = cells.join(F.broadcast(limits), "column")
        cell = F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("k"))
        counts = placed.groupBy("column", F.least(cell, F.col("k") - 1).cast("int").alias("bin")).agg(F.sum("n").alias("n"))
        return stats.histogram_rows(limits, counts)

    def top_values(self, columns: Sequence[str], k: int = profile.TOP_VALUES) -> DataFrame:
        ranked = stats.ranked_values(self.frequencies(columns, profile.MISSING_LABEL), k)
        return ranked.select("column", "rank", "value", "n")

    def date_shares(self) -> dict[str, float]:
        """Share of each text column's values that parse as a date; each distinct value is parsed once, not each row."""
        texts = [c for c in self.columns if self.groups[c] == "categorical"]
        if not texts:
            return {}
        dated = F.when(lenient_timestamp("value").isNotNull(), F.col("n")).otherwise(0)
        found = self.frequencies(texts).filter(F.col("value").isNotNull()).groupBy("column").agg((F.sum(dated) / F.sum("n")).alias("share"))
        return {r["column"]: r["share"] for r in found.collect()}

    def semantic_types(self) -> DataFrame:
        shares = self.date_shares()
        rows = [
            (c, i, self.groups[c], 1.0 if self.groups[c] == "datetime" else shares.get(c, 0.0), self.rows)
            for i, c in enumerate(self.columns)
        ]
        known = self.table(rows, "column string, position int, dtype_group string, share double, rows long")
        # a table without rows has no cells
        joined = F.broadcast(known).join(self.distinct_counts(), "column", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))
        return joined.select(
            "column",
            "position",
            "dtype_group",
            "distinct",
            (F.col("distinct") / at_least_one("rows")).alias("unique_rate"),
            rounded("share", 4).alias("date_share"),
            semantic_type("dtype_group", "distinct", "rows", "share").alias("semantic_type"),
        )

    def numeric_baseline(self, quantiles: dict[str, list[float]]) -> DataFrame:
        """`quantiles` are those of the drift baseline."""
        columns = [c for c in self.numeric if c != self.target]
        rows = [
            (c, self.fact("mean", c), self.fact("std", c), *quantiles.get(c, (None,) * 3), (self.rows - self.fact("n", c)) / max(self.rows, 1))
            for c in columns
        ]
        return self.table(rows, "feature string, mean double, std double, q05 double, q50 double, q95 double, missing_rate double")

    def categorical_baseline(self, k: int = 10) -> DataFrame:
        columns = [c for c in other_columns(self.df) if c != self.target]
        missing = self.missing_counts(columns)
        rate = lambda n: F.col(n) / at_least_one("rows")
        return self.top_values(columns, k).join(F.broadcast(missing), "column").select(
            F.col("column").alias("feature"), "rank", "value", rate("n").alias("rate"), rate("missing").alias("missing_rate")
        )

    def duplicate_rows(self) -> DataFrame:
        """One row `(rows, duplicates)`; the table is read again only if hashes repeat."""
        hashes = self.cells.filter(F.col("position") == ROW_HASH).groupBy("whole").agg(F.sum("n").alias("n"))
        shared = hashes.filter(F.col("n") > 1).select(F.col("whole").alias("__h"))
        if shared.isEmpty():
            return self.table([(self.rows, 0)], "rows long, duplicates long")
        copies = stats.copies_among(self.df, shared)
        return copies.agg(F.lit(self.rows).cast("long").alias("rows"), F.coalesce(F.sum("copies"), F.lit(0)).alias("duplicates"))

    def unique_density(self) -> DataFrame:
        features = [c for c in self.columns if c != self.target]
        ratio = F.col("distinct") / F.lit(max(self.rows, 1))
        return self.distinct_counts(features).select(F.col("column").alias("feature"), F.col("distinct").alias("unique_values"), rounded(ratio).alias("unique_ratio"))

    def categorical_concentration(self) -> DataFrame:
        features = [c for c in other_columns(self.df) if c != self.target]
        names = self.table([(c,) for c in features], "column string")
        return profile.concentration(names, self.frequencies(features))

    def class_distribution(self, k: int = 25) -> DataFrame:
        value = F.coalesce("class", F.lit(profile.MISSING_LABEL)).alias("value")
        counts = self._named([self.target]).groupBy("column", value).agg(F.sum("n").alias("n"))
        return stats.ranked_values(counts, k).select(F.col("value").alias("label"), "n", "rank")

    def outlier_counts(self, columns: Sequence[str], quartiles: dict[str, list[float]]) -> DataFrame:
        """`(feature, outliers)`; `quartiles` are the first and the third of each column."""
        counted = {c: (self.fact("n", c), quartiles.get(c)) for c in columns}
        fences = quality.fences_of(counted)
        kept = self.table([(c,) for c, (n, _) in counted.items() if n >= quality.MIN_FENCE_ROWS], "feature string")
        limits = F.broadcast(self.table([(c, *map(float, f)) for c, f in fences.items()], "grp string, lo double, hi double"))
        outside = (F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))
        found = self.numbers(columns).join(limits, "grp").groupBy(F.col("grp").alias("feature")).agg(F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("outliers"))
        return kept.join(found, "feature", "left").select("feature", F.coalesce("outliers", F.lit(0)).alias("outliers"))

    def quartiles_by_class(self, feature: str) -> DataFrame:
        q = group_quantiles(self.numbers([feature]), "class", "value", stats.QUARTILES, weight="n")
        return q.select(F.col("grp").alias("class"), *[F.col("q")[i].alias(name) for i, name in enumerate(("q1", "median", "q3"))])

    def class_rates(self, feature: str) -> DataFrame:
        cells = self._named([feature]).filter(F.col("text").isNotNull() & F.col("class").isNotNull())
        return relations.rates_of(cells.groupBy(F.col("text").alias("category"), "class").agg(F.sum("n").alias("n")))

    def mean_target(self, feature: str, k: int = 12) -> DataFrame:
        cells = self._named([feature]).filter(F.col("text").isNotNull() & (F.col("y_rows") > 0))
        per = cells.groupBy(F.col("text").alias("category")).agg(F.sum("y_rows").alias("n"), F.sum("y_sum").alias("total"))
        return per.orderBy(F.col("n").desc(), "category").limit(k).select("category", (F.col("total") / F.col("n")).alias("target_mean"))

    def mutual_information(self, bins: int = 10, k: int = relations.RANKING) -> DataFrame:
        """The ranking of `relations.mutual_information`.  Classes are read off the cells; a target of numbers is one
        more scan, as its bins are known only now."""
        features = [c for c in self.numeric if c != self.target]
        texts = columns_of(self.df, "categorical", "boolean", exclude=[self.target])
        grid = [i / bins for i in range(1, bins)]
        binned = features if self.classes else [*features, self.target]
        cuts = {c: sorted(set(q)) for c, q in self.quantiles(binned, grid, complete=True).items()}
        if not self.classes:
            return relations.mutual_information(self.df, self.target, "regression", bins, k, cuts=cuts)
        if not features + texts or (features and not cuts):
            return self.table([], "feature string, score double")
        table = F.broadcast(self.table([(c, q) for c, q in cuts.items()], "grp string, cuts array<double>"))
        code = F.size(F.filter("cuts", lambda q: q < F.col("value"))).cast("string")
        numbers = self.numbers(features).filter("complete").join(table, "grp").select(F.col("grp").alias("column"), code.alias("x"), F.col("class").alias("y"), "n")
        levels = self._named(texts).filter("complete").select("column", F.col("text").alias("x"), F.col("class").alias("y"), "n")
        counts = numbers.unionByName(levels).groupBy("column", "x", "y").agg(F.sum("n").alias("nxy"))
        return relations.information(stage(counts, "information"), features, texts, k)

    # ---- one more scan ---------------------------------------------------------------

    def correlations(self, columns: Sequence[str] | None = None) -> DataFrame:
        """All pairs of numeric columns, shifted by the known means; staged."""
        columns = list(columns if columns is not None else self.numeric)
        means = {c: self.fact("level", c) or 0.0 for c in columns}
        return stage(stats.correlation_pairs(self.df, columns, means=means), "correlations")

    def leakage_ranking(self, pairs: DataFrame) -> DataFrame:
        """`pairs` are the correlations of all numeric columns."""
        against = self.table([], "feature string, correlation double")
        if self.groups[self.target] == "numeric":
            other = F.when(F.col("feature_a") == self.target, F.col("feature_b")).otherwise(F.col("feature_a"))
            mine = (F.col("feature_a") == self.target) | (F.col("feature_b") == self.target)
            against = pairs.filter(mine).select(other.alias("feature"), "correlation")
        return leakage.rank_signals(leakage.name_overlap(self.df, self.target), self.match_rates(), against)
