"""Exact order statistics at any size.

Tiny inputs use Spark's `percentile` aggregate, which keeps every distinct value in one buffer.  All else takes two scans,
whatever the distribution: the first builds a KLL sketch of each column beside its count and bounds, and the sketch gives
a bracket of values around each wanted rank by its rank error; the second counts what lies between the brackets and keeps
the values inside them, about one row in 200 for each rank, as (column, bracket, value, count).  The ranks are read off
those rows.  A rank that its bracket missed, which the counts show, is found by `select_ranks`, so results are exact.

`select_ranks` works on rows `(grp, value)`: a counting pass spreads the values over equal-width cells and keeps each
cell's count, minimum and maximum; a wanted rank lies in one known cell, and only that cell is looked at again.

Quantiles of groups, however many, stay on the executors: counts of (group, value), running totals by ordered buckets,
and one grouped maximum for each wanted rank.
"""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.expr import quoted
from plumbline.operators.ranks import running_totals
from plumbline.session import is_small, several_passes, stage

CELLS = 1024
ACCURACY = 10_000
FINISH_ROWS = 200_000
PERCENTILE_BYTES = 4 * 1024 * 1024
INF = float("inf")
#: Size of the sketch behind brackets, and how far a bracket reaches on each side of its rank: twice the sketch's error.
SKETCH, REACH = 4000, 0.0026
LARGEST = sys.float_info.max


def percentile_column(column: str, probs: Sequence[float], exact: bool = True) -> Column:
    c = quoted(column).cast("double")
    grid = F.array(*[F.lit(float(p)) for p in probs])
    if exact:
        return F.percentile(c, grid)
    return F.percentile_approx(c, grid, ACCURACY)


def long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-null numeric cells as `(grp, value)`, one row per cell."""
    wide = df.select(*[quoted(c).cast("double").alias(c) for c in columns])
    cells = wide.unpivot([], [quoted(c) for c in columns], "grp", "value")
    return cells.filter(F.col("value").isNotNull())


def cell_stats(cells: DataFrame, weight: str | None = None) -> dict[str, tuple]:
    """`(finite rows, min, max, rows at -inf, rows at +inf)` of each group of `(grp, value)`."""
    v = F.col("value")
    finite = F.when(F.abs(v) != INF, v)
    count = lambda test: F.count_if(test) if weight is None else F.sum(F.when(test, F.col(weight)).otherwise(0))
    rows = cells.groupBy("grp").agg(
        count(F.abs(v) != INF).alias("n"), F.min(finite).alias("lo"), F.max(finite).alias("hi"), count(v == -INF).alias("low"), count(v == INF).alias("high")
    )
    return {r["grp"]: (r["n"], r["lo"], r["hi"], r["low"], r["high"]) for r in rows.collect()}


class _Spot:
    """Where a rank is known to lie: closed value interval, rows inside it, rows below it."""

    __slots__ = ("grp", "rank", "lo", "hi", "n", "below")

    def __init__(self, grp, rank, lo, hi, n, below):
        self.grp, self.rank, self.lo, self.hi, self.n, self.below = grp, rank, lo, hi, n, below


def _within(cells: DataFrame, spots: list[_Spot]) -> tuple[DataFrame, dict]:
    """Rows of the spots' intervals, tagged with an interval number; one broadcast row per interval."""
    keys = sorted({(s.grp, s.lo, s.hi) for s in spots})
    slots = {k: i for i, k in enumerate(keys)}
    # halving keeps the width finite for intervals wider than the double range
    rows = [(g, i, lo, hi, 0.5 if hi - lo == INF else 1.0) for (g, lo, hi), i in slots.items()]
    table = F.broadcast(cells.sparkSession.createDataFrame(rows, "grp string, slot int, lo double, hi double, unit double"))
    v = F.col("value")
    return cells.join(table, "grp").filter((v >= F.col("lo")) & (v <= F.col("hi"))), slots


def select_ranks(
    cells: DataFrame,
    ranks: dict[str, Sequence[int]],
    stats: dict[str, tuple] | None = None,
    finish_rows: int = FINISH_ROWS,
    width: int = CELLS,
    weight: str | None = None,
) -> dict[tuple[str, int], float]:
    """Values at the given zero-based ranks of each group of `(grp, value)`; values are non-null.

    Groups are feature names or classes.  The result holds one number per asked rank.  With `weight`, a row stands for
    as many rows as that column says, and `stats` must be given.
    """
    rows = F.count("*") if weight is None else F.sum(weight)
    stats = stats or cell_stats(cells)
    found: dict[tuple[str, int], float] = {}
    waiting: list[_Spot] = []
    for g, rs in ranks.items():
        n, lo, hi, low, high = stats[g]
        for r in set(rs):
            if r < low or r >= low + n:
                found[(g, r)] = -INF if r < low else INF
            elif lo == hi:
                found[(g, r)] = lo
            else:
                waiting.append(_Spot(g, r, lo, hi, n, low))
    while waiting:
        ready = [s for s in waiting if s.n <= finish_rows]
        if ready:
            found.update(_finish(cells, ready, rows))
        open_spots = [s for s in waiting if s.n > finish_rows]
        if not open_spots:
            break
        inside, slots = _within(cells, open_spots)
        unit = F.col("unit")
        share = (F.col("value") * unit - F.col("lo") * unit) / (F.col("hi") * unit - F.col("lo") * unit)
        cell = F.least(F.floor(share * width), F.lit(width - 1)).cast("int")
        counted: dict[int, list] = defaultdict(list)
        per_cell = inside.groupBy("slot", cell.alias("cell")).agg(rows.alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        for row in per_cell.collect():
            counted[row["slot"]].append((row["cell"], row["n"], row["lo"], row["hi"]))
        waiting = []
        for s in open_spots:
            seen = s.below
            for _, n, lo, hi in sorted(counted[slots[(s.grp, s.lo, s.hi)]]):
                if s.rank < seen + n:
                    if lo == hi:
                        found[(s.grp, s.rank)] = lo
                    else:
                        waiting.append(_Spot(s.grp, s.rank, lo, hi, n, seen))
                    break
                seen += n
    return found


def _finish(cells: DataFrame, spots: list[_Spot], rows: Column) -> dict:
    """Read off ranks whose interval holds few rows: grouped count, then a running count."""
    inside, slots = _within(cells, spots)
    counts = inside.groupBy("slot", "value").agg(rows.alias("n"))
    upto = F.sum("n").over(W.partitionBy("slot").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    wanted = cells.sparkSession.createDataFrame(
        [(s.grp, s.rank, slots[(s.grp, s.lo, s.hi)], s.rank - s.below) for s in spots], "grp string, rank long, slot int, local long"
    )
    running = counts.select("slot", "value", "n", upto.alias("upto"))
    picked = running.join(F.broadcast(wanted), "slot").filter(
        (F.col("local") < F.col("upto")) & (F.col("local") >= F.col("upto") - F.col("n"))
    )
    return {(r["grp"], r["rank"]): r["value"] for r in picked.select("grp", "rank", "value").collect()}


def _interpolation(n: int, p: float) -> tuple[int, int, float]:
    position = (n - 1) * p
    low = floor(position)
    return low, ceil(position), position - low


def quantiles_by_selection(
    cells: DataFrame,
    probs: Sequence[float],
    stats: dict[str, tuple] | None = None,
    finish_rows: int = FINISH_ROWS,
    width: int = CELLS,
    weight: str | None = None,
) -> dict[str, list[float]]:
    """Linear-interpolation quantiles of each group of `(grp, value)` by rank selection.

    With `weight`, a row stands for as many rows as that column says.
    """
    stats = stats or cell_stats(cells, weight)
    plan, ranks = _wanted(stats, probs)
    return _read_off(plan, select_ranks(cells, ranks, stats, finish_rows, width, weight))


def _wanted(stats: dict[str, tuple], probs: Sequence[float]) -> tuple[dict[str, list], dict[str, list[int]]]:
    """The ranks that each quantile interpolates between, and all ranks of a group."""
    plan = {g: [_interpolation(n + low + high, p) for p in probs] for g, (n, _, _, low, high) in stats.items() if n + low + high}
    return plan, {g: sorted({r for low, high, _ in spots for r in (low, high)}) for g, spots in plan.items()}


def _read_off(plan: dict[str, list], values: dict[tuple[str, int], float]) -> dict[str, list[float]]:
    def between(a: float, b: float, w: float) -> float:
        return a if w == 0 or a == b else a * (1 - w) + b * w

    return {g: [between(values[(g, low)], values[(g, high)], w) for low, high, w in spots] for g, spots in plan.items()}


def _brackets(row, i: int, count: int) -> list[tuple[float, float]]:
    """Column `i`'s brackets in order, those that meet joined."""
    out: list[list[float]] = []
    for lo, hi in sorted((row[f"q{i}"][2 * j], row[f"q{i}"][2 * j + 1]) for j in range(count)):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def quantiles_in_two_scans(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], extra: Sequence[Column] = (), sketch: int = SKETCH, reach: float = REACH
) -> tuple[dict[str, tuple], dict[str, list[float]], dict]:
    """Per column `(finite rows, min, max, rows at -inf, rows at +inf)` and its quantiles, and the values of `extra`.

    `extra` are aggregates (aliased) that ride along in the first scan.  Columns without values have no quantiles.
    """
    sums = list(extra)
    for i, c in enumerate(columns):
        v = quoted(c).cast("double")
        finite = F.when(F.abs(v) != INF, v)
        sums += [F.count(finite).alias(f"__n{i}"), F.min(finite).alias(f"__a{i}"), F.max(finite).alias(f"__b{i}")]
        sums += [F.count_if(v == -INF).alias(f"__l{i}"), F.count_if(v == INF).alias(f"__h{i}")]
        # infinities keep their ranks as the largest finite numbers
        sketched = F.when(v == INF, F.lit(LARGEST)).when(v == -INF, F.lit(-LARGEST)).otherwise(v)
        sums.append(F.kll_sketch_agg_double(sketched, F.lit(sketch)).alias(f"__s{i}"))
    scanned = df.agg(*sums)
    ends = F.array(*[F.lit(min(1.0, max(0.0, p + side))) for p in probs for side in (-reach, reach)])
    reads = [F.when(F.col(f"__n{i}") > 0, F.kll_sketch_get_quantile_double(f"__s{i}", ends)).alias(f"q{i}") for i in range(len(columns))]
    row = scanned.select(*[c for c in scanned.columns if not c.startswith("__s")], *reads).first()
    stats = {c: tuple(row[f"__{k}{i}"] for k in "nablh") for i, c in enumerate(columns)}
    plan, ranks = _wanted(stats, probs)
    values: dict[tuple[str, int], float] = {}
    brackets = {}
    for i, c in enumerate(columns):
        n, lo, hi, low, _ = stats[c]
        for r in ranks.get(c, ()):
            if not low <= r < low + n:
                values[(c, r)] = -INF if r < low else INF
            elif lo == hi:
                values[(c, r)] = lo
            else:
                brackets.setdefault(c, _brackets(row, i, len(probs)))
    if brackets:
        values.update(_ranks_by_brackets(df, brackets, {c: [r for r in ranks[c] if (c, r) not in values] for c in brackets}, stats))
    return stats, _read_off(plan, values), {k: row[k] for k in scanned.columns if not k.startswith("__")}


def _ranks_by_brackets(df: DataFrame, brackets: dict[str, list[tuple[float, float]]], ranks: dict[str, list[int]], stats: dict[str, tuple]) -> dict[tuple[str, int], float]:
    """The second scan.  Slot 2i + 1 of a column is inside its i-th bracket, an even slot lies between two and keeps no values.

    The slots of all columns are numbered in a row, so that rows are grouped by two plain numbers.  Brackets come from a
    broadcast row a column: with literals, the generated code would outgrow what the JVM compiles.
    """
    names, most = list(brackets), max(map(len, brackets.values()))
    first = [i * (2 * most + 1) for i in range(len(names))]
    blank = [float("nan")] * 2  # no number reaches it
    ends = [(c, at, *[x for pair in [*brackets[c], *[blank] * (most - len(brackets[c]))] for x in pair]) for c, at in zip(names, first)]
    fields = ", ".join(f"lo{i} double, hi{i} double" for i in range(most))
    table = F.broadcast(df.sparkSession.createDataFrame(ends, f"grp string, at int, {fields}"))
    v, passed = F.col("value"), F.lit(0)
    for i in range(most):
        passed = passed + (v >= F.col(f"lo{i}")).cast("int") + (v > F.col(f"hi{i}")).cast("int")
    slot = F.when(F.isnan(v), 2 * most).otherwise(passed)
    placed = long_values(df, names).join(table, "grp").select("at", "value", slot.alias("passed"))
    keys = [(F.col("at") + F.col("passed")).alias("slot"), F.when(F.col("passed") % 2 == 1, v).alias("value")]
    # a task sends one row for each gap, and the distinct values inside brackets
    kept = stage(placed.select(*keys).groupBy("slot", "value").agg(F.count("*").alias("n")), "brackets")
    totals: dict[str, dict[int, tuple]] = defaultdict(dict)
    for r in kept.groupBy("slot").agg(F.sum("n").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect():
        i = bisect_right(first, r["slot"]) - 1
        totals[names[i]][r["slot"] - first[i]] = (r["n"], r["lo"], r["hi"])
    local: dict[str, list[int]] = defaultdict(list)
    asked, missed, inner = {}, defaultdict(list), {}
    for i, c in enumerate(names):
        for rank in ranks[c]:
            seen = 0
            for slot, (n, lo, hi) in sorted(totals[c].items()):
                if rank < seen + n:
                    break
                seen += n
            if slot % 2:
                grp = str(first[i] + slot)
                local[grp].append(rank - seen)
                asked[(grp, rank - seen)] = (c, rank)
                inner[grp] = (n, lo, hi, 0, 0)
            else:
                missed[c].append(rank)
    found = {}
    if local:
        inside = kept.filter(F.col("value").isNotNull()).select(F.col("slot").cast("string").alias("grp"), "value", "n")
        found = {asked[k]: v for k, v in select_ranks(inside, local, inner, weight="n").items()}
    kept.unpersist()
    if missed:
        found.update(select_ranks(long_values(df, list(missed)), missed, stats))
    return found


def order_stats(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], exact: bool = True, small: bool | None = None
) -> dict[str, tuple[int, list[float] | None]]:
    """`(values, quantiles)` per column, on the driver (a few numbers per column); None where a column is all null."""
    columns = list(columns)
    if not columns:
        return {}
    numbers = df.select(*[quoted(c).cast("double").alias(c) for c in columns])
    small = is_small(numbers, PERCENTILE_BYTES) if small is None else small
    if exact and not small:
        with several_passes(numbers) as d:
            stats, got, _ = quantiles_in_two_scans(d, columns, probs)
        return {c: (stats[c][0] + stats[c][3] + stats[c][4], got.get(c)) for c in columns}
    exprs = []
    for i, c in enumerate(columns):
        exprs += [F.count(quoted(c)).alias(f"n{i}"), percentile_column(c, probs, exact).alias(f"q{i}")]
    row = numbers.agg(*exprs).first()
    return {c: (row[f"n{i}"], row[f"q{i}"]) for i, c in enumerate(columns)}


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], exact: bool = True, small: bool | None = None
) -> dict[str, list[float] | None]:
    """Quantiles per column, on the driver; None where a column is all null."""
    return {c: q for c, (_, q) in order_stats(df, columns, probs, exact, small).items()}


def group_quantiles(
    df: DataFrame, group: str, value: str, probs: Sequence[float], exact: bool = True, small: bool | None = None, buckets: int | None = None, weight: str | None = None
) -> DataFrame:
    """`(grp, q array<double>)` of `value` inside each group (a class label, a customer), nulls left out.

    Any number of groups of any size: nothing is gathered on the driver, and a group is never sorted in one task.
    With `weight`, a row stands for as many rows as that column says.
    """
    copies = F.lit(1) if weight is None else quoted(weight)
    cells = df.select(quoted(group).cast("string").alias("grp"), quoted(value).cast("double").alias("value"), copies.cast("long").alias("copies"))
    cells = cells.filter(F.col("grp").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
    small = is_small(cells, PERCENTILE_BYTES) if small is None else small
    if weight is None and (not exact or small):
        return cells.groupBy("grp").agg(percentile_column("value", probs, exact).alias("q"))
    counts = stage(cells.groupBy("grp", "value").agg(F.sum("copies").alias("n")), "group_values")
    totals = counts.groupBy("grp").agg(F.sum("n").alias("total"))
    placed = running_totals(counts, "value", ["n"], group=["grp"], buckets=buckets).join(totals, "grp")
    spot = lambda p: (F.col("total") - 1).cast("double") * F.lit(float(p))
    at = lambda rank: F.max(F.when((F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n")), F.col("value")))
    ends = [e.alias(f"{k}{j}") for j, p in enumerate(probs) for k, e in (("a", at(F.floor(spot(p)))), ("b", at(F.ceil(spot(p)))))]
    picked = placed.groupBy("grp").agg(F.first("total").alias("total"), *ends)

    def between(j: int, p: float) -> Column:
        a, b, w = F.col(f"a{j}"), F.col(f"b{j}"), spot(p) - F.floor(spot(p))
        return F.when((w == 0) | (a == b), a).otherwise(a * (1 - w) + b * w)

    return picked.select("grp", F.array(*[between(j, p) for j, p in enumerate(probs)]).alias("q"))
