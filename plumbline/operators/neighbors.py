"""k-nearest-neighbour joins without all pairs, exact and approximate.

Base vectors are put into cells around pivots.  For each query cell a distance bound is
computed that its k nearest neighbours cannot exceed (from the k closest members of every
base cell and the triangle inequality); a base vector is sent only to query cells it can
still matter to.  Close cells share a strip and a hot cell has several; a row travels once to each strip of the other
side that it matters to, and there are about STRIPS of them, so what is shuffled grows with the rows.  Inside a pair of
strips, cells meet in blocks of a bounded number of rows, which rank by matrix products and measure exactly what may be
among the nearest; a pair emits at most k rows per query.  All pairs of close rows are still compared: that is the job.
A table joined with itself (the same DataFrame as queries and base) has each two strips meet once, for the rows of both.

The approximate join sends each query to the cells of its `probes` nearest pivots only.

Pivots and, for each, k reaches are all that the driver and every task hold: MOST_PIVOTS x (dimension + k) numbers
at most, whatever the rows.  Cell pairs and their bounds are computed by tasks, a query cell at a time, and stay a table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.expr import quoted
from plumbline.operators.split import sample_rows
from plumbline.session import stage

BLOCK_ROWS = 4096
MOST_PIVOTS = 4096
PROBES = 8
SLACK = 1e-9
#: Numbers in one array of differences, and in one table of products.
ARRAY, PRODUCTS = 4_000_000, 1_000_000
#: Queries that meet a block at a time.
QUERY_ROWS = 1024
#: Share of the bounds that rounding may reach before products are taken in double precision.
ROUNDING = 0.01
#: Strips of either side of a join, and numbers of vectors in the largest one.
STRIPS, STRIP_NUMBERS = 8, 8_000_000
#: Rows of a table of cells and strips, or of pairs of strips, up to which it is broadcast.
BROADCAST_ROWS = 100_000


def _pivot_count(rows: int) -> int:
    return int(max(1, min(MOST_PIVOTS, round((rows / 64) ** 0.5))))


def _pivots(base: DataFrame, count: int) -> np.ndarray:
    return np.array([r["v"] for r in sample_rows(base, "id", min(count, MOST_PIVOTS)).select("v").collect()], dtype=float)


def _vectors(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Single precision stays so, as it travels; it is measured in double precision all the same."""
    single = df.select(quoted(vector)).schema[0].dataType.simpleString() == "array<float>"
    v = quoted(vector) if single else F.transform(quoted(vector), lambda x: x.cast("double"))
    return df.select(quoted(id_col).alias("id"), v.alias("v"))


def _assign(df: DataFrame, pivots: np.ndarray, cells: int = 1, listed: bool = False) -> DataFrame:
    """`(id, v, cell, reach)`: the nearest pivots and the distances to them, a row for each of `cells` pivots.

    `listed`: one row, of the nearest, with the others in `near`.
    """
    take = min(cells, len(pivots))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        norms = (pivots**2).sum(axis=1)
        for b in batches:
            for i in range(0, len(b), BLOCK_ROWS):
                part = b.iloc[i : i + BLOCK_ROWS]
                x = np.array(part["v"].tolist(), dtype=float)
                near = np.argsort(norms - 2 * x @ pivots.T, axis=1, kind="stable")[:, :take] if take > 1 else (norms - 2 * x @ pivots.T).argmin(axis=1)[:, None]
                if listed:
                    yield part.assign(cell=near[:, 0].astype("int32"), reach=np.sqrt(((x - pivots[near[:, 0]]) ** 2).sum(axis=1)), near=list(near.astype("int32")))
                    continue
                reach = np.sqrt(((x[:, None, :] - pivots[near]) ** 2).sum(axis=2))
                rows = part.iloc[np.repeat(np.arange(len(part)), take)]
                yield rows.assign(cell=near.ravel().astype("int32"), reach=reach.ravel())

    id_type, v_type = (df.schema[c].dataType.simpleString() for c in ("id", "v"))
    return df.mapInPandas(nearest, f"id {id_type}, v {v_type}, cell int, reach double" + ", near array<int>" * listed)


def _centred(df: DataFrame, pivots: np.ndarray) -> np.ndarray:
    """The pivots moved to the means of their cells; the driver gets one number a pivot and dimension."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(pivots), pivots.shape[1] + 1))
        for b in batches:
            np.add.at(total, b["cell"].to_numpy(), np.column_stack([np.array(b["v"].tolist(), dtype=float), np.ones(len(b))]))
        at = np.flatnonzero(np.repeat(total[:, -1] > 0, total.shape[1]))
        yield pd.DataFrame({"at": at, "value": total.ravel()[at]})

    out = np.zeros(len(pivots) * (pivots.shape[1] + 1))
    assigned = _assign(df, pivots).select("v", "cell")
    for at, value in assigned.mapInPandas(sums, "at long, value double").groupBy("at").agg(F.sum("value")).collect():
        out[at] = value
    out = out.reshape(len(pivots), -1)
    return np.where(out[:, -1:] > 0, out[:, :-1] / np.maximum(out[:, -1:], 1), pivots)


def _routes(base: DataFrame, queries: DataFrame, pivots: np.ndarray, need: int) -> DataFrame:
    """`(cell, q_cell, min_reach, theta)`: base cells that may hold neighbours of a query cell.

    A member of the base cell matters if its reach is `min_reach` or more; no query of the cell has its `need` nearest
    beyond `theta`.
    """
    closest = base.select("cell", "reach").withColumn("r", F.row_number().over(W.partitionBy("cell").orderBy("reach"))).filter(F.col("r") <= need)
    near = closest.groupBy("cell").agg(F.sort_array(F.collect_list("reach")).alias("near"))
    held = base.groupBy("cell").agg(F.max("reach").alias("reach")).join(near, "cell").orderBy("cell").collect()  # a row a pivot
    cells, reach = np.array([r["cell"] for r in held]), np.array([r["reach"] for r in held])
    near_at = np.repeat(np.arange(len(held)), [len(r["near"]) for r in held])
    near_reach = np.concatenate([r["near"] for r in held])

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for cell, far in b.itertuples(index=False):
                gaps = np.sqrt(((pivots[cells] - pivots[cell]) ** 2).sum(axis=1))
                bound = far + gaps[near_at] + near_reach
                at = min(need, len(bound)) - 1
                theta = float(np.partition(bound, at)[at])
                # a member at distance r from its pivot is at least (pivot gap - own reach - r) away
                least = gaps - far - theta - SLACK
                open_ = least <= reach
                yield pd.DataFrame({"cell": cells[open_], "q_cell": cell, "min_reach": least[open_], "theta": theta})

    asked = queries.groupBy("cell").agg(F.max("reach").alias("reach"))
    return asked.mapInPandas(bounds, "cell int, q_cell int, min_reach double, theta double")


def _in_line(pivots: np.ndarray) -> np.ndarray:
    """The pivots' numbers in an order that goes from each to the nearest one left, so that a strip holds close cells."""
    left, at = np.ones(len(pivots), bool), 0
    line = []
    for _ in range(len(pivots)):
        line.append(at)
        left[at] = False
        gaps = ((pivots - pivots[at]) ** 2).sum(axis=1)
        at = int(np.where(left, gaps, np.inf).argmin())
    return np.array(line)


def _laid(rows: DataFrame, pivots: np.ndarray, block_rows: int) -> list[tuple[int, int, int, int]]:
    """`(cell, first, parts, rows)`: the strips of each cell of `rows`.

    Close cells share a strip, a cell of many rows has several.  There are about STRIPS of them, whatever the rows and the
    blocks, until a strip would hold more than STRIP_NUMBERS numbers.
    """
    sizes = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # a row a pivot
    most = max(1, STRIP_NUMBERS // pivots.shape[1])
    size = max(1, min(most, max(block_rows, -(-sum(sizes.values()) // STRIPS))))
    out, strip, filled = [], 0, 0
    for cell in [int(c) for c in _in_line(pivots) if int(c) in sizes]:
        n = sizes[cell]
        if filled and filled + n > size:
            strip, filled = strip + 1, 0
        parts = -(-n // size)
        out.append((cell, strip, parts, n))
        strip, filled = (strip, filled + n) if parts == 1 else (strip + parts, 0)
    return out


def _strip_table(spark: SparkSession, laid: list[tuple[int, int, int, int]]) -> DataFrame:
    return F.broadcast(spark.createDataFrame([x[:3] for x in laid], "at_cell int, first int, parts int"))


def _strips(rows: DataFrame, pivots: np.ndarray, block_rows: int) -> DataFrame:
    """`(at_cell, first, parts)` of _laid()."""
    return _strip_table(rows.sparkSession, _laid(rows, pivots, block_rows))


def _own_strip():
    return F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")


def _every_strip():
    return F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1))


class _Rows:
    """A strip's rows, those of one cell together and the farthest from their pivot first, with the nearest found for each."""

    def __init__(self, rows: pd.DataFrame, need: int):
        self.rows = rows = rows.iloc[np.lexsort((-rows["reach"].to_numpy(), rows["cell"].to_numpy()))]
        self.ids, self.reach, self.need = rows["id"].to_numpy(), rows["reach"].to_numpy(), need
        by_id = np.argsort(self.ids, kind="stable")
        self.in_order, self.rank = self.ids[by_id], np.empty(len(rows), dtype=np.int64)
        self.rank[by_id] = np.arange(len(rows))
        v = np.array(rows["v"].tolist())
        self.v = v if v.dtype == np.float32 else v.astype(float)
        self.cells, self.first = np.unique(rows["cell"].to_numpy(), return_index=True)
        self.last = np.append(self.first[1:], len(rows))
        self.theta = rows["theta"].to_numpy(dtype=float) if "theta" in rows else np.full(len(rows), np.inf)
        self.near = np.array(rows["near"].tolist()) if "near" in rows else None
        self.d, self.at = np.full((len(rows), need), np.inf), np.full((len(rows), need), -1)
        # rows whose bound may be far beyond their nearest
        self.loose = rows["loose"].to_numpy(dtype=bool).copy() if "loose" in rows else np.ones(len(rows), bool)

    def centre(self, mid: np.ndarray) -> None:
        """Rows from here on are told apart around `mid`, where rounding is least."""
        self.mid, centred = mid, self.v - mid
        self.own, self.length = np.einsum("ij,ij->i", centred, centred), np.sqrt(np.einsum("ij,ij->i", self.v, self.v, dtype=float))
        self.narrow = self._wide(centred, self.own).astype("f4") if 1e-24 < self.own.max() < 1e24 else None

    @staticmethod
    def _wide(centred: np.ndarray, own: np.ndarray) -> np.ndarray:
        return np.column_stack([centred, own, np.ones(len(own))])

    def factors(self, span: slice, kind: str) -> np.ndarray:
        return self.narrow[span] if kind == "f4" else self._wide(self.v[span] - self.mid, self.own[span])

    def limit(self, span: slice, cell: int) -> np.ndarray:
        """The distance beyond which rows of `cell` do not matter; less than 0 where none does."""
        limit = np.minimum(self.theta[span], self.d[span, -1])
        return limit if self.near is None else np.where((self.near[span] == cell).any(axis=1), limit, -np.inf)

    def first_looks(self, span: slice, limit: np.ndarray, others: int) -> np.ndarray:
        """Rows of `span` that meet as many others as they need, with a loose bound: once for each row."""
        if others < self.need:
            return np.empty(0, dtype=np.int64)
        rows = np.flatnonzero(self.loose[span] & (limit >= 0))
        self.loose[span.start + rows] = False
        return rows

    def put(self, row: np.ndarray, other: _Rows, at: np.ndarray) -> None:
        """Put rows `at` of the other strip among the nearest of each of `row`, where they are nearer or tie with a lower id."""
        step, need = max(1, ARRAY // self.v.shape[1]), self.need
        spans = [slice(j, j + step) for j in range(0, len(row), step)]
        d = np.concatenate([np.sqrt(((self.v[row[j]].astype(float) - other.v[at[j]]) ** 2).sum(axis=1)) for j in spans])
        better = d <= self.d[row, -1]
        row, at, d = row[better], at[better], d[better]
        if not len(row):
            return
        where = np.unique(row)
        new_row = np.concatenate([np.repeat(where, need), row])
        new_d, new_at = np.concatenate([self.d[where].ravel(), d]), np.concatenate([self.at[where].ravel(), other.rank[at]])
        order = np.lexsort((new_at, new_d, new_row))
        new_row, new_d, new_at = new_row[order], new_d[order], new_at[order]
        kept = np.arange(len(new_row)) - np.searchsorted(new_row, new_row) < need
        self.d[where], self.at[where] = new_d[kept].reshape(-1, need), new_at[kept].reshape(-1, need)

    def pairs(self, other: _Rows) -> pd.DataFrame:
        row, col = np.nonzero(self.at >= 0)
        return pd.DataFrame({"query_id": self.ids[row], "neighbor_id": other.in_order[self.at[row, col]], "distance": self.d[row, col]})


def _bounded(table: np.ndarray, need: int) -> np.ndarray:
    """A number that `need` numbers of each column do not exceed: of the least of several parts, the `need`th."""
    parts = 8 * need
    if len(table) >= 4 * parts:
        table = table[: len(table) // parts * parts].reshape(-1, parts, table.shape[1]).min(axis=0)
    return np.partition(table, need - 1, axis=0)[need - 1]


class _Meeting:
    """Two strips, or one and itself: blocks of rows rank by products, and what may be among the nearest is measured.

    Distances are measured in double precision.  Which pairs to measure is told by products in single precision, with a
    bound of their rounding; where that is not small beside the distances, by products in double precision.  `both`: the rows
    of either strip look for neighbours in the other, and a product serves both.
    """

    def __init__(self, left: _Rows, right: _Rows, both: bool):
        self.left, self.right, self.both = left, right, both
        mid = left.v.sum(axis=0, dtype=float) + right.v.sum(axis=0, dtype=float)
        for rows in {id(left): left, id(right): right}.values():
            rows.centre(mid / (len(left.ids) + len(right.ids)))
        self.table, self.mask = np.empty(0), np.empty(0, bool)

    def _rounding(self, s: slice, t: slice, kind: str) -> float:
        """What rounding may add to or take from a squared distance."""
        left, right = self.left, self.right
        width = left.v.shape[1] + 9
        least = width * np.finfo("f8").eps * (left.length[s].max() + right.length[t].max()) ** 2
        return least + width * np.finfo(kind).eps * (np.sqrt(left.own[s].max()) + np.sqrt(right.own[t].max())) ** 2

    def meet(self, s: slice, cell: int, t: slice, other: int, both: bool) -> None:
        """Rows `s` of the left strip, all of `cell`, and `t` of the right one, all of `other`."""
        left, right = self.left, self.right
        limits = [left.limit(s, other), right.limit(t, cell) if both else np.empty(0)]
        used = [x[x >= 0] for x in limits]
        if not any(map(len, used)):
            return
        kind, slack = "f8", self._rounding(s, t, "f8")
        if left.narrow is not None and right.narrow is not None:
            single = self._rounding(s, t, "f4")
            if np.sqrt(single / ROUNDING) <= min(np.median(x) for x in used if len(x)):
                kind, slack = "f4", single
        b = right.factors(t, kind)
        x = left.factors(s, kind)
        width = x.shape[1] - 2
        x = np.column_stack([-2 * x[:, :width], x[:, width + 1], x[:, width]])
        size = len(x) * len(b)
        if self.table.dtype != kind or len(self.table) < size:
            self.table = np.empty(size, dtype=kind)
        rough = np.matmul(x, b.T, out=self.table[:size].reshape(len(x), len(b)))
        if len(used[0]):
            open_ = left.first_looks(s, limits[0], len(b))
            first = _bounded(np.ascontiguousarray(rough[open_].T), left.need) if len(open_) else None
            row, at = self._within(rough, limits[0], open_, first, slack, 0)
            if len(row):
                left.put(s.start + row, right, t.start + at)
        if len(used[1]):
            open_ = right.first_looks(t, limits[1], len(x))
            first = _bounded(rough[:, open_], right.need) if len(open_) else None
            at, row = self._within(rough, limits[1], open_, first, slack, 1)
            if len(row):
                right.put(t.start + row, left, s.start + at)

    def _within(self, rough: np.ndarray, limit: np.ndarray, open_: np.ndarray, first: np.ndarray | None, slack: float, axis: int) -> tuple[np.ndarray, ...]:
        """Positions in `rough` of what may lie within the limits of its rows (axis 0) or columns (axis 1)."""
        with np.errstate(over="ignore"):
            bound = np.where(limit < 0, -np.inf, (limit + SLACK) ** 2 + slack)
            if first is not None:
                bound[open_] = np.minimum(bound[open_], first + 2 * slack)
            bound = bound.astype(rough.dtype)
            bound = np.where(limit < 0, bound, np.nextafter(bound, np.array(np.inf, dtype=rough.dtype)))
        words = -(-rough.size // 8)
        if len(self.mask) < words * 8:
            self.mask = np.empty(words * 8, bool)
        mask = self.mask[: words * 8]
        mask[rough.size :] = False
        np.less_equal(rough, np.expand_dims(bound, 1 - axis), out=mask[: rough.size].reshape(rough.shape))
        # few are: found by words of eight
        held = np.flatnonzero(mask.view(np.uint64))
        word, byte = np.nonzero(mask.reshape(-1, 8)[held])
        return np.divmod(held[word] * 8 + byte, rough.shape[1])

    def blocks(self, pivots: np.ndarray, block_rows: int) -> None:
        """All blocks of one cell and `block_rows` rows at most on either side, the nearest cells first.

        Rows of the right strip that lie beyond the distances found so far are left out by the triangle inequality.
        """
        left, right, size = self.left, self.right, min(block_rows, QUERY_ROWS)
        step = min(block_rows, max(1, PRODUCTS // size))
        for i, cell in enumerate(left.cells):
            gaps = np.sqrt(((pivots[right.cells] - pivots[cell]) ** 2).sum(axis=1))
            nearest = np.argsort(gaps, kind="stable")
            for start in range(left.first[i], left.last[i], size):
                s = slice(start, min(left.last[i], start + size))
                for j in nearest:
                    # within one strip each pair of cells meets once; a cell meets itself row by row
                    if self.both and left is right and j < i:
                        continue
                    both = self.both and not (left is right and i == j)
                    t = slice(right.first[j], right.last[j])
                    most = left.limit(s, right.cells[j]).max()
                    if both:
                        most = max(most, right.limit(t, cell).max())
                    if most < 0:
                        continue
                    least = gaps[j] - left.reach[start] - most - SLACK
                    end = t.start + int(np.searchsorted(-right.reach[t], -least, side="right"))
                    for at in range(t.start, end, step):
                        self.meet(s, cell, slice(at, min(end, at + step)), right.cells[j], both)


def _no_pairs() -> pd.DataFrame:
    return pd.DataFrame({"query_id": [], "neighbor_id": [], "distance": []})


def _strip_best(need: int, pivots: np.ndarray, block_rows: int):
    """The `need` nearest rows of a right strip for each row of a left one; ties by id."""

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return _no_pairs()
        asked, sent = _Rows(left, need), _Rows(right, need)
        _Meeting(asked, sent, False).blocks(pivots, block_rows)
        return asked.pairs(sent)

    return best


def _own_best(need: int, pivots: np.ndarray, block_rows: int):
    """The rows of a strip, with the `need` nearest of the same strip for each, and the distance that others have to be within."""

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        one = _Rows(rows.drop(columns=["low", "high", "task"]), need)
        _Meeting(one, one, True).blocks(pivots, block_rows)
        ids, counts = one.in_order[one.at], (one.at >= 0).sum(axis=1)
        met = {"met_id": [x[:n] for x, n in zip(ids, counts)], "met_distance": [x[:n] for x, n in zip(one.d, counts)]}
        return one.rows.assign(theta=np.minimum(one.theta, one.d[:, -1]), loose=one.loose, **met)

    return best


def _mutual_best(need: int, pivots: np.ndarray, block_rows: int):
    """The `need` nearest rows of the other strip for each row of either of two; ties by id."""

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        low = (rows["own"] < rows["other"]).to_numpy()
        if low.all() or not low.any():
            return _no_pairs()
        one, two = _Rows(rows[low], need), _Rows(rows[~low], need)
        _Meeting(one, two, True).blocks(pivots, block_rows)
        return pd.concat([one.pairs(two), two.pairs(one)])

    return best


def _met(asked: DataFrame, sent: DataFrame, keys: list[str], best, id_type: str) -> DataFrame:
    return asked.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(best, f"query_id {id_type}, neighbor_id {id_type}, distance double")


def _ranked(found: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    if exclude_self:
        found = found.filter(F.col("query_id") != F.col("neighbor_id"))
    order = W.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")


def _dealt(spark: SparkSession, loads: dict[tuple[int, int], float]) -> DataFrame:
    """`(low, high, task)`: a number for each pair of strips, such that the shuffle's hash deals the pairs evenly by load."""
    schema = "low int, high int, task int"
    if len(loads) > BROADCAST_ROWS:  # so many come out even by themselves
        return spark.createDataFrame([(*pair, n) for n, pair in enumerate(sorted(loads))], schema)
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbers: dict[int, list[int]] = {}
    some = spark.range(8 * max(count, len(loads))).select(F.col("id").cast("int").alias("n"))
    for n, part in some.select("n", F.pmod(F.hash("n"), F.lit(count))).collect():  # eight numbers a pair or partition
        numbers.setdefault(part, []).append(n)
    filled = [(0.0, part) for part in sorted(numbers)]
    out = []
    for (low, high), load in sorted(loads.items(), key=lambda x: (-x[1], x[0])):
        had, part = heapq.heappop(filled)
        out.append((low, high, numbers[part].pop()))
        if numbers[part]:
            heapq.heappush(filled, (had + load, part))
    return F.broadcast(spark.createDataFrame(out, schema))


def _mutual(rows: DataFrame, routes: DataFrame, pivots: np.ndarray, need: int, block_rows: int) -> DataFrame:
    """The join of `rows` with themselves by the routes of their cells: a product of two rows serves either.

    The rows of a strip meet first; what each finds there bounds how far it has to look in the others.  Then a row travels once
    to each pair of its strip with one that it matters to, be it as query or as base.
    """
    spark, id_type = rows.sparkSession, rows.schema["id"].dataType.simpleString()
    laid = _laid(rows, pivots, block_rows)
    held: dict[int, float] = {}
    for _, first, parts, count in laid:
        for strip in range(first, first + parts):
            held[strip] = held.get(strip, 0.0) + count / parts
    strips = _strip_table(spark, laid)
    thetas = routes.groupBy(F.col("q_cell").alias("of")).agg(F.min("theta").alias("theta"))
    placed = rows.join(strips, F.col("cell") == F.col("at_cell")).withColumn("own", _own_strip())
    placed = placed.join(F.broadcast(thetas), F.col("cell") == F.col("of")).select(*rows.columns, "theta", "own")  # a row a pivot
    types = ", ".join(f"{c} {t}" for c, t in placed.dtypes) + f", loose boolean, met_id array<{id_type}>, met_distance array<double>"
    placed = placed.join(_dealt(spark, {(x, x): n * n for x, n in held.items()}), F.col("own") == F.col("low"))
    met = stage(placed.groupBy("task").applyInPandas(_own_best(need, pivots, block_rows), types), "knn-met")
    found = met.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("met_id", "met_distance")).alias("m"))
    found = found.select("query_id", F.col("m.met_id").alias("neighbor_id"), F.col("m.met_distance").alias("distance"))
    if len(held) == 1:
        return found
    as_query = routes.join(strips, F.col("cell") == F.col("at_cell")).select(F.col("q_cell").alias("of"), _every_strip().alias("other"), F.lit(float("-inf")).alias("least"))
    as_base = routes.join(strips, F.col("q_cell") == F.col("at_cell")).select(F.col("cell").alias("of"), _every_strip().alias("other"), F.col("min_reach").alias("least"))
    to = as_query.union(as_base).groupBy("of", "other").agg(F.min("least").alias("least")).join(strips, F.col("of") == F.col("at_cell"))
    to = to.select("of", _every_strip().alias("of_own"), "other", "least").filter("of_own <> other")
    to = to.withColumn("low", F.least("of_own", "other")).withColumn("high", F.greatest("of_own", "other"))
    to = to.join(_dealt(spark, {(low, high): held[low] * held[high] for low in held for high in held if low < high}), ["low", "high"])
    if sum(parts for _, _, parts, _ in laid) * len(held) <= BROADCAST_ROWS:
        to = F.broadcast(to)
    sent = met.join(to, (F.col("cell") == F.col("of")) & (F.col("own") == F.col("of_own"))).filter(F.col("reach") >= F.col("least"))
    pairs = sent.select(*rows.columns, "theta", "loose", "own", "other", "task").groupBy("task")
    return found.union(pairs.applyInPandas(_mutual_best(need, pivots, block_rows), ", ".join(f"{c} {t}" for c, t in found.dtypes)))


def _nothing(base: DataFrame, id_type: str) -> DataFrame:
    return base.sparkSession.createDataFrame([], f"query_id {id_type}, rank int, neighbor_id {id_type}, distance double")


def knn_join(
    queries: DataFrame, base: DataFrame, k: int = 7, id_col: str = "id", vector: str = "v", exclude_self: bool = False, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """`(query_id, rank, neighbor_id, distance)`: Euclidean, ties by id.  Exact."""
    q, s = _vectors(queries, id_col, vector), _vectors(base, id_col, vector)
    need = k + 1 if exclude_self else k
    id_type, rows = s.schema["id"].dataType.simpleString(), s.count()
    if rows == 0:
        return _nothing(s, id_type)
    pivots = _pivots(s, _pivot_count(rows))
    # read by several passes: kept in memory when small, written to the shared folder when not
    if queries is base:
        sa = stage(_assign(s, pivots), "knn-base")
        return _ranked(_mutual(sa, stage(_routes(sa, sa, pivots, need), "knn-routes"), pivots, need, block_rows), k, exclude_self)
    sa, qa = stage(_assign(s, pivots), "knn-base"), stage(_assign(q, pivots), "knn-queries")
    routes = stage(_routes(sa, qa, pivots, need), "knn-routes")
    q_strips, s_strips = _strips(qa, pivots, block_rows), _strips(sa, pivots, block_rows)
    to_queries = routes.join(q_strips, F.col("q_cell") == F.col("at_cell")).select("cell", "min_reach", _every_strip().alias("q_strip"))
    to_queries = to_queries.groupBy(F.col("cell").alias("to_cell"), "q_strip").agg(F.min("min_reach").alias("min_reach"))
    to_base = routes.join(s_strips, F.col("cell") == F.col("at_cell")).select("q_cell", "theta", _every_strip().alias("s_strip")).distinct()
    sent = sa.join(s_strips, F.col("cell") == F.col("at_cell")).select("id", "v", "cell", "reach", _own_strip().alias("s_strip"))
    sent = sent.join(to_queries, F.col("cell") == F.col("to_cell")).filter("reach >= min_reach").select("id", "v", "cell", "reach", "q_strip", "s_strip")
    asked = qa.join(q_strips, F.col("cell") == F.col("at_cell")).select("id", "v", "cell", "reach", _own_strip().alias("q_strip"))
    asked = asked.join(to_base, F.col("cell") == F.col("q_cell")).select("id", "v", "cell", "reach", "theta", "q_strip", "s_strip")
    return _ranked(_met(asked, sent, ["q_strip", "s_strip"], _strip_best(need, pivots, block_rows), id_type), k, exclude_self)


def knn_approximate(
    queries: DataFrame,
    base: DataFrame,
    k: int = 7,
    id_col: str = "id",
    vector: str = "v",
    exclude_self: bool = False,
    probes: int = PROBES,
    pivots: int | None = None,
    rounds: int = 2,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """knn_join() over the base cells of each query's `probes` nearest pivots only; distances and ranks are exact among those.

    Pivots are rows moved to the means of their cells in `rounds` rounds.  Each base row is in one cell, each query in `probes`; with `probes` at the number of pivots the join is exact.  Cells of
    more than `block_rows` rows meet in blocks, those of more numbers than a strip holds in several tasks.
    """
    q, s = _vectors(queries, id_col, vector), _vectors(base, id_col, vector)
    need = k + 1 if exclude_self else k
    id_type, rows = s.schema["id"].dataType.simpleString(), s.count()
    if rows == 0:
        return _nothing(s, id_type)
    centres = _pivots(s, pivots or _pivot_count(rows))
    for _ in range(rounds):
        centres = _centred(s, centres)
    if queries is base:
        sa = stage(_assign(s, centres, probes, listed=True), "knn-base")
        probed = sa.select(F.explode("near").alias("cell"), F.col("cell").alias("q_cell")).distinct()
        routes = stage(probed.select("cell", "q_cell", F.lit(float("-inf")).alias("min_reach"), F.lit(float("inf")).alias("theta")), "knn-routes")
        return _ranked(_mutual(sa, routes, centres, need, block_rows), k, exclude_self)
    sa, qa = stage(_assign(s, centres), "knn-base"), stage(_assign(q, centres, probes), "knn-queries")
    strips = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    most = max(block_rows, STRIP_NUMBERS // centres.shape[1])
    sizes = stage(strips(sa, "s_strips").join(strips(qa, "q_strips"), "cell"), "knn-cells")
    own, every = (lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    sent = sa.join(sizes, "cell").select("id", "v", "cell", "reach", own("s_strips").alias("s_strip"), every("q_strips").alias("q_strip"))
    asked = qa.join(sizes, "cell").select("id", "v", "cell", "reach", F.lit(float("inf")).alias("theta"), own("q_strips").alias("q_strip"), every("s_strips").alias("s_strip"))
    return _ranked(_met(asked, sent, ["cell", "q_strip", "s_strip"], _strip_best(need, centres, block_rows), id_type), k, exclude_self)


def knn_classify(queries: DataFrame, base: DataFrame, label: str, k: int = 7, id_col: str = "id", vector: str = "v", exclude_self: bool = False) -> DataFrame:
    """`(query_id, prediction, votes)`: majority of the k neighbours, lowest label on ties."""
    found = knn_join(queries, base, k, id_col, vector, exclude_self)
    labels = base.select(quoted(id_col).alias("neighbor_id"), quoted(label).alias("label"))
    votes = found.join(labels, "neighbor_id").groupBy("query_id", "label").agg(F.count("*").alias("votes"))
    best = F.min_by(F.struct("label", "votes"), F.struct((-F.col("votes")).alias("v"), F.col("label")))
    return votes.groupBy("query_id").agg(best.alias("b")).select("query_id", F.col("b.label").alias("prediction"), "b.votes")


def knn_regress(queries: DataFrame, base: DataFrame, target: str, k: int = 7, id_col: str = "id", vector: str = "v", exclude_self: bool = False) -> DataFrame:
    """`(query_id, prediction)`: mean target of the k neighbours."""
    found = knn_join(queries, base, k, id_col, vector, exclude_self)
    values = base.select(quoted(id_col).alias("neighbor_id"), quoted(target).cast("double").alias("y"))
    return found.join(values, "neighbor_id").groupBy("query_id").agg(F.avg("y").alias("prediction"))
