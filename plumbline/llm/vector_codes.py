"""Product codes of vectors: each part of a vector becomes the number of its nearest codebook entry.

Components become integers, floor(256 x), so that distances, sums and ties are exact.  A vector is cut into equal
consecutive parts; each part position has a codebook, which starts as that part of the first vectors by key and is
improved by Lloyd rounds: every part goes to its nearest entry (squared Euclidean distance, ties to the lower number),
then each entry becomes the floor of the mean of its parts; an entry without parts stays.

Active entries: between rounds each part keeps its entry and the exact distance to it.  If that entry did not move, the
distance still holds, and every entry that stayed is still no nearer: the part is compared with the moved entries only.
If its entry moved, the part is compared with all.  The result equals a full comparison, ties to the lower number included.

The state (integers, entries, distances) is staged in the shared folder after each round, one narrow pass a round and no
shuffle of vectors; each task adds up its own parts and sends one row a codebook number.  The driver holds the codebooks,
whose size is parts x entries x width, a parameter.

Nulls, ties and the like: vectors that are null or empty, hold a null, NaN or an infinity are left out, and so are those whose
length differs from the first kept one's or is no multiple of the number of parts; a null key sorts last and is
coded like any other; rows that share a key are ordered by their components and repeated rows count as often as they occur; with fewer vectors
than entries the codebooks are shorter; null labels are one label; an empty table gives an empty result.  Components
beyond 2 ^ 20 would overflow the exact distances and stop the job with an OverflowError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import forget, only_columns, staged

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components are multiplied by this and rounded down.
SCALE = 256
#: Integers from which squared distances might not fit in 64 bits.
TOO_LARGE = 1 << 28
#: Vectors compared at a time.
BATCH = 1024


def usable(column: str) -> Column:
    """Whether a vector is not empty and has finite components only."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & (F.size(column) > 0) & ~F.coalesce(bad, F.lit(True))


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    scaled = np.floor(SCALE * np.asarray(vectors, np.float64))
    if scaled.size and np.abs(scaled).max() >= TOO_LARGE:
        raise OverflowError("a vector component is beyond 2 ^ 20")
    return scaled.astype(np.int64)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x (n, width) to the entries (m, width)."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for i in range(x.shape[1]):
        step = x[:, i, None] - entries[None, :, i]
        out += step * step
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest entry, the lowest of equals, and the distance to it."""
    d = distances(x, entries)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(x)), best]


def reassigned(x: np.ndarray, best: np.ndarray, d: np.ndarray, entries: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """nearest(), given the former answer and which entries moved since; the last value counts distances computed."""
    best, d = best.copy(), d.copy()
    fixed, movers = ~moved[best], np.flatnonzero(moved)
    if len(movers) and fixed.any():
        at = np.flatnonzero(fixed)
        j, dj = nearest(x[at], entries[movers])
        closer = (dj < d[at]) | ((dj == d[at]) & (movers[j] < best[at]))
        best[at[closer]], d[at[closer]] = movers[j[closer]], dj[closer]
    again = np.flatnonzero(~fixed)
    if len(again):
        best[again], d[again] = nearest(x[again], entries)
    return best, d, int(fixed.sum()) * len(movers) + len(again) * len(entries)


STATE = "x binary, best binary, d binary, error long, compared long"


def _assigned(state: DataFrame, kept: list[str], books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """The state after comparing all parts with `books` (parts, entries, width); `moved` is None the first time."""
    parts, entries, width = books.shape
    first = moved is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                n = batch.num_rows
                read = lambda name, kind: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind)
                x = whole_numbers(batch.column("v").flatten().to_numpy(zero_copy_only=False)) if first else read("x", np.int64)
                x = x.reshape(n, parts, width)
                best = np.zeros((n, parts), np.uint8) if first else read("best", np.uint8).reshape(n, parts)
                d = np.zeros((n, parts), np.int64) if first else read("d", np.int64).reshape(n, parts)
                best, d, compared = best.astype(np.int64), d.copy(), 0
                for p in range(parts):
                    if first:
                        (best[:, p], d[:, p]), count = nearest(x[:, p], books[p]), n * entries
                    else:
                        best[:, p], d[:, p], count = reassigned(x[:, p], best[:, p], d[:, p], books[p], moved[p])
                    compared += count
                rows = [pa.array([row.tobytes() for row in block], pa.binary()) for block in (x, best.astype(np.uint8), d)]
                share = pa.array([compared] + [0] * (n - 1), pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *rows, pa.array(d.sum(axis=1)), share], [*kept, "x", "best", "d", "error", "compared"])

    columns = ", ".join(f"`{c}` {state.schema[c].dataType.simpleString()}" for c in kept)
    return state.mapInArrow(run, f"{columns}, {STATE}")


def _moved_to_means(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with each entry that has parts at the floor of their mean."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * entries, width + 1), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.int64).reshape(-1, width)
                best = np.frombuffer(b"".join(batch.column("best").to_pylist()), np.uint8).reshape(-1, parts)
                np.add.at(total, (best + np.arange(parts) * entries).ravel(), np.column_stack([x, np.ones(len(x), np.int64)]))
        flat = total.ravel()
        used = np.flatnonzero(np.repeat(total[:, -1] > 0, width + 1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(flat[used], pa.int64())], ["slot", "value"])

    total = np.zeros(parts * entries * (width + 1), np.int64)
    for slot, value in state.select("x", "best").mapInArrow(run, "slot int, value long").groupBy("slot").agg(F.sum("value")).collect():
        total[slot] = value
    total = total.reshape(parts, entries, width + 1)
    n = total[:, :, -1:]
    return np.where(n > 0, total[:, :, :-1] // np.maximum(n, 1), books)


def coded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, key: str = "vec_id", column: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(key, label, x, best, d, error, compared) of the kept vectors, staged, and the codebooks (parts, entries, width).

    `best` holds a byte a part, `d` the parts' squared distances, `x` the components, both as 64-bit integers; `error` sums d;
    the sum of `compared` is the number of distances that the last round computed.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256")
    named = vectors.select(F.col(f"`{key}`").alias(key), F.col(f"`{label}`").alias(label), F.col(f"`{column}`").cast("array<double>").alias("v"))
    named = named.where(usable("v"))
    order = [F.col(key).isNull(), F.col(key), F.transform("v", lambda x: F.floor(x * SCALE))]
    cut = named.where(F.size("v") % parts == 0).orderBy(*order).select("v").first()
    width = len(cut[0]) // parts if cut else 1
    rows = named.where(F.size("v") == width * parts)
    start = whole_numbers([r[0] for r in rows.orderBy(*order).select("v").limit(entries).collect()] if cut else np.zeros((1, parts)))
    books = np.ascontiguousarray(start.reshape(-1, parts, width).transpose(1, 0, 2))
    state = staged(_assigned(rows, [key, label], books, None), "codes")
    for _ in range(rounds):
        former, old = books, state
        books = _moved_to_means(state, former)
        state = staged(_assigned(old, [key, label], books, (books != former).any(axis=2)), "codes")
        forget(old)
    return state, books if cut else books[:, :0]


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_table(vectors: DataFrame, key: str = "vec_id", label: str = "label", **options) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of the kept vectors; code has two hex digits a part."""
    state, books = coded(vectors, key=key, label=label, **options)
    sums = staged(state.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error")), "label_errors")
    joined = state.join(sums, F.col(label).eqNullSafe(F.col("_label")))
    return joined.select(key, F.lower(F.hex("best")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def codes_sql(source: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """code_table() in DuckDB's SQL, by full comparisons."""
    apart = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""near{i} AS MATERIALIZED (SELECT r, p, min(d * {entries} + e) % {entries} AS e, min(d) AS d FROM (SELECT a.r, a.p, b.e, {apart} AS d FROM parts a JOIN books{i} b USING (p)) GROUP BY r, p)""")
        if i < rounds:
            steps.append(f"""means{i} AS (SELECT p, e, list(m ORDER BY k) AS v FROM (SELECT n.p, n.e, k, floor(sum(a.v[k]) / count(*))::BIGINT AS m FROM near{i} n JOIN parts a USING (r, p), range(1, (SELECT max(len(v)) FROM parts) + 1) t(k) GROUP BY n.p, n.e, k) GROUP BY p, e),
books{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.v, b.v) AS v FROM books{i} b LEFT JOIN means{i} m USING (p, e))""")
    steps = ",\n".join(steps)
    return f"""WITH usable AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM {source}
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
kept AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS r FROM usable),
parts AS MATERIALIZED (SELECT r, p, q[p * len(q) // {parts} + 1 : (p + 1) * len(q) // {parts}] AS v FROM kept, range({parts}) t(p)),
books0 AS MATERIALIZED (SELECT p, r AS e, v FROM parts WHERE r < {entries}),
{steps},
coded AS (SELECT vec_id, label, code, error FROM kept JOIN (SELECT r, string_agg(lower(printf('%02x', e::INTEGER)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY r) USING (r))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM books{rounds}) AS codebooks_sha256 FROM coded"""
