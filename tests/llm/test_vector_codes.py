"""Vector codes against comparing every part with every entry."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm.vector_codes import code_table, coded, distances, nearest, reassigned

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow_codes(rows: list[tuple], parts: int, entries: int, rounds: int) -> tuple[list[tuple], list]:
    kept = [r for r in rows if r[1] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    cut = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in kept]
    cut.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(cut[0][1]) // parts
    pieces = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in cut]
    books = [[pieces[r][p] for r in range(min(entries, len(cut)))] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x[p], e)), j) for j, e in enumerate(books[p])) for p in range(parts)] for x in pieces]

    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [x[p] for x, n in zip(pieces, near) if n[p][1] == j]
                if mine:
                    books[p][j] = [math.floor(sum(c) / len(mine)) for c in zip(*mine)]
    near = assign()
    error = [sum(d for d, _ in n) for n in near]
    total = {}
    for (_, _, label), e in zip(cut, error):
        total[label] = total.get(label, 0) + e
    return sorted(((i, "".join(f"{j:02x}" for _, j in n), e, total[label]) for (i, _, label), n, e in zip(cut, near, error)), key=repr), books


def vectors(n: int, seed: int = 3, size: int = 8) -> list[tuple]:
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(size)] for _ in range(5)]
    return [(i, [c + draw.gauss(0, 0.2) for c in draw.choice(centres)], draw.choice((None, 0, 1, 2))) for i in range(n)]


def compared(spark, rows, parts, entries, rounds):
    df = spark.createDataFrame(rows, SCHEMA)
    got = code_table(df, parts=parts, entries=entries, rounds=rounds).collect()
    state, books = coded(df, parts=parts, entries=entries, rounds=rounds)
    expected, slow_books = slow_codes(rows, parts, entries, rounds)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=repr) == expected
    assert books.tolist() == slow_books
    return state, len(expected)


@pytest.mark.parametrize("rounds", [0, 1, 2, 6])
def test_against_full_comparison(spark, rounds):
    state, n = compared(spark, vectors(200), 4, 8, rounds)
    if rounds == 6:  # entries have come to rest, so most distances were not computed again
        assert state.agg(F.sum("compared")).first()[0] < 0.7 * n * 4 * 8


def test_edges(spark):
    rows = vectors(30)
    rows += [(3, rows[3][1], 1), (3, [0.5] * 8, 1), (None, [0.25] * 8, None), (40, None, 1), (41, [None] + [0.0] * 7, 1), (42, [float("nan")] + [0.0] * 7, 0), (43, [float("inf")] + [0.0] * 7, 0), (44, [], 0)]
    rows += [(i, rows[0][1], 2) for i in range(50, 60)]
    compared(spark, rows, 4, 16, 2)
    compared(spark, rows[:5], 4, 16, 2)
    empty = spark.createDataFrame([], SCHEMA)
    assert code_table(empty).collect() == [] and code_table(empty).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    odd = spark.createDataFrame(rows[:5] + [(99, [1.0] * 4, 0)], SCHEMA)
    assert {r["vec_id"] for r in code_table(odd, parts=4).collect()} == {0, 1, 2, 3, 4}
    clashing = spark.createDataFrame([(*r, "a", 1) for r in rows[:5]], SCHEMA + ", code string, v int")
    assert len(code_table(clashing, parts=4).collect()) == 5


def test_ties_and_moved_entries():
    draw = np.random.default_rng(5)
    for _ in range(200):
        x, entries = draw.integers(-3, 4, (20, 2)), draw.integers(-3, 4, (6, 2))
        best, d = nearest(x, entries)
        assert (distances(x, entries).min(axis=1) == d).all()
        following = np.where(draw.random((6, 1)) < 0.4, draw.integers(-3, 4, (6, 2)), entries)
        b, e, _ = reassigned(x, best, d, following, (following != entries).any(axis=1))
        assert (b == nearest(x, following)[0]).all() and (e == nearest(x, following)[1]).all()


def test_too_large_components_stop(spark):
    with pytest.raises(Exception, match="beyond 2"):
        code_table(spark.createDataFrame([(1, [1e30] * 16, 0)], SCHEMA)).collect()
