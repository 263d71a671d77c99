"""Personal data: the fixed patterns against Python's, the bootstrapping against a plain version of it."""

from __future__ import annotations

import hashlib
import math
import re

from plumbline.llm import personal_data as P

SCHEMA = "doc_id long, text string"


def good(kind: str, value: str) -> bool:
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base(text: str) -> list[tuple]:
    return [(i, m.start(), m.end()) for i, k in enumerate(P.KINDS) for m in re.finditer(P.PATTERNS[k], text) if good(k, m[0])]


def named(spans: list[tuple]) -> str:
    return ",".join(f"{(P.KINDS + P.ADDED)[r]}:{a}:{b}" for r, a, b in spans)


def slow_added(texts: list[str]) -> list[list[tuple]]:
    """Spans that bootstrapping adds, text by text."""
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    words = lambda t: re.findall(P.WORD, re.sub("[0-9]", "9", low(t)))
    places = []
    for n, text in enumerate(texts):
        known = base(text)
        for rank, regex in [*enumerate(P.PATTERNS.values()), (P.NONE, P.CANDIDATE)]:
            found = [m for m in re.finditer(regex, text) if rank != 2 or 16 <= len(re.sub("[^0-9]", "", m[0])) <= 19]
            for i, m in enumerate(found):
                before = text[found[i - 1].end() if i else 0 : m.start()]
                after = text[m.end() : found[i + 1].start() if i + 1 < len(found) else len(text)]
                if rank == P.NONE:
                    if not ("@" in m[0] or len(re.sub("[^0-9]", "", m[0])) >= P.LEAST_DIGITS) or re.search(P.ALNUM, before[-1:] + after[:1]):
                        continue
                    if any(a < m.end() and m.start() < b for _, a, b in known):
                        continue
                elif not good(P.KINDS[rank], m[0]):
                    continue
                left, right = words(before[-P.CONTEXT :]), words(after[: P.CONTEXT])
                patterns = [f"2|{' '.join(left[-2:])}"] * (len(left) > 1) + [f"1|{''.join(left[-1:])} _ {''.join(right[:1])}"] * bool(left and right)
                places.append((n, rank, m.start(), m.end(), low(m[0]), patterns))
    edges = {(p, v) for *_, v, ps in places for p in ps}
    total = {}
    for p, _ in edges:
        total[p] = total.get(p, 0) + 1
    edges = {(p, v) for p, v in edges if total[p] >= P.SUPPORT}
    seeds = {(v, r): P.MILLION for _, r, _, _, v, _ in places if r != P.NONE}
    accepted: dict = {}
    for _ in range(P.ROUNDS):
        mass: dict = {}
        for (v, r), s in {**seeds, **accepted}.items():
            for p, w in edges:
                if w == v:
                    mass.setdefault((p, r), []).append(s)
        kept = {k: c for k, ss in mass.items() if len(ss) >= P.SUPPORT and (c := sum(ss) / (P.MILLION * (total[k[0]] + 1.0))) >= P.SURE}
        proof: dict = {}
        for (p, r), c in kept.items():
            for q, v in edges:
                n = len(re.sub("[^0-9]", "", v))
                fits = ("@" in v, bool(re.match(r"^[0-9]+\.[0-9]+\.[0-9.]+$", v)), 12 <= n <= 19 and "@" not in v, 7 <= n <= 15 and "@" not in v)[r]
                if p == q and fits and not any(w == v for w, _ in seeds):
                    proof[v, r] = proof.get((v, r), 0) + round(-math.log(1 - c) * P.MILLION)
        best: dict = {}
        for (v, r), x in proof.items():
            if x >= round(-math.log(1 - P.ACCEPT) * P.MILLION):
                best[v] = min(best.get(v, (0, 0)), (-x, r))
        accepted = {(v, r): round((1 - math.exp(x / P.MILLION)) * P.MILLION) for v, (x, r) in best.items()}
    kind = {v: r for v, r in accepted}
    return [sorted((kind[v] + 4, a, b) for m, rank, a, b, v, _ in places if m == n and rank == P.NONE and v in kind) for n in range(len(texts))]


def compared(spark, rows: list[tuple]) -> list[list[tuple]]:
    texts = [t or "" for _, t in rows]
    got = P.personal_data_table(spark.createDataFrame(rows, SCHEMA)).collect()
    added = slow_added(texts)
    expected = []
    for (i, _), text, more in zip(rows, texts, added):
        known = base(text)
        counts = [sum(r == k for r, *_ in known) for k in range(4)]
        expected.append((i, *counts, len(more), hashlib.sha256(named(known).encode()).hexdigest(), named(known + more)))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    return added


TEXTS = [
    "write to a.b-c+d@mail.example.com. or x@y or @z.q or a@b@c.d.e..f a@b.c_d@e.f é@ü.de %@-.-",
    "1.2.3.4 1.2.3.4.5.6.7.8.9 256.1.1.1 0001.02.3.0255 1..2.3.4 12.3.4 999999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 22 4111  1111 1111 1111 4111 1111 1111 11110 5555 5555 5555 4444x",
    "+1 (743) 555-3824 and +12 34, +1234567890123456 +1 +2 3 ++49 30 1234567.",
    "",
    None,
]


def test_fixed_patterns(spark):
    compared(spark, list(enumerate(TEXTS)) + [(None, TEXTS[0]), (0, TEXTS[1])])


def planted() -> list[tuple]:
    rows = [(i, f"Please call me at +1 (743) 555-38{i:02d} after six. Invoice no {1000000 + i} is paid.") for i in range(8)]
    rows += [(20 + i, f"please CALL me at 743-555-39{i:02d} after lunch, ticket no {2000000 + i} is open") for i in range(3)]
    rows += [(30 + i, f"my desk line: 030 555 12{i:02d} rings; also call me at 030 555 12{i:02d} after ten") for i in range(4)]
    rows += [(40, "my desk line: 040 777 1234 rings; twice"), (41, "send it to x1@mail.example.com or y2@mail.example.com now"), (42, "order 99999999 after six")]
    return rows


def test_contexts_find_more(spark):
    added = compared(spark, planted())
    texts = dict(planted())
    found = {texts[i][a:b] for (i, _), spans in zip(planted(), added) for _, a, b in spans}
    assert {"743-555-3900", "030 555 1200"} <= found
    assert "040 777 1234" in found  # its only pattern was learned from numbers found in the round before
    assert not any(x.startswith(("1000", "2000", "9999")) for x in found)


def test_edges(spark, edge, nothing):
    assert P.personal_data_table(nothing).collect() == []
    assert len(P.personal_data_table(edge).collect()) == edge.count()


LONG = {
    "7" * 300_000: 0,
    "1 " * 200_000: 0,
    "a" * 300_000 + "@": 0,
    "x@" + ".a" * 150_000: 0,
    "x@a" + ".a" * 150_000: 1,
    "1." * 150_000: 37_500,
    "+1" * 150_000: 0,
    "+1 555 123 4567 / 5551234567 " * 8_000: 8_000,
}


def test_long_texts(spark):
    rows = P.personal_data_table(spark.createDataFrame(list(enumerate(LONG)), SCHEMA).repartition(8)).collect()
    assert {r["doc_id"]: len([s for s in r["spans"].split(",") if s]) for r in rows} == dict(enumerate(LONG.values()))


def test_sql_twin_on_planted_contexts(spark):
    import duckdb
    import pyarrow as pa

    given = planted() + list(enumerate(TEXTS, 100))
    docs = pa.table({"doc_id": pa.array([i for i, _ in given], pa.int64()), "text": pa.array([t for _, t in given], pa.string())})
    con = duckdb.connect()
    con.register("docs", docs)
    table = P.personal_data_table(spark.createDataFrame(given, SCHEMA))
    expected = con.sql(f"SELECT {', '.join(table.columns)} FROM ({P.personal_data_sql('docs')})").fetchall()
    assert sorted(map(tuple, table.collect())) == sorted(expected) and sum(r[5] for r in expected) > 5
