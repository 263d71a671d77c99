"""Spelling variants against comparing all pairs."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import pytest

from plumbline.llm import spelling
from plumbline.llm.spelling import Acceptor, nearest_words, variants, words_of

SCHEMA = "doc_id long, text string"


def one_edit(a: str, b: str) -> bool:
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(rows: list[tuple], least: int = 7) -> dict[str, tuple]:
    found: Counter[str] = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                word = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(word) >= least:
                    found[word] += 1
            run = ""
    n = {w: c for w, c in found.items() if c >= 2}
    near = {w: [o for o in n if one_edit(w, o)] for w in n}
    best = {w: min(o, key=lambda x: (-n[x], x)) if o else None for w, o in near.items()}
    form = {w: b if b and n[b] >= 10 * n[w] else None for w, b in best.items()}

    def root(w: str) -> str:
        return root(form[w]) if form[w] else w

    return {w: (n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w in n}


def table(df) -> dict[str, tuple]:
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}


def some_rows(seed: int = 1) -> list[tuple]:
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcÀé") for _ in range(draw.randint(5, 9))) for _ in range(150)]
    words += [w[:i] + draw.choice("abcé") + w[i + 1 :] for w in words[:40] for i in (0, len(w) // 2)]
    weights = [draw.choice((1, 1, 2, 30)) for _ in words]
    return [(i, " ".join(draw.choices(words, weights, k=120))) for i in range(40)]


@pytest.mark.parametrize("limit", [1 << 18, 200, 1])
def test_against_all_pairs(spark, limit):
    rows = some_rows()
    expected = slow_variants(rows)
    assert sum(x[1] > 0 for x in expected.values()) > 50 and sum(x[2] is not None for x in expected.values()) > 5
    assert table(variants(spark.createDataFrame(rows, SCHEMA), limit=limit)) == expected


def test_acceptor_is_minimal():
    words = sorted(a + b for a in ("kar", "kor", "mar", "mor") for b in ("ten", "tes", "tet"))
    machine = Acceptor(words)
    assert len(machine.final) == 7  # the start, and a state after each further letter: all share their endings
    assert machine.count[machine.start] == len(words)


@pytest.mark.parametrize("seed", range(20))
def test_pairs_of_one_acceptor(seed):
    draw = random.Random(seed)
    words = sorted({"".join(draw.choice("ab") for _ in range(draw.randint(1, 6))) for _ in range(draw.randint(1, 40))})
    pairs = [(int(i), int(j)) for a, b in Acceptor(words).pairs() for i, j in zip(a, b)]
    assert len(pairs) == len(set(map(frozenset, pairs)))
    assert {frozenset((words[i], words[j])) for i, j in pairs} == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}
    near, best = nearest_words(words, [2] * len(words))
    assert [len([o for o in words if one_edit(w, o)]) for w in words] == near.tolist()
    assert all((b == -1) == (n == 0) for n, b in zip(near, best))


def test_chains_reach_their_root(spark):
    words = ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb"]  # each ten times rarer than the one before
    forms = spark.createDataFrame([(b, a) for a, b in zip(words, words[1:])], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling._with_roots(forms).collect()} == dict.fromkeys(words[1:], words[0])


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "Größere größere GRÖSSERE"), (3, "grösere " * 3), (3, "grösere " * 3), (4, "x" * 20_000 + " " + "x" * 20_000), (5, "x" * 20_001 + " " + "x" * 20_001), (6, "÷÷÷÷÷÷÷ ÷÷÷÷÷÷÷")]
    expected = slow_variants(rows)
    assert table(variants(spark.createDataFrame(rows, SCHEMA))) == expected
    assert table(variants(spark.createDataFrame(rows, SCHEMA), limit=5)) == expected
    assert variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert variants(spark.createDataFrame([(1, None)], SCHEMA)).collect() == []
    clashing = spark.createDataFrame([(*r, 1, "a") for r in rows], SCHEMA + ", n long, word string")
    assert table(variants(clashing)) == expected


def test_runs():
    assert words_of("ABCDEFGH1ijklmno Ünderwa+ÜBERALL") == ["abcdefgh", "ijklmno", "Ünderwa", "Überall"]
