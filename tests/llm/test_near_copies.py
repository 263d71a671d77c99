import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import near_copies as N
from tests.llm.test_simhash import groups


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def alike(x, y):
    a, b = shingles(x), shingles(y)
    return len(a & b) / len(a | b) >= 0.8


def planted():
    """Texts of 30 to 200 words with near copies round the threshold, and a crowd that shares one passage."""
    random.seed(11)
    some = lambda n: [f"w{random.randrange(5000)}" for _ in range(n)]
    texts = []
    for _ in range(60):
        base = some(random.randint(30, 200))
        texts.append(" ".join(base))
        for _ in range(3):
            near = list(base)
            for _ in range(max(1, int(len(base) * random.uniform(0, 0.03)))):
                near[random.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
    passage = some(60)
    texts += [" ".join(passage + some(random.randint(1, 40))) for _ in range(150)]
    random.shuffle(texts)
    return dict(enumerate(texts))


def test_planted_near_copies(spark):
    texts = planted()
    root = groups(sorted(texts), [(a, b) for a in texts for b in texts if a < b and alike(texts[a], texts[b])])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert got == set(root.values()) and len(got) < len(texts) - 100


def crowds():
    """A long chain of near copies that no one text reaches, and a crowd of strangers that share most of a text, some of them in pairs."""
    draw = random.Random(5)
    some = lambda n: [f"w{draw.randrange(5000)}" for _ in range(n)]
    base, texts = some(120), []
    for i in range(40):
        texts.append(" ".join(base))
        base = list(base)
        base[(7 * i) % 120] = f"c{i}"
    passage = some(100)
    for _ in range(30):
        own = passage[:70] + some(30)
        texts.append(" ".join(own))
        if draw.random() < 0.5:
            own[75] = "other"
            texts.append(" ".join(own))
    draw.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_crowded_cells_lose_no_group(spark, rounds, monkeypatch):
    """With few leaders and rounds the prefix filter has to find what is left; with none it finds all but the stars."""
    monkeypatch.setattr(N, "LEADERS", 2)
    monkeypatch.setattr(N, "cells", lambda hashes: np.arange(2, dtype=np.int64))  # all texts in the same two cells
    texts = crowds()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    sets = N.sketches(docs).groupBy("fp").agg(F.min(F.struct("doc_id", "n", "cells")).alias("s")).select("fp", "s.*")
    found = {(r["a"], r["b"]) for r in N.links(docs, sets, rounds=rounds).collect()}
    prints = {i: N.set_print(N.shingle_set(t)) for i, t in texts.items()}
    of = {p: i for i, p in prints.items()}
    got = groups(sorted(of.values()), [(of[a], of[b]) for a, b in found])
    expected = groups(sorted(of.values()), [(a, b) for a in of.values() for b in of.values() if a < b and alike(texts[a], texts[b])])
    assert got == expected and 20 < len(set(expected.values())) < len(of) - 20


def test_cells_of_like_sets():
    a = N.shingle_set("a b c d e f g h")
    assert len(a) == 4 and set(N.cells(a)) == set(N.cells(a[::-1].copy())) and len(set(N.cells(a).tolist())) == N.TABLES
    assert not len(N.cells(N.shingle_set(None))) and N.set_print(N.shingle_set("")) == N.set_print(N.shingle_set(None))
    assert not set(N.cells(a)) & set(N.cells(N.shingle_set("q r s t u v w x")))


def test_edges(edge, nothing):
    kept = N.deduplicated(edge)
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert kept.columns == edge.columns and ids == [1, 4, 7, 8, 9, None]
    assert N.deduplicated(nothing).count() == 0
    assert N.deduplicated(edge.withColumn("doc_id", F.col("doc_id").cast("string"))).count() == 6


def test_fingerprints_give_candidates(spark):
    """The multi-index search alone finds texts that share no cell, and sets of one fingerprint."""
    draw = random.Random(2)
    base = [f"w{draw.randrange(5000)}" for _ in range(3000)]
    near = [*base[:1500], "changed", *base[1501:]]
    texts = {0: " ".join(base), 1: " ".join(near), 2: " ".join(reversed(base))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = N.sketches(docs).withColumn("cells", F.array((F.col("doc_id") + 7).cast("long")))
    prints = {i: N.set_print(N.shingle_set(t)) for i, t in texts.items()}
    first = N.by_fingerprints(sets.select("fp", "sim"))
    assert {frozenset(r) for r in first.collect()} == {frozenset((prints[0], prints[1]))}
    assert N.links(docs, sets).count() == 0
    assert {frozenset(r) for r in N.links(docs, sets, first=first).collect()} == {frozenset((prints[0], prints[1]))}


def test_parity_bits_leave_strangers_out(spark):
    """Texts that share most, but less than 0.8, are no pairs to verify; close sets are, also beyond the bits' number."""
    draw = random.Random(9)
    some = lambda n: [f"w{draw.randrange(90000)}" for _ in range(n)]
    base, texts = some(80), []
    for at in range(10, 71, 6):
        texts.append(" ".join([*base[:at], f"c{at}", *base[at + 1 :]]))
    strangers = len(texts)
    for n in (40, 2000):
        base = some(n)
        texts += [" ".join(base), " ".join([*base[:-1], "other"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = N.sketches(docs)
    shingles = N._shingles(docs.join(sets.select("doc_id", "fp"), "doc_id").select("text", "fp"), N.WORDS)
    pairs = N._by_rare_shingles(sets.select("fp", "n", F.col("fp").alias("root")), shingles).distinct().collect()
    prints = [N.set_print(N.shingle_set(t)) for t in texts]
    found, near = {frozenset(r) for r in pairs}, {frozenset(prints[i : i + 2]) for i in (strangers, strangers + 2)}
    # of 55 pairs at 0.77; shingles that fall on one bit hide a few
    assert near <= found and len(found - near) < 30
