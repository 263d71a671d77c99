import random
import re

import xxhash
from pyspark.sql import functions as F

from plumbline.llm import components as C
from plumbline.llm import near_copies
from plumbline.llm import simhash as H
from plumbline.llm.common import LEAST_TASKS, staged
from plumbline.llm.components import components


def slow_print(text, words=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def near(values):
    return [(a, b) for i, a in enumerate(values) for b in values[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2]


def test_fingerprints_by_hand_and_in_the_jvm(spark, edge):
    got = {(r["doc_id"], r["fingerprint"]) for r in H.fingerprints(edge, 3).collect()}
    assert got == {(r["doc_id"], signed(slow_print(r["text"]))) for r in edge.select("doc_id", "text").collect()}
    jvm = spark.sql("SELECT xxhash64('a b c') AS h").first()[0]
    assert jvm == signed(xxhash.xxh64_intdigest(b"a b c", 42))


def test_links_with_crowded_cells(spark):
    random.seed(5)
    values = set()
    for base in [random.getrandbits(64) for _ in range(3)]:
        for _ in range(250):  # near copies
            x = base
            for _ in range(random.randint(0, 5)):
                x ^= 1 << random.randrange(64)
            values.add(x)
        for _ in range(150):  # many that share half of their bits
            values.add((base & ~0xFFFFFFFF) | random.getrandbits(32))
            values.add((base & 0xFFFFFFFF) | (random.getrandbits(32) << 32))
    nodes = sorted(signed(v) for v in values)
    links = H.close_links(spark.createDataFrame([(n,) for n in nodes], "fp long"))
    assert all(bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= 2 for r in links.collect())
    got = {r["node"]: r["root"] for r in components(links).collect()}
    want = groups(nodes, near(nodes))
    assert {n: got.get(n, n) for n in nodes} == want


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(200)] + [(300 + i, 300) for i in range(1, 150)] + [(7, 7), (None, 3), (5, 6)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {300 + i: 300 for i in range(150)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_small_tables_of_components_are_few_files(spark, monkeypatch):
    files = {}

    def counted(df, *args):
        out = staged(df, *args)
        files[args[0]] = max(files.get(args[0], 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(C, "staged", counted)
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        links = spark.range(3000).selectExpr("id AS a", "id - id % 3 AS b")
        got = {r["node"]: r["root"] for r in C.components(links).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i - i % 3 for i in range(3000)}
    assert max(files["least"], files["large"]) <= LEAST_TASKS < 64


def test_edges(edge, nothing):
    got = {(r["doc_id"], r["component_id"]) for r in H.near_duplicates(edge).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (9, 9)} <= got
    kept = H.deduplicated(edge)
    assert kept.columns == edge.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids.count(9) == 1 and ids.count(None) == 1 and {1, 4, 7, 8, 9} <= set(ids) and not {2, 3, 5, 6} & set(ids)
    assert H.near_duplicates(nothing).count() == 0 and H.deduplicated(nothing).count() == 0


def test_a_copy_held_by_most_rows(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "one two three four").otherwise(F.concat(F.lit("unlike "), F.sha2(F.col("id").cast("string"), 256))).alias("text"))
    got = {r["doc_id"]: r["component_id"] for r in H.near_duplicates(df).collect()}
    assert all(got[i] == 1 for i in got if i % 3)


def test_ids_that_repeat_with_unlike_texts(spark):
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "red green blue white black grey"
    rows = [(1, a), (9, a), (9, b), (12, b), (20, c), (20, "gold " * 9), (20, c), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for module in (H, near_copies):
        got = sorted(((r["doc_id"], r["text"]) for r in module.deduplicated(docs).collect()), key=str)
        assert got == sorted([(1, a), (9, b), (20, c), (20, "gold " * 9), (None, a)], key=str)
