import hashlib
import math

from pyspark.sql import functions as F

from plumbline.llm import sharding as S


def draw(key, node, path="tree"):
    """The placement by hand."""
    if node.shard is not None:
        return node.shard
    waits = []
    for c in node.children:
        u = (int(hashlib.md5(f"{path}/{c.name}|{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        waits.append((-math.log(u) / c.weight, c))
    _, child = min(waits, key=lambda w: w[0])
    return draw(key, child, f"{path}/{child.name}")


def placed(df, tree):
    return {r["doc_id"]: (r["region"], r["rack"], r["shard"]) for r in S.place(df, tree).collect()}


def test_placement_by_hand_and_growth(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"))
    tree, more = S.shard_tree(8), S.shard_tree(9, grown_from=8)
    old, new = placed(df, tree), placed(df, more)
    assert all(old[k][2] == draw(k, tree) and new[k][2] == draw(k, more) for k in old)
    moved = [k for k in old if old[k] != new[k]]
    assert moved and all(new[k][2] == 8 for k in moved)
    assert abs(len(moved) - 3000 / 9) < 80


def test_a_weight_moves_only_its_own_subtree(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"))
    tree = S.shard_tree(8)
    heavier = S.reweighted(tree, 2, 2.0)
    old, new = placed(df, tree), placed(df, heavier)
    changed = ("r0", "k1")
    for k in old:
        if old[k] != new[k]:  # rows only come into the region, the rack and the shard that grew
            assert new[k][0] == changed[0] and (old[k][0] != changed[0] or new[k][1] == changed[1])
    assert sum(v[2] == 2 for v in new.values()) > sum(v[2] == 2 for v in old.values())
    assert all(v[2] != 5 for v in placed(df, S.reweighted(tree, 5, 0.0)).values())


def test_edges(edge, nothing):
    got = S.shard_table(edge).collect()
    assert len(got) == edge.count()
    for shard in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert len({r["shard"] for r in got if r["doc_id"] == 9}) == 1
    assert {r["size"] for r in got if r["doc_id"] in (4, 5)} == {1}
    assert {r["size"] for r in got if r["doc_id"] == 8} == {len("ünï cödé 中文 words".encode()) + 1}
    full = S.place(edge, S.shard_tree(8))
    assert full.columns.count("shard") == 1 and dict(full.dtypes)["shard"] == "int" and "extra" in full.columns
    assert S.shard_table(nothing).count() == 0
