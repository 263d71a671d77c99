import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from plumbline.llm import decontaminate, language, mixing, sharding, simhash
from plumbline.llm.common import staged
from plumbline.llm.queries import MIX, MIX_SEED, domain_of_source
from tests.llm.test_decontaminate import slow
from tests.llm.test_near_copies import shingles
from tests.llm.test_simhash import groups

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    steps = {"documents": docs}
    for name, stage in P.STAGES:
        docs = steps[name] = staged(stage(spark, docs, FOLDER), name)
        if name != "sharding":
            assert docs.columns == steps["documents"].columns
    raw, known, lone, clean, mix, out = (by_id(df) for df in steps.values())

    model = language.fit(steps["documents"].where(~language.held_out()))
    langs, scores = model.predict([raw[i]["text"] for i in raw])
    assert set(known) == {i for i, x, s in zip(raw, langs, scores) if x != "und" and s >= 0.35}

    texts = {i: known[i]["text"] for i in known}
    sets = {i: shingles(t) for i, t in texts.items()}
    root = groups(sorted(known), [(a, b) for a in texts for b in texts if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    assert set(lone) == set(root.values())
    assert len(lone) < len(known)

    items = [(r["item_id"], decontaminate.words_of(r["text"])) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for i, r in lone.items():
        words = decontaminate.words_of(r["text"])
        hit, _ = slow(words, items, 10)
        if len(hit) > 0.5 * len(words):
            assert i not in clean
        elif not hit:
            assert clean[i] == r
        else:
            assert not slow(decontaminate.words_of(clean[i]["text"]), items, 10)[0] and clean[i]["n_chars"] == len(clean[i]["text"]) < r["n_chars"]

    rows, cut = mixing.mixed(steps["decontamination"], MIX, P.MIX_SHARE, 1, MIX_SEED, domain=domain_of_source())
    assert set(mix) == {r["doc_id"] for r in mixing.copies(rows, cut, MIX_SEED).where("copies = 1").collect()}
    assert all(clean[i] == mix[i] for i in mix)

    want = by_id(sharding.place(steps["source_mix"].select("doc_id"), sharding.shard_tree(P.SHARDS)))
    assert {i: r["shard"] for i, r in out.items()} == {i: r["shard"] for i, r in want.items()}
    whole = by_id(P.run(spark, FOLDER))
    assert whole == out


def test_edges(spark, edge, nothing):
    for docs in (edge, nothing):
        for _, stage in P.STAGES:
            docs = staged(stage(spark, docs, FOLDER), "edge")
        assert {"extra", "shard", "score"} <= set(docs.columns) and docs.columns.count("shard") == 1
    kept = staged(P.near_dedup(spark, edge, FOLDER), "kept")
    assert kept.where(F.col("doc_id").isNull()).count() == 1
    assert simhash.deduplicated(kept).count() == kept.count()
