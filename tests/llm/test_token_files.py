import os
import zlib

import numpy as np
import pytest

from plumbline.llm import token_files as K

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def test_round_trips_and_damage(monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 64)
    monkeypatch.setattr(K, "LANES", 7)
    r = np.random.default_rng(1)
    for ids in (np.zeros(0), np.zeros(1), r.integers(0, 49408, 1000), np.minimum(r.zipf(1.3, 3000), 49407), np.tile([5, 6, 49407], 500), np.zeros(2000), np.full(130, 65535)):
        ids = ids.astype(np.int32)
        blocks = K.write_blocks(ids, 65536)
        assert np.array_equal(K.read_blocks(blocks, 65536), ids)
    n, crc, payload = blocks[0]
    with pytest.raises(ValueError):
        K.read_blocks([(n, crc ^ 1, payload)], 65536)
    alone = K.write_blocks(ids, 65536)[1]
    assert np.array_equal(K.read_blocks([alone], 65536), ids[64:128])  # any block can be read by itself
    assert K.digits_of(2) == 1 and K.digits_of(16) == 1 and K.digits_of(17) == 2 and K.digits_of(49408) == 4 and K.digits_of(65537) == 5


def test_it_compresses():
    r = np.random.default_rng(2)
    phrases = [r.integers(0, 49408, 12) for _ in range(20)]
    ids = np.concatenate([phrases[i] for i in r.integers(0, 20, 1500)]).astype(np.int32)
    size = sum(len(p) for _, _, p in K.write_blocks(ids, 49408))
    assert size < 0.4 * 2 * len(ids)


def direct(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [K.END_ID] for t in texts]


def test_words_give_the_text_s_ids(monkeypatch):
    texts = [None, "", " \n", "Don't I'll  x", "ünï é 가 ΣΑΣ ﬁ x\x85y　z\x1cq", "<|endoftext|> a<|startoftext|>b", "aaa " * 50]
    for bound in (K.REMEMBERED, 3):
        monkeypatch.setattr(K, "REMEMBERED", bound)
        words = K.WordTokens(PATH)
        for part in (texts, texts[::-1]):
            assert [np.frombuffer(x, "<u4").tolist() for x in words.of(part)] == direct(part)


def expected(rows):
    start, out = 0, []
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    for (key, _), ids in zip(rows, direct([t for _, t in rows])):
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("size", [40, 8_000_000])
def test_files(spark, edge, nothing, monkeypatch, size):
    monkeypatch.setattr(K, "SEGMENT_BYTES", size * 100)
    blocks, index = K.written(edge, PATH)
    assert index.count() == edge.count()
    got = [tuple(r) for r in K.read_back(blocks, index, PATH).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected([(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()])
    assert K.read_back(*K.written(nothing, PATH), PATH).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_query(spark, monkeypatch):
    from plumbline.llm.queries import QUERIES

    monkeypatch.setattr(K, "SEGMENT_BYTES", 250_000)
    folder = "/root/testdata/sf0.001"
    got = [tuple(r) for r in QUERIES["op8_context_mixing_token_files"](spark, folder).collect()]
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(got, key=lambda r: r[1]) == expected(rows)
