import random
import re

from plumbline.llm import decontaminate as D


def slow(words, items, least):
    hit, met = set(), set()
    for number, item in items:
        n = min(least, len(item))
        windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                met.add(number)
    return hit, met


def test_automaton_against_all_windows():
    random.seed(2)
    for _ in range(300):
        letters = [bytes([c]) for c in b"abc"[: random.randint(1, 3)]]
        some = lambda most: [random.choice(letters) for _ in range(random.randint(0, most))]
        items = [(i, some(9)) for i in range(random.randint(0, 4))]
        words, least = some(25) + ([b"z"] + some(8)) * random.randint(0, 1), random.randint(1, 5)
        spans, met, longest = D.Automaton(items, least).scan(words)
        want, names = slow(words, items, least)
        assert {p for a, b in spans for p in range(a, b)} == want and met == names
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_matches_and_packs(spark, edge, nothing):
    words = "the quick brown fox jumps over the lazy dog and runs"
    items = spark.createDataFrame([(10, words), (11, "12-34"), (12, words), (13, None), (14, "!!"), (None, "a text")], "item_id long, text string")
    got = {(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in D.matches(edge, items).collect()}
    assert {(1, 14, 11, (10, 12)), (3, 14, 11, (10, 12)), (4, 0, 0, ()), (5, 0, 0, ()), (7, 2, 2, (11,)), (8, 4, 0, ()), (None, 5, 2, ())} <= got
    assert got == {(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in D.matches(edge, items, pack_words=12).collect()}
    assert D.matches(nothing, items).count() == 0
    assert D.matches(edge, items.limit(0)).where("n_hit > 0").count() == 0


def test_cutting(spark, edge):
    items = spark.createDataFrame([(1, "b c d e f g h i j k l"), (2, "lazy dog and runs away from it all the time")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x y a b c d e b c d e f g h i j k l f g h i j k z1 z2 z3 z4 z5 z6 z7", 9), (2, "clean text, stays. ", 19), (3, "b c d e f g h i j k l", 21), (4, None, None)], "doc_id long, text string, n_chars long")
    for pack in (100, 11):
        out = {r["doc_id"]: r for r in D.decontaminated(docs, items, pack_words=pack, max_share=0.6).collect()}
        assert set(out) == {1, 2, 4} and out[2]["text"] == "clean text, stays. " and out[2]["n_chars"] == 19
        assert out[1]["n_chars"] == len(out[1]["text"]) and not slow(D.words_of(out[1]["text"]), [(0, [bytes([c]) for c in b"bcdefghijkl"])], 10)[0]
        assert out[1]["text"].startswith("x y a") and out[1]["text"].endswith("z7")
    assert D.decontaminated(edge, items).columns == edge.columns


def test_word_places():
    text = "Añ b-c,  中9 D"
    starts, ends = D.word_places(text)
    assert [text[a:b] for a, b in zip(starts, ends)] == re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)
    assert D.words_of(text) == [text[a:b].lower().encode() for a, b in zip(starts, ends)]


def test_one_pack_and_many_give_equal_rows(spark):
    some = lambda letter, n: [f"{letter}{i}" for i in range(n)]
    a, b = some("a", 12), some("b", 12)
    items = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(some("x", 5) + some("y", 5)))], "item_id long, text string")
    texts = [
        some("c", 8) + a + some("d", 8) + b,  # 24 of 40 words, 12 in each pack
        some("c", 20) + a + some("d", 20) + b,  # 24 of 64
        some("c", 40) + some("x", 5) + a + some("y", 5) + some("d", 40),  # what is left forms another match
        some("e", 9),
    ]
    docs = spark.createDataFrame([(i, " ".join(t), len(" ".join(t))) for i, t in enumerate(texts)] + [(None, None, None)], "doc_id long, text string, n_chars long")
    one, many = (sorted(map(tuple, D.decontaminated(docs, items, pack_words=n).collect()), key=str) for n in (100, 12))
    assert one == many and [r[0] for r in one] == [1, 2, 3, None]
    assert one[1][1].split() == some("c", 40) + some("d", 40)


def test_packs_are_fetched_one_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c"), (2, "k l m n")], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"{x} b c") for i, x in enumerate("adefgh")], "item_id long, text string")
    fetched, seen, real, build = [], [], D.packs, D.staged
    monkeypatch.setattr(D, "packs", lambda *a: (fetched.append(1) or p for p in real(*a)))
    monkeypatch.setattr(D, "staged", lambda *a: (seen.append(len(fetched)), build(*a))[1])
    assert {r["doc_id"]: r["n_hit"] for r in D.matches(docs, items, 2, 3).collect()} == {1: 3, 2: 0}
    assert seen == [2, 3, 4, 5, 6]
