import math
import random
import re

from plumbline.llm import quality_rules as R


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places, where = set(), {}
    for i in range(len(words) - 4):
        where.setdefault(tuple(words[i : i + 5]), []).append(i)
    for found in where.values():
        if len(found) > 1:
            places |= {p for i in found for p in range(i, i + 5)}
    some = lambda keep: sum(bool(re.match(keep, c)) for c in text)
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": some(r"[#*$%&|<>]"), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(places), "n_upper": some("[A-Z]"), "n_exclaim": text.count("!"), "n_digits": some("[0-9]"), "n_punctuation": some(r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"),
    }


def some_texts():
    random.seed(8)
    vocabulary = ["a", "bb", "ccc", "é", "中文", "#x", "WORD!!", "1234", "|", "end."]
    out = [None, "", "   ", "\n\n", "a a a a a a a", "line\nline\n \nline", "one two three four five"]
    for _ in range(80):
        out.append("".join(random.choice(vocabulary[: random.randint(1, 10)]) + random.choice([" ", " ", "  ", "\n", "\t", "\x0b"]) for _ in range(random.randint(0, 60))))
    return [*out, "clean words in a row that go on " * 3, "w " * 3000]


def test_counts_by_hand(spark):
    texts = some_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in R.counted(df).collect():
        want = counts(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want, texts[r["doc_id"]]


def slow_fit(votes, rounds):
    share, good, bad = R.FIRST["share"], [R.FIRST["good"]] * len(R.RULES), [R.FIRST["bad"]] * len(R.RULES)
    hold = lambda x, kind: min(max(x, R.BOUNDS[kind][0]), R.BOUNDS[kind][1])

    def posterior(vs):
        odds = math.log(share / (1 - share)) + sum(math.log(g / (1 - b)) if v == 1 else math.log((1 - g) / b) if v == -1 else 0 for v, g, b in zip(vs, good, bad))
        return 1 / (1 + math.exp(-odds))

    for _ in range(rounds):
        ps = [posterior(v) for v in votes]
        new_good, new_bad = list(good), list(bad)
        for j in range(len(good)):
            cast = [(v[j], p) for v, p in zip(votes, ps) if v[j]]
            if cast:
                new_good[j] = hold(sum(p for v, p in cast if v == 1) / sum(p for _, p in cast), "good")
                new_bad[j] = hold(sum(1 - p for v, p in cast if v == -1) / sum(1 - p for _, p in cast), "bad")
        share, good, bad = hold(sum(ps) / len(ps), "share"), new_good, new_bad
    return [posterior(v) for v in votes]


def test_posteriors_by_hand(spark):
    texts = some_texts()
    df = spark.createDataFrame(list(enumerate(texts)) + [(1000, texts[20])], "doc_id long, text string")
    got = R.rated(df).orderBy("doc_id").collect()
    votes = [tuple(r[f"v_{rule.name}"] for rule in R.RULES) for r in got]
    for r, p in zip(got, slow_fit(votes, R.ROUNDS)):
        assert abs(r["posterior"] - p) < 1e-6
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["posterior"] >= 0.5)


def test_edges(edge, nothing):
    got = R.rated(edge).collect()
    assert len(got) == edge.count() and not any(r["kept"] for r in got if r["doc_id"] in (4, 5, 6))
    assert R.rated(nothing).count() == 0
