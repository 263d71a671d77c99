import random

from plumbline.llm import chat as C

PIECES = ["\\", "#", "###", ":", " ", "</turn>", "a", "\n", "<", " </turn>\n", "### user: ", "é"]


def some_turns(n):
    text = lambda most: "".join(random.choice(PIECES) for _ in range(random.randint(0, most)))
    return [(random.choice(["user", "assistant", text(2)]), text(8)) for _ in range(n)]


def test_reading_undoes_writing():
    random.seed(1)
    for _ in range(1000):
        turns = some_turns(random.randint(0, 5))
        assert C.read_turns(C.marked_turns(turns)) == turns
        got = C.formatted_conversation(turns)
        learned = [C.unescaped(got["formatted"][a:b]) for a, b in got["loss"]]
        assert learned == [t for r, t in turns if r == "assistant"]
        assert "".join(got["formatted"][a:b] for a, b in got["spans"]) == got["formatted"] and len(got["spans"]) == len(turns)


def test_templates_that_rewrite_history():
    counted = lambda turns: f"{len(turns)}\n" + "".join(t for _, t in turns)
    got = C.formatted_conversation([("user", "x"), ("assistant", "y")], counted)
    assert got["rewritten_at"] == 1 and got["loss"] == [] and got["spans"] == []
    only_last = lambda turns: "".join(t if i == len(turns) - 1 or r == "user" else "[cut]" for i, (r, t) in enumerate(turns))
    assert C.formatted_conversation([("user", "x"), ("assistant", "long"), ("user", "z")], only_last)["rewritten_at"] == 2
    plain = lambda turns: "".join(f"<{r}>{t}" for r, t in turns)
    got = C.formatted_conversation([("user", "<a>"), ("assistant", "<assistant>")], plain)
    assert got["rewritten_at"] is None and [got["formatted"][a:b] for a, b in got["loss"]] == ["<assistant>"]


def test_edges(spark):
    rows = [(1, 1, "assistant", "b", "x"), (1, 0, "user", "a", "x"), (1, 1, "assistant", "b", "x"), (1, None, None, None, None), (None, 0, "user", None, "y"), (2, 0, "user", "w " * 20000, "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in C.formatted(df).collect()}
    assert set(got) == {1, 2, None}
    assert C.read_turns(got[1]["formatted"]) == [("", ""), ("user", "a"), ("assistant", "b"), ("assistant", "b")]
    assert got[1]["n_turns"] == 4 and len(got[1]["loss"]) == 2 and got[2]["loss"] == []
    read = {r["conv_id"]: r for r in C.digests(C.formatted(df)).collect()}
    assert read[1]["loss_chars"] == 2 and read[2]["formatted_chars"] == len(got[2]["formatted"])
    assert C.digests(C.formatted(df.limit(0))).count() == 0
