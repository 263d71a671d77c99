import hashlib
import random

from plumbline.llm import mixing as M


def shared(capacity, weight, amount):
    """Water filling by rounds: give by weight, take back what exceeds, go on with the rest."""
    got, open_ = dict.fromkeys(capacity, 0.0), {k for k in capacity if weight[k] > 0 and capacity[k] > 0}
    while amount > 1e-9 and open_:
        total = sum(weight[k] for k in open_)
        part = {k: amount * weight[k] / total for k in open_}
        amount = 0.0
        for k, x in part.items():
            room = capacity[k] - got[k]
            got[k] += min(x, room)
            amount += max(0.0, x - room)
        open_ = {k for k in open_ if capacity[k] - got[k] > 1e-9}
    return got


def test_budgets_against_rounds(spark):
    random.seed(4)
    leaves = [(d, lang, s, random.randint(0, 400)) for d in "ab" for lang in "xyz" for s in ("s1", "s2", "s3") if random.random() < 0.9]
    weights = {("a",): 3.0, ("a", "x"): 2.0, ("b", "y"): 0.0, ("a", "x", "s1"): 5.0, ("b", "z", "s2"): 4.0}
    w = lambda *p: weights.get(p, 1.0)
    table = spark.createDataFrame(leaves, "domain string, lang string, source string, supply long")
    for tokens in (0, 500, 2000, 10**6):
        cap = {x[:3]: float(x[3]) * 2 if w(*x[:2]) > 0 else 0.0 for x in leaves}
        want = {}
        tops = shared({d: sum(v for k, v in cap.items() if k[0] == d) for d in "ab"}, {d: w(d) for d in "ab"}, tokens)
        for d, b in tops.items():
            langs = sorted({k[1] for k in cap if k[0] == d})
            for lang, bb in shared({x: sum(v for k, v in cap.items() if k[:2] == (d, x)) for x in langs}, {x: w(d, x) for x in langs}, b).items():
                ends = [k for k in cap if k[:2] == (d, lang)]
                want |= shared({k: cap[k] for k in ends}, {k: w(*k) for k in ends}, bb)
        got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in M.budgets(table, weights, tokens, 2).collect()}
        assert all(abs(got[k] - want[k]) <= 1 for k in want), tokens


def test_prefixes_by_hand(spark):
    random.seed(6)
    docs = [(i, " ".join(["w"] * random.randint(0, 9)), random.choice("ab"), "x", random.choice(("s1", "s2"))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, domain string, lang string, source string")
    for share, epochs in ((0.4, 1), (0.9, 3), (1.7, 3)):
        rows, cut = M.mixed(df, {("a",): 3.0}, share, epochs, "seed")
        got = {r["doc_id"]: r for r in M.copies(rows, cut, "seed").collect()}
        assert len(got) == 400
        for leaf in {(d, s) for _, _, d, _, s in docs}:
            mine = [(i, len(t.split())) for i, t, d, _, s in docs if (d, s) == leaf]
            supply, budget = sum(n for _, n in mine), got[mine[0][0]]["budget"]
            full = budget // supply
            rest, used = budget - full * supply, 0
            for i, n in sorted(mine, key=lambda x: (int(hashlib.md5(f"seed|{full}|{x[0]}".encode()).hexdigest()[:13], 16), x[0])):
                used += n
                assert got[i]["copies"] == full + (1 if rest and used <= rest else 0)
    taken = M.mixed_documents(df, {("a",): 3.0}, 1.7, 3, "seed")
    assert taken.columns == df.columns and taken.count() == sum(r["copies"] for r in got.values())


def test_edges(edge, nothing):
    from pyspark.sql import functions as F

    rows, cut = M.mixed(edge, {}, 0.5, 1, domain=F.lit("d"))
    got = [tuple(r) for r in M.copies(rows, cut, "mix").select("doc_id", "lang", "source", "n_tokens", "copies").collect()]
    assert len(got) == edge.count() and {(3, "~", "~", 14)} <= {g[:4] for g in got}
    assert len({g[4] for g in got if g[0] == 9}) == 1
    assert M.mixed_documents(edge, {}, 0.5, domain=F.lit("d")).columns == edge.columns
    assert M.mixed_documents(edge, {}, 5.0, domain=F.lit("d")).where("text LIKE '%fox%'").count() == 3
    assert M.mixed_documents(nothing, {}, 0.5, domain=F.lit("d")).count() == 0
