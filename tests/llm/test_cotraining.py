import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import cotraining as C

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_unseen_labels(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    seen = labels.where("doc_id % 4 <> 0")
    model = C.fit(docs, seen)
    scored = C.scored(docs, model)
    assert scored.count() == docs.count()
    rows = scored.join(labels.where("doc_id % 4 = 0"), "doc_id").select("score", "text_score", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")).collect()

    def auc(column):
        good, bad = [r[column] for r in rows if r["good"]], [r[column] for r in rows if not r["good"]]
        return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])

    assert auc("score") > 0.9 and auc("score") >= auc("text_score") - 0.001
    assert np.mean([r["score"] >= 0.5 for r in rows if r["good"]]) > 0.9
    assert len(model.rounds) > 1 and sum(model.rounds[1]["by_text"]) > 0
    assert model.rounds[0]["loss"] >= min(r["loss"] for r in model.rounds) == next(r["loss"] for r in model.rounds if r["chosen"])


def views(seed, knows_page, rows=900, labelled=150):
    """A text view that always knows the label, a page view that knows it for `knows_page` of the rows, and hidden labels."""
    r = np.random.default_rng(seed)
    good = r.random(rows) < 0.6
    texts = [np.array(sorted({int(10 + g) if r.random() < 0.9 else 12, int(20 + r.integers(50))}), np.int32) for g in good]
    pages = [np.array([int(100 + g) if r.random() < knows_page else 102], np.int32) for g in good]
    return good, texts, pages, [int(g) if i < labelled else None for i, g in enumerate(good)]


def test_both_views_hand_over_and_both_count():
    good, texts, pages, labels = views(3, 0.9)
    model = C.cotrained(texts, pages, labels, 3, 60, 0.05)
    assert min(model.rounds[1]["by_text"]) > 0 and min(model.rounds[1]["by_page"]) > 0
    assert model.curves[2][0] > 0 and model.curves[2][1] > 0
    a, b, both = ((x > 0.5) == good for x in model.scores(texts, pages))
    assert both[150:].mean() > max(a[150:].mean(), b[150:].mean()) and both[150:].mean() > 0.97


def test_rounds_teach_what_labels_lack():
    """A second mark of each kind is on rows without a label, and on labelled rows that are held back: the page view brings it."""
    r = np.random.default_rng(5)
    good = r.random(1200) < 0.5
    labels = [int(g) if i < 160 else None for i, g in enumerate(good)]
    second = [r.random() < 0.5 if i >= 160 else i % 4 == 0 and i < 80 for i in range(1200)]
    texts = [np.array([(13 if g else 14) if s else (11 if g else 10)], np.int32) for g, s in zip(good, second)]
    pages = [np.array([100 + int(g)], np.int32) for g in good]
    plain, taught = (C.cotrained(texts, pages, labels, n, 300, 0.05) for n in (0, 3))
    assert plain.text[13] == plain.text[14] == 0.0
    assert sum(taught.rounds[1]["by_page"]) > 0 and not taught.rounds[0]["chosen"]
    assert taught.text[13] > 0 > taught.text[14]
    at = [i for i in range(160, 1200) if second[i]]
    right = np.mean((taught.scores([texts[i] for i in at], [pages[i] for i in at])[0] > 0.5) == good[at])
    assert right == 1.0


def test_a_view_that_knows_nothing_hands_little_and_harms_nothing():
    good, texts, pages, labels = views(4, 0.0)
    model = C.cotrained(texts, pages, labels, 3, 60, 0.05)
    assert all(sum(x["by_page"]) == 0 for x in model.rounds)
    a, _, both = ((x > 0.5) == good for x in model.scores(texts, pages))
    assert both.mean() >= a.mean() > 0.9


def test_curve_weights_are_not_negative():
    r = np.random.default_rng(2)
    y = (r.random(300) < 0.5).astype(float)
    w = C.combined_curve(np.column_stack([y + r.normal(size=300), -y + r.normal(size=300)]), y)
    assert w[0] > 0 and w[1] == 0


def test_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (9, 1, 0), (None, 1, 1), (8, None, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    got = C.scored(edge, C.fit(edge, labels)).collect()
    assert len(got) == edge.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 9}) == 1
    blank = C.fit(edge, labels.limit(0))
    assert {r["score"] for r in C.scored(edge, blank).collect()} == {0.5}
    assert C.scored(nothing, C.fit(nothing, labels)).count() == 0
    assert C.scored(edge.drop("source", "n_chars"), blank).count() == edge.count()
