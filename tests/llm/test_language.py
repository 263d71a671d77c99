import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import language as L

FOLDER = "/root/testdata/sf0.01"


def test_support_vector_machine_and_curve():
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 5)).astype(np.float32)
    y = np.where(x[:, 0] - x[:, 1] > 0, 1.0, -1.0)
    w, b = L.support_vector_machine(x, y)
    assert ((x @ w + b > 0) == (y > 0)).mean() > 0.97
    slope, offset = L.logistic_curve(x @ w + b, y)
    assert slope > 0 and abs(offset) < 3


def test_features_do_not_depend_on_chunks(monkeypatch):
    text = "Größe und Übermut, ça va? " * 50
    whole = L.features(text)
    assert abs(float(whole @ whole) - 1) < 1e-5
    monkeypatch.setattr(L, "CHUNK", 7)
    assert np.allclose(L.features(text), whole, atol=1e-6)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = L.identified(docs, per_language=200).join(docs.select("doc_id", "lang"), "doc_id")
    right = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert right[0] >= 0.97 and 0 <= right[1] and right[2] <= 1


def test_edges(spark, edge, nothing):
    got = [tuple(r) for r in L.identified(edge).collect()]
    assert len(got) == edge.count()
    by = {g[0]: g for g in got}
    assert all(by[i][2:] == ("und", 0.0) for i in (4, 5, 6, 7))
    assert {by[i][2] for i in (1, 2, 3, 8, 9)} <= {"en", "de", "fr"} and by[None][1] is False
    assert L.readable(edge).columns == edge.columns and L.readable(edge).where("doc_id IN (4, 5, 6, 7)").count() == 0
    assert L.identified(nothing).count() == 0
    none = L.identified(edge.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    one = L.identified(edge.withColumn("lang", F.lit("tlh")))
    assert {(r["lang_pred"], r["score"]) for r in one.collect()} == {("und", 0.0), ("tlh", 1.0)}


def test_prediction_sees_the_text_only(spark, edge):
    model = L.fit(edge)
    other = edge.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("other"))
    pick = lambda df: sorted((r["text"] or "", r["lang_pred"], r["score"]) for r in L.predicted(df, model).collect())
    assert pick(edge) == pick(other)
