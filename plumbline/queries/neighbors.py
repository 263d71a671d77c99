"""Nearest neighbours over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import neighbors as N
from plumbline.queries.base import query, read, rounds

_KNN = (
    "d AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, b.label, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance "
    "FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id), "
    "k AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id))::INTEGER AS rank FROM d QUALIFY rank <= 7)"
)


def vectors(spark, folder):
    return read(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


@query("nearest_neighbors", f"WITH {_KNN} SELECT query_id, rank, neighbor_id, round(distance, 6) AS distance FROM k")
def nearest_neighbors(spark, folder):
    e = vectors(spark, folder)
    return rounds(N.knn_join(e, e, 7, exclude_self=True))


@query("nearest_neighbors_small_blocks", f"WITH {_KNN} SELECT query_id, rank, neighbor_id, round(distance, 6) AS distance FROM k")
def nearest_neighbors_small_blocks(spark, folder):
    """Blocks of 100 rows: the way hot cells are cut at scale, forced."""
    e = vectors(spark, folder)
    return rounds(N.knn_join(e, e, 7, exclude_self=True, block_rows=100))


@query(
    "knn_classify",
    f"WITH {_KNN}, v AS (SELECT query_id, label, count(*) AS votes FROM k GROUP BY ALL) "
    "SELECT query_id, label AS prediction, votes FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) = 1",
)
def knn_classify(spark, folder):
    e = vectors(spark, folder)
    return N.knn_classify(e, e, "label", 7, exclude_self=True)


@query("knn_regress", f"WITH {_KNN} SELECT query_id, round(avg(label), 6) AS prediction FROM k GROUP BY 1")
def knn_regress(spark, folder):
    e = vectors(spark, folder)
    return rounds(N.knn_regress(e, e, "label", 7, exclude_self=True))


@query(
    "approximate_neighbors_recall",
    "SELECT 'queries with neighbours' AS fact, count(*) AS n FROM embeddings UNION ALL SELECT 'neighbours', 7 * count(*) FROM embeddings "
    "UNION ALL SELECT 'distances as in the exact join where both have a neighbour', 1 UNION ALL SELECT 'recall of 0.95 or more', 1",
)
def approximate_neighbors_recall(spark, folder):
    """The approximate join, thirteen of sixteen cells probed (these vectors have hardly any clusters), held against the exact one over all embeddings."""
    e = vectors(spark, folder)
    near = N.knn_approximate(e, e, 7, exclude_self=True, pivots=16, probes=13).cache()
    both = near.join(N.knn_join(e, e, 7, exclude_self=True).withColumnRenamed("distance", "exact"), ["query_id", "neighbor_id"])
    met = both.agg(F.count("*"), F.count_if(F.abs(F.col("distance") - F.col("exact")) > 1e-9)).first()
    rows = near.agg(F.countDistinct("query_id"), F.count("*")).first()
    facts = [("queries with neighbours", rows[0]), ("neighbours", rows[1]), ("distances as in the exact join where both have a neighbour", int(met[1] == 0)), ("recall of 0.95 or more", int(met[0] >= 0.95 * rows[1]))]
    return spark.createDataFrame(facts, "fact string, n long")
