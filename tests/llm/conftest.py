import pytest

#: A table with all that operators must bear: nulls in any column, empty and long texts, ties, repeated rows, and extra
#: columns with the names of results.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it", "en", "src1", 65, "x"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from it", "en", "src1", 65, "x"),
    (3, "the QUICK brown fox jumps over the lazy dog and runs away from it", None, None, None, None),
    (4, None, "de", "src2", None, "y"),
    (5, "", "fr", "src3", 0, "y"),
    (6, " \n\t ", "fr", "src3", 4, "z"),
    (None, "a text without an id", "en", None, 20, None),
    (7, "12 34 !! ##", "en", "src1", 11, "z"),
    (8, "ünï cödé 中文 words", "de", "src2", 17, "z"),
    (9, "word " * 4000, "en", "src1", 20000, "long"),
    (9, "word " * 4000, "en", "src1", 20000, "long"),
]
NAMES = ("shard", "region", "rack", "slot", "fingerprint", "component_id", "copies", "budget", "score", "lang_pred", "base", "added", "kept", "posterior", "n_words", "spans")


@pytest.fixture(scope="session")
def edge(spark):
    from pyspark.sql import functions as F

    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long, extra string")
    return plain.select("*", *[F.lit("taken").alias(n) for n in NAMES])


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)
