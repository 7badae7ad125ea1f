import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def docs(spark):
    """Few documents with every trap: nulls, empty and long texts, repeated rows, clashing columns."""
    prose = "the quick brown fox jumps over the lazy dog while seven wizards quietly judge my vow of black quartz again"
    rows = [
        (1, prose, "en", "a", 1),
        (2, prose, "en", "a", 1),
        (2, prose, "en", "a", 1),
        (3, prose.replace("wizards", "lizards"), "en", "b", 1),
        (4, None, None, None, None),
        (5, "", "en", "a", 0),
        (6, " \t\n ", "en", "", 3),
        (7, "12 %% 34", "fr", "b", 8),
        (8, "élan été où l'âme naïve s'égare déjà près d'une forêt très âgée", "fr", "b", 60),
        (9, "mot " * 30_000, "fr", "c", 120_000),
        (None, "an orphan without any number", "en", "a", 28),
        (10, "one two three", "en", "a", 13),
        (11, "One  TWO three", None, "a", 14),
        (12, "a" * 5000, "en", "d", 5000),
        (13, "snow ☃ and \U0001f600 emoji", "en", "d", 20),
    ] + [(100 + i, f"{prose} number {i} of many plain lines of words", "en", "a", 50) for i in range(40)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    extra = {c: df["n_chars"] for c in ("size", "shard", "id", "score", "label", "group", "n", "token", "row", "slot", "batch")}
    return df.withColumns(extra)
