import pytest

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta epsilon " * 3000

ROWS = [
    (1, "one two three four five six", "en", "a", 27),
    (2, "ONE two\tthree  four\n five six", "en", "b", 30),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " \n\t ", "en", "", 4),
    (6, LONG, "en", "a", len(LONG)),
    (7, LONG, "fr", None, len(LONG)),
    (8, "one two three four five six", "en", "b", 27),
    (8, "one two three four five six", "en", "b", 27),
    (None, "nameless text", None, "b", 13),
    (None, None, "en", "a", None),
    (9, "élan vital — \U0001f600 naïve", "fr", "ü", 20),
    (10, "tie", None, "b", 3),
    (11, "tie", None, "b", 3),
]


@pytest.fixture(scope="session")
def odd_documents(spark, tmp_path_factory):
    """Nulls in any column, empty, blank and long texts, ties, repeated rows, and extra columns."""
    frame = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("row", "key", "size", "src", "range", "band", "label", "target", "part", "mark", "shard", "place", "held_out"):
        frame = frame.withColumn(name, F.lit("extra"))
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    frame.coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (2, 1, 0), (4, 0, 1), (6, 1, 0), (7, 0, 1), (8, 1, None), (8, None, 0), (9, 0, 1), (None, 1, 1), (10, 0, 0)],
        "doc_id long, quality int, toxic int",
    )


@pytest.fixture(scope="session")
def mid_dir():
    return "/root/testdata/sf0.01"
