import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty and very long texts, ties and repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i % 997} here" for i in range(60_000))
    rows = [(1, "the same words stand here twice over", "en", "a"), (1, "the same words stand here twice over", "en", "a"), (2, "the same words stand here twice over", "en", "a"), (3, None, None, None), (4, "", "de", "b"), (5, " \n\t ", "fr", "b"), (6, "one", None, "b"), (7, long, "en", "a"), (None, "no id at all", "en", None), (9, "é" * 300 + " ünïcode 😀 " + "x" * 5000, "de", "a")]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 1, 2, 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, fp int, rank int, score int")
