import pytest

LONG = "word " * 30_000 + "Idiot end."
#: Null ids and texts, empty and long texts, repeated rows and ids, odd white space.
ROWS = [(1, "One two three four five."), (2, None), (2, None), (None, "One two three four five."), (3, ""), (3, "other text under an id that repeats"), (4, LONG), (5, " \t\x0b\r\n "), (6, "one TWO three  four\tfive."), (7, "écoutez l'été — ça"), (None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    """ROWS with columns whose names the operators use themselves."""
    clash = [("fp", "x"), ("score", "y"), ("n", 1), ("word", "w"), ("spans", "s"), ("value", 2), ("held_out", "h"), ("row", 3)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("*", *[F.lit(v).alias(k) for k, v in clash])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")
