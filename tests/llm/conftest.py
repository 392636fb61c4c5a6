import pytest
from pyspark.sql import functions as F

LONG = "word " * 60_000


@pytest.fixture(scope="session")
def make(spark):
    def docs(rows):
        """rows of (doc_id, text) or (doc_id, text, source), with columns whose names the operators use inside."""
        rows = [(*r, "src")[:3] if len(r) == 2 else r for r in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        clash = ["k", "k1", "k2", "row", "node", "comp", "score", "label", "size", "tie", "gone", "copy", "n_lines", "host", "part", "hits", "_t1", "id"]
        return df.withColumns({c: F.lit(f"own {c}") for c in clash})

    return docs


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    return make([(1, None, None), (2, "", "a"), (3, LONG, "a"), (4, "one", None), (4, "one", None), (None, "no id " * 40, "b"), (None, None, "b"), (5, " \n\t ", "b"), (6, "é ü 漢字   x", "c")])


@pytest.fixture(scope="session")
def none(make, spark):
    return make([(1, "x")]).limit(0)
