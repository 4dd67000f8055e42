import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text[, lang, source]) tuples, with columns whose names the operators use inside."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for name in ("size", "token", "cls", "_th", "th", "_id", "h", "n", "line", "site", "rng", "guest", "copies", "rank", "label", "component", "salt", "_row"):
            df = df.withColumn(name, F.lit("x"))
        return df

    return make
