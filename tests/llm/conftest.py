import pytest

from reelframe.llm.common import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True, scope="session")
def _shipped(spark):
    ship(spark)


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text[, source]) as documents."""

    def make(rows, extra=()):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name in extra:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit(7))
        return df

    return make
