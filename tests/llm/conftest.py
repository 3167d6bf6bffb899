import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture()
def docs_of(spark):
    """Documents from a list of texts (or (doc_id, text)); one extra clashing column each."""
    def make(texts, extra=()):
        rows = [(t[0], t[1]) if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
        for name in extra:
            df = df.withColumn(name, F.lit("mine"))
        return df.repartition(3)
    return make
