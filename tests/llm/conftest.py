import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture()
def docs_of(spark):
    """Documents from ``(doc_id, text[, lang, source])`` rows, with extra columns of clashing names on demand."""

    def make(rows, extra=()):
        full = [(r[0], r[1], *(r[2:] if len(r) > 2 else ("en", "a")), None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name in extra:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("clash"))
        return df

    return make
