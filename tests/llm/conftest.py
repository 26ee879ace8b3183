import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text) pairs, over a few partitions, read from a file."""
    import uuid

    from claimwise.session import scratch_root

    def make(rows, extra=None):
        df = spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in rows], DOC)
        for name, value in (extra or {}).items():
            df = df.withColumn(name, value)
        path = f"{scratch_root(spark)}/docs-{uuid.uuid4().hex}"
        df.repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make
