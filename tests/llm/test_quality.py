"""op8: the trees and held-out accuracy."""
import numpy as np
from pyspark.sql import functions as F

from claimwise.llm import quality as ql

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = ql.train(docs, labels, usable=lambda i: ~ql.held_out(i))
    rows = ql.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).join(labels, "doc_id").filter(ql.held_out(F.col("doc_id"))).select("score", "quality").collect()
    s, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert len(s) > 500 and ((s >= ql.THRESHOLD) == y).mean() > 0.97
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.98


def test_flat_trees_equal_walked_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    t = ql.fit(x, y, trees=20, depth=3)

    def walk(row):
        total = t.base
        for node in t.roots:
            while t.left[node] != node:
                node = t.left[node] if row[t.feature[node]] <= t.threshold[node] else t.right[node]
            total += t.value[node]
        return 1 / (1 + np.exp(-total))

    got = t.score(x)
    assert np.allclose(got, [walk(r) for r in x]) and ((got > 0.5) == y).mean() > 0.95


def test_edges(spark, documents):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, 0), (3, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    docs = documents([(1, "Good text here, it is."), (2, "BAD!! BAD!!"), (3, None), (4, ""), (None, "no id"), (2, "BAD!! BAD!!"), (5, "x" * 100_000)], {"_y": F.lit(1), "score": F.lit("clash")})
    model = ql.train(docs, labels)
    got = ql.score(docs, model).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
    assert ql.score(documents([]), ql.train(documents([]), labels)).collect() == []
    assert ql.drop_poor(docs, model).columns == docs.columns


def test_training_does_not_read_other_columns(spark, documents):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    rows = [(i, ("good words in a line " if i % 2 else "!! ## ") * (i + 1)) for i in range(40)]
    a, b = (ql.train(documents(rows, {"lang": F.lit(v), "source": F.lit(v)}), labels) for v in ("x", "y"))
    assert np.array_equal(a.value, b.value) and np.array_equal(a.threshold, b.threshold)
