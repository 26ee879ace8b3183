"""op12 against plain loops, and packed products against integer products."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimwise.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, anchor, positives=5, negatives=3):
    good = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, a, lab) in enumerate(good):
        if not anchor(i):
            continue
        s = sorted((-sum(x * y for x, y in zip(a, b)), j, other) for m, (j, b, other) in enumerate(good) if m != n and len(a) == len(b))
        for p, j, _ in [x for x in s if x[2] == lab][:positives]:
            near = [(-q, k) for q, k, other in s if other != lab and 50 * -p <= 100 * -q <= 95 * -p]
            out += [(i, j, r + 1, k, -p, q) for r, (q, k) in enumerate(near[:negatives])]
    return sorted(out)


def read(spark, rows, schema=SCHEMA):
    import uuid

    from claimwise.session import scratch_root
    path = f"{scratch_root(spark)}/vectors-{uuid.uuid4().hex}"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def single(x):
    return float(np.float32(x))


def made(n, dims=6, seed=3):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    return [(i, [single(c + rng.gauss(0, 0.6)) for c in centre[i % 4]], (i + (i % 5 == 0)) % 4) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"cell_rows": 37, "anchor_rows": 3}])
def test_equals_plain_loops(spark, options, monkeypatch):
    monkeypatch.setattr(hn, "PACKED_ROWS", 16)
    rows = made(300)
    rows += [(400 + i, rows[10][1], 2) for i in range(120)]                       # one very common vector
    rows += [(50, rows[50][1], 1), (7, None, 1), (None, rows[1][1], 1), (9, rows[3][1], None), (600, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1),
             (650, [float("nan")] * 6, 1), (700, [float("inf")] + [1.0] * 5, 1), (750, [], 1), (800, [1.0, 2.0], 1), (850, [2.0, 2.0], 1), (851, [1.5, 1.5], 2), (900, [0.0] * 6, 3)]
    df = read(spark, rows).withColumns({"row": F.lit(1), "cell": F.lit("x"), "id": F.lit(5), "rank": F.lit(0)})
    got = sorted(tuple(r) for r in hn.mine(df, lambda i: i % 10 == 0, **options).collect())
    want = brute(rows, lambda i: i % 10 == 0)
    assert got == want and len(got) > 100


def test_few_rows_and_none(spark):
    assert hn.mine(read(spark, []), lambda i: i % 50 == 0).collect() == []
    for rows in ([(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 2)], [(0, [1.0], 1), (1, [1.0], 1), (2, [0.75], 2)]):
        assert sorted(tuple(r) for r in hn.mine(read(spark, rows), lambda i: i % 50 == 0).collect()) == brute(rows, lambda i: i % 50 == 0)


@pytest.mark.parametrize("size", [1, 300, 2**20, 2**29])
def test_packed_products(size):
    rng = np.random.default_rng(size)
    rows, anchors = rng.integers(-size, size + 1, (70, 9)), rng.integers(-size, size + 1, (20, 9))
    rows[0], anchors[0], rows[1], anchors[1] = size, -size, -size, -size
    assert np.array_equal(hn.Packed(rows, size).scores(anchors), anchors @ rows.T)


def test_scores_beyond_a_long(spark):
    rows = [(0, [2.0**24] * 4, 1), (1, [2.0**24] * 4, 1), (2, [2.0**23] * 4, 2)]
    with pytest.raises(Exception, match="does not fit a long"):
        hn.mine(read(spark, rows), lambda i: i % 50 == 0).collect()
    with pytest.raises(Exception, match="scaled component"):
        hn.mine(read(spark, [(0, [1e30], 1), (1, [1e30], 1)]), lambda i: i % 50 == 0).collect()
