"""Distributed rank / prefix sums / exact quantiles against NumPy."""
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimwise.operators.ordering import exact_quantiles, global_row_number, prefix_sums


def test_global_row_number_matches_sort(spark):
    rng = np.random.default_rng(1)
    vals = rng.integers(0, 20, 500)          # heavy ties, broken by the key
    df = spark.createDataFrame([(int(i), int(v)) for i, v in enumerate(vals)], "k long, v long")
    got = {r["k"]: r["rn"] for r in global_row_number(df, ["v", "k"], num_partitions=7).collect()}
    order = sorted(range(len(vals)), key=lambda i: (vals[i], i))
    assert got == {k: pos + 1 for pos, k in enumerate(order)}


def test_prefix_sums_grouped(spark):
    rows = [(g, t, float(t % 3)) for g in ("a", "b") for t in range(50)]
    df = spark.createDataFrame(rows, "g string, t long, x double")
    got = {(r["g"], r["t"]): r["cum_x"] for r in prefix_sums(df, [F.col("t").desc()], ["x"], ["g"], num_partitions=5).collect()}
    for g in ("a", "b"):
        run = 0.0
        for t in reversed(range(50)):
            run += t % 3
            assert got[(g, t)] == run


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60), st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]))
def test_exact_quantiles_equal_numpy(spark, values, q):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for method in ("buffered", "distributed"):
        got = exact_quantiles(df, "v", [q], method=method).first()["quantile"]
        assert abs(got - float(np.percentile(values, q * 100))) < 1e-9


def test_grouped_quantiles_with_group_probabilities(spark):
    rows = [("a", float(v)) for v in range(11)] + [("b", float(v) * 2) for v in range(5)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = spark.createDataFrame([("a", 0.3), ("b", 0.75)], "g string, prob double")
    for method in ("buffered", "distributed"):
        got = {r["g"]: r["quantile"] for r in exact_quantiles(df, "v", probs, ["g"], method=method).collect()}
        assert abs(got["a"] - np.percentile(range(11), 30)) < 1e-9
        assert abs(got["b"] - np.percentile([0, 2, 4, 6, 8], 75)) < 1e-9
