"""A third of all rows on one key: results stay exact and the work is split."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from claimwise.operators import ranking as rk
from claimwise.operators.ordering import exact_quantiles, global_row_number, prefix_sums

N = 9000


def _skewed(spark):
    rng = np.random.default_rng(7)
    pred = rng.random(N)
    pred[: N // 3] = 0.5                      # the hot score
    actual = rng.poisson(0.1, N)
    pdf = pd.DataFrame({"model": "m", "IDpol": np.arange(N, dtype="int64"), "actual": actual.astype("int64"),
                        "predicted": pred})
    return pdf, spark.createDataFrame(pdf)


def test_hot_tie_is_split_across_range_partitions(spark):
    _, df = _skewed(spark)
    sizes = [r["n"] for r in df.repartitionByRange(8, "model", "predicted", "IDpol")
             .groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) < 2 * N / 8            # the 3,000-row tie does not land in one task


def test_ranks_and_lift_exact_under_skew(spark):
    pdf, df = _skewed(spark)
    got = {r["IDpol"]: r["rn"] for r in global_row_number(df, ["predicted", "IDpol"], num_partitions=8).collect()}
    order = pdf.sort_values(["predicted", "IDpol"])["IDpol"].tolist()
    assert got == {k: i + 1 for i, k in enumerate(order)}
    lift = rk.lift_table(df).orderBy("bin").toPandas()
    ranks = np.arange(1, N + 1)
    srt = pdf.sort_values(["predicted", "IDpol"]).assign(bin=pd.qcut(ranks, 10, labels=False))
    exp = srt.groupby("bin")["actual"].agg(["mean", "size"])
    assert list(lift["count"]) == list(exp["size"])
    assert np.allclose(lift["avg_actual"], exp["mean"])


def test_grouped_prefix_sums_with_hot_group(spark):
    rows = [("hot", i, 1.0) for i in range(N // 3)] + [(f"g{i % 50}", i, 2.0) for i in range(N - N // 3)]
    df = spark.createDataFrame(rows, "g string, t long, x double")
    got = {(r["g"], r["t"]): r["cum_x"] for r in prefix_sums(df, ["t"], ["x"], ["g"], num_partitions=8).collect()}
    assert got[("hot", N // 3 - 1)] == float(N // 3)
    assert all(got[("hot", t)] == t + 1 for t in range(0, N // 3, 97))


def test_exact_quantiles_with_hot_value(spark):
    pdf, df = _skewed(spark)
    for q in (0.1, 0.33, 0.5, 0.9):
        got = exact_quantiles(df, "predicted", [q], method="distributed").first()["quantile"]
        assert abs(got - np.percentile(pdf["predicted"], q * 100)) < 1e-12
