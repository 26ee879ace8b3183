"""Selection, lift by boundary search, one-shuffle prefix sums and the two-round metric rows."""
import contextlib
import io
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimwise.operators import evaluate as ev
from claimwise.operators import ordering, ranking, selection
from claimwise.session import materialize


def plan_of(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("simple")
    return buf.getvalue()


def scores(spark, n, seed=1, tie=None):
    rng = np.random.default_rng(seed)
    rows = []
    for m in ("a", "b"):
        p = rng.gamma(1.0, 0.1, n).round(4)
        if tie:
            p[rng.random(n) < tie] = 0.07
        y = rng.poisson(np.minimum(p, 3))
        rows += [(m, int(i), int(y[i]), float(p[i])) for i in range(n)]
    return materialize(spark.createDataFrame(rows, "model string, IDpol long, actual long, predicted double").repartition(5), "selection-test")


def pandas_lift(df, n_bins=10):
    out = {}
    for m, d in df.toPandas().groupby("model"):
        d = d.sort_values(["predicted", "IDpol"]).reset_index(drop=True)
        d["bin"] = pd.qcut(np.arange(1, len(d) + 1), n_bins, labels=False, duplicates="drop")
        for b, x in d.groupby("bin"):
            out[m, b] = (len(x), x["actual"].mean(), x["predicted"].mean(), x["actual"].mean() / (d["actual"].mean() or 1e-10))
    return out


@pytest.mark.parametrize("n,tie", [(997, None), (1003, 0.35), (40, 0.9), (11, 1.0)])
def test_lift_equals_qcut(spark, n, tie):
    df = scores(spark, n, tie=tie)
    want = pandas_lift(df)
    got = {(r["model"], r["bin"]): r for r in ranking.lift_table(df).collect()}
    assert got.keys() == want.keys()
    for k, (count, a, p, lift) in want.items():
        r = got[k]
        assert r["count"] == count and math.isclose(r["avg_actual"], a, abs_tol=1e-12) and math.isclose(r["avg_predicted"], p) and math.isclose(r["lift"], lift, abs_tol=1e-9)


@pytest.mark.parametrize("method", ["qcut", "position"])
@pytest.mark.parametrize("n", [1, 2, 7, 10, 23])
def test_lift_equals_ranked_path(spark, n, method, monkeypatch):
    df = scores(spark, n, seed=n, tie=0.5)
    fast = {tuple(r)[:2]: tuple(r) for r in ranking.lift_table(df, method=method).collect()}
    monkeypatch.setattr(selection, "MAX_GROUPS", 1)
    slow = {tuple(r)[:2]: tuple(r) for r in ranking.lift_table(df, method=method).collect()}
    assert fast.keys() == slow.keys()
    assert all(np.allclose(fast[k][1:], slow[k][1:]) for k in fast)


def test_lift_sorts_no_rows(spark):
    plan = plan_of(ranking.lift_table(scores(spark, 500, tie=0.3)))
    assert "rangepartitioning" not in plan and plan.count("FileScan") == 1
    # what is exchanged is one row per bin
    assert plan.count("Exchange hashpartitioning") == 2


def test_prefix_sums_shuffle_once(spark, monkeypatch):
    seen = []
    real = ordering.materialize
    monkeypatch.setattr(ordering, "materialize", lambda df, label: (seen.append(plan_of(df)), real(df, label))[1])
    df = scores(spark, 300, tie=0.3)
    curve = ranking.pr_curve(df)
    assert len(seen) == 1 and seen[0].count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in seen[0]
    assert curve.count() == df.groupBy("model").agg(F.count_distinct("predicted")).agg(F.sum("count(DISTINCT predicted)")).first()[0] + 2


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["x", "y", None]), st.integers(-5, 5), st.integers(0, 3), st.floats(-2, 2)), max_size=60), st.integers(1, 5), st.booleans())
def test_prefix_sums(spark, rows, parts, many):
    before, ordering.MAX_OFFSETS = ordering.MAX_OFFSETS, 0 if many else 100
    try:
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, g string, o int, n long, x double")
        got = {r["i"]: (r["cum_n"], r["cum_x"]) for r in ordering.prefix_sums(df, ["o", "i"], ["n", "x"], ["g"], num_partitions=parts).collect()}
    finally:
        ordering.MAX_OFFSETS = before
    assert len(got) == len(rows)
    for i, (g, o, _, _) in enumerate(rows):
        upto = [r for j, r in enumerate(rows) if r[0] == g and (r[1], j) <= (o, i)]
        assert got[i][0] == sum(r[2] for r in upto) and math.isclose(got[i][1], sum(r[3] for r in upto), abs_tol=1e-9)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["x", "y"]), st.floats(-1e6, 1e6) | st.sampled_from([0.0, 1.0, float("nan"), None, float("inf")])), min_size=1, max_size=80),
       st.lists(st.floats(0, 1), min_size=1, max_size=4, unique=True))
def test_quantiles(spark, rows, probs):
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["prob"]): r["quantile"] for r in ordering.exact_quantiles(df, "v", probs, ["g"], method="distributed").collect()}
    for g in ("x", "y"):
        v = np.sort([x for k, x in rows if k == g and x is not None and not math.isnan(x)])
        for p in probs:
            if not len(v):
                assert (g, p) not in got
                continue
            pos = (len(v) - 1) * p
            lo, hi = v[int(pos)], v[min(len(v) - 1, int(pos) + (pos > int(pos)))]
            want = lo if lo == hi else (int(pos) + 1 - pos) * lo + (pos - int(pos)) * hi
            assert got[g, p] == want or math.isclose(got[g, p], want, rel_tol=1e-9) or (math.isnan(want) and math.isnan(got[g, p]))


def test_selection_limits_fall_back(spark, monkeypatch):
    df = scores(spark, 200)
    want = [tuple(r) for r in ordering.exact_quantiles(df, "predicted", [0.1, 0.5], ["model"], method="distributed").orderBy("model", "prob").collect()]
    for limit in ("MAX_CELLS", "MAX_GROUPS"):
        with monkeypatch.context() as m:
            m.setattr(selection, limit, 1)
            got = [tuple(r) for r in ordering.exact_quantiles(df, "predicted", [0.1, 0.5], ["model"], method="distributed").orderBy("model", "prob").collect()]
        assert got == want
    assert [tuple(r) for r in ordering.exact_quantiles(df, "predicted", [0.1, 0.5], ["model"], method="sorted").orderBy("model", "prob").collect()] == want


@pytest.mark.parametrize("case", ["plain", "ties", "bad", "zero", "one"])
def test_metric_rows_equal_general_path(spark, case, monkeypatch):
    df = scores(spark, 400, tie=0.4 if case == "ties" else None)
    if case == "bad":
        df = df.withColumn("predicted", F.when(F.col("IDpol") % 9 == 0, float("nan")).when(F.col("IDpol") % 11 == 0, None).when(F.col("IDpol") % 50 == 1, float("inf")).otherwise(F.col("predicted")))
    if case == "zero":
        df = df.withColumn("actual", F.lit(0).cast("long"))
    if case == "one":
        df = df.where("IDpol = 3")
    fast = {r["model"]: r.asDict() for r in ev.metric_rows(df).collect()}
    monkeypatch.setattr(selection, "MAX_GROUPS", 0)
    slow = {r["model"]: r.asDict() for r in ev.metric_rows(df).collect()}
    assert fast.keys() == slow.keys() and len(fast) == 2
    for m in fast:
        assert list(fast[m]) == list(slow[m])
        for k, a in fast[m].items():
            b = slow[m][k]
            assert a == b or (a is not None and b is not None and (math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) or (math.isnan(a) and math.isnan(b)))), (case, m, k, a, b)


def test_scans_are_told_from_work(spark):
    df = scores(spark, 20)
    assert selection.is_scan(df.where("actual > 0").select("model", (F.col("predicted") * 2).alias("x")))
    assert not selection.is_scan(df.groupBy("model").count()) and not selection.is_scan(df.join(df.select("IDpol"), "IDpol"))
