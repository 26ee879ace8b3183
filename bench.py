"""Headline timings at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS]. Prints ONE JSON line.

Every operator first runs once, untimed, on the smallest fixture (sf0.001)
so JIT and codegen caches are warm (BENCH_WARMUP=0 skips this); then each is
timed once on the full $BENCH_SF_DIR data, forced with a full action
(``collect``/``count`` of the result, or the fit itself). ``value`` is the
sum of the per-operator seconds; job counts come from the status tracker.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def _sf_value(sf_dir: str):
    name = os.path.basename(sf_dir.rstrip("/"))
    try:
        return float(name.replace("sf", ""))
    except ValueError:
        return name


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from claimwise.session import build_session

    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus),
                          extra={"spark.sql.files.maxPartitionBytes": str(32 * 1024 * 1024),
                                 "spark.driver.memory": os.environ.get("CLAIMWISE_DRIVER_MEMORY", "8g")})
    from pyspark.sql import functions as F

    from claimwise.operators import boost as bst
    from claimwise.operators import evaluate as ev
    from claimwise.operators import features as feat
    from claimwise.operators import glm
    from claimwise.operators import profile as prof
    from claimwise.operators import ranking as rk
    from claimwise.operators import target as tg
    from claimwise.session import materialize
    from claimwise.sources import tables as src
    from claimwise.plans.catalog import ENGINEERED_NUMERIC, KEY_VARS

    tracker = spark.sparkContext.statusTracker()

    def jobs_so_far():
        return len(tracker.getJobIdsForGroup())

    timings, jobs = {}, {}

    def headline(sf: str, timed):
        pol = src.policies(spark, sf)
        # feature build: policies join + cleaning + 41 columns, materialised
        fe = timed("feature_build", lambda: materialize(feat.engineer(pol)[0], "bench-features"))
        sc = materialize(src.scored_from(pol), "bench-scored", min_partitions=spark.sparkContext.defaultParallelism)
        long = src.long_scores(sc)
        timed("metric_rows", lambda: ev.metric_rows(long).collect())
        timed("lift_table", lambda: rk.lift_table(long).collect())
        timed("pr_curve", lambda: rk.pr_curve(long).write.format("noop").mode("overwrite").save())
        timed("pr_summary", lambda: rk.pr_summary(long).collect())
        timed("correlation_matrix", lambda: prof.correlation_pairs(fe, KEY_VARS + ENGINEERED_NUMERIC).collect())
        timed("describe", lambda: prof.describe(fe, ["Density", "LogDensity", "CompositeRiskScore",
                                                      "RiskFactorScore", "ClaimNb"]).collect())
        mf = materialize(glm.model_frame(fe), "bench-model-frame", min_partitions=spark.sparkContext.defaultParallelism)
        train, test = tg.split(mf)
        cols = feat.model_columns(mf)
        fitted = timed("glm_fit_poisson", lambda: glm.fit_glm(train, "poisson", feature_cols=cols))
        timed("glm_score_eval",
              lambda: ev.metric_rows(fitted.predict(test).withColumn("model", F.lit("poisson"))).collect())
        timed("boost_10_rounds", lambda: bst.fit_boosted(train, "poisson", cols,
                                                         bst.BoostParams(objective="poisson", rounds=10)))

    def untimed(name, fn):
        return fn()

    def timed(name, fn):
        j0 = jobs_so_far()
        t0 = time.perf_counter()
        out = fn()
        timings[name] = round(time.perf_counter() - t0, 3)
        jobs[name] = jobs_so_far() - j0
        return out

    # warm-up: every operator once on the smallest fixture (JIT, codegen caches), untimed
    warm = "/root/testdata/sf0.001"
    if os.path.exists(warm) and os.environ.get("BENCH_WARMUP", "1") == "1":
        headline(warm, untimed)
    headline(sf_dir, timed)
    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "sum_of_headline_query_seconds", "value": total, "unit": "sec",
                      "queries": timings, "jobs": jobs, "sf": _sf_value(sf_dir),
                      "cpus": int(cpus), "driver_memory": spark.conf.get("spark.driver.memory", "?")}))


if __name__ == "__main__":
    main()
