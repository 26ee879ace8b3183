"""Scaling check: the sf0.1 policy table replicated k times (new keys, so
ranks / splits see k x rows), then the headline operators timed at each k.
Writes its inputs under a fresh scratch folder; prints one JSON line per k.

usage: python tools/scaling.py [k ...]      (default 1 4 10)
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    ks = [int(x) for x in sys.argv[1:]] or [1, 4, 10]
    from pyspark.sql import functions as F

    from claimwise.operators import evaluate as ev
    from claimwise.operators import features as feat
    from claimwise.operators import glm
    from claimwise.operators import profile as prof
    from claimwise.operators import ranking as rk
    from claimwise.operators import target as tg
    from claimwise.plans.catalog import ENGINEERED_NUMERIC, KEY_VARS
    from claimwise.session import build_session, materialize
    from claimwise.sources import tables as src

    spark = build_session("local[8]", shuffle_partitions=16)
    scratch = tempfile.mkdtemp(prefix="claimwise-scaling-", dir="/tmp")
    base = src.conform(src.policies(spark, "/root/testdata/sf0.1"))
    for k in ks:
        rep = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_r")) \
                  .withColumn("IDpol", F.col("IDpol") * 64 + F.col("_r")).drop("_r")
        path = f"{scratch}/policies_x{k}"
        rep.repartition(max(8, 2 * k)).write.parquet(path)
        pol = spark.read.parquet(path)
        t = {}

        def timed(name, fn):
            t0 = time.perf_counter()
            out = fn()
            t[name] = round(time.perf_counter() - t0, 2)
            return out

        fe = timed("feature_build", lambda: materialize(feat.engineer(pol, stage=False)[0], "scale-fe", 8))
        long = src.long_scores(materialize(src.scored_from(pol), "scale-sc", 8))
        timed("metric_rows", lambda: ev.metric_rows(long).collect())
        timed("lift_table", lambda: rk.lift_table(long).collect())
        timed("pr_summary", lambda: rk.pr_summary(long).collect())
        timed("correlation", lambda: prof.correlation_pairs(fe, KEY_VARS + ENGINEERED_NUMERIC).collect())
        mf = materialize(glm.model_frame(fe), "scale-mf", 8)
        train, _ = tg.split(mf)
        timed("glm_fit", lambda: glm.fit_glm(train, "poisson", feature_cols=feat.model_columns(mf)))
        print(json.dumps({"k": k, "rows": pol.count(), "seconds": t}), flush=True)


if __name__ == "__main__":
    main()
