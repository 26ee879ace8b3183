"""Per-operator stage count, task time and shuffle volume from Spark's event
log (written to a fresh scratch folder; no UI / server involved).

usage: python tools/stage_report.py [sf_dir]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _read_events(log_dir: str) -> list[dict]:
    events = []
    for path in glob.glob(f"{log_dir}/**/*", recursive=True):
        if not os.path.isfile(path):
            continue
        with open(path, errors="replace") as fh:
            for line in fh:
                try:
                    events.append(json.loads(line))
                except ValueError:
                    pass
    return events


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="claimwise-events-", dir="/tmp")
    from claimwise.session import build_session, materialize
    spark = build_session("local[8]", shuffle_partitions=8,
                          extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                 "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"})
    from claimwise.operators import evaluate as ev
    from claimwise.operators import features as feat
    from claimwise.operators import profile as prof
    from claimwise.operators import ranking as rk
    from claimwise.plans.catalog import ENGINEERED_NUMERIC, KEY_VARS
    from claimwise.sources import tables as src

    sc = spark.sparkContext
    pol = src.policies(spark, sf_dir)
    rows = pol.count()
    ops = {
        "feature_build": lambda: materialize(feat.engineer(pol)[0], "report-fe"),
    }
    fe = None
    marks = []

    def run(name, fn):
        sc.setJobGroup(name, name)
        out = fn()
        marks.append(name)
        return out

    fe = run("feature_build", ops["feature_build"])
    sc_tab = materialize(src.scored_from(pol), "report-sc", 8)
    long = src.long_scores(sc_tab)
    run("metric_rows", lambda: ev.metric_rows(long).collect())
    run("lift_table", lambda: rk.lift_table(long).collect())
    run("pr_summary", lambda: rk.pr_summary(long).collect())
    run("correlation", lambda: prof.correlation_pairs(fe, KEY_VARS + ENGINEERED_NUMERIC).collect())
    spark.stop()

    events = _read_events(log_dir)
    job_group, stage_job = {}, {}
    for e in events:
        if e.get("Event") == "SparkListenerJobStart":
            group = (e.get("Properties") or {}).get("spark.jobGroup.id")
            job_group[e["Job ID"]] = group
            for sid in e.get("Stage IDs", []):
                stage_job[sid] = e["Job ID"]
    report = {m: {"stages": set(), "task_ms": 0, "shuffle_write_bytes": 0, "shuffle_read_bytes": 0} for m in marks}
    for e in events:
        if e.get("Event") != "SparkListenerTaskEnd":
            continue
        group = job_group.get(stage_job.get(e.get("Stage ID")))
        if group not in report:
            continue
        r = report[group]
        r["stages"].add(e["Stage ID"])
        info, metrics = e.get("Task Info", {}), e.get("Task Metrics") or {}
        r["task_ms"] += max(0, info.get("Finish Time", 0) - info.get("Launch Time", 0))
        r["shuffle_write_bytes"] += (metrics.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
        rd = metrics.get("Shuffle Read Metrics") or {}
        r["shuffle_read_bytes"] += rd.get("Remote Bytes Read", 0) + rd.get("Local Bytes Read", 0)
    for m, r in report.items():
        print(json.dumps({"operator": m, "stages": len(r["stages"]), "task_seconds": round(r["task_ms"] / 1000, 2),
                          "shuffle_write_MB": round(r["shuffle_write_bytes"] / 2**20, 2),
                          "shuffle_bytes_per_policy": round(r["shuffle_write_bytes"] / rows, 1)}))


if __name__ == "__main__":
    main()
