"""Every registered query with an oracle text matches DuckDB at sf0.001
(row count, column names, order-insensitive rounded values)."""
import math

import pytest

import __spark_entry__  # registers the queries
from claimwise.plans.catalog import REGISTRY

ORACLES = {name: sql for name, (_, sql) in REGISTRY.items() if sql}

SF = "/root/testdata/sf0.001"


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    sdf = REGISTRY[name][0](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(ORACLES[name])
    drows = cur.fetchall()
    dcols = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _rows(srows, sdf.columns) == _rows(drows, dcols)


def test_entry_smoke(spark):
    df = __spark_entry__.entry(spark)
    rows = df.collect()
    assert {r["RiskSegment"] for r in rows} <= {"Low", "Medium", "High"}
    assert sum(r["policies"] for r in rows) == 1500


#: Hundreds of rounds: run below with a few.
LONG = ["j04_boosted_grid", "j05_boosted_cv_scores", "l06_boosted_importance", "l09_boosted_standard_scores", "l10_boosted_poisson_scores", "l11_boosted_tweedie_scores"]
ROWS_ONLY = sorted(set(REGISTRY) - set(ORACLES) - set(LONG))


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_query_runs(spark, name):
    df = REGISTRY[name][0](spark, SF)
    rows = df.collect()
    assert len(rows) > 0
    # no NaN / null in the numeric results of the model queries
    for r in rows:
        for v in r:
            if isinstance(v, float):
                assert not math.isnan(v), (name, r)


def test_boosted_queries_with_few_rounds(spark, monkeypatch):
    from dataclasses import replace

    from claimwise.plans import models
    few = {m: replace(s, params=replace(s.params, rounds=3)) for m, s in models.BOOST_SPECS.items()}
    monkeypatch.setattr(models, "BOOST_SPECS", few)
    monkeypatch.setattr(models, "CV_ROUNDS", 2)
    monkeypatch.setattr(models, "GRID_ROUNDS", 1)
    monkeypatch.setattr(models, "TUNED", {"learning_rate": [0.01, 0.05, 0.1], "max_depth": [1, 2, 3]})
    fits = []
    real = models.bst.fit_models
    monkeypatch.setattr(models.bst, "fit_models", lambda *a, **k: (fits.append(1), real(*a, **k))[1])
    rows = {name: REGISTRY[name][0](spark, SF).collect() for name in LONG}
    assert len(fits) == 1                      # one joint fit for all four queries
    assert all(len(r) > 0 for r in rows.values())
    assert sorted(r["rank"] for r in rows["j04_boosted_grid"]) == [1, 2, 3, 4]
    assert {r["fold"] for r in rows["j05_boosted_cv_scores"]} == {-2, -1, 0, 1, 2, 3, 4}
    scores = [rows[n] for n in LONG[3:]]
    assert len({frozenset(r["IDpol"] for r in s) for s in scores}) == 1 and all(0 <= r["predicted"] < 20 for s in scores for r in s)


def test_every_query_name_carries_a_survey_id():
    import re
    for name in REGISTRY:
        assert re.match(r"^[a-m]\d\d_[a-z0-9_]+$", name), name


def test_entry_without_training_data_operators(tmp_path):
    """A copy without claimwise/llm and corpus_pipeline.py registers all other queries."""
    import os
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(f"{root}/claimwise", tmp_path / "claimwise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries())); print(len(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert got == [str(len(REGISTRY)), str(len(ORACLES))]
    # the pipeline left behind, the operators gone
    shutil.copy(f"{root}/corpus_pipeline.py", tmp_path) if os.path.exists(f"{root}/corpus_pipeline.py") else None
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.split() == got
