"""The registered grid search: every combination, bounded at any size."""
import math

from claimwise.plans import models
from claimwise.plans.catalog import REGISTRY

SF = "/root/testdata/sf0.001"


def test_grid_query_asks_for_every_combination(monkeypatch):
    """729 combinations of the reference's values, its 5 folds and 100 rounds."""
    asked = []
    monkeypatch.setattr(models, "model_data", lambda *a: ("train", None, ["x"]))
    monkeypatch.setattr(models.tune, "boosted_grid", lambda train, cols, grid, base, k: asked.append((grid, base, k)))
    monkeypatch.setattr(models.tune, "grid_summary", lambda scores: scores)
    REGISTRY["j04_boosted_grid"][0](None, SF)
    (grid, base, k), = asked
    assert len(grid) == 6 and math.prod(len(v) for v in grid.values()) == 729 and k == 5 and base.rounds == 100
    assert grid["max_depth"] == [3, 5, 7] and grid["gamma"] == [0, 0.1, 0.2]


def test_boosted_queries_with_few_rounds_and_the_whole_grid(spark, monkeypatch):
    """Middle values are searched too; the scores of the other boosted queries with few rounds."""
    from dataclasses import replace
    few = {m: replace(s, params=replace(s.params, rounds=2)) for m, s in models.BOOST_SPECS.items()}
    monkeypatch.setattr(models, "BOOST_SPECS", few)
    monkeypatch.setattr(models, "CV_ROUNDS", 2)
    monkeypatch.setattr(models, "GRID_ROUNDS", 1)
    monkeypatch.setattr(models, "TUNED", {"learning_rate": [0.01, 0.05, 0.1], "max_depth": [1, 2, 3]})
    rows = REGISTRY["j04_boosted_grid"][0](spark, SF).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 10))
    assert {(r["learning_rate"], r["max_depth"]) for r in rows} == {(a, b) for a in (0.01, 0.05, 0.1) for b in (1.0, 2.0, 3.0)}
    assert {r["fold"] for r in REGISTRY["j05_boosted_cv_scores"][0](spark, SF).collect()} == {-2, -1, 0, 1, 2, 3, 4}
    scores = [REGISTRY[n][0](spark, SF).collect() for n in ("l09_boosted_standard_scores", "l10_boosted_poisson_scores", "l11_boosted_tweedie_scores")]
    assert len({frozenset(r["IDpol"] for r in s) for s in scores}) == 1 and all(0 <= r["predicted"] < 20 for s in scores for r in s)
