"""Searches and refits do the whole job: every grid point, models of their full size."""
import pytest

from riskloom.operators import ml
from riskloom.operators.ordering import materialize
from riskloom.plans import base, q_extra, q_ml

X = ["a", "b"]


@pytest.fixture(scope="module")
def claims(spark):
    return materialize(spark.range(0, 240, 1, 2).selectExpr("id claim_id", "double(pmod(id * 37, 101)) a", "double(pmod(id * 53, 89)) b", "int(pmod(id, 4)) ring_id",
                                                            "int(pmod(id * 37, 101) > 50 or pmod(id, 9) = 0) fraud_label"))


def test_boosted_folds_are_fitted_once_for_all_tree_counts(claims, monkeypatch):
    grid = {"maxIter": [1, 3], "stepSize": [0.1, 0.5], "maxDepth": [2], "subsamplingRate": [0.8]}
    fit, fits = ml.fit, []
    monkeypatch.setattr(ml, "fit", lambda *a, **k: fits.append(k) or fit(*a, **k))
    best, rows, model = ml.cross_validate(claims, X, "gradient_boosting", "claim_id", grid, 3)
    assert len(fits) == 2 * 3 + 1                                          # before: 4 * 3 + 1
    dealt = ml.stratified_folds(claims.drop("ring_id"), "claim_id", 3).coalesce(1)
    dealt = materialize(dealt)
    for (name, params, f1), p in zip(rows, ml.grid_points("gradient_boosting", grid), strict=True):
        each = [ml._f1(fit(dealt.where(f"fold <> {i}"), X, name, 42, **p), dealt.where(f"fold = {i}"), "claim_id") for i in range(3)]
        assert params == str(sorted(p.items())) and f1 == pytest.approx(sum(each) / 3, abs=0.02)
    assert max(r[2] for r in rows) == dict(r[1:] for r in rows)[str(sorted(best.items()))]
    assert model.stages[-1].getNumTrees == best["maxIter"]


def test_provider_search_has_the_whole_grid(spark, claims, monkeypatch):
    asked = []

    def search(pool, features, name, key, grid=None, folds=5, seed=42):
        asked.append((name, grid or ml.GRIDS[name], folds))
        model = ml.fit(pool, features, name, seed, maxIter=1, maxDepth=1)
        return {}, [(name, str(sorted(p.items())), 0.5) for p in ml.grid_points(name, grid)], model

    monkeypatch.setattr(q_extra, "PROVIDER_FEATURES", X)
    monkeypatch.setattr(ml, "cross_validate", search)
    rows = claims.selectExpr("claim_id claim_key", "fraud_label", "a", "b", "case when claim_id < 140 then 'train' when claim_id < 190 then 'val' else 'test' end split")
    base.view(spark, "whole-search", "provider_features", lambda: rows)
    assert q_extra.ml_cv_provider(spark, "whole-search").count() == 81     # before: 2 points of 5 trees
    assert asked == [("gradient_boosting", ml.GRIDS["gradient_boosting"], 5)]


def test_refits_have_the_size_of_the_baseline(spark, claims, monkeypatch):
    made, estimator = {}, ml.estimator

    def small(name, rows, seed=42, label="fraud_label", **over):
        whole = estimator(name, rows, seed, label, **over)
        made.setdefault(name, []).append(whole)
        return estimator(name, rows, seed, label, **{"logistic_regression": {}, "random_forest": {"numTrees": 2, "maxDepth": 2}, "gradient_boosting": {"maxIter": 1, "maxDepth": 1}}[name])

    monkeypatch.setattr(ml, "estimator", small)
    monkeypatch.setattr(q_ml, "FEATURES", X)
    rows = claims.selectExpr("*", "case when claim_id < 140 then 'train' when claim_id < 190 then 'val' else 'test' end split")
    base.view(spark, "whole-refits", "encoded", lambda: rows)
    assert q_ml.ml_seed_refits(spark, "whole-refits").count() == 3 * 5 * 6
    assert q_ml.ml_seed_summary(spark, "whole-refits").count() > 0
    assert {len(v) for v in made.values()} == {5} and len(made) == 3
    assert {(m.getNumTrees(), m.getMaxDepth()) for m in made["random_forest"]} == {(200, 12)}               # before: 10 x 5
    assert {(m.getMaxIter(), m.getMaxDepth()) for m in made["gradient_boosting"]} == {(150, 5)}             # before: 5 x 3
