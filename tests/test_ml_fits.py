"""Model fits: forests grown with little memory, fits side by side, the same results as one by one."""
import os
import threading

import pytest

from riskloom.operators import ml
from riskloom.operators.ordering import materialize

X = ["a", "b"]


@pytest.fixture(scope="module")
def claims(spark):
    return materialize(spark.range(0, 240, 1, 2).selectExpr("id claim_id", "double(pmod(id * 37, 101)) a", "double(pmod(id * 53, 89)) b", "int(pmod(id, 4)) ring_id",
                                                            "int(pmod(id * 37, 101) > 50 or pmod(id, 9) = 0) fraud_label"))


def test_forest_keeps_node_ids_and_little_memory(spark):
    one = ml.estimator("random_forest", 10)
    assert one.getCacheNodeIds() and one.getMaxMemoryInMB() <= 64          # before: False, 256
    assert (one.getNumTrees(), one.getMaxDepth()) == (200, 12)


def test_fits_run_side_by_side_with_the_same_results(claims, monkeypatch):
    fit, running, most, lock = ml.fit, [0], [0], threading.Lock()

    def counted(*args, **more):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        try:
            return fit(*args, **more)
        finally:
            running[0] -= 1

    pool, test = claims.where("claim_id < 180"), claims.where("claim_id >= 180")
    params = {"logistic_regression": {}, "random_forest": {"numTrees": 3, "maxDepth": 3}}
    grid = {"C": [0.1, 1.0], "penalty": ["l2"]}
    results = []
    for at_once in (1, 4):
        monkeypatch.setattr(ml, "SIDE_BY_SIDE", at_once)
        monkeypatch.setattr(ml, "fit", counted if at_once > 1 else fit)
        seeds = [tuple(r) for r in ml.seed_refits(pool, test, X, params, (0, 1)).collect()]
        folds = ml.cross_validate(pool, X, "logistic_regression", "claim_id", grid, 3)
        tuned = ml.tune(pool, test, X, "logistic_regression", grid)
        results.append((seeds, folds[:2], tuned[:2]))
    (seeds, folds, tuned), (others, *rest) = results
    assert [r[:3] for r in seeds] == [r[:3] for r in others] and len(seeds) == 2 * 2 * 6
    assert [r[3] for r in seeds] == pytest.approx([r[3] for r in others], abs=1e-9)
    for a, b in zip((folds, tuned), rest):
        assert a[0] == b[0] and [r[:2] for r in a[1]] == [r[:2] for r in b[1]]
        assert [r[2] for r in a[1]] == pytest.approx([r[2] for r in b[1]], abs=1e-9)
    assert most[0] > 1


def test_tables_for_fits_are_cut_into_files(spark):
    stored = materialize(spark.range(0, 100, 1, 1), 20)
    files = [f for f in os.listdir(stored.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]) if f.endswith(".parquet")]
    assert len(files) == 5 and stored.count() == 100


def test_small_passes_grow_the_same_forest(claims):
    usual = ml.fit(claims, X, "random_forest", numTrees=4, maxDepth=5, cacheNodeIds=False, maxMemoryInMB=256)
    ours = ml.fit(claims, X, "random_forest", numTrees=4, maxDepth=5)
    trees = lambda m: m.stages[-1].toDebugString.split("\n", 1)[1]
    assert trees(ours) == trees(usual)
