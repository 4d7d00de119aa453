"""Hand cases for the core operators (tiers, rules, split, quantiles, evaluation)."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions.tiers import alert_action, alert_level, risk_tier
from riskloom.operators import evaluate as ev
from riskloom.operators.clean import dedup_first, impute_median, impute_mode
from riskloom.operators.ordering import global_index, kth_values, quantiles
from riskloom.operators.scoring import DEFAULT_PROFILE, hybrid_score, rule_score
from riskloom.operators.split import temporal_split


def test_risk_tier_edges(spark):
    df = spark.createDataFrame([(0.40,), (0.41,), (0.70,), (0.71,)], "s double")
    got = [r[0] for r in df.select(risk_tier(F.col("s"))).collect()]
    assert got == ["LOW", "MEDIUM", "MEDIUM", "HIGH"]


def test_alert_levels(spark):
    df = spark.createDataFrame([(0.85,), (0.55,), (0.15,), (0.75,), (0.45,)], "s double")
    got = [(r[0], r[1]) for r in df.select(alert_level(F.col("s")), alert_action(F.col("s"))).collect()]
    assert got == [("HIGH", "BLOCK_AND_REVIEW"), ("MEDIUM", "MANUAL_REVIEW"), ("LOW", "AUTO_APPROVE"),
                   ("HIGH", "BLOCK_AND_REVIEW"), ("MEDIUM", "MANUAL_REVIEW")]


@pytest.mark.parametrize("amount,proc,days,expected", [
    (90000.0, 20, 30, 0.90), (12001.0, 12, 18, 0.28), (5000.0, 1, 0, 0.0)])
def test_rule_score_default_profile(spark, amount, proc, days, expected):
    prof = spark.createDataFrame([DEFAULT_PROFILE])
    df = spark.createDataFrame([(amount, proc, days)], "claim_amount double, num_procedures int, days_in_hospital int")
    got = rule_score(df, prof).collect()[0]["rule_score"]
    assert got == pytest.approx(expected)


def test_hybrid_blend_and_clip(spark):
    df = spark.createDataFrame([(0.5, 0.28), (0.0, 0.0), (1.0, 0.9)], "ml double, rule double")
    got = [r[0] for r in df.select(hybrid_score(F.col("ml"), F.col("rule"))).collect()]
    assert got == pytest.approx([0.444, 0.01, 0.99])


@pytest.mark.parametrize("n,expected", [(10, (6, 2, 2)), (7, (4, 1, 2))])
def test_temporal_split_sizes(spark, n, expected):
    base = dt.date(2024, 1, 1)
    rows = [(i, base + dt.timedelta(days=i // 3)) for i in range(n)]  # ties on dates
    df = spark.createDataFrame(rows, "claim_id long, claim_date date")
    s = temporal_split(df, "claim_date", "claim_id")
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert (counts.get("train", 0), counts.get("val", 0), counts.get("test", 0)) == expected
    # time order: every train row precedes every val row, which precedes every test row
    got = sorted((r["claim_date"], r["claim_id"], r["split"]) for r in s.collect())
    order = {"train": 0, "val": 1, "test": 2}
    assert [order[x[2]] for x in got] == sorted(order[x[2]] for x in got)


def test_temporal_split_train_stats_do_not_leak(spark):
    """Changing val/test rows must not change what lands in train."""
    base = dt.date(2024, 1, 1)
    rows = [(i, base + dt.timedelta(days=i)) for i in range(20)]
    a = temporal_split(spark.createDataFrame(rows, "claim_id long, claim_date date"), "claim_date", "claim_id")
    tr = sorted(r[0] for r in a.where("split = 'train'").select("claim_id").collect())
    assert tr == list(range(12))


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.round(rng.normal(100, 30, 997), 1)
    df = spark.createDataFrame([(float(v), int(i % 3)) for i, v in enumerate(vals)], "v double, g int")
    probs = {"p10": 0.1, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    q = quantiles(df, "v", probs, ["g"]).collect()
    for r in q:
        sub = np.array([v for i, v in enumerate(vals) if i % 3 == r["g"]])
        for k, p in probs.items():
            assert r[k] == pytest.approx(float(np.quantile(sub, p)), rel=1e-12)


def test_kth_order_stats_1_to_20(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 21)], "v double")
    r = kth_values(df, "v", {"q1": F.floor(F.col("n") / 4), "q3": F.floor(F.col("n") * 3 / 4),
                             "median": F.floor(F.col("n") / 2)}).collect()[0]
    assert (r["q1"], r["q3"], r["median"]) == (6.0, 16.0, 11.0)


def test_global_index_is_a_permutation(spark):
    df = spark.range(0, 500).select(((F.col("id") * 7919) % 500).alias("k"))
    got = sorted((r["idx"], r["k"]) for r in global_index(df, ["k"], n_buckets=7).collect())
    assert got == [(i, i) for i in range(500)]


def test_dedup_first_is_deterministic(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (1, 2, "b"), (2, 5, "z")], "k int, o int, p string")
    got = sorted(tuple(r) for r in dedup_first(df, ["k"], ["o"]).collect())
    assert got == [(1, 1, "a"), (2, 5, "z")]


def test_impute_median_and_mode(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, None), (3.0, "y"), (10.0, "y"), (None, "x")], "a double, c string")
    out = impute_mode(impute_median(df, ["a"]), ["c"]).collect()
    assert [r["a"] for r in out] == [1.0, 3.0, 3.0, 10.0, 3.0]
    assert [r["c"] for r in out] == ["x", "x", "y", "y", "x"]   # tie x/y -> smallest


def test_auc_ap_match_bruteforce(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.random(300) * 0.5 + y * 0.3, 2)  # ties on purpose
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    r = ev.roc_auc(df, "y", "s").collect()[0]
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert r["roc_auc"] == pytest.approx(auc, rel=1e-12)
    # AP: sum over distinct thresholds of recall step * precision
    ap = 0.0
    for t in sorted(set(s), reverse=True):
        sel = s >= t
        tp = (y[sel] == 1).sum()
        ap += ((y[s == t] == 1).sum() / (y == 1).sum()) * tp / sel.sum()
    assert r["average_precision"] == pytest.approx(ap, rel=1e-12)


def test_auc_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, s double")
    r = ev.roc_auc(df, "y", "s").collect()[0]
    assert r["roc_auc"] is None and r["average_precision"] is None


def test_ring_doctor_recall_half_counts(spark):
    df = spark.createDataFrame([("A", 1, 1, True), ("A", 1, 1, False), ("B", 1, 1, False)],
                               "doctor_id string, ring_id int, fraud_label int, pred boolean")
    r = ev.ring_unit_recall(df, "pred").collect()[0]
    assert r["ring_doctor_recall"] == 0.5


def test_seed_ci_matches_reference_values(spark):
    rows = [("m", i, "recall", float(v)) for i, v in enumerate([1, 1, .9844, 1, 1])]
    df = spark.createDataFrame(rows, "model string, seed int, metric string, value double")
    r = ev.seed_summary(df).collect()[0]
    assert (round(r["ci_low"], 4), round(r["ci_high"], 4)) == (0.9908, 1.003)


def test_empty_summaries_do_not_fail(spark):
    df = spark.createDataFrame([], "y int, s double")
    r = ev.roc_auc(df, "y", "s").collect()[0]
    assert r["roc_auc"] is None
    m = ev.binary_metrics(df, F.col("y"), F.col("s") > 0.5).collect()[0]
    assert (m["tp"], m["accuracy"], m["f1"]) == (0, 0.0, 0.0)
