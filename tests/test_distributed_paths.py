"""The range-bucketed exact operators against brute force, with few buckets so
groups straddle bucket borders."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.operators import evaluate as ev
from riskloom.operators.explain import range_impact
from riskloom.operators.ordering import (global_index, kth_values, quantiles, rolling_rows, running_totals,
                                         with_previous)
from riskloom.operators.split import temporal_split


@pytest.fixture()
def distributed(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_quantiles_distributed(distributed):
    rng = np.random.default_rng(11)
    vals = np.round(rng.exponential(50, 1500), 0)          # many ties
    df = distributed.createDataFrame([(float(v), int(i % 2)) for i, v in enumerate(vals)], "v double, g int")
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    for r in quantiles(df, "v", probs, ["g"]).collect():
        sub = vals[np.arange(len(vals)) % 2 == r["g"]]
        for k, p in probs.items():
            assert r[k] == pytest.approx(float(np.quantile(sub, p)), rel=1e-12)


def test_kth_values_distributed(distributed):
    vals = [float(x) for x in [5, 3, 3, 9, 1, 7, 7, 7, 2, 8, 4, 6, 0]]
    df = distributed.createDataFrame([(v,) for v in vals], "v double")
    r = kth_values(df, "v", {"q1": F.floor(F.col("n") / 4), "med": F.floor(F.col("n") / 2),
                             "q3": F.floor(F.col("n") * 3 / 4)}).collect()[0]
    s = sorted(vals)
    n = len(s)
    assert (r["q1"], r["med"], r["q3"]) == (s[n // 4], s[n // 2], s[3 * n // 4])


def test_global_index_distributed(distributed):
    df = distributed.range(0, 777).select(((F.col("id") * 31) % 777).alias("k"))
    got = sorted((r["idx"], r["k"]) for r in global_index(df, ["k"], n_buckets=6).collect())
    assert got == [(i, i) for i in range(777)]


def test_running_totals_grouped_desc(distributed):
    rows = [(g, float(v), int(v) % 3) for g in ("a", "b") for v in range(200)]
    df = distributed.createDataFrame(rows, "g string, v double, w int")
    out = running_totals(df, ["g"], [F.col("v").desc()], ["w"], n_buckets=4).collect()
    for r in out:
        exp = sum(int(x) % 3 for x in range(int(r["v"]), 200))
        assert r["cum_w"] == exp


def test_rolling_rows_matches_window_with_hot_group(distributed):
    """A hot stream (most rows) over several buckets equals the plain window."""
    base = dt.datetime(2024, 1, 1)
    rows = [(i, "hot" if i % 10 else "cold", base + dt.timedelta(seconds=i), float((i * 7919) % 101))
            for i in range(900)]
    df = distributed.createDataFrame(rows, "id long, s string, ts timestamp, x double")
    got = {r["id"]: (r["roll_n"], r["roll_mean"]) for r in
           rolling_rows(df, ["s"], ["ts", "id"], "x", 20, n_buckets=7).collect()}
    w = Window.partitionBy("s").orderBy("ts", "id").rowsBetween(-19, 0)
    ref = df.select("id", F.count("x").over(w).alias("n"), F.avg("x").over(w).alias("m")).collect()
    for r in ref:
        assert got[r["id"]][0] == r["n"]
        assert got[r["id"]][1] == pytest.approx(r["m"], rel=1e-12)


def test_with_previous_matches_lag(distributed):
    rows = [(i % 3, i, i * 2) for i in range(300)]
    df = distributed.createDataFrame(rows, "k int, t int, v int")
    got = {r["t"]: r["prev_v"] for r in with_previous(df, ["k"], ["t"], ["v"], n_buckets=4).collect()}
    for t in range(300):
        assert got[t] == (None if t < 3 else (t - 3) * 2)


def test_split_distributed_straddle(distributed):
    base = dt.date(2024, 1, 1)
    rows = [(i, base + dt.timedelta(days=i // 50)) for i in range(500)]   # boundaries fall inside dates
    s = temporal_split(distributed.createDataFrame(rows, "claim_id long, claim_date date"), "claim_date", "claim_id")
    lab = {r["claim_id"]: r["split"] for r in s.collect()}
    assert [lab[i] for i in range(500)] == ["train"] * 300 + ["val"] * 100 + ["test"] * 100


def test_auc_distributed(distributed):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400), 2)
    df = distributed.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    r = ev.roc_auc(df, "y", "s").collect()[0]
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert r["roc_auc"] == pytest.approx(auc, rel=1e-12)


def test_range_impact_with_ties(distributed):
    rows = [(float(i % 7), float((i * 13) % 10) / 10) for i in range(103)]
    df = distributed.createDataFrame(rows, "f double, p double")
    r = range_impact(df, "f", "p").collect()[0]
    srt = sorted(rows)
    n = len(srt)
    low = np.mean([p for _, p in srt[: n // 4]])
    high = np.mean([p for _, p in srt[3 * n // 4:]])
    assert r["low_range_avg_prediction"] == pytest.approx(low, rel=1e-12)
    assert r["high_range_avg_prediction"] == pytest.approx(high, rel=1e-12)


def test_top_k_per_group_matches_window_on_hot_group(spark):
    from riskloom.operators.ordering import top_k_per_group
    rows = [("hot" if i % 10 else f"g{i % 7}", (i * 7919) % 1009, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v long, id long")
    got = sorted((r["g"], r["rank"], r["v"], r["id"]) for r in top_k_per_group(df, ["g"], ["v", "id"], 5).collect())
    w = Window.partitionBy("g").orderBy("v", "id")
    ref = sorted((r["g"], r["rank"], r["v"], r["id"]) for r in
                 df.withColumn("rank", F.row_number().over(w)).where("rank <= 5").collect())
    assert got == ref


@pytest.mark.parametrize("parts", ["8", "200"])
def test_exact_operators_on_empty_null_and_int_input(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        empty = spark.createDataFrame([], "v int, g int")
        nulls = spark.createDataFrame([(None, 1), (None, 2)], "v int, g int")
        for df in (empty, nulls):
            assert [tuple(r) for r in quantiles(df, "v", {"m": 0.5}).collect()] == [(None,)]
            assert [tuple(r) for r in kth_values(df, "v", {"m": F.floor(F.col("n") / 2)}).collect()] == [(0, None)]
            assert quantiles(df, "v", {"m": 0.5}, ["g"]).collect() == []
        ints = spark.createDataFrame([(3, None), (1, None), (2, 7)], "v int, g int")
        k = kth_values(ints, "v", {"m": F.floor(F.col("n") / 2)}, ["g"])
        assert dict(k.dtypes)["m"] == "int" and sorted((r["g"] is None, r["n"], r["m"]) for r in k.collect()) == [(False, 1, 2), (True, 2, 3)]
        q = quantiles(ints, "v", {"m": 0.5})
        assert q.dtypes == [("m", "double")] and q.first()["m"] == 2.0
        assert global_index(empty, ["v"]).collect() == []
        assert running_totals(empty, ["g"], ["v"], ["v"]).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_many_groups(spark):
    df = spark.range(200_000).select((F.col("id") % 100_000).alias("g"), F.col("id").alias("v"))
    out = with_previous(df, ["g"], ["v"], ["v"])
    assert out.where("prev_v IS NOT NULL").count() == 100_000
    r = rolling_rows(df, ["g"], ["v"], "v", 20).agg(F.max("roll_n"), F.count("*")).first()
    assert tuple(r) == (2, 200_000)


def test_rolling_rows_with_many_tiny_buckets(distributed):
    rows = [(i, "ab"[i % 2], float((i * 31) % 17)) for i in range(120)]
    df = distributed.createDataFrame(rows, "id long, s string, x double")
    got = {r["id"]: (r["roll_n"], r["roll_mean"]) for r in rolling_rows(df, ["s"], ["id"], "x", 20, n_buckets=40).collect()}
    w = Window.partitionBy("s").orderBy("id").rowsBetween(-19, 0)
    for r in df.select("id", F.count("x").over(w).alias("n"), F.avg("x").over(w).alias("m")).collect():
        assert got[r["id"]] == (r["n"], pytest.approx(r["m"], rel=1e-12))
