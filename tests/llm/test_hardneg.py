import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=10, scale=256):
    """{(anchor, positive): [(negative, positive score, negative score)]} by comparing everything."""
    best, limit = {}, hardneg.component_limit(max((len(v) for _, v, _ in rows if v), default=1))
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        own = (str(label), [int(max(-limit, min(limit, math.floor(scale * float(np.float32(c)))))) for c in v])
        best[i] = min(best.get(i, own), own)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = {}
    for a in (i for i in best if i % 100 == 0):
        label, v = best[a]
        score = {i: dot(v, w) for i, (_, w) in best.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if best[i][0] == label][:positives]:
            good = [i for i in order if best[i][0] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]][:negatives]
            if good:
                out[a, p] = [(i, score[p], score[i]) for i in good]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.anchor_id, r.positive_id, r["rank"])):
        own = out.setdefault((r.anchor_id, r.positive_id), [])
        assert r["rank"] == len(own) + 1
        own.append((r.negative_id, r.positive_score, r.negative_score))
    return out


def table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("v", "rank", "anchor_id", "score", "r"):
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(5)


def vectors(kind, seed, n=900, dim=12):
    rng = np.random.default_rng(seed)
    if kind == "random":
        x = rng.standard_normal((n, dim))
    elif kind == "clusters":
        centre = rng.standard_normal((8, dim)) * 3
        x = centre[rng.integers(0, 8, n)] + 0.01 * rng.standard_normal((n, dim))
    else:                                   # few different vectors: ties everywhere
        x = rng.integers(-1, 2, (n, 3)).astype(float)
    ids = np.where(np.arange(n) < 40, np.arange(n) * 100, np.arange(n) + 10_001)
    ids = np.where((ids % 100 == 0) & (np.arange(n) >= 40), ids + 500_001, ids)
    return [(int(i), [float(c) for c in v.astype(np.float32)], int(y)) for i, v, y in zip(ids, x, rng.integers(0, 3, n))]


@pytest.mark.parametrize("kind", ["random", "clusters", "ties"])
def test_equals_comparing_everything(spark, monkeypatch, kind):
    monkeypatch.setattr(hardneg, "BLOCK", 7)
    monkeypatch.setattr(hardneg, "TILE", 64)
    monkeypatch.setattr(hardneg, "SEEDS", 50)
    rows = vectors(kind, 3)
    want = brute(rows)
    assert want and result(hardneg.hard_negatives(table(spark, rows), F.col("vec_id") % 100 == 0)) == want


def test_passes_give_the_same_rows(spark, monkeypatch):
    rows = vectors("random", 5, 300)
    want = brute(rows)
    monkeypatch.setattr(hardneg, "PASS_BYTES", 8 * 12 * 15)
    assert result(hardneg.hard_negatives(table(spark, rows), F.col("vec_id") % 100 == 0)) == want


def test_odd_rows(spark):
    rows = vectors("random", 7, 120)
    some = rows[0][1]
    rows += [(None, some, 1), (50_000, None, 1), (50_100, some, None), (50_200, [None] * 12, 1), (50_300, [float("nan")] * 12, 1), (50_400, [float("inf")] * 12, 1),
             (50_500, [], 1), (50_600, some[:5], 2), (50_700, some + some, 2), rows[0], (rows[1][0], some, 0), (50_800, [0.0] * 12, 1), (50_900, some, 77)]
    assert result(hardneg.hard_negatives(table(spark, rows), F.col("vec_id") % 100 == 0)) == brute(rows)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i * 50, [float(np.float32(c)) for c in rng.standard_normal(4) * 10.0 ** rng.integers(0, 9)], int(i % 2)) for i in range(60)]
    assert result(hardneg.hard_negatives(table(spark, rows), F.col("vec_id") % 100 == 0)) == brute([(i, v, y) for i, v, y in rows])


def test_empty_and_without_anchors(spark):
    for rows in ([], [(1, [1.0], 0)], [(100, [1.0], 0)], [(100, None, 0)]):
        assert hardneg.hard_negatives(table(spark, rows), F.col("vec_id") % 100 == 0).collect() == []


def test_bounds_hold_and_skip_rows():
    """On clustered vectors far fewer scores are computed than pairs exist, and every one that counts is among them."""
    rows = vectors("clusters", 11, 4000)
    x = np.array([np.floor(256 * np.array(v)) for _, v, _ in rows])
    ids, label = np.array([r[0] for r in rows]), [str(r[2]) for r in rows]
    own = np.flatnonzero(ids % 100 == 0)
    own = own[np.argsort(ids[own])]
    anchors = hardneg.Anchors(ids[own], [label[i] for i in own], x[own], x.shape[1], 5, 10)
    batch = pa.record_batch({"vec_id": ids, "label": pa.array(label), "v": pa.array([list(map(int, v)) for v in x], pa.list_(pa.int32()))})
    lists, _ = anchors.find_positives([batch])
    anchors.set_windows([(int(ids[own[i]]), int(p), int(s)) for i, (score, who) in lists.found.items() for s, p in zip(score, who)], 30, 90)
    lists, done = anchors.find_negatives([batch])
    pairs = len(own) * len(x)
    assert done < 0.6 * pairs
    for tree in anchors.all:
        assert sum(p < 0 for _, p, _ in tree) == 1 and len({n for n, _, _ in tree}) == len(tree)
        for node, parent, edge in tree:
            if parent >= 0:
                assert abs(edge - np.linalg.norm(anchors.x[node] - anchors.x[parent])) < 1e-6
    want = brute(rows)
    got = {anchors.pairs[i][:2]: list(zip(who.tolist(), score.astype(int).tolist())) for i, (score, who) in lists.found.items()}
    assert got == {k: [(n, s) for n, _, s in v] for k, v in want.items()}
