"""Anchors: the samples are compiled arithmetic, with the results of a plain loop over them."""
import math
import random

from riskloom.operators import explain as ix

COLS = [f"c{i}" for i in range(9)]


def by_hand(v, score):
    spread = [None if x is None else abs(x) * 0.6 for x in v]
    top = sorted((i for i, s in enumerate(spread) if s is not None and s > 0.01), key=lambda i: (-spread[i], i))[:5]
    hits = 0
    for s in range(100):
        moved = [0.0 if i in top else None if x is None else abs(x * (-0.2 + 0.4 * ((s * 31 + i * 17) % 100) / 100.0)) for i, x in enumerate(v)]
        hits += None not in moved and sum(moved) / len(v) < 0.15
    rule = " AND ".join(f"{COLS[i]} > {v[i] * 0.8:.2f}" if score is not None and score > 0.5 else f"{COLS[i]} <= {v[i] * 1.2:.2f}" for i in top[:3])
    return [COLS[i] for i in top], rule or "Default rule", hits / 100, min(0.4 + hits / 100 * 0.3, 1.0)


def test_samples_are_compiled_and_equal_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([0.0, 0.5, 0.9, None]), *[rng.choice([0.0, rng.gauss(0, 5), rng.gauss(0, 0.01), 2.5, -2.5]) for _ in COLS]) for k in range(60)]
    rows += [(100, 0.7, *[0.0] * 9), (101, 0.2, 1.0, None, *[3.0] * 7), (101, 0.2, 1.0, None, *[3.0] * 7), (None, 0.9, *[float(i) for i in range(9)])]
    df = spark.createDataFrame(rows, "id long, score double, " + ", ".join(f"{c} double" for c in COLS))
    out = ix.anchors(df, "id", "score", COLS)
    assert "sequence(" not in out._jdf.queryExecution().optimizedPlan().toString()     # before: a lambda over the samples, interpreted for each
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = sorted(((r[0], *by_hand(r[2:], r[1])) for r in rows), key=key)
    found = sorted(((r.id, r.anchor_features, r.rule, r.precision, r.coverage) for r in out.collect()), key=key)
    assert len(found) == len(want)
    for a, b in zip(found, want):
        assert a[:3] == b[:3] and all(math.isclose(x, y, abs_tol=1e-12) for x, y in zip(a[3:], b[3:]))
