import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import toxicity
from tests.llm.conftest import documents

PLAIN = [f"{a}{b}{c}" for a in ("an", "the", "re", "on", "ti", "st") for b in ("er", "ou", "ing", "ha") for c in ("nd", "ly", "es", "")]
INSULTS = ["moron", "scum", "idiot"]


def text(rng, n, bad=0, insults=INSULTS):
    words = [rng.choice(PLAIN) for _ in range(n)]
    for _ in range(bad):
        words[rng.randrange(n)] = rng.choice(insults) + rng.choice(["", "s", "ing", "tum", "enter"])
    return " ".join(words)


def corpus(n, seed, long=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        bad = int(i % 4 == 0)
        size = rng.randrange(300, 600) if long else rng.randrange(10, 150)
        rows.append((text(rng, size, bad * rng.randrange(2, 5)), bad))
    return rows


@pytest.fixture(scope="module")
def net():
    rows = corpus(700, 1)
    return toxicity.train(pa.array([t for t, _ in rows]), np.array([y for _, y in rows], np.float32), 0.25)


def test_gradients_equal_differences(monkeypatch):
    for name, value in (("WORD_BUCKETS", 64), ("CHAR_BUCKETS", 64), ("WINDOW_WORDS", 7), ("STRIDE", 4)):
        monkeypatch.setattr(toxicity, name, value)
    net = toxicity.Net(3, np.float64)
    own = toxicity.Words(pa.array([text(random.Random(i), 3 + 5 * i, 1) for i in range(4)]))
    windows, target = own.windows(slice(None)), np.arange(len(own.begin)) % 2.0

    def loss():
        z = net.forward(net.project(net.inputs(own.bucket, own.gram_first, own.grams)), windows)
        return np.mean(np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - z * target)

    g, rows = net.gradients(own, windows, target)
    for k, (at, v) in rows.items():
        g[k] = np.zeros_like(net.p[k])
        g[k][at] = v
    rng = np.random.default_rng(0)
    for k, grad in g.items():
        assert np.abs(grad).max() > 0, k
        for i in rng.choice(grad.size, min(grad.size, 25), replace=False):
            at, step = np.unravel_index(i, grad.shape), 1e-6
            net.p[k][at] += step
            above = loss()
            net.p[k][at] -= 2 * step
            below = loss()
            net.p[k][at] += step
            assert abs((above - below) / (2 * step) - grad[at]) < 1e-6, (k, at)


def test_forward_equals_one_window_at_a_time():
    """The batched pass equals plain recurrences over each window's own words."""
    net = toxicity.Net(9, np.float64)
    own = toxicity.Words(pa.array([text(random.Random(i), n) for i, n in enumerate((1, 5, 32, 33, 90))]))
    x, h = net.inputs(own.bucket, own.gram_first, own.grams), toxicity.HIDDEN
    got = net.forward(net.project(x), own.windows(slice(None)))
    for k, row in enumerate(own.windows(slice(None))):
        ids = [i for i in row if i < len(x)]
        states = {}
        for d, seq in (("f", list(enumerate(ids))), ("b", list(enumerate(ids))[::-1])):
            state = np.zeros(h)
            for t, i in seq:
                a, u = x[i] @ net.p[f"W{d}"] + net.p[f"B{d}"], state @ net.p[f"U{d}"]
                z, r = np.clip(a[:h] + u[:h], 0, 1), np.clip(a[h:2 * h] + u[h:2 * h], 0, 1)
                new = toxicity._curve(a[2 * h:] + r * u[2 * h:])
                state = (1 - z) * new + z * state
                states[d, t] = state
        both = np.array([np.concatenate([states["f", t], states["b", t]]) for t in range(len(ids))])
        e = toxicity._curve(both @ net.p["A"] + net.p["c"]) @ net.p["v"]
        weight = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        assert abs(weight @ both @ net.p["w"] + net.p["o"][0] - got[k]) < 1e-9


def test_windows_cover_texts_and_overlap():
    size, step = toxicity.WINDOW_WORDS, toxicity.STRIDE
    assert step < size
    for n in (0, 1, size - 1, size, size + 1, size + step, size + step + 1, 1000):
        of, first = toxicity.window_starts(np.array([n]))
        covered = sorted({w for a in first for w in range(a, min(a + size, n))})
        assert covered == list(range(n)) and len(of) == len(first)
        assert list(first) == [step * i for i in range(len(first))]
        assert all(a + size < n for a in first[:-1])


def test_held_out_texts_and_unseen_forms(net):
    rows = corpus(300, 2) + corpus(60, 3, long=True)
    y = np.array([b for _, b in rows])
    score = net.score(pa.array([t for t, _ in rows]))
    assert (score[y == 1] >= toxicity.THRESHOLD).mean() > 0.95 and (score[y == 0] >= toxicity.THRESHOLD).mean() < 0.03
    rng = random.Random(5)
    unseen = [text(rng, 60, 3, ["morongul", "scumzeft", "idiotwab"]) for _ in range(40)]
    assert (net.score(pa.array(unseen)) >= toxicity.THRESHOLD).mean() > 0.9


def test_one_insult_anywhere_in_a_long_text(net):
    rng = random.Random(8)
    for at in (0, 9_999, 19_999):
        words = [rng.choice(PLAIN) for _ in range(20_000)]
        clean = net.score(pa.array([" ".join(words)]))[0]
        words[at:at + 1] = ["scum", "moron", "idiots"]
        assert net.score(pa.array([" ".join(words)]))[0] > max(clean, toxicity.THRESHOLD)


def test_scores_do_not_depend_on_the_batch(net):
    texts = [t for t, _ in corpus(40, 11)] + ["", None, "x", "!!!"]
    whole = net.score(pa.array(texts))
    alone = np.concatenate([net.score(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(whole, alone, atol=1e-5) and list(whole[-4:][[0, 1, 3]]) == [0, 0, 0]


def test_fit_and_predict_on_tables(spark):
    rows = corpus(400, 21)
    docs = documents(spark, [(i, t) for i, (t, _) in enumerate(rows)] + [(900, None), (901, ""), (902, "?!"), (903, "word " * 30_000), (None, "the moron"), (0, rows[0][0])], extra=True)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)] + [(900, 1), (901, 0), (950, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels, F.col("doc_id") % 5 != 0)
    out = toxicity.predict(docs, net).collect()
    assert len(out) == docs.count()
    by = {}
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= toxicity.THRESHOLD)
        by.setdefault(r.doc_id, []).append(r.score)
    assert by[900] == by[901] == by[902] == [0.0] and len(by[0]) == 2 and by[0][0] == pytest.approx(by[0][1], abs=1e-5)
    held = [(by[i][0] >= toxicity.THRESHOLD, y) for i, (_, y) in enumerate(rows) if i % 5 == 0]
    assert np.mean([p == bool(y) for p, y in held]) > 0.95
    assert toxicity.predict(docs.limit(0), net).collect() == []


def test_no_labels_and_one_class(spark):
    docs = documents(spark, [(1, "the scum"), (2, "the end"), (3, None)])
    for labels, want in (([], 0.0), ([(1, 1), (2, 1)], 1.0), ([(1, 0), (2, 0)], 0.0)):
        net = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
        assert {r.doc_id: r.score for r in toxicity.predict(docs, net).collect()} == {1: want, 2: want, 3: 0.0}
