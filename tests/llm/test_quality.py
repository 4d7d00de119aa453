import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from riskloom.llm import quality
from tests.llm.conftest import documents, words


def corpus(n=400):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        t = words(rng, rng.randint(5, 80), 500)
        rows.append((i, t if good else t.upper().replace(" ", "!! ")))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus()
    odd = [(900, None), (901, ""), (902, "x" * 300_000), (903, "\n" * 50), (None, "a b c"), (5, "again")]
    table = spark.createDataFrame(labels + [(900, None, 0), (5000, 1, 0), (None, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows + odd, extra=True)
    trees = quality.fit(docs, table, F.col("doc_id") % 3 != 1)
    out = quality.predict(docs, trees).collect()
    assert len(out) == len(rows) + len(odd)
    by = {r.doc_id: r for r in out if r.doc_id != 5}
    truth = {i: q for i, q, _ in labels}
    assert np.mean([by[i].predicted == truth[i] for i in by if i in truth and i % 3 == 1]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert abs(by[900].score - by[901].score) < 1e-12
    kept = quality.predict(docs, trees, keep=docs.columns)
    assert set(docs.columns) < {*kept.columns, "doc_id"} and kept.count() == len(out)


def test_one_class_and_no_rows(spark):
    docs = documents(spark, [(1, "a"), (2, "b")])
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert all(r.score > 0.5 for r in quality.predict(docs, quality.fit(docs, one, F.lit(True))).collect())
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.score == 0.5 for r in quality.predict(docs, quality.fit(docs, none, F.lit(True))).collect())
    assert quality.predict(documents(spark, []), quality.fit(docs, one, F.lit(True))).collect() == []


def test_flattened_traversal_equals_walking_each_row():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 5))
    trees = quality.grow(x, ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float))
    for row, s in zip(x, trees.score(x)):
        z = trees.bias
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            i = 0
            while i < len(f):
                i = 2 * i + 2 if row[f[i]] > t[i] else 2 * i + 1
            z += leaf[i - len(f)]
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-12


def test_statistics_of_odd_texts():
    x = quality.statistics(pa.array([None, "", "\n", "a", "A b\nC", "é" * 10]))
    assert x.shape == (6, quality.FEATURES) and np.isfinite(x).all()
    assert (x[0] == x[1]).all()
