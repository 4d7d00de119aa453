import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from riskloom.llm import lm
from tests.llm.conftest import documents, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def tokens(t):
    return WORD.findall((t or "").translate(LOWER)) + ["\n"]


def corpus():
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randint(0, 40), 60)) for i in range(150)]
    return rows + [(200, None), (201, ""), (202, "  \t\n"), (203, "ÀB Àb W1 w1"), (204, "w1 " * 30_000), (204, "w1 " * 30_000), (None, "w2 w3")]


def test_scores_equal_brute_force(spark):
    rows = corpus()
    held, fold = F.col("doc_id") % 7 == 2, F.col("doc_id") % 10
    out = lm.score(documents(spark, rows, extra=True), held, fold).collect()
    assert len(out) == len(rows)
    train = [t for i, t in rows if i is None or i % 7 != 2]
    count = Counter(x for t in train for x in tokens(t))
    pairs = Counter(p for t in train for p in zip(["\n", *tokens(t)], tokens(t)))
    n, v = sum(count.values()), len(count)
    # the operator's own weights, from the held-out tenth by plain counting
    tune = [t for i, t in rows if i is not None and i % 7 != 2 and i % 10 == 0]
    tc, tp = Counter(x for t in tune for x in tokens(t)), Counter(p for t in tune for p in zip(["\n", *tokens(t)], tokens(t)))
    codes = []
    for t in tune:
        for a, b in zip(["\n", *tokens(t)], tokens(t)):
            c = count[a] - tc[a]
            codes.append(int(lm._bucket(np.array([c]))[0]) << 32 | int(lm._bins(np.array([(pairs[a, b] - tp[a, b]) / max(c, 1)]))[0]) << 16
                         | int(lm._bins(np.array([(count[b] - tc[b]) / (n - sum(tc.values()))]))[0]))
    u, k = np.unique(codes, return_counts=True)
    weights = lm.learn_weights(u, k.astype(float), v)
    texts = {i: t for i, t in rows}
    for r in out:
        own = tokens(texts[r.doc_id])
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[x] > 0 for x in own), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        total = 0.0
        for a, b in zip(["\n", *own], own):
            w = weights[int(lm._bucket(np.array([count[a]]))[0])]
            total += math.log10(w[0] * pairs[a, b] / max(count[a], 1) + w[1] * count[b] / n + w[2] / (v + 1))
        assert math.isclose(r.score, total, rel_tol=1e-6)


def test_weights_sum_to_one_and_follow_the_events():
    code = np.array([3 << 32 | 0 << 16 | 160, 3 << 32 | lm.NONE << 16 | 160], np.int64)
    w = lm.learn_weights(code, np.array([900.0, 100.0]), 1000)
    assert np.allclose(w.sum(axis=1), 1)
    assert w[3][0] > 0.8 and w[0][0] == 0


def test_empty_table_and_empty_corpus(spark):
    assert lm.score(documents(spark, []), F.lit(False), F.lit(1)).collect() == []
    out = lm.score(documents(spark, [(1, "a b")]), F.lit(True), F.lit(1)).first()
    assert (out.n_tokens, out.n_known, out.train_tokens) == (3, 0, 0) and out.score == 0.0
