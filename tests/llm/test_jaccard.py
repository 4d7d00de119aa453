import random
import re

import numpy as np
from pyspark.sql import functions as F

from riskloom.llm import jaccard
from tests.llm.conftest import documents, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def expected(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def edited(rng, t, share):
    w = t.split(" ")
    for _ in range(int(len(w) * share)):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
    return " ".join(w)


def corpus():
    rng = random.Random(12)
    rows, base = [], []
    for i in range(60):
        base.append(words(rng, rng.randint(6, 120), 10 ** 6))
    i = 0
    for t in base:
        rows.append((i, t))
        i += 1
        for _ in range(rng.randint(0, 4)):
            rows.append((i, edited(rng, t, rng.choice([0, 0.01, 0.03, 0.04, 0.05]))))
            i += 1
    passage = words(rng, 60, 10 ** 6)
    for _ in range(40):                     # a passage that many different documents share
        rows.append((i, words(rng, 30, 10 ** 6) + " " + passage + " " + words(rng, 25, 10 ** 6)))
        i += 1
    chain = words(rng, 200, 10 ** 6).split(" ")
    for k in range(12):                     # neighbours link, ends do not
        rows.append((i, " ".join(chain[k * 8:k * 8 + 100])))
        i += 1
    return rows + [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "ONE  two"), (905, "two one"), (906, words(rng, 40_000, 10 ** 6)), (907, "a a a a a a a a"), (908, "a a a a a a")]


def test_components_equal_brute_force(spark):
    rows = corpus()
    out = jaccard.jaccard_groups(documents(spark, rows + [(None, "one two"), (None, None)], extra=True)).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None}
    assert got == expected(rows)
    assert sorted((r.n_shingles, r.component_id) for r in out if r.doc_id is None) == [(0, None), (1, None)]


def test_hot_groups_split_tiles(spark, monkeypatch):
    """Large groups of near copies and a common passage over many small tiles."""
    monkeypatch.setattr(jaccard, "TILE", 8)
    monkeypatch.setattr(jaccard, "PREFIX_HOT", 20)
    rng = random.Random(3)
    base = words(rng, 80, 10 ** 6)
    passage = words(rng, 50, 10 ** 6)
    rows = [(i, edited(rng, base, 0.04)) for i in range(120)]
    rows += [(200 + i, passage + " " + words(rng, rng.randint(5, 60), 10 ** 6)) for i in range(80)]
    rows += [(400 + i, base) for i in range(40)]
    out = jaccard.jaccard_groups(documents(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == expected(rows)


def test_empty_table(spark):
    assert jaccard.jaccard_groups(documents(spark, [])).collect() == []


def test_components_of_a_long_path(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    out = jaccard.components(edges).collect()
    assert len(out) == 201 and {r.root for r in out} == {0}


def test_bitmap_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 900))
        a = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[:int(len(a) * rng.random())], rng.integers(0, 2 ** 63, int(n * rng.uniform(0.3, 1))).astype(np.uint64)]))
        x, y = (np.frombuffer(jaccard.bitmap(s), np.uint64)[None, :] for s in (a, b))
        width = min(x.shape[1], y.shape[1])
        differ = np.bitwise_count(jaccard.fold(x, width) ^ jaccard.fold(y, width)).sum()
        assert (len(a) + len(b) - differ) // 2 >= len(np.intersect1d(a, b))
