import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import divergence
from riskloom.llm.common import text_buffer

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(rows, min_docs, top):
    """{(lang, source, part): [(item, value)]} in rank order."""
    df, count = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = terms_of(text)
        count[lang or "", source or ""].update(found)
        df[lang or ""].update(set(found))
    out = {}
    for (lang, source), own in count.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        sources = [s for l, s in count if l == lang]
        share = lambda c: {t: 1 + 10 ** 9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        p, q = share(own), share(sum((count[lang, s] for s in sources), Counter()))
        pairs = [(s, sum(abs(p[t] - r[t]) for t in kept)) for s in sources if s != source for r in [share(count[lang, s])]]
        over = [(t, p[t] - q[t]) for t in kept if own[t] and p[t] > q[t]]
        by = lambda x: (-x[1], x[0].encode())
        out[lang, source, "pair"], out[lang, source, "term"] = sorted(pairs, key=by), sorted(over, key=by)[:top]
    return {k: v for k, v in out.items() if v}


def frame(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    for c in ("term", "n", "docs", "p", "q", "total", "base", "x", "y", "block", "rank", "part", "item"):
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(4)


def result(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.lang, r.source, r.part, r["rank"])):
        out[r.lang, r.source, r.part].append((r.item, r.value))
        assert r["rank"] == len(out[r.lang, r.source, r.part])
    return dict(out)


WORDS = ["the", "The", "THE", "then", "thenceforward", "thenceforwards", "thenceforwar", "é", "É", "éa", "straße", "日本", "日本語", "a", "A", "zz", "𝒳", "İ", "abcdefgh", "abcdefghi", "abcdefgh\x7f", "x1y", "_", "12"]


def corpus(seed, n=150, sources=7):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        lang, source = rng.choice(["en", "de", None]), rng.choice([f"s{min(rng.randrange(sources * 3), sources - 1) if rng.random() < .5 else rng.randrange(sources)}", None, "é"])
        words = rng.choices(WORDS, k=rng.randrange(30))
        out.append((rng.choice([" ", "\n", "-", "\x00", ", "]).join(words) if rng.random() > .05 else rng.choice([None, "", " "]), lang, source))
    return out


@pytest.mark.parametrize("min_docs,top", [(1, 5), (20, 50), (10_000, 50)])
def test_equals_counting(spark, min_docs, top):
    rows = corpus(min_docs)
    assert result(divergence.audit(frame(spark, rows), min_docs, top)) == brute(rows, min_docs, top)


def test_tiles_shards_and_long_documents(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE_SOURCES", 2)
    monkeypatch.setattr(divergence, "TILE_ROWS", 10)
    monkeypatch.setattr(divergence, "SHARD", 400)
    rows = corpus(5) + [(" ".join(WORDS * 200), "en", "s1"), ("b" * 3000, "en", "s1"), (" ".join(WORDS * 90), "de", "long only")]
    assert result(divergence.audit(frame(spark, rows), 3, 50)) == brute(rows, 3, 50)


def test_empty_table_single_source_repeated_rows(spark):
    assert divergence.audit(frame(spark, [])).collect() == []
    rows = [("a b a", "en", "s")] * 40
    assert result(divergence.audit(frame(spark, rows))) == brute(rows, 30, 50) == {}
    rows += [("b c", "en", "t")] * 3
    assert result(divergence.audit(frame(spark, rows))) == brute(rows, 30, 50)


def test_pointer_sort_and_runs():
    rng = random.Random(4)
    alphabet = ["a", "b", "abcdefgh", "é", "日", "\U0010ffff"]
    texts = ["".join(rng.choices(alphabet + [" ", "."], k=rng.randrange(80))) for _ in range(300)]
    raw, off = text_buffer(pa.array(texts))
    start, end = divergence.term_spans(raw, off)
    data = raw.tobytes()
    words = [data[a:b] for a, b in zip(start, end)]
    assert [w.decode() for w in words] == [t for x in texts for t in TERM.findall(x)]
    order, run = divergence.sort_pointers(raw, start, end)
    assert [words[i] for i in order] == sorted(words)
    assert run.tolist() == [sorted(set(words)).index(words[i]) for i in order]
    group = np.array([i % 3 for i in range(len(texts))])
    terms, found, n, docs = divergence.count_runs(raw, off, group)
    got = {(t, g): (a, b) for t, g, a, b in zip(terms.to_pylist(), found.tolist(), n.tolist(), docs.tolist())}
    want = defaultdict(lambda: (0, 0))
    for i, x in enumerate(texts):
        for t, k in Counter(terms_of(x)).items():
            want[t, i % 3] = want[t, i % 3][0] + k, want[t, i % 3][1] + 1
    assert got == dict(want)
