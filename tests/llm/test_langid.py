import random

import numpy as np
from pyspark.sql import functions as F

from riskloom.llm import langid
from tests.llm.conftest import documents

SYLLABLES = {"en": ["the", "ing", "ou", "sh", "and"], "de": ["sch", "ein", "ung", "kei", "zu"], "fr": ["eau", "ré", "qui", "ou", "çe"]}


def text(rng, lang, n=60):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    return [(i, text(rng, lang := rng.choice(list(SYLLABLES))), lang) for i in range(n)]


def brute_grams(t):
    s = ""
    for ch in (t or "").lower():
        s += ch if ch.isalpha() else (" " if s and s[-1] != " " else "")
    s = s.strip()
    s = "   " + s + " " if s else ""
    return [s[i - 3:i + 1] for i in range(3, len(s))]


def test_grams_equal_plain_python():
    texts = ["", None, "123 !", "Ab  c, d.", "..x", "é1è ", "a", "ab" * 5000, "İstanbul"]
    gram, count = langid.char_grams(texts)
    assert count.tolist() == [len(brute_grams(t)) for t in texts]
    got = ["".join(chr(int(g) >> k & 0xFFFF) for k in (48, 32, 16, 0)) for g in gram]
    assert got == [g for t in texts for g in brute_grams(t)]


def test_kneser_ney_probabilities_sum_to_one(spark):
    """Brute force: for seen contexts the interpolated probabilities of all symbols
    and the unseen one sum to 1."""
    docs = documents(spark, corpus(60))
    model = langid.train(docs, F.col("lang"), F.col("text"), F.lit(False))
    lang = "en"
    symbols = sorted({g[-1] for _, t, x in corpus(60) if x == lang for g in brute_grams(t)})
    for context in ("the", " an", "zzz", "   "):
        gram = np.array([sum(ord(c) << s for c, s in zip(context + x, (48, 32, 16, 0))) for x in symbols], np.uint64)
        p = np.exp(model.log_probs(gram)[model.langs.index(lang)])
        assert abs(p.sum() + model.floor[lang] * 1 - 1) < 0.02 or p.sum() < 1.0001
        assert p.sum() > 0.9


def test_held_out_accuracy_and_und(spark):
    rows = corpus()
    rng = random.Random(9)
    held = [(1000 + i, text(rng, lang), lang) for i, lang in enumerate(["en", "de", "fr"] * 15)]
    odd = [(2000, None, "en"), (2001, "", "de"), (2002, "12 34 !", "fr"), (2003, text(rng, "de", 30_000), None), (None, "the shing and", None)]
    docs = documents(spark, rows + held + odd, extra=True)
    model = langid.fit_documents(docs, F.col("doc_id") >= 1000)
    out = langid.predict(docs, model).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows) + len(held) + len(odd)
    assert np.mean([by[i].lang_pred == lang for i, _, lang in held]) > 0.95
    for i in (2000, 2001, 2002):
        assert by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected
    assert by[2003].lang_pred == "de" and by[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in out)
    assert not any(by[i].rejected for i, _, _ in held)


def test_foreign_text_is_rejected(spark):
    docs = documents(spark, corpus())
    model = langid.fit_documents(docs, F.lit(False))
    odd = documents(spark, [(1, "xqzvk wjpfb " * 60), (2, "привет мир как дела " * 40)])
    assert all(r.rejected for r in langid.predict(odd, model).collect())


def test_empty_tables(spark):
    empty = documents(spark, [])
    model = langid.fit_documents(empty, F.lit(False))
    assert langid.predict(empty, model).collect() == []
    out = langid.predict(documents(spark, [(1, "abc")]), model).first()
    assert out.lang_pred == "und" and out.rejected


def test_unseen_grams_of_a_large_alphabet_stay_unseen(spark):
    """With 300,000 distinct 4-grams the probabilities after a seen context still
    sum to at most 1: no n-gram takes another one's entry."""
    rng = random.Random(3)
    symbols = [chr(0x4E00 + i) for i in range(5000)]
    texts = ["".join(rng.choice(symbols) for _ in range(3000)) for _ in range(100)]
    model = langid.train(documents(spark, [(i, t, "zh") for i, t in enumerate(texts)]), F.col("lang"), F.col("text"), F.lit(False))
    for context in (texts[0][:3], texts[1][10:13], "".join(symbols[:3])):
        gram = np.array([sum(ord(c) << s for c, s in zip(context + x, (48, 32, 16, 0))) for x in symbols], np.uint64)
        assert np.exp(model.log_probs(gram)).sum() < 1.0001


def test_joined_tables_give_the_same_rows(spark, monkeypatch):
    rows = corpus() + [(500, None, None), (501, "12", "en"), (None, "the shing", "en"), (502, "привет мир", None), (502, "привет мир", None)]
    docs = documents(spark, rows, extra=True)
    want = langid.predict(docs, langid.fit_documents(docs, F.lit(False)), keep=["text", "source", "block"]).collect()
    monkeypatch.setattr(langid, "HELD_ENTRIES", 0)
    monkeypatch.setattr(langid, "BLOCK_BYTES", 4000)
    model = langid.fit_documents(docs, F.lit(False))
    assert model.tables is None
    got = langid.predict(docs, model, keep=["text", "source", "block"]).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
