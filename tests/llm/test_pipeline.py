import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P

from riskloom.llm.common import stored
from tests.llm.conftest import words


def test_stages_equal_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    kept, left = docs, set(text)
    steps = {}
    for name, stage in P.STAGES[:-1]:
        kept = stored(stage(spark, kept, sf))
        assert kept.columns == docs.columns
        now = {r.doc_id for r in kept.select("doc_id").collect()}
        assert now <= left
        steps[name] = (left, now)
        left = now
    # language: only texts above the calibrated threshold go; these documents are all in a known language
    assert steps["language"][1] == set(text)
    # quality: what stays is what the classifier does not reject
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before, after = steps["quality"]
    good = [i in after for i in before if labels.get(i) == 1]
    assert np.mean(good) > 0.98
    # exact copies: the smallest id of each normalised text
    import re
    before, after = steps["exact_dedup"]
    low = {}
    for i in sorted(before):
        low.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text[i] or ""), i)
    assert after == set(low.values())
    # near copies: one document of each component
    from tests.llm.test_jaccard import expected
    before, after = steps["near_duplicates"]
    assert after == {i for i, (_, c) in expected([(i, text[i]) for i in before]).items() if i == c}
    # packing: every id of every remaining document, once
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tk.encode_special_tokens = True
    want = {i: [*tk.encode(text[i] or "", add_special_tokens=False).ids, 1] for i in after}
    rows = P.STAGES[-1][1](spark, kept, sf).collect()
    assert {r.doc_id for r in rows} == after
    assert sum(r.length for r in rows) == sum(map(len, want.values()))
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start:r.start + r.length], "<u4").tobytes())


def test_stages_take_an_empty_table_and_nulls(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    empty = spark.createDataFrame([], schema)
    for _, stage in P.STAGES:
        assert stage(spark, empty, sf).collect() == []
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "w1 w2 w3", "en", None, None), (2, "w1 w2", "en", "s", 1)], schema)
    for _, stage in P.STAGES[2:]:
        assert stage(spark, odd, sf).count() >= 1


def test_clashing_column_names(spark, sf):
    """Extra columns called like anything the operators make, or with dots, pass through."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plain = docs
    names = ["rejected", "score", "predicted", "lang_pred", "cross_entropy", "row", "group", "c0", "k_text", "_id", "a.b", "_norm", "held_out", "n", "text_"]
    for c in names:
        docs = docs.withColumn(c, F.lit(c))
    for name, stage in P.STAGES[:-1]:
        out = stored(stage(spark, docs, sf))
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == c for r in rows[:5] for c in names)
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in stage(spark, plain, sf).collect()), name
    assert P.STAGES[-1][1](spark, docs, sf).count() > 0


def test_repeated_and_null_ids(spark, sf):
    """Rows are judged, not ids: a repeated id loses only its copies, and copies with a null id go too."""
    rng = random.Random(3)
    a, b, c = (words(rng, 60) for _ in range(3))
    near = lambda t: t + " w1"
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    row = lambda i, t: (i, t, "en", "s", 1)
    docs = spark.createDataFrame([row(5, a), row(5, b), row(2, near(a)), row(7, near(b)), row(None, near(c)), row(None, c), row(9, None), row(9, ""), row(9, "w1")], schema)
    out = sorted(((r.doc_id, r.text) for r in P.no_near_copies(spark, docs, sf).collect()), key=str)
    got = [x for x in out if x[0] is not None and x[1]]
    assert sorted(got) == [(2, near(a)), (5, b), (9, "w1")] and (9, None) in out and (9, "") in out
    assert len([x for x in out if x[0] is None]) == 1
    first = sorted(((r.doc_id, r.text) for r in P.no_copies(spark, docs.unionByName(docs), sf).collect()), key=str)
    assert len(first) == 8 and sum(1 for _, t in first if not t) == 1


def test_run_is_the_stages(spark, sf):
    out = P.run(spark, sf)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0
