"""Words that a polynomial hash modulo 2^64 cannot tell apart, and look-ups under colliding hashes."""
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer
import tiktoken
import base64

from riskloom.llm import bpe, jaccard, lm, packing, pieces
from riskloom.llm.common import span_hashes, spans_equal, text_buffer, word_hashes
from pyspark.sql import functions as F
from tests.llm.conftest import documents

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def twins(n):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def own(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)


@pytest.mark.parametrize("n", [1024, 2048])
def test_coders_keep_twins_apart(n):
    texts = [*twins(n), " ".join(twins(n))]
    raw, off = text_buffer(pa.array(texts))
    ids, first = bpe.read_ranks(RANKS).encode(raw, off)
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [own(t) for t in texts]
    plain = Tokenizer.from_file(JSON)
    ids, first = packing.read_tokenizer(JSON).encode(raw, off)
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("hash_", [lambda raw, s, e: np.zeros(len(s), np.uint64), lambda raw, s, e: (e - s).astype(np.uint64) % np.uint64(3)])
def test_colliding_pieces_are_encoded_right(monkeypatch, hash_):
    monkeypatch.setattr(pieces, "span_hashes", hash_)
    texts = ["the cat sat", "on the mat, the cat's mat", "", "caté 日本 cat", *twins(64)]
    coder = bpe.read_ranks(RANKS)
    for _ in range(2):                      # the second time from the cache
        raw, off = text_buffer(pa.array(texts))
        ids, first = coder.encode(raw, off)
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [own(t) for t in texts]
        texts = texts[::-1] + ["sat mat"]


def test_spans_are_hashed_and_compared_by_their_bytes():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in [0, 1, 7, 8, 9, 15, 16, 17, 255, 256, 257, 3000] for _ in range(8)]
    words += [w.encode() for n in (1024, 2048) for w in twins(n)]
    raw = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    h = span_hashes(raw, start, end)
    seen = {}
    for w, x in zip(words, h):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    for i in (0, 5, 40, 90):
        k = np.full(len(words), i)
        assert spans_equal(raw, start, end, raw, start[k], end[k]).tolist() == [w == words[i] for w in words]


def test_language_model_and_join_tell_twins_apart(spark):
    a, b = twins(1024)
    raw, off = text_buffer(pa.array([a, b]))
    assert len(set(word_hashes(raw, off)[0].tolist())) == 2
    rows = [(i, f"{a} w1 w2 w3 w4 w5") for i in range(1, 4)] + [(10, f"{b} w1 w2 w3 w4 w5")]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(documents(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10}
    train = [(i, a) for i in range(20)]
    out = {r.doc_id: r for r in lm.score(documents(spark, [*train, (100, a), (101, b)]), F.col("doc_id") >= 100, F.col("doc_id") % lm.FOLD).collect()}
    assert out[100].n_known == 2 and out[101].n_known == 1 and out[100].score > out[101].score
