import base64
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskloom.llm import bpe, packing
from riskloom.llm.common import text_buffer
from riskloom.llm.pieces import character_classes, piece_starts
from tests.llm.conftest import documents

KINDS = character_classes()
PATTERN = regex.compile(public_tokenizers.PATTERN)
JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", "a", "the cat's  dog'll\n\n go ", "<|endoftext|> x", "é中🙂 ¹²½ '", "word " * 60_000, "x" * 5000, "\t\x0b\x1c y\xa0z", "don't'S'stop 's"]


@pytest.fixture(scope="module")
def coder():
    return bpe.read_ranks(RANKS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'stredvlm \n\t1²é,.!中🙂 \xa0\x1c"), max_size=25), max_size=6))
def test_pieces_equal_the_pattern(texts):
    raw, off = text_buffer(pa.array(texts, pa.string()))
    want = []
    for t, at in zip(texts, off):
        for piece in PATTERN.findall(t):
            want.append(at)
            at += len(piece.encode())
    # U+001C-U+001F are no White_Space for the tokenizer libraries
    if not any("\x1c" in t for t in texts):
        assert piece_starts(raw, off, KINDS).tolist() == want
    else:
        assert len(piece_starts(raw, off, KINDS)) >= len([t for t in texts if t])


def test_ids_equal_tiktoken_and_round_trip(spark, coder):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = documents(spark, list(enumerate(TEXTS)) + [(3, TEXTS[3])], extra=True)
    out = bpe.decode(bpe.encode(docs, coder), coder).collect()
    assert len(out) == len(TEXTS) + 1
    for r in out:
        t = TEXTS[r.doc_id] or ""
        assert r.ids == enc.encode_ordinary(t)
        assert bytes(r.decoded) == t.encode()
    assert bpe.encode(documents(spark, []), coder).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "th", "ing", " ", "é", "中", "🙂", "'", "1", "tion"]), max_size=30), st.data())
def test_prefix_table_append_and_edit(coder, parts, data):
    v = coder.vocabulary
    text = "".join(parts).encode()
    half = data.draw(st.integers(0, len(text)))
    table = bpe.PrefixTable(v, text[:half])
    table.append(text[half:])
    assert table.tokens() == (list(v._merge(text)) if text else [])
    a = data.draw(st.integers(0, len(text)))
    b = data.draw(st.integers(a, len(text)))
    new = data.draw(st.sampled_from([b"", b"x", "é".encode(), b"ing"]))
    table.replace(a, b, new)
    edited = text[:a] + new + text[b:]
    assert table.last == bpe.PrefixTable(v, edited).last


def test_edit_recomputes_only_its_surroundings(coder):
    table = bpe.PrefixTable(coder.vocabulary, b"lorem" * 3000)
    assert table.replace(50, 51, b"zz") < 200


@given(st.integers(0, 100_000))
def test_cut_uses_reciprocal_lengths(n):
    parts = packing.cut(n)
    assert sum(parts) == n and all(2048 % p == 0 for p in parts)


def test_packing_equals_tokenizers_and_has_no_padding(spark):
    tk = Tokenizer.from_file(JSON)
    tk.encode_special_tokens = True
    docs = documents(spark, [(i % 40, f"{t or ''} {i}" if i >= len(TEXTS) else t) for i, t in enumerate(TEXTS * 4)], extra=True).repartition(3)
    rows = packing.pack(docs, packing.read_tokenizer(JSON)).collect()
    want = {i: [*tk.encode(f"{t or ''} {i}" if i >= len(TEXTS) else (t or ""), add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS * 4)}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert zlib.crc32(bytes(r.ids)) == zlib.crc32(np.array(want[r.doc_id][r.start:r.start + r.length], "<u4").tobytes())
        assert r.doc_tokens == len(want[r.doc_id])
    assert set(by_doc) == set(want)
    for i, own in by_doc.items():
        assert [t for r in sorted(own, key=lambda r: r.start) for t in np.frombuffer(bytes(r.ids), "<u4")] == want[i]
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0          # full, or a power of two: no padding
    assert packing.pack(documents(spark, []), packing.read_tokenizer(JSON)).collect() == []
