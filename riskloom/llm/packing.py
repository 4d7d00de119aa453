"""Harmonic sequence packing.

The length classes are the reciprocals C/1, C/2, C/4, ... C/C of the sequence
capacity C (a power of two).  A document is cut, left to right, into whole
sequences and the pieces of its remainder's binary expansion, so every piece has
exactly the length of its class, and a sequence of class k is filled by exactly k
pieces: full sequences have no padding.  Classes fill independently, each worker
on its own: no shuffle, no state but the open sequences (under C pieces).  When a
worker ends, an open sequence with m < k pieces is divided by the binary
expansion of m into sequences whose lengths are powers of two, which need no
padding either.

Sequence ids are ``partition << 40 | counter``: unique, and the same again when
a lost task is run anew.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import row_groups, share, text_buffer, unpacked
from riskloom.llm.pieces import CHUNK, PieceCoder, character_classes

CAPACITY = 2048
END_ID = 1


def byte_letters() -> dict:
    """The printable character that byte-level vocabularies write for each byte:
    printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {chr(b): chr(b if b in plain else next(rest)) for b in range(256)}


class ModelCoder(PieceCoder):
    """Pieces encoded by the model of a ``tokenizers`` JSON file, whose content
    travels with the broadcast; the model is built once per worker."""

    def __init__(self, kinds, content: str):
        super().__init__(kinds)
        self.content = content
        self.model = None

    def __getstate__(self):
        return super().__getstate__() | {"model": None}

    def encode_piece(self, piece: bytes):
        if self.model is None:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_str(self.content).model
            self.letters = str.maketrans(byte_letters())
        return [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.letters))]


def read_tokenizer(path: str) -> ModelCoder:
    """Coder for a byte-level BPE file of the ``tokenizers`` library."""
    with open(path, encoding="utf-8") as f:
        content = f.read()
    kind = json.loads(content)["pre_tokenizer"]
    if kind["type"] != "ByteLevel" or kind.get("add_prefix_space"):
        raise ValueError("a byte-level tokenizer without prefix space is needed")
    return ModelCoder(character_classes(), content)


def cut(length: int, capacity: int = CAPACITY) -> list[int]:
    """Piece lengths of a document: whole sequences, then descending powers of two."""
    left = length % capacity
    return [capacity] * (length // capacity) + [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


class _Bins:
    """Open sequences of one worker, one per class; gives finished rows."""

    def __init__(self, capacity: int, partition: int):
        self.capacity, self.next, self.open = capacity, partition << 40, {}

    def _close(self, rows: list) -> list:
        """Rows of the sequences made of these equal pieces, by binary expansion."""
        out, at = [], 0
        for b in range(len(rows).bit_length() - 1, -1, -1):
            if len(rows) >> b & 1:
                offset = 0
                for row in rows[at:at + (1 << b)]:
                    out.append((*row, self.next, offset))
                    offset += row[2]
                self.next += 1
                at += 1 << b
        return out

    def add(self, row: tuple) -> list:
        size = row[2]
        rows = self.open.setdefault(size, [])
        rows.append(row)
        return self._close(self.open.pop(size)) if len(rows) * size == self.capacity else []

    def end(self) -> list:
        return [r for size in sorted(self.open) for r in self._close(self.open[size])]


def pack(docs: DataFrame, coder: ModelCoder, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id,
    offset``; ``ids`` are the token ids as little-endian unsigned 32-bit integers.

    A document's tokens are its text's ids and a closing ``END_ID``; a null or empty text has
    the closing id alone.  Rows that repeat an id are documents of their own.
    Extra columns are ignored; an empty table gives no rows.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    shared = share(docs.sparkSession, coder)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = dict(rows.dtypes)["doc_id"]

    def table(found: list, kind: pa.DataType):
        cols = list(zip(*found))
        names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
        types = (kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.record_batch({n: pa.array(c, t) for n, c, t in zip(names, cols, types)})

    def run(batches):
        bins, kind = _Bins(capacity, TaskContext.get().partitionId()), pa.int64()
        for batch in batches:
            kind = batch.column("doc_id").type
            _, off = text_buffer(batch.column("text"))
            for part in row_groups(batch, np.diff(off), CHUNK):
                raw, o = text_buffer(part.column("text"))
                ids, first = unpacked(shared).encode(raw, o)
                found = []
                for i, doc in enumerate(part.column("doc_id").to_pylist()):
                    own = np.append(ids[first[i]:first[i + 1]], END_ID).astype("<u4").tobytes()
                    total, start = len(own) // 4, 0
                    for size in cut(total, capacity):
                        found += bins.add((doc, start, size, own[4 * start:4 * (start + size)], total))
                        start += size
                if found:
                    yield table(found, kind)
        if found := bins.end():
            yield table(found, kind)

    return rows.mapInArrow(run, f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
