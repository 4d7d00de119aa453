"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

Two neighbouring tokens can stand in an encoding only if merging their joined
bytes by rank gives these two tokens back.  For every prefix of a piece exactly
one last token is compatible with the prefix before it, so the table of last
tokens *is* the encoding of every prefix: it is filled left to right in linear
time, appending continues it, and after an edit it is refilled only until it
agrees again with the old table over the length of the longest token.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import row_groups, share, text_buffer, unpacked
from riskloom.llm.pieces import CHUNK, PieceCoder, character_classes

PAIRS = 2_000_000        # pair answers that a worker keeps


class Ranks:
    """Vocabulary by rank, and which neighbouring tokens merging leaves apart."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: tokens that merging makes of their own bytes
        self.reachable = {i for i, t in self.tokens.items() if self._merge(t) == (i,)}
        self.pairs: dict[tuple[int, int], bool] = {}

    def __getstate__(self):
        return self.__dict__ | {"pairs": {}}

    def _merge(self, data: bytes) -> tuple[int, ...]:
        """Greedy merging: the pair of lowest rank first, the leftmost of equals."""
        cuts = [data[i:i + 1] for i in range(len(data))]
        while len(cuts) > 1:
            best, at = min((self.ranks.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
            if best == np.inf:
                break
            cuts[at:at + 2] = [cuts[at] + cuts[at + 1]]
        return tuple(self.ranks[c] for c in cuts)

    def fits(self, left: int, right: int) -> bool:
        """``left, right`` is what merging makes of their joined bytes."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._merge(self.tokens[left] + self.tokens[right]) == key
        return known


class PrefixTable:
    """Last token of every prefix of one piece."""

    def __init__(self, vocabulary: Ranks, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _at(self, i: int) -> int:
        v, data, last = self.v, self.data, self.last
        for j in range(max(0, i - v.longest), i):
            token = v.ranks.get(data[j:i])
            if token is not None and (token in v.reachable if j == 0 else v.fits(last[j], token)):
                return token
        raise ValueError(f"no token ends at byte {i}: the vocabulary misses a byte")

    def append(self, more: bytes) -> None:
        at = len(self.data)
        self.data += more
        for i in range(at + 1, len(self.data) + 1):
            self.last.append(self._at(i))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Replace ``data[start:end]``; returns how many prefixes were computed anew."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[:start + 1]
        same = 0
        for i in range(start + 1, len(self.data) + 1):
            token = self._at(i)
            self.last.append(token)
            # equal tokens over the longest length, all behind the edit: the rest is as before
            same = same + 1 if i - shift >= end and i > start + len(new) and old[i - shift] == token else 0
            if same >= self.v.longest:
                self.last += old[i - shift + 1:]
                return i - start
        return len(self.data) - start

    def tokens(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at -= len(self.v.tokens[out[-1]])
        return out[::-1]


class RankCoder(PieceCoder):
    """Pieces encoded by prefix tables; a piece that is a token is that token."""

    def __init__(self, kinds, vocabulary: Ranks):
        super().__init__(kinds)
        self.vocabulary = vocabulary

    def encode_piece(self, piece: bytes):
        whole = self.vocabulary.ranks.get(piece)
        return [whole] if whole is not None else PrefixTable(self.vocabulary, piece).tokens()


def read_ranks(path: str) -> RankCoder:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return RankCoder(character_classes(), Ranks(ranks))


def encode(docs: DataFrame, coder: RankCoder, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (array of int) for every row; null or empty text: no ids.
    Repeated rows are encoded each; an empty table gives no rows; extra columns are ignored."""
    shared = share(docs.sparkSession, coder)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            _, off = text_buffer(batch.column("text"))
            for part in row_groups(batch, np.diff(off), CHUNK):
                ids, first = unpacked(shared).encode(*text_buffer(part.column("text")))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "ids": pa.ListArray.from_arrays(first.astype(np.int32), ids.astype(np.int32))})

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>")


def decode(tokens: DataFrame, coder: RankCoder) -> DataFrame:
    """Adds ``decoded`` (binary) to rows with ``ids``; null ids: no bytes.  An id outside the
    vocabulary is an error."""
    v = coder.vocabulary.tokens
    size = max(v, default=-1) + 1
    shared = tokens.sparkSession.sparkContext.broadcast([v.get(i) for i in range(size)])
    rows = tokens.select("doc_id", "ids")

    def run(batches):
        words = shared.value
        for batch in batches:
            ids = batch.column("ids")
            size = np.diff(ids.offsets.to_numpy()) if not ids.null_count else np.array([len(x) if x.is_valid else 0 for x in ids])
            for part in row_groups(batch, size, CHUNK):
                own = part.column("ids").fill_null([]) if part.column("ids").null_count else part.column("ids")
                first = own.offsets.to_numpy()
                flat = own.flatten().to_numpy(zero_copy_only=False).tolist()
                first = (first - first[0]).tolist()
                out = [b"".join([words[i] for i in flat[a:b]]) for a, b in zip(first, first[1:])]
                yield pa.record_batch({"doc_id": part.column("doc_id"), "ids": own, "decoded": pa.array(out, pa.binary())})

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>, decoded binary")
