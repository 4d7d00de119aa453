"""Pre-tokenisation of byte-level BPE with numpy, and a per-worker cache of
encoded pieces.

``piece_starts`` finds the matches of the public split pattern (contractions,
then runs of letters, numbers or other characters with one leading space, then
white space) from character classes, without a regular-expression engine.
``PieceCoder`` encodes every distinct piece once and maps the rest by array look-ups, which
are confirmed by comparing bytes; a piece whose hash belongs to another piece is encoded on its own.
It is broadcast: workers keep their copy, and so its cache, between tasks.
"""

from __future__ import annotations

import numpy as np

from riskloom.llm.common import span_hashes, spans_equal

CHUNK = 1 << 20                 # bytes of text handled at once
CACHE = 1_500_000               # pieces kept by a worker

#: Code points with the Unicode property White_Space.
SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE, LETTER, NUMBER, OTHER = range(4)


def character_classes() -> np.ndarray:
    """Class of every code point."""
    chars = np.arange(0x110000, dtype=np.uint32).view("U1")
    letter = np.char.isalpha(chars)
    kind = np.where(letter, LETTER, np.where(np.char.isnumeric(chars), NUMBER, OTHER)).astype(np.uint8)
    kind[SPACES] = SPACE
    return kind


def piece_starts(raw: np.ndarray, off: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Byte positions at which the pieces of all texts begin (texts are split apart)."""
    if not len(raw):
        return np.zeros(0, np.int64)
    cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    place = np.flatnonzero((raw & 0xC0) != 0x80)            # byte position of each character
    n = len(cp)
    cls = kinds[cp]
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(place, off)] = True
    white = cls == SPACE
    joined = ~first[1:n]                                    # character i+1 continues the text of i
    start = first[:n].copy()
    changed = (cls[1:] != cls[:-1]) & joined
    # a run of letters, numbers or others begins, unless a space before it belongs to it
    start[1:] |= changed & ~white[1:] & (cp[:-1] != 32)
    # white space: its run begins, and its last character stands alone or joins what follows
    start[1:] |= changed & white[1:]
    start[:-1] |= white[:-1] & ~white[1:] & joined
    # contractions: an apostrophe that begins a piece and one of the endings after it
    apos = np.flatnonzero(start & (cp == 39))
    if len(apos):
        pad = np.concatenate((cp, np.zeros(2, np.uint32)))
        end = np.concatenate((first, [True]))
        one, two = pad[apos + 1], pad[apos + 2]
        has1 = ~end[apos + 1]
        has2 = has1 & ~end[np.minimum(apos + 2, n + 1)]
        short = has1 & np.isin(one, [ord(c) for c in "stmd"])
        long = has2 & (((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l"))))
        size = np.where(short, 2, np.where(long, 3, 0))
        hit = size > 0
        start[apos[hit] + 1] = False
        after = (apos + size)[hit]
        start[after[after < n]] = True
    return place[start]


class PieceCoder:
    """Token ids of texts: ``encode_piece(bytes) -> sequence of ids`` is called
    once for each distinct piece that the cache does not hold."""

    def __init__(self, kinds: np.ndarray):
        self.kinds = kinds
        self._reset()

    def _reset(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)
        self.text = np.zeros(0, np.uint8)            # the pieces' bytes, one after the other
        self.text_end = np.zeros(1, np.int64)

    def __getstate__(self):
        state = dict(self.__dict__)
        for k in ("known", "slot", "begin", "size", "pool", "text", "text_end"):
            state.pop(k, None)
        return state

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._reset()

    def encode_piece(self, piece: bytes):
        raise NotImplementedError

    def _learn(self, hashes: np.ndarray, pieces: list) -> None:
        if len(self.known) > CACHE:
            self._reset()
        found = [self.encode_piece(p) for p in pieces]
        size = np.fromiter(map(len, found), np.int64, len(found))
        begin = len(self.pool) + np.concatenate(([0], np.cumsum(size)))[:-1]
        slot = len(self.begin) + np.arange(len(found))
        self.begin, self.size = np.concatenate((self.begin, begin)), np.concatenate((self.size, size))
        self.pool = np.concatenate((self.pool, np.fromiter((t for ids in found for t in ids), np.uint32, int(size.sum()))))
        self.text = np.concatenate((self.text, np.frombuffer(b"".join(pieces), np.uint8)))
        self.text_end = np.concatenate((self.text_end, self.text_end[-1] + np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))))
        at = np.searchsorted(self.known, hashes)
        self.known, self.slot = np.insert(self.known, at, hashes), np.insert(self.slot, at, slot)

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids begin (texts + 1)."""
        start = piece_starts(raw, off, self.kinds)
        end = np.concatenate((start[1:], [len(raw)])).astype(np.int64) if len(start) else start
        distinct, index, inverse = np.unique(span_hashes(raw, start, end), return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > CACHE:
            self._reset()
        at = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        new = self.known[at] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if new.any():
            data = raw.tobytes()
            self._learn(distinct[new], [data[start[i]:end[i]] for i in index[new]])
        slot = self.slot[np.searchsorted(self.known, distinct)][inverse]
        size = self.size[slot]
        # equal hashes are not enough
        other = np.flatnonzero(~spans_equal(raw, start, end, self.text, self.text_end[slot], self.text_end[slot + 1]))
        own = [self.encode_piece(raw[start[i]:end[i]].tobytes()) for i in other]
        size[other] = [len(x) for x in own]
        before = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
        if len(other):
            ids = self._mixed(slot, size, before, other, own)
        else:
            ids = self.pool[np.repeat(self.begin[slot] - before[:-1], size) + np.arange(before[-1])]
        return ids, before[np.searchsorted(start, off)]

    def _mixed(self, slot, size, before, other, own) -> np.ndarray:
        """Ids in which the pieces ``other`` have ids of their ``own``."""
        ids = np.empty(before[-1], np.uint32)
        known = np.setdiff1d(np.arange(len(slot)), other)
        within = np.arange(size[known].sum()) - np.repeat(np.concatenate(([0], np.cumsum(size[known])))[:-1], size[known])
        ids[np.repeat(before[known], size[known]) + within] = self.pool[np.repeat(self.begin[slot[known]], size[known]) + within]
        for i, x in zip(other, own):
            ids[before[i]:before[i + 1]] = x
        return ids
