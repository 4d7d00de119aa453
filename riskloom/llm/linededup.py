"""Line de-duplication with a once-seen and a twice-seen Bloom filter.

1. Every worker hashes the line keys of its texts (numpy, whole Arrow buffers) and
   sends each distinct hash once per batch, dealt by hash range.  The task of a
   range holds a once-seen filter of ``ONCE_BITS`` bits a key; a hash that it has
   already seen goes into the range's twice-seen filter.
2. The twice-seen filters hold only repeated keys.  Their joint size is at most
   ``TWICE_BITS`` whatever the input (beyond it they are fuller and suspect more
   lines), so they are broadcast.
3. Only lines that the filter suspects are shuffled, with their whole key: the
   documents of each key are counted exactly and the largest id is chosen.
   Documents without a suspect never move.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import WINDOW, _table, mix, parallelism, row_groups, share, span_hashes, stored, text_buffer, unpacked

MIN_CHARS = 20
MIN_DOCS = 3
ONCE_BITS = 16
TWICE_BITS = 1 << 30
STRIP = " \t\n\x0b\x0c\r"
_LOWER = {c: c + 32 for c in range(65, 91)}


def line_key(line: str) -> str:
    return line.strip(STRIP).translate(_LOWER)


def line_hashes(raw: np.ndarray, off: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines: row, hash of the key, and whether the key has ``min_chars`` code points."""
    n = len(raw)
    rows = len(off) - 1
    newline = np.flatnonzero(raw == 10)
    nrow = np.searchsorted(off, newline, side="right") - 1
    # a row has one line more than newlines
    start = np.concatenate((off[:-1], newline + 1))
    row = np.concatenate((np.arange(rows), nrow))
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    end = np.concatenate((start[1:] - 1, [n]))
    last = np.concatenate((row[1:] != row[:-1], [True]))[:len(row)]
    end = np.where(last, off[row + 1], end) if len(row) else end[:0]
    solid = np.flatnonzero(~_table("white")[raw])
    a = np.searchsorted(solid, start)
    b = np.searchsorted(solid, end)
    some = a < b
    pad = np.concatenate((solid, [0]))
    s = np.where(some, pad[np.minimum(a, len(solid))], 0)
    e = np.where(some, pad[np.maximum(b - 1, 0)] + 1, 0)
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return row, span_hashes(_table("lower")[raw], s, e), chars[e] - chars[s] >= min_chars


def _probes(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return hashes & np.uint64(bits - 1), mix(hashes) & np.uint64(bits - 1)


def _filter_bits(keys: int, per_key: int, most: int) -> int:
    return min(1 << max(6, (keys * per_key - 1).bit_length()), most)


def _send_hashes(slices: int, min_chars: int):
    def run(batches):
        for batch in batches:
            _, off = text_buffer(batch.column("text"))
            for part in row_groups(batch, np.diff(off), WINDOW):
                row, h, long_enough = line_hashes(*text_buffer(part.column("text")), min_chars)
                row, h = row[long_enough], h[long_enough]
                order = np.lexsort((row, h))
                row, h = row[order], h[order]
                fresh = np.concatenate(([True], h[1:] != h[:-1]))[:len(h)]
                other = np.concatenate(([False], (h[1:] == h[:-1]) & (row[1:] != row[:-1])))[:len(h)]
                group = np.cumsum(fresh) - 1
                repeated = np.zeros(int(fresh.sum()), bool)
                repeated[group[other]] = True           # in several rows of this batch
                keys = h[fresh]
                part_of = ((keys >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)
                cuts = np.searchsorted(part_of, np.arange(slices + 1, dtype=np.uint64))
                own = np.flatnonzero(np.diff(cuts))
                yield pa.record_batch({
                    "slice": own.astype(np.int32),
                    "keys": pa.array([keys[cuts[i]:cuts[i + 1]].tobytes() for i in own], pa.binary()),
                    "repeated": pa.array([np.packbits(repeated[cuts[i]:cuts[i + 1]]).tobytes() for i in own], pa.binary())})
    return run


def _fill_filters(slices: int):
    def run(table):
        blobs = [np.frombuffer(k.as_py(), np.uint64) for k in table.column("keys")]
        flags = [np.unpackbits(np.frombuffer(r.as_py(), np.uint8))[:len(b)].astype(bool) for r, b in zip(table.column("repeated"), blobs)]
        bits = _filter_bits(sum(map(len, blobs)), ONCE_BITS, 1 << 32)
        once = np.zeros(bits, bool)
        suspects = []
        for keys, again in zip(blobs, flags):
            p, q = _probes(keys, bits)
            suspects.append(keys[again | (once[p] & once[q])])
            once[p] = True
            once[q] = True
        found = np.unique(np.concatenate(suspects))
        bits = _filter_bits(len(found), ONCE_BITS, max(64, 1 << (TWICE_BITS // slices).bit_length() - 1))
        twice = np.zeros(bits, bool)
        for p in _probes(found, bits):
            twice[p] = True
        return pa.table({"slice": table.column("slice").slice(0, 1), "twice": pa.array([np.packbits(twice).tobytes()], pa.binary())})
    return run


class TwiceSeen:
    """The twice-seen filters of all slices."""

    def __init__(self, slices: int, filters: dict[int, bytes]):
        self.slices, self.filters = slices, filters

    def test(self, hashes: np.ndarray) -> np.ndarray:
        part_of = (((hashes >> np.uint64(32)) * np.uint64(self.slices)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part_of, kind="stable")
        cuts = np.searchsorted(part_of[order], np.arange(self.slices + 1))
        hit = np.zeros(len(hashes), bool)
        for i in np.flatnonzero(np.diff(cuts)):
            if i in self.filters:
                bytes_ = np.frombuffer(self.filters[i], np.uint8)
                own = order[cuts[i]:cuts[i + 1]]
                p, q = _probes(hashes[own], len(bytes_) * 8)
                on = lambda x: (bytes_[x >> np.uint64(3)] >> (np.uint8(7) - (x & np.uint64(7)).astype(np.uint8))) & 1
                hit[own] = (on(p) & on(q)).astype(bool)
        return hit


def _mark(shared, min_chars: int):
    """Adds the number of lines and the distinct keys that the filter suspects."""
    def run(batches):
        for batch in batches:
            _, off = text_buffer(batch.column("text"))
            for part in row_groups(batch, np.diff(off), WINDOW):
                row, h, long_enough = line_hashes(*text_buffer(part.column("text")), min_chars)
                n_lines = np.bincount(row, minlength=part.num_rows)
                hit = np.zeros(len(h), bool)
                hit[long_enough] = unpacked(shared).test(h[long_enough])
                first = np.concatenate(([0], np.cumsum(n_lines)))
                keys: list = [[] for _ in range(part.num_rows)]
                for r in np.unique(row[hit]):
                    lines = part.column("text")[int(r)].as_py().split("\n")
                    keys[r] = list(dict.fromkeys(line_key(lines[i]) for i in np.flatnonzero(hit[first[r]:first[r + 1]])))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "text": part.column("text"), "n_lines": n_lines,
                                       "keys": pa.array(keys, pa.list_(pa.string()))})
    return run


def _remove(batches):
    for batch in batches:
        _, off = text_buffer(batch.column("text"))
        for part in row_groups(batch, np.diff(off), WINDOW):
            kept, dropped = [], []
            for text, gone in zip(part.column("text").to_pylist(), part.column("gone").to_pylist()):
                lines = (text or "").split("\n")
                stay = [x for x in lines if line_key(x) not in gone_set] if (gone_set := set(gone or ())) else lines
                kept.append("\n".join(stay))
                dropped.append(len(lines) - len(stay))
            yield pa.record_batch({"doc_id": part.column("doc_id"), "n_lines": part.column("n_lines"), "n_dropped": pa.array(dropped, pa.int64()), "text": pa.array(kept, pa.string())})


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` (the text left) for every row.

    Keys (stripped, A-Z lower-cased lines) of at least ``min_chars`` code points
    in at least ``min_docs`` documents stay only in the largest id that holds them, in
    all its lines.  Null or empty text is one empty line.  Rows that repeat an
    id are one document when documents are counted, and each is returned; a null id is smaller
    than any other.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = dict(rows.dtypes)["doc_id"]
    slices = max(16, parallelism(spark))
    sent = rows.select("text").mapInArrow(_send_hashes(slices, min_chars), "slice int, keys binary, repeated binary")
    filters = sent.groupBy("slice").applyInArrow(_fill_filters(slices), "slice int, twice binary")
    # at most TWICE_BITS / 8 bytes in all
    found = {r["slice"]: bytes(r["twice"]) for r in filters.collect()}
    shared = share(spark, TwiceSeen(slices, found))
    marked = rows.mapInArrow(_mark(shared, min_chars), f"doc_id {id_type}, text string, n_lines long, keys array<string>")
    clean = marked.where(F.size("keys") == 0).select("doc_id", "n_lines", F.lit(0).cast("long").alias("n_dropped"), "text")
    suspects = stored(marked.where(F.size("keys") > 0))
    held = suspects.select("doc_id", F.explode("keys").alias("key")).distinct()
    repeated = held.groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("stays")).where(F.col("docs") >= min_docs).select("key", "stays")
    gone = (held.join(repeated, "key").where(~F.col("doc_id").eqNullSafe(F.col("stays")))
            .groupBy(F.col("doc_id").alias("gid")).agg(F.collect_list("key").alias("gone")))
    cleaned = (suspects.join(gone, F.col("doc_id").eqNullSafe(F.col("gid")), "left").select("doc_id", "text", "n_lines", "gone")
               .mapInArrow(_remove, f"doc_id {id_type}, n_lines long, n_dropped long, text string"))
    return clean.unionByName(cleaned)
