"""Helpers shared by the training-data operators.

Word hashing works on whole Arrow string buffers with numpy: white space and
word borders come from one byte table, and all words are hashed eight bytes at a
time side by side, so there is no Python loop over words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import derived_path

#: ASCII white space of all contracts: 0x20 and 0x09-0x0D.
WHITE = "[\\x20\\x09-\\x0D]"
#: Bytes handled at once by the numpy code; bounds a worker's temporary arrays.
WINDOW = 1 << 20
#: Spans above this many bytes are hashed and compared one by one.
LONG_SPAN = 256

_BASE = 0x9E3779B97F4A7C15
_tables: dict = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir`` (shared by driver and executors), deleted with
    the application's other derived tables when it ends."""
    return derived_path(spark)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table to the shared folder and read it back:
    cuts the lineage, survives lost executors, computes shared parents once."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def share(spark: SparkSession, value):
    """Broadcast ``value`` as bytes that carry the code of its classes: executors
    need no copy of the library.  Workers read it with ``unpacked``."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def unpacked(shared):
    """The value of a ``share``d broadcast, unpickled once per worker."""
    if not hasattr(shared, "_unpacked"):
        shared._unpacked = cloudpickle.loads(shared.value)
    return shared._unpacked


def numbered(docs: DataFrame) -> tuple[DataFrame, dict]:
    """``docs`` with the columns c0, c1, ... and each column's new name: names that
    clash with nothing, whatever the table calls its own."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def crc_mod(col, n: int):
    """crc32 of the id written as text, modulo n (null id: null)."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")) % n


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buffer(arr) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string array (nulls: empty)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    off = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset:arr.offset + n + 1].astype(np.int64)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def row_groups(batch, sizes: np.ndarray, limit: int):
    """Slices of ``batch`` whose summed ``sizes`` stay near ``limit`` (one row at least)."""
    n, at = len(sizes), 0
    ends = np.cumsum(sizes)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(name: str):
    if name not in _tables:
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        white = np.zeros(256, bool)
        white[[9, 10, 11, 12, 13, 32]] = True
        _tables.update(lower=lower, white=white)
    return _tables[name]


def eight_bytes(raw: np.ndarray) -> np.ndarray:
    """View of the eight bytes that begin at each position, zeros behind the end (len + 1 rows)."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate((raw, np.zeros(8, np.uint8))), 8)


#: Masks that keep the first k of eight bytes read as a little-endian number.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _chunk(eight: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Up to eight bytes from ``at`` as numbers; ``left`` bytes count."""
    return eight[at].view("<u8").ravel() & _KEEP[np.clip(left, 0, 8)]


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span of ``raw`` (length included).

    Eight bytes at a time are mixed into the state by a non-linear finaliser; spans
    above LONG_SPAN bytes go through a cryptographic hash.
    """
    size = end - start
    eight = eight_bytes(raw)
    state = mix(size.astype(np.uint64) * np.uint64(_BASE) + _chunk(eight, start, size))
    rest = np.flatnonzero((size > 8) & (size <= LONG_SPAN))
    depth = 8
    while len(rest):
        state[rest] = mix((state[rest] ^ _chunk(eight, start[rest] + depth, size[rest] - depth)) * np.uint64(_BASE) + np.uint64(depth))
        depth += 8
        rest = rest[size[rest] > depth]
    for i in np.flatnonzero(size > LONG_SPAN):
        state[i] = np.frombuffer(hashlib.blake2b(raw[start[i]:end[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return state


def spans_equal(raw: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_start: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether each span of ``raw`` has the same bytes as its span of ``other``."""
    size = end - start
    same = size == other_end - other_start
    a, b = eight_bytes(raw), eight_bytes(other)
    rest, depth = np.flatnonzero(same & (size > 0) & (size <= LONG_SPAN)), 0
    while len(rest):
        ok = _chunk(a, start[rest] + depth, size[rest] - depth) == _chunk(b, other_start[rest] + depth, size[rest] - depth)
        same[rest[~ok]] = False
        depth += 8
        rest = rest[ok & (size[rest] > depth)]
    for i in np.flatnonzero(same & (size > LONG_SPAN)):
        same[i] = np.array_equal(raw[start[i]:end[i]], other[other_start[i]:other_end[i]])
    return same


def lowered(raw: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return _table("lower")[raw]


def windows(white: np.ndarray):
    """Cut positions behind marked bytes, about WINDOW bytes apart."""
    n, at = len(white), 0
    while at < n:
        to = min(at + WINDOW, n)
        if to < n:
            back = np.flatnonzero(white[at:to])
            if len(back):
                to = at + int(back[-1]) + 1
            else:
                ahead = np.flatnonzero(white[to:])
                to = to + int(ahead[0]) + 1 if len(ahead) else n
        yield at, to
        at = to


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word (maximal run without ASCII white space);
    words never cross rows."""
    word = ~_table("white")[raw]
    n = len(raw)
    border = np.zeros(n + 1, bool)
    border[off] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], before[1:] = True, ~word[:-1]
        after[-1], after[:-1] = True, ~word[1:]
    start = np.flatnonzero(word & (before | border[:n]))
    end = np.flatnonzero(word & (after | border[1:])) + 1
    return start, end


def word_hashes(raw: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and, per row, the index of its first word (len rows + 1).
    A-Z are lower-cased first if ``lower``."""
    parts, starts = [], []
    white = _table("white")[raw]
    for a, b in windows(white):
        i, j = np.searchsorted(off, [a, b])
        inner = np.unique(np.clip(off[max(0, i - 1):j + 1], a, b)) - a
        piece = _table("lower")[raw[a:b]] if lower else raw[a:b]
        s, e = word_spans(piece, inner)
        parts.append(span_hashes(piece, s, e))
        starts.append(s + a)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    return np.concatenate(parts), np.searchsorted(np.concatenate(starts), off)
