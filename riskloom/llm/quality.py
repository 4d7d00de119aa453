"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a document (shares of byte classes, word, vocabulary and line
measures) come from numpy over whole Arrow buffers.  Trees are grown on the
driver from a bounded sample of labelled rows (``SAMPLE`` rows with the smallest
id hash); features are cut into at most ``BINS`` quantile bins and every split
is chosen from gradient histograms.  The fitted trees are complete binary trees
flattened into arrays, which workers walk level by level for all documents of a
batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import WINDOW, row_groups, share, text_buffer, unpacked, word_hashes

SAMPLE = 40_000
BINS = 48
TREES = 80
DEPTH = 4
RATE = 0.15
L2 = 1.0
MIN_CHILD = 20

#: Byte classes whose shares are features, in feature order.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!", b"?",
           b"|", b"#$%&*@^~", b"()[]{}<>", b"\"'`", b"/\\", b":;", b"-_=+")
FEATURES = 2 * len(CLASSES) + 2 + 13


def _class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.int64)        # control bytes
    table[128:] = len(CLASSES) + 1                      # beyond ASCII
    for i, members in enumerate(CLASSES):
        table[list(members)] = i
    return table


def _runs(key: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the longest run per row; the row is in the high bits."""
    key = np.sort(key)
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    row = (key[new] >> np.uint64(40)).astype(np.int64)
    longest = np.zeros(rows)
    np.maximum.at(longest, row, np.diff(np.concatenate((new, [len(key)]))))
    return np.bincount(row, minlength=rows).astype(float), longest


def statistics(arr) -> np.ndarray:
    """(documents, FEATURES) statistics of an Arrow string array; null: empty text."""
    raw, off = text_buffer(arr)
    rows = len(off) - 1
    size = np.diff(off).astype(float)
    n_class = len(CLASSES) + 2
    row = np.repeat(np.arange(rows), np.diff(off))
    cls = _class_table()[raw]
    counts = np.bincount(row * n_class + cls, minlength=rows * n_class).reshape(rows, n_class).astype(float)
    share = counts / np.maximum(size, 1)[:, None]
    hashes, first = word_hashes(raw, off)
    words = np.diff(first).astype(float)
    wrow = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(first))
    distinct, most = _runs(wrow << np.uint64(40) | hashes >> np.uint64(24), rows)
    pair = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])[wrow[:-1] == wrow[1:]] if len(hashes) else hashes
    prow = wrow[:-1][wrow[:-1] == wrow[1:]] if len(hashes) else wrow
    pairs, pair_most = _runs(prow << np.uint64(40) | pair >> np.uint64(24), rows)
    # bytes at word ends say how sentences and junk suffixes look
    word_end = np.flatnonzero((cls[:-1] != 3) & (cls[:-1] != 4) & ((cls[1:] == 3) | (cls[1:] == 4))) if len(raw) else np.zeros(0, np.int64)
    ends = np.bincount(row[word_end] * n_class + cls[word_end], minlength=rows * n_class).reshape(rows, n_class) / np.maximum(words, 1)[:, None]
    lines = counts[:, 4] + 1
    newline = np.flatnonzero(raw == 10)
    start = np.sort(np.concatenate((off[:-1][size > 0], newline + 1)))
    start = np.unique(start[start < len(raw)])
    stop = np.concatenate((start[1:], [len(raw)]))
    lrow = row[start] if len(raw) else np.zeros(0, np.int64)
    length = (stop - start).astype(float)
    mean_line = size / lines
    spread = np.sqrt(np.maximum(np.bincount(lrow, weights=length ** 2, minlength=rows) / lines - mean_line ** 2, 0))
    longest_line = np.zeros(rows)
    np.maximum.at(longest_line, lrow, length)
    letters = counts[:, 0] + counts[:, 1]
    w1 = np.maximum(words, 1)
    pairs_all = np.maximum(words - 1, 1)
    more = np.stack([np.log1p(size), np.log1p(words), size / w1, distinct / w1, most / w1, pairs / pairs_all, pair_most / pairs_all,
                     np.log1p(lines), mean_line, spread, longest_line, counts[:, 0] / np.maximum(letters, 1),
                     (words == 0).astype(float)], axis=1)
    return np.concatenate([share, ends[:, :len(CLASSES)], more], axis=1)


@dataclass
class Trees:
    """Complete binary trees in arrays: node i has the children 2i+1 and 2i+2;
    a row goes right where its feature exceeds the threshold."""

    feature: np.ndarray      # (trees, inner nodes)
    threshold: np.ndarray    # (trees, inner nodes)
    leaf: np.ndarray         # (trees, leaves)
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        at = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[at, f[node]] > t[node])
            z += leaf[node - inner]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for a 0/1 target.  One class or no rows: a constant score."""
    inner = 2 ** DEPTH - 1
    empty = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 0.0)
    if not len(y):
        return empty
    prior = (y.sum() + 1.0) / (len(y) + 2.0)
    empty.bias = float(np.log(prior / (1 - prior)))
    if y.min() == y.max():
        return empty
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)  # bin b: x <= cuts[b]
    usable = np.array([[b < len(c) for b in range(BINS)] for c in cuts])
    flat = bins + np.arange(width) * BINS
    z = np.full(n, empty.bias)
    feats, thrs, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feat, thr = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            nodes = 2 ** depth
            local = node - (nodes - 1)
            key = (local[:, None] * (width * BINS) + flat).ravel()
            shape = (nodes, width, BINS)
            hg = np.bincount(key, np.repeat(g, width), nodes * width * BINS).reshape(shape).cumsum(axis=2)
            hh = np.bincount(key, np.repeat(h, width), nodes * width * BINS).reshape(shape).cumsum(axis=2)
            hn = np.bincount(key, minlength=nodes * width * BINS).reshape(shape).cumsum(axis=2)
            tg, th, tn = hg[:, :1, -1:], hh[:, :1, -1:], hn[:, :1, -1:]
            gain = hg ** 2 / (hh + L2) + (tg - hg) ** 2 / (th - hh + L2) - tg ** 2 / (th + L2)
            gain[(hn < MIN_CHILD) | (tn - hn < MIN_CHILD) | ~usable[None]] = -1
            pick = gain.reshape(nodes, -1).argmax(axis=1)
            best = gain.reshape(nodes, -1).max(axis=1)
            for i in np.flatnonzero(best > 1e-9):
                j, b = divmod(int(pick[i]), BINS)
                feat[nodes - 1 + i], thr[nodes - 1 + i] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feat[node]] > thr[node])
        local = node - inner
        leaf = -np.bincount(local, g, inner + 1) / (np.bincount(local, h, inner + 1) + L2) * RATE
        z += leaf[local]
        feats.append(feat), thrs.append(thr), leaves.append(leaf)
    return Trees(np.stack(feats), np.stack(thrs), np.stack(leaves), empty.bias)


def fit(docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Trees:
    """Fit on at most ``sample`` labelled rows for which ``use`` holds, those of
    the smallest id hash.  Null labels and labels without a document are ignored; an id
    with several labels gives an example for each, one with several texts the example of the smallest statistics."""
    chosen = (labels.where(use).where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
              .select(F.col(id_col).alias("lid"), (F.col(label_col) > 0).cast("int").alias("y"))
              .orderBy(F.xxhash64("lid"), "lid", "y").limit(sample))
    rows = docs.select(F.col(id_col).alias("lid"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "lid").select("lid", "y", "text")

    def run(batches):
        for batch in batches:
            _, off = text_buffer(batch.column("text"))
            for part in row_groups(batch, np.diff(off), WINDOW):
                x = statistics(part.column("text"))
                yield pa.record_batch({"lid": part.column("lid"), "y": part.column("y"),
                                       "x": pa.FixedSizeListArray.from_arrays(x.ravel(), x.shape[1]).cast(pa.list_(pa.float64()))})

    found = rows.mapInArrow(run, f"lid {dict(rows.dtypes)['lid']}, y int, x array<double>")
    got = found.groupBy("lid", "y").agg(F.min("x").alias("x")).toArrow().sort_by([("lid", "ascending"), ("y", "ascending")])
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return grow(x.reshape(got.num_rows, FEATURES), got.column("y").to_numpy().astype(float))


def predict(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc_id, score, predicted`` for every row (null text: empty text).
    ``keep`` names further columns to pass on."""
    shared = share(docs.sparkSession, trees)
    kept = [c for c in keep or [] if c != id_col]
    source = {c: "_text" if c == text_col else f"k_{c}" for c in kept}
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(k) for c, k in source.items() if k != "_text"])

    def run(batches):
        for batch in batches:
            _, off = text_buffer(batch.column("_text"))
            for part in row_groups(batch, np.diff(off), WINDOW):
                score = unpacked(shared).score(statistics(part.column("_text")))
                out = {"doc_id": part.column("_id"), "score": score, "predicted": (score >= 0.5).astype(np.int32)}
                yield pa.record_batch(out | {f"k_{c}": part.column(source[c]) for c in kept})

    types = dict(rows.dtypes)
    schema = f"doc_id {types['_id']}, score double, predicted int" + "".join(f", `k_{c}` {types[source[c]]}" for c in kept)
    return rows.mapInArrow(run, schema).select("doc_id", "score", "predicted", *[F.col(f"k_{c}").alias(c) for c in kept])
