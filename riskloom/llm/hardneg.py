"""Hard-negative mining with anchor spanning-tree bounds.

A row's score for an anchor is the integer inner product of their vectors.  An
anchor's positives are its best rows of the same label; for each of them, the
negatives are the best rows of other labels whose score lies in a window given
in per cent of the positive's score.

Anchors are the stated query set.  They are broadcast in passes of a bounded size
(``PASS_BYTES``); every task compares its own rows with all anchors of the pass.  Near anchors
form blocks, and each block has a minimum spanning tree.  Walking down the tree, a
row's score for a child lies within ``edge length * row's norm`` of its score for
the parent, so only rows whose interval reaches into a window, above what the task has
already found, are scored again.  ``SEEDS`` rows give first thresholds; they
decide how much is skipped, never the result.

Every task gives at most the wanted number of rows per list; Spark merges them.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import share, stored, unpacked

PASS_BYTES = 32 << 20     # of anchor vectors broadcast at once
BLOCK = 512               # anchors of one tree
TILE = 8192               # rows compared at once
SEEDS = 4096              # rows that give the first thresholds
SHARE = 0.3               # of a tile from which scoring it whole is cheaper than picking rows


def component_limit(dim: int) -> int:
    """Largest magnitude of a component for which any score fits 64 bits."""
    return 1 << min(30, (62 - math.ceil(math.log2(max(dim, 1)))) // 2)


def quantised(rows: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """``vec_id, label, v``: rows that take part, components as ``floor(scale * x)``.

    Rows with a null id, label or vector, or with a null or non-finite component, are left out.  Of rows
    that share an id the one with the smallest label, then vector, stays.  Labels become text.
    """
    own = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("v")).where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    own = own.where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    one = own.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select(F.col("vec_id").cast("long"), "r.label", "r.v")
    limit = component_limit(one.agg(F.max(F.size("v"))).first()[0] or 1)
    step = lambda c: F.greatest(F.lit(-limit), F.least(F.lit(limit), F.floor(F.lit(float(scale)) * c.cast("double")))).cast("int")
    return one.select("vec_id", "label", F.transform("v", step).alias("v"))


def matrix(col, dim: int, kind=np.float64) -> np.ndarray:
    """(rows, dim) of a list array; shorter vectors end in zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat, first = col.flatten().to_numpy(zero_copy_only=False), col.offsets.to_numpy()
    size = np.diff(first)
    if (size == dim).all():
        return flat.astype(kind).reshape(len(size), dim)
    out = np.zeros((len(size), dim), kind)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(first[:-1] - first[0], size)] = flat
    return out


def blocks(x: np.ndarray, members: np.ndarray, size: int) -> list:
    """``members`` in groups of at most ``size`` near rows of ``x``, halved along the line to the farthest row."""
    out, left = [], [members]
    while left:
        own = left.pop()
        if len(own) <= size:
            out.append(own)
            continue
        y = x[own].astype(np.float64)
        far = y[((y - y[0]) ** 2).sum(axis=1).argmax()] - y[0]
        order = np.argsort(y @ far, kind="stable")
        left += [own[order[:len(own) // 2]], own[order[len(own) // 2:]]]
    return out


def spanning_tree(x: np.ndarray) -> list:
    """[(row, parent row or -1, edge length)] of a minimum spanning tree, each parent before its children."""
    y = x.astype(np.float64)
    n = len(y)
    near, parent, free = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    at, out, kids = 0, {0: (0, -1, 0.0)}, {i: [] for i in range(n)}
    for _ in range(n - 1):
        free[at] = False
        d = np.sqrt(((y - y[at]) ** 2).sum(axis=1))
        closer = free & (d < near)
        near[closer], parent[closer] = d[closer], at
        at = int(np.where(free, near, np.inf).argmin())
        out[at] = (at, int(parent[at]), float(near[at]))
        kids[int(parent[at])].append(at)
    walk, left = [], [0] if n else []
    while left:                       # depth first, so that few bounds are held at once
        walk.append(out[left.pop()])
        left += kids[walk[-1][0]]
    return walk


class Lists:
    """The best ``k`` rows of each list, higher scores first, then smaller ids."""

    def __init__(self, k: int, bar: np.ndarray):
        self.k, self.bar, self.found = k, bar.copy(), {}

    def offer(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        """Rows in ascending order of ids."""
        good = score >= self.bar[i]
        if not good.any():
            return
        score, ids = score[good], ids[good]
        if len(score) > self.k:
            last = np.partition(score, len(score) - self.k)[len(score) - self.k]
            above = np.flatnonzero(score > last)
            pick = np.concatenate((above, np.flatnonzero(score == last)[:self.k - len(above)]))
            score, ids = score[pick], ids[pick]
        if i in self.found:
            score, ids = np.concatenate((self.found[i][0], score)), np.concatenate((self.found[i][1], ids))
        order = np.lexsort((ids, -score))[:self.k]
        self.found[i] = score[order], ids[order]
        if len(order) == self.k:
            self.bar[i] = max(self.bar[i], score[order[-1]])


class Anchors:
    """The anchors of one pass with their trees, within a label and over all."""

    def __init__(self, ids, labels, x: np.ndarray, dim: int, positives: int, negatives: int):
        self.ids, self.names, self.dim, self.x = ids, sorted(set(labels)), dim, x
        code = {n: i for i, n in enumerate(self.names)}
        self.label = np.array([code[n] for n in labels], np.int64)
        self.lowest = -np.inf if x.dtype == np.float64 else np.iinfo(np.int64).min
        tree = lambda own: [(int(own[a]), int(own[p]) if p >= 0 else -1, d) for a, p, d in spanning_tree(x[own])]
        self.same = [[tree(b) for b in blocks(x, np.flatnonzero(self.label == c), BLOCK)] for c in range(len(self.names))]
        self.all = [tree(b) for b in blocks(x, np.arange(len(ids)), BLOCK)]
        self.k, self.most = positives, negatives
        self.bar = np.full(len(ids), self.lowest, x.dtype)
        self.window: dict = {}            # anchor -> [(list, lowest score, highest score)]
        self.pairs: list = []             # list -> (anchor id, positive id, positive's score)
        self.window_bar = np.zeros(0, x.dtype)

    def set_windows(self, found: list, low: int, high: int) -> None:
        """``found``: (anchor id, positive id, score) of all positives."""
        at = {int(a): i for i, a in enumerate(self.ids)}
        for a, p, s in sorted(found):
            lo, hi = -(-low * s // 100), high * s // 100
            if lo <= hi:
                self.window.setdefault(at[a], []).append((len(self.pairs), lo, hi))
                self.pairs.append((a, p, s))
        self.window_bar = np.full(len(self.pairs), self.lowest, self.x.dtype)

    def walk(self, tree: list, x: np.ndarray, norm: np.ndarray, need, take) -> int:
        """Scores the rows ``x`` along a tree: ``need(anchor, lowest, highest)`` marks the rows whose bounds call for their
        score, ``take(anchor, rows, scores)`` gets it.  Returns how many scores were computed."""
        left, kids, done = {}, {}, 0
        for _, parent, _ in tree:
            kids[parent] = kids.get(parent, 0) + 1
        for node, parent, edge in tree:
            if parent < 0:
                pick = None
            else:
                lo, hi = left[parent]
                room = edge * norm * (1 + 1e-9) + 1e-9 * np.maximum(np.abs(lo), np.abs(hi)) + 1
                lo, hi = lo - room, hi + room
                pick = np.flatnonzero(need(node, lo, hi))
                kids[parent] -= 1
                if not kids[parent]:
                    del left[parent]
            if pick is None or len(pick) > SHARE * len(x):
                score = x @ self.x[node]
                lo = hi = score.astype(np.float64)
                take(node, slice(None), score)
                done += len(x)
            elif len(pick):
                score = x[pick] @ self.x[node]
                lo[pick] = hi[pick] = score
                take(node, pick, score)
                done += len(pick)
            if kids.get(node):
                left[node] = lo, hi
        return done

    def _tiles(self, batches):
        """(ids, label codes, vectors, norms) in ascending order of ids; -1: a label that no anchor has."""
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                ids = part.column("vec_id").to_numpy(zero_copy_only=False)
                code = pc.fill_null(pc.index_in(part.column("label"), pa.array(self.names, pa.string())), -1).to_numpy(zero_copy_only=False)
                order = np.argsort(ids, kind="stable")
                x = matrix(part.column("v"), self.dim, self.x.dtype)[order]
                yield ids[order], code[order], x, np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))

    def find_positives(self, batches) -> tuple[Lists, int]:
        lists, done = Lists(self.k, self.bar), 0
        for ids, code, x, norm in self._tiles(batches):
            for c in np.unique(code[code >= 0]):
                rows = np.flatnonzero(code == c)
                own, own_x, own_norm = ids[rows], x[rows], norm[rows]

                def take(node, pick, score):
                    i = own[pick]
                    lists.offer(node, score[i != self.ids[node]], i[i != self.ids[node]])

                for tree in self.same[c]:
                    done += self.walk(tree, own_x, own_norm, lambda node, lo, hi: hi >= lists.bar[node], take)
        return lists, done

    def find_negatives(self, batches) -> tuple[Lists, int]:
        lists, done = Lists(self.most, self.window_bar), 0
        for ids, code, x, norm in self._tiles(batches):
            def need(node, lo, hi):
                out = np.zeros(len(ids), bool)
                for i, low, high in self.window.get(node, ()):
                    out |= (hi >= max(low, lists.bar[i])) & (lo <= high)
                return out & (code != self.label[node])

            def take(node, pick, score):
                other = code[pick] != self.label[node]
                score, own = score[other], ids[pick][other]
                for i, low, high in self.window.get(node, ()):
                    inside = (score >= low) & (score <= high)
                    lists.offer(i, score[inside], own[inside])

            for tree in self.all:
                done += self.walk(tree, x, norm, need, take)
        return lists, done


def _best(found: DataFrame, of: list, ids: str, score: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*of).orderBy(F.desc(score), ids))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
                   id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on ``vec_id``.  An anchor's positives are its first ``positives`` other rows of the same label
    (all, if fewer); each gets the first ``negatives`` rows of other labels with ``low * positive_score <= 100 * negative_score <=
    high * positive_score``; higher scores come first, ties by smaller id.  A pair without such rows gives none.

    Which rows take part: see ``quantised``.  Components are clipped to ``component_limit``; vectors of different lengths
    are compared as if the shorter ones ended in zeros.  Extra columns are ignored; no anchors or an empty table give no rows.
    """
    spark = rows.sparkSession
    own = stored(quantised(rows, id_col, vec_col, label_col, scale))
    facts = own.agg(F.max(F.size("v")).alias("dim"), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))).alias("top"), F.count(F.when(is_anchor, 1)).alias("n")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not facts["n"]:
        return spark.createDataFrame([], schema)
    dim, top = max(facts["dim"], 1), facts["top"] or 0
    kind = np.float64 if dim * top ** 2 < 1 << 53 else np.int64         # sums of products are exact in either
    per_pass = max(1, PASS_BYTES // (8 * dim))
    passes = 1 if facts["n"] <= per_pass else math.ceil(2 * facts["n"] / per_pass)
    seeds = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEEDS).toArrow().combine_chunks().to_batches()
    results = []
    for i in range(passes):
        got = own.where(is_anchor).where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i).toArrow().sort_by("vec_id")
        if got.num_rows:
            anchors = Anchors(got.column("vec_id").to_numpy(), got.column("label").to_pylist(), matrix(got.column("v"), dim, kind), dim, positives, negatives)
            results.append(_one_pass(own, anchors, seeds, low, high))
    return functools.reduce(DataFrame.unionByName, results)


def _one_pass(own: DataFrame, anchors: Anchors, seeds: list, low: int, high: int) -> DataFrame:
    spark = own.sparkSession
    anchors.bar = anchors.find_positives(seeds)[0].bar
    first = share(spark, anchors)

    def positives(batches):
        a = unpacked(first)
        lists, _ = a.find_positives(batches)
        for i, (score, ids) in lists.found.items():
            yield pa.record_batch({"anchor_id": np.full(len(ids), a.ids[i]), "positive_id": ids, "positive_score": score.astype(np.int64)})

    found = own.mapInArrow(positives, "anchor_id long, positive_id long, positive_score long")
    pairs = _best(found, ["anchor_id"], "positive_id", "positive_score", anchors.k).drop("rank").toArrow()
    first.destroy()
    anchors.set_windows(list(zip(*(pairs.column(c).to_pylist() for c in ("anchor_id", "positive_id", "positive_score")))), low, high)
    anchors.window_bar = anchors.find_negatives(seeds)[0].bar
    second = share(spark, anchors)

    def negatives(batches):
        a = unpacked(second)
        lists, _ = a.find_negatives(batches)
        for i, (score, ids) in lists.found.items():
            anchor, positive, of = a.pairs[i]
            n = len(ids)
            yield pa.record_batch({"anchor_id": np.full(n, anchor), "positive_id": np.full(n, positive), "positive_score": np.full(n, of), "negative_id": ids, "negative_score": score.astype(np.int64)})

    found = own.mapInArrow(negatives, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    best = _best(found, ["anchor_id", "positive_id"], "negative_id", "negative_score", anchors.most)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")
