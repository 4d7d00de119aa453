"""Jaccard self-join on word n-grams: size-banded tiles, hashed bitmaps, exact check.

Documents with the same word sequence are one *node*.  For a similarity ``t``:

1. A frequency sketch (``SKETCH`` counters, all documents) orders n-grams, rare ones
   first.  Two sets that link share an n-gram among the first
   ``n - ceil(t n) + 1`` of each (prefix filter), so only n-grams that occur in the prefixes of several
   nodes matter; they are found per hash range, very frequent ones over several
   tasks, since the sketch tells which they are.
2. Every node is compared with a few *leaders*: in each of ``STARS`` hash orders the
   first node of an n-gram leads it, and a node's leader is the one that shares most of its prefix
   n-grams.  The links found join most copies at a linear cost.
3. What is left are leaders whose nodes are in different components.  These nodes are
   sorted into tiles of one size band; a pair of tiles is compared by
   bitmaps (the parity of hashed n-grams, as wide as the sets need): the bits that
   differ bound the overlap from above.  Pairs inside one component are not looked at.
4. Surviving pairs are decided by intersecting the sorted arrays of both sets, the
   most promising pair of every two components first, then all that are left.
   Only the sets of nodes in such pairs are ever sent.

No step caps partners: tiles of a large group go to different tasks.  Nodes are
64-bit hashes of whole word sequences, n-grams 64-bit hashes of their words.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import WINDOW, mix, parallelism, row_groups, stored, text_buffer, word_hashes

WORDS = 5
SIMILAR = 80                # per cent
SKETCH = 1 << 20            # counters
SLICES = 64
RANGE_BYTES = 8 << 20       # text bytes whose prefixes one hash range serves
TILE = 256                  # nodes of a tile
BLOOM_BITS = 1 << 28        # most bits of the filter of active nodes
STARS = 6                   # leaders that a node is compared with, in different hash orders
FIRST_STARS = 2             # the others only while the node is still apart from them
PREFIX_HOT = 2000           # estimated occurrences of an n-gram per task


def shingle_sets(arr, words: int = WORDS):
    """Per row: sorted distinct n-gram hashes (concatenated, with row starts), and
    the hash of the word sequence.  Fewer words than ``words``: the whole
    sequence is one n-gram; no words: none."""
    h, first = word_hashes(*text_buffer(arr))
    count = np.diff(first)
    rows = len(count)
    row = np.repeat(np.arange(rows), count)      # words = 0: only the sequence hash is wanted
    place = np.arange(len(h)) - first[row]
    mult = np.uint64(0x9E3779B97F4A7C15)
    # sequence hash: sum of words mixed with their places
    seq = np.zeros(rows, np.uint64)
    if len(h):
        spot = mix(h + mix(place.astype(np.uint64) + np.uint64(1)))
        has = np.flatnonzero(count)
        seq[has] = mix(np.add.reduceat(spot, first[has]) + count[has].astype(np.uint64))
    if not words:
        return h[:0], first[:0], seq
    n = len(h) - words + 1
    if n > 0:
        gram = h[:n].copy()
        for i in range(1, words):
            gram = gram * mult + h[i:i + n]
        full = np.flatnonzero(row[:n] == row[words - 1:])
        gram, grow = mix(gram[full]), row[full]
    else:
        gram, grow = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < words))
    gram, grow = np.concatenate((gram, mix(seq[short] + mult))), np.concatenate((grow, short))
    order = np.argsort(gram)
    order = order[_stable(grow[order], rows)]
    gram, grow = gram[order], grow[order]
    keep = np.ones(len(gram), bool)
    keep[1:] = (gram[1:] != gram[:-1]) | (grow[1:] != grow[:-1])
    gram, grow = gram[keep], grow[keep]
    return gram, np.searchsorted(grow, np.arange(rows + 1)), seq


def _stable(values: np.ndarray, limit: int) -> np.ndarray:
    """Stable order; numpy sorts small integers by radix."""
    return np.argsort(values.astype(np.uint16) if limit < 1 << 16 else values, kind="stable")


def overlap_needed(a, b, similar: int = SIMILAR):
    """Least intersection for 100 * common >= similar * union."""
    return -(-(similar * (a + b)) // (100 + similar))


def prefix_length(n, similar: int = SIMILAR):
    """Any linked set shares one of so many first n-grams."""
    return n - (-(-(similar * n) // 100)) + 1


def index_length(n, similar: int = SIMILAR):
    """With a set that is no smaller, a linked set shares one of so many first
    n-grams (and one of the other's ``prefix_length``)."""
    return n - (-(-(2 * similar * n) // (100 + similar))) + 1


def band(n: np.ndarray, similar: int = SIMILAR) -> np.ndarray:
    """Size band: sets that link are in the same band or in neighbouring ones."""
    return np.floor(np.log(n) / math.log(100 / similar) + 1e-9).astype(np.int64)


def bitmap_bits(n: int) -> int:
    return max(256, 1 << int(n).bit_length())


def bitmap(grams: np.ndarray) -> bytes:
    """Parity of the n-grams hashed to each bit."""
    bits = bitmap_bits(len(grams))
    return np.packbits(np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def fold(maps: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows, words of 64 bits) folded to ``width`` words."""
    while maps.shape[1] > width:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def _chunks(batches, *columns):
    for batch in batches:
        _, off = text_buffer(batch.column("text"))
        for part in row_groups(batch, np.diff(off), WINDOW):
            yield part


ABOUT = "node long, n long, bits binary, slice int, part int, counts binary"


def _describe(words: int):
    """Rows of documents (id, node, set size, bitmap), and at the end of a
    partition its sketch counters in slices."""
    def run(batches):
        counts, kind = np.zeros(SKETCH, np.uint32), None
        for part in _chunks(batches):
            kind = part.column("doc_id").type
            gram, first, seq = shingle_sets(part.column("text"), words)
            n = np.diff(first)
            own = np.zeros(len(seq), bool)
            own[np.unique(seq, return_index=True)[1]] = True         # copies in this chunk count once
            counts += np.bincount((gram[np.repeat(own, n)] & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
            none = pa.nulls(len(n), pa.int32())
            yield pa.record_batch({"doc_id": part.column("doc_id"), "node": seq.view(np.int64), "n": n,
                                   "bits": pa.array([bitmap(gram[first[i]:first[i + 1]]) if own[i] and n[i] else None for i in range(len(n))], pa.binary()),
                                   "slice": none, "part": none, "counts": pa.nulls(len(n), pa.binary())})
        if kind is not None:
            size, none = SKETCH // SLICES, pa.nulls(SLICES, pa.int64())
            yield pa.record_batch({"doc_id": pa.nulls(SLICES, kind), "node": none, "n": none, "bits": pa.nulls(SLICES, pa.binary()),
                                   "slice": np.arange(SLICES, dtype=np.int32), "part": np.full(SLICES, int(counts.sum() % 1021), np.int32),
                                   "counts": pa.array([counts[i * size:(i + 1) * size].astype(np.uint64).tobytes() for i in range(SLICES)], pa.binary())})
    return run


def _add_sketches(table):
    total = sum(np.frombuffer(c.as_py(), np.uint64) for c in table.column("counts"))
    return pa.table({"slice": table.column("slice").slice(0, 1), "part": table.column("part").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def frequency_classes(sketches: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Per sketch counter: its class (0: not above chance) and its count.  SKETCH
    counters reach the driver, whatever the input."""
    schema = "slice int, part int, counts binary"
    total = np.zeros(SKETCH, np.uint64)
    size = SKETCH // SLICES
    # two levels, so that no task adds up all partitions
    for r in sketches.groupBy("slice", "part").applyInArrow(_add_sketches, schema).groupBy("slice").applyInArrow(_add_sketches, schema).collect():
        total[r["slice"] * size:(r["slice"] + 1) * size] = np.frombuffer(bytes(r["counts"]), np.uint64)
    mean = total.mean()
    chance = mean + 6 * math.sqrt(mean) + 2
    over = np.maximum(total / chance, 1)
    return np.where(total > chance, 1 + np.floor(4 * np.log2(over)), 0).astype(np.uint8), total


def _send_prefixes(shared, ranges: int, words: int, similar: int):
    """Prefix n-grams of distinct nodes, per hash range; frequent n-grams are dealt
    over several ranges by node."""
    def run(batches):
        classes, counts = shared.value
        for part in _chunks(batches):
            gram, first, seq = shingle_sets(part.column("text"), words)
            n = np.diff(first)
            own = np.zeros(len(n), bool)
            own[np.unique(seq, return_index=True)[1]] = True
            own &= n > 0
            row = np.repeat(np.arange(len(n)), n)
            slot = (gram & np.uint64(SKETCH - 1)).astype(np.int64)
            order = np.argsort(classes[slot], kind="stable")            # rare first, then by hash
            order = order[_stable(row[order], len(n))]
            gram, row, slot = gram[order], row[order], slot[order]
            place = np.arange(len(gram)) - first[row]
            use = (place < prefix_length(n, similar)[row]) & own[row]
            gram, row, slot = gram[use], row[use], slot[use]
            indexed = place[use] < index_length(n, similar)[row]
            salts = np.where(classes[slot] > 0, 1 + counts[slot] // PREFIX_HOT, 1).astype(np.uint64)
            salt = mix(seq[row]) % salts
            to = (mix(gram + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(ranges)).astype(np.int64)
            order = _stable(to, ranges)
            gram, row, salts, to, indexed = gram[order], row[order], salts[order], to[order], indexed[order]
            cuts = np.searchsorted(to, np.arange(ranges + 1))
            own_ranges = np.flatnonzero(np.diff(cuts))
            spans = [slice(cuts[i], cuts[i + 1]) for i in own_ranges]
            yield pa.record_batch({
                "range": own_ranges.astype(np.int32),
                "grams": pa.array([gram[s].tobytes() for s in spans], pa.binary()),
                "seq": pa.array([seq[np.unique(row[s])].tobytes() for s in spans], pa.binary()),
                "size": pa.array([n[np.unique(row[s])].astype(np.uint32).tobytes() for s in spans], pa.binary()),
                "at": pa.array([np.searchsorted(np.unique(row[s]), row[s]).astype(np.uint16 if len(n) < 65536 else np.uint32).tobytes() for s in spans], pa.binary()),
                "wide": pa.array([len(n) >= 65536] * len(spans), pa.bool_()),
                "indexed": pa.array([np.packbits(indexed[s]).tobytes() for s in spans], pa.binary()),
                "frequent": pa.array([np.packbits(salts[s] > 1).tobytes() for s in spans], pa.binary())})
    return run


def _shared_prefixes(similar: int):
    """N-grams of one hash range that several nodes of like size have in their
    prefixes (and all frequent ones, whose nodes are spread)."""
    def run(table):
        parts = []
        for g, s, z, at, wide, i, f in zip(*(table.column(c).to_pylist() for c in ("grams", "seq", "size", "at", "wide", "indexed", "frequent"))):
            own = np.frombuffer(g, np.uint64)
            where = np.frombuffer(at, np.uint32 if wide else np.uint16)
            flags = [np.unpackbits(np.frombuffer(x, np.uint8))[:len(own)].astype(bool) for x in (i, f)]
            parts.append((own, np.frombuffer(s, np.uint64)[where], np.frombuffer(z, np.uint32)[where], *flags))
        cols = [np.concatenate(x) for x in zip(*parts)]
        order = np.argsort(cols[0], kind="stable")
        cols = [c[order] for c in cols]
        gram, often = cols[0], cols[4]
        same = gram[1:] == gram[:-1]
        several = np.concatenate((same, [False])) | np.concatenate(([False], same)) | often
        gram, node, size, indexed, often = (c[several] for c in cols)
        order = np.lexsort((node, size, gram))
        gram, node, size, indexed, often = gram[order], node[order], size[order], indexed[order], often[order]
        fresh = np.ones(len(gram), bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])     # copies from several chunks
        gram, node, size, indexed, often = gram[fresh], node[fresh], size[fresh], indexed[fresh], often[fresh]
        # in order of size, the nearest sizes are neighbours
        near = (gram[1:] == gram[:-1]) & (100 * size[:-1].astype(np.int64) >= similar * size[1:].astype(np.int64))
        use = np.concatenate((near, [False]))[:len(gram)] | np.concatenate(([False], near))[:len(gram)] | often
        return pa.table({"gram": gram[use].view(np.int64), "node": node[use].view(np.int64), "n": size[use].astype(np.int64), "indexed": pa.array(indexed[use], pa.bool_())})
    return run


def _bloom(nodes: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """Filter of the active nodes: 16 bits each, at most BLOOM_BITS in all."""
    bits = min(max(64, 1 << (16 * max(count, 1) - 1).bit_length()), BLOOM_BITS)
    where = F.explode(F.array(F.col("node").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("node", 32).bitwiseAND(F.lit(bits - 1))))
    words = (nodes.select(where.alias("at")).groupBy(F.shiftright("at", 5).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 AS INT))")).alias("bits")).toArrow())
    out = np.zeros(bits // 32, np.uint32)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return out, bits


def _chosen_sets(shared, words: int):
    """(node, grams): sorted n-grams of each node in the filter, once per chunk."""
    def run(batches):
        table, bits = shared.value
        for part in _chunks(batches):
            seq = shingle_sets(part.column("text"), 0)[2]
            hit = np.ones(len(seq), bool)
            for at in (seq & np.uint64(bits - 1), (seq >> np.uint64(32)) & np.uint64(bits - 1)):
                hit &= (table[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32) & 1).astype(bool)
            own = np.unique(seq, return_index=True)[1]
            own = own[hit[own]]
            if len(own):
                gram, first, seq = shingle_sets(part.column("text").take(pa.array(own)), words)
                yield pa.record_batch({"node": seq.view(np.int64), "grams": pa.array([gram[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())})
    return run


def node_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, grams) of at least these nodes, in one pass over the texts that sends nothing but their sets."""
    nodes = stored(nodes)
    filter_ = docs.sparkSession.sparkContext.broadcast(_bloom(nodes, nodes.count()))
    found = docs.select("text").mapInArrow(_chosen_sets(filter_, words), "node long, grams binary")
    sets = stored(found.groupBy("node").agg(F.first("grams").alias("grams")))
    filter_.destroy()
    return sets


def _linked(similar: int):
    """Pairs whose sorted arrays intersect enough."""
    def run(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            last, left = None, None
            for i, (x, y) in enumerate(zip(b.column("grams_a"), b.column("grams_b"))):
                key = b.column("a")[i].as_py()
                if key != last:
                    last, left = key, np.frombuffer(x.as_py(), np.uint64)
                right = np.frombuffer(y.as_py(), np.uint64)
                both = np.concatenate((left, right))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * common >= similar * (len(left) + len(right) - common)
            take = pa.array(np.flatnonzero(keep))
            yield pa.record_batch({"a": b.column("a").take(take), "b": b.column("b").take(take)})
    return run


def verify(pairs: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The pairs (a, b) of nodes that link, decided exactly."""
    one = pairs.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("grams_b")), "b")
    two = one.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("grams_a")), "a")
    return two.select("a", "b", "grams_a", "grams_b").mapInArrow(_linked(similar), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root: the smallest node of its
    component.  Large-star and small-star steps until all edges point to roots;
    every step is stored."""
    # a > b in all edges
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        # every node's larger neighbours move to its smallest one
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = stored(both.join(low, "u").where("v > u AND v <> low").select(F.col("v").alias("a"), F.col("low").alias("b")))
        # then every node and its smaller neighbours to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").union(low.select("a", F.col("low").alias("b")))
        e = stored(small.distinct())
        # done when every node points to one node and that one points to none
        ends = e.select(F.col("a").alias("u"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(e.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 OR (out > 0 AND in > 0)").isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after more links: only the components that these touch are looked at."""
    ends = links.join(_named(roots, "a"), "a", "left").join(_named(roots, "b"), "b", "left")
    merged = components(ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    moved = merged.select(F.col("node").alias("root"), F.col("root").alias("to"))
    known = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return known.union(merged.join(roots, "node", "left_anti").select("node", "root"))


def may_link(maps_a: list, maps_b: list, n_a: np.ndarray, n_b: np.ndarray, similar: int) -> np.ndarray:
    """For pairs of sets (bitmaps and sizes): whether the bits that differ leave room for enough overlap."""
    out = np.zeros(len(n_a), bool)
    width = np.minimum([len(m) for m in maps_a], [len(m) for m in maps_b])
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        x, y = (np.concatenate([fold(np.frombuffer(maps[i], np.uint64)[None, :], w // 8) for i in own]) for maps in (maps_a, maps_b))
        differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        out[own] = (n_a[own] + n_b[own] - differ) // 2 >= overlap_needed(n_a[own], n_b[own], similar)
    return out


def _prune(similar: int):
    def run(batches):
        for b in batches:
            ok = may_link(b.column("bits_a").to_pylist(), b.column("bits_b").to_pylist(), b.column("n_a").to_numpy(), b.column("n_b").to_numpy(), similar)
            take = pa.array(np.flatnonzero(ok))
            yield pa.record_batch({c: b.column(c).take(take) for c in ("a", "b", "star")})
    return run


def _compare_tiles(similar: int):
    """Pairs of different components in a task's tile pairs that the prefix, size
    and bitmap bounds leave, with the bound of their similarity."""
    def run(table):
        leader, tile_a, tile_b, side = (table.column(c).to_numpy() for c in ("leader", "tile_a", "tile_b", "side"))
        node, n, root, indexed = (table.column(c).to_numpy() for c in ("node", "n", "root", "indexed"))
        maps = table.column("bits").to_pylist()
        wide = np.array([len(m) // 8 for m in maps])
        order = np.lexsort((n, tile_b, tile_a, leader))
        key = np.stack([leader, tile_a, tile_b])[:, order]
        cuts = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0), [True])))
        found = [np.zeros((3, 0), np.int64)]
        for s, e in zip(cuts, cuts[1:]):
            own = order[s:e]
            left, right = own[side[own] != 1], own[side[own] != 0]
            if not len(left) or not len(right):
                continue
            l, r = left[:, None], right[None, :]
            small, big = np.minimum(n[l], n[r]), np.maximum(n[l], n[r])
            ok = (100 * small >= similar * big) & (root[l] != root[r]) & np.where(n[l] < n[r], indexed[l], np.where(n[r] < n[l], indexed[r], indexed[l] | indexed[r]))
            pair_width = np.minimum(wide[l], wide[r])
            for w in np.unique(pair_width[ok]):
                here = ok & (pair_width == w)
                i, j = np.flatnonzero(here.any(axis=1)), np.flatnonzero(here.any(axis=0))
                x, y = (np.concatenate([fold(np.frombuffer(maps[k], np.uint64)[None, :], w) for k in side_[at]]) for side_, at in ((left, i), (right, j)))
                differ = np.zeros((len(i), len(j)), np.int64)
                for c in range(w):
                    differ += np.bitwise_count(x[:, c][:, None] ^ y[:, c][None, :])
                total = n[left[i]][:, None] + n[right[j]][None, :]
                room = (total - differ) // 2
                p, q = np.nonzero(here[np.ix_(i, j)] & (100 * room >= similar * (total - room)))
                a, b = node[left[i[p]]], node[right[j[q]]]
                found.append(np.stack([np.minimum(a, b), np.maximum(a, b), 1000 * room[p, q] // (total - room)[p, q]]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.table({"a": pairs[0], "b": pairs[1], "bound": pairs[2]})
    return run


def tile_candidates(rows: DataFrame, bits: DataFrame, tasks: int, similar: int = SIMILAR) -> DataFrame:
    """Pairs (a, b, bound) that may link, from rows (leader, node, n, indexed, root).

    A leader's nodes form tiles by size band and hash; every pair of tiles of
    the same or of neighbouring bands is compared in one place.
    """
    groups = rows.groupBy("leader").agg(F.count("*").alias("nodes"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    split = F.ceil(F.col("nodes") / TILE)
    log = math.log(100 / similar)
    own = (rows.join(groups.select("leader", "nodes"), "leader")
           .join(bits.select("node", "bits"), "node")
           .withColumn("band", F.when(split > 1, F.floor(F.log(F.col("n").cast("double")) / log + 1e-9)).otherwise(0))
           .withColumn("split", split).withColumn("part", F.pmod(F.xxhash64("node"), split)))
    tile = lambda b, p: (b * F.col("split") + p).cast("long")
    # a node is on the left of the pairs with later parts of its band and all parts of the next one
    me = tile(F.col("band"), F.col("part"))
    parts = F.sequence(F.lit(0).cast("long"), F.col("split") - 1)
    same = F.transform(parts, lambda p: F.struct(
        F.least(me, tile(F.col("band"), p)).alias("tile_a"), F.greatest(me, tile(F.col("band"), p)).alias("tile_b"),
        F.when(p == F.col("part"), 2).when(p > F.col("part"), 0).otherwise(1).alias("side")))
    up = F.transform(parts, lambda p: F.struct(me.alias("tile_a"), tile(F.col("band") + 1, p).alias("tile_b"), F.lit(0).alias("side")))
    down = F.transform(parts, lambda p: F.struct(tile(F.col("band") - 1, p).alias("tile_a"), me.alias("tile_b"), F.lit(1).alias("side")))
    places = F.when(F.col("split") > 1, F.concat(same, up, down)).otherwise(same)
    placed = own.select("leader", "node", "n", "indexed", "root", "bits", F.inline(places))
    dealt = placed.withColumn("task", F.pmod(F.xxhash64("leader", "tile_a", "tile_b"), tasks))
    return dealt.groupBy("task").applyInArrow(_compare_tiles(similar), "a long, b long, bound long").distinct()


def _named(roots: DataFrame, side: str) -> DataFrame:
    return roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components."""
    both = pairs.join(_named(roots, "a"), "a", "left").join(_named(roots, "b"), "b", "left")
    return both.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(pairs.columns)


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    A set holds the distinct ``words``-word shingles of the lower-cased text (fewer
    words: the whole sequence; none or null: empty, linked with nothing).  Sets
    link when 100 * common >= ``similar`` * union; ``component_id`` is the
    smallest id reachable.  A null id takes part in no component (null).
    Rows that repeat an id are returned each.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = dict(rows.dtypes)["doc_id"]
    known = rows.where("doc_id IS NOT NULL AND text IS NOT NULL")
    about = stored(rows.mapInArrow(_describe(words), f"doc_id {id_type}, " + ABOUT))
    meta = about.where("slice IS NULL")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(parallelism(spark), math.ceil(size / RANGE_BYTES))

    shared = spark.sparkContext.broadcast(frequency_classes(about.where("slice IS NOT NULL").select("slice", "part", "counts")))
    sent = known.select("text").mapInArrow(
        _send_prefixes(shared, ranges, words, similar),
        "range int, grams binary, seq binary, size binary, at binary, wide boolean, indexed binary, frequent binary")
    common = stored(sent.groupBy("range").applyInArrow(_shared_prefixes(similar), "gram long, node long, n long, indexed boolean"))
    shared.destroy()
    active = common.select("node").distinct()
    bits = stored(meta.where("bits IS NOT NULL").join(active, "node", "left_semi").groupBy("node").agg(F.first("bits").alias("bits"), F.first("n").alias("n")))

    # each node and, for each of STARS hash orders, the leader that shares most of its prefix n-grams
    first = [F.min(F.struct(F.xxhash64("node", F.lit(r)).alias("h"), "node", "n")) for r in range(STARS)]
    leaders = common.groupBy("gram").agg(F.array(*first).alias("leaders"), F.count("*").alias("nodes")).where("nodes > 1")
    votes = (common.join(leaders, "gram").select("node", "n", F.posexplode("leaders").alias("star", "l")).where(F.col("l.node") != F.col("node"))
             .where(100 * F.least("n", "l.n") >= similar * F.greatest("n", "l.n"))
             .groupBy("node", "star", F.col("l.node").alias("leader")).count())
    chosen = votes.groupBy("node", "star").agg(F.max_by("leader", F.struct("count", "leader")).alias("leader"))
    chosen = chosen.groupBy(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).agg(F.min("star").alias("star"))
    one, two = (bits.select(F.col("node").alias(c), F.col("bits").alias(f"bits_{c}"), F.col("n").alias(f"n_{c}")) for c in ("a", "b"))
    chosen = stored(chosen.join(two, "b").join(one, "a").select("a", "b", "star", "bits_a", "bits_b", "n_a", "n_b").mapInArrow(_prune(similar), "a long, b long, star int"))
    sets = node_sets(known, chosen.select(F.col("a").alias("node")).union(chosen.select("b")).distinct(), words)
    links = stored(verify(chosen.where(F.col("star") < FIRST_STARS), sets, similar))
    roots = stored(components(links))
    later = _apart(chosen.where(F.col("star") >= FIRST_STARS), roots)
    more = stored(verify(later.select("a", "b"), sets, similar))
    if not more.isEmpty():
        roots = stored(joined(roots, more))

    # nodes that share an n-gram share its leader: one row per leader and node instead of one per n-gram
    led = (common.join(leaders.select("gram", F.col("leaders")[0]["node"].alias("leader")), "gram")
           .groupBy("leader", "node").agg(F.first("n").alias("n"), F.bool_or("indexed").alias("indexed")))
    rooted = led.join(roots, "node", "left").select("leader", "node", "n", "indexed", F.coalesce("root", "node").alias("root"))
    left = stored(tile_candidates(rooted, bits, ranges, similar).join(
        chosen.select("a", "b"), ["a", "b"], "left_anti"))
    needed = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    sets = sets.union(node_sets(known, needed.join(sets, "node", "left_anti"), words).join(sets, "node", "left_anti"))
    for last in (False, True):
        if left.isEmpty():
            break
        # one pair of each two components first: most links join the same components
        rank = F.max_by(F.struct("a", "b"), F.struct("bound", "a", "b")).alias("p")
        tried = left if last else left.join(_named(roots, "a"), "a", "left").join(_named(roots, "b"), "b", "left").groupBy(
            F.least(F.coalesce("root_a", "a"), F.coalesce("root_b", "b")).alias("r"), F.greatest(F.coalesce("root_a", "a"), F.coalesce("root_b", "b")).alias("s")
        ).agg(rank).select("p.a", "p.b")
        tried = stored(tried.select("a", "b"))
        more = stored(verify(tried, sets, similar))
        if not more.isEmpty():
            roots = stored(joined(roots, more))
        if last:
            break
        left = stored(_apart(left.join(tried, ["a", "b"], "left_anti"), roots))
    final = roots

    nodes = meta.where("n > 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("low"))
    labelled = final.join(nodes, "node")
    lows = labelled.groupBy("root").agg(F.min("low").alias("all_low"))
    node_low = labelled.join(lows, "root").select("node", "all_low")
    every = nodes.join(node_low, "node", "left").select("node", F.coalesce("all_low", "low").alias("label"))
    return (meta.join(every, "node", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("label")).otherwise(F.col("doc_id"))).alias("component_id")))
