"""Source divergence audit by sorting pointers to word starts.

A worker gathers whole documents into shards of about ``SHARD`` bytes.  A shard's
terms are pointers to their first byte in the Arrow text buffer; no word becomes a Python object.
The pointers are put in term order by a multikey quicksort whose
characters are slices of eight bytes: pointers that agree so far and go on are
sorted by their next slice.  Equal runs are the shard's distinct terms; the runs'
pointers, which know their documents, yield occurrences and document frequency per source.

Spark sums the shards' rows.  Terms are kept by their document frequency in a
language, and every source's smoothed share of a kept term is compared with its
language's and with those of the other sources, all in integers.  Pairs of sources are
compared in tiles: two groups of sources over a block of terms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import lowered, row_groups, stored, text_buffer, windows

SHARD = 12 << 20          # bytes of text whose pointers are sorted together
TILE_SOURCES = 64         # sources of a tile's side, about
TILE_ROWS = 20_000        # (term, source) rows of a tile's block of terms, about
MIN_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50


def _letters() -> np.ndarray:
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = letter[128:] = True
    return letter


def term_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every term: a maximal run of ASCII letters and bytes above 127 within a text."""
    inside = _letters()[raw]
    border = np.zeros(len(raw) + 1, bool)
    border[off] = True
    edge = inside.copy()
    edge[1:] &= ~inside[:-1] | border[1:-1]
    start = np.flatnonzero(edge)
    edge = inside.copy()
    edge[:-1] &= ~inside[1:] | border[1:-1]
    return start, np.flatnonzero(edge) + 1


def sort_pointers(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, run): pointers in order of their terms' bytes, and the number of the equal
    run that each pointer of that order belongs to."""
    n = len(start)
    wide = np.concatenate((raw, np.zeros(8, np.uint8)))
    slices = np.lib.stride_tricks.sliding_window_view(wide, 8)
    cut = np.array([0] + [(1 << 64) - (1 << 64 - 8 * k) for k in range(1, 9)], np.uint64)     # keeps the first k bytes

    def character(pointer: np.ndarray, depth: int) -> np.ndarray:
        """The next eight bytes as a number, zeros behind the term's end."""
        at = start[pointer] + depth
        left = np.clip(end[pointer] - at, 0, 8)
        return slices[np.minimum(at, len(raw))].copy().view(">u8").ravel().astype(np.uint64) & cut[left]

    order = np.arange(n)
    key = character(order, 0)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    depth = 8
    while True:
        # slices of equal pointers of which some go on
        more = end[order] - start[order] > depth
        run = np.cumsum(new) - 1
        goes = np.zeros(run[-1] + 1 if n else 0, bool)
        goes[run[more]] = True
        size = np.bincount(run, minlength=len(goes))
        open_ = goes & (size > 1)
        if not open_.any():
            return order, run
        place = np.flatnonzero(open_[run])
        inner, of = order[place], run[place]
        key = character(inner, depth)
        # a term that ends here comes before longer ones: zero bytes occur in no term
        by = np.lexsort((key, of))
        order[place] = inner[by]
        key, of = key[by], of[by]
        changed = np.ones(len(place), bool)
        changed[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
        new[place] |= changed
        depth += 8


def _gather(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans as strings."""
    size = end - start
    off = np.concatenate(([0], np.cumsum(size)))
    data = raw[np.repeat(start - off[:-1], size) + np.arange(off[-1])]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def count_runs(raw: np.ndarray, off: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, groups, occurrences, documents): one entry for each term and group
    of a shard's documents, in term order."""
    raw = lowered(raw)
    start, end = term_spans(raw, off)
    if not len(start):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, run = sort_pointers(raw, start, end)
    doc = (np.searchsorted(off, start, side="right") - 1)[order]
    # within a run by group, then document
    width, docs = int(group.max()) + 1, len(group)
    cell = np.sort((run * width + group[doc]) * docs + doc)
    own, document = cell // docs, np.ones(len(cell), bool)
    document[1:] = cell[1:] != cell[:-1]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    n = np.diff(np.concatenate((first, [len(own)])))
    seen = np.add.reduceat(document.astype(np.int64), first)
    term, found = own[first] // width, own[first] % width
    head = order[np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))][term]
    return _gather(raw, start[head], end[head]), found, n, seen


def _long_document(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """``count_runs`` of one long document, in windows cut between its terms."""
    raw, _ = text_buffer(text)
    tables = []
    for a, b in windows(~_letters()[raw]):
        terms, _, n, _ = count_runs(raw[a:b], np.array([0, b - a]), np.zeros(1, np.int64))
        tables.append(pa.table({"term": terms, "n": n}))
    whole = pa.concat_tables(tables).group_by("term").aggregate([("n", "sum")])
    n = whole.column("n_sum").to_numpy()
    return whole.column("term").combine_chunks(), np.zeros(len(n), np.int64), n, np.ones(len(n), np.int64)


def _shard_rows(batches):
    """(lang, source, text) -> (lang, source, term, n, docs) summed over shards."""
    def rows(part, count):
        lang, source = part.column("lang").to_pylist(), part.column("source").to_pylist()
        names: dict = {}
        group = np.fromiter((names.setdefault(k, len(names)) for k in zip(lang, source)), np.int64, len(lang))
        terms, found, n, docs = count(part, group)
        names = list(names)
        take = pa.array(found)
        return pa.record_batch({"lang": pa.array([k[0] for k in names], pa.string()).take(take), "source": pa.array([k[1] for k in names], pa.string()).take(take),
                                "term": terms, "n": n, "docs": docs})

    def shard(part, group):
        return count_runs(*text_buffer(part.column("text")), group)

    waiting, size = [], 0
    for batch in batches:
        _, off = text_buffer(batch.column("text"))
        long = np.diff(off) > SHARD
        for i in np.flatnonzero(long):
            yield rows(batch.slice(int(i), 1), lambda part, group: _long_document(part.column("text")))
        batch = batch.filter(pa.array(~long)) if long.any() else batch
        _, off = text_buffer(batch.column("text"))
        for part in row_groups(batch, np.diff(off), SHARD):
            own = int(np.diff(text_buffer(part.column("text"))[1]).sum())
            if waiting and size + own > SHARD:
                yield rows(pa.Table.from_batches(waiting).combine_chunks(), shard)
                waiting, size = [], 0
            waiting.append(part)
            size += own
    if waiting:
        yield rows(pa.Table.from_batches(waiting).combine_chunks(), shard)


def _or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of every term and documents holding it, per language
    and source.  Null language, source or text: empty text.  An empty table gives no rows."""
    rows = docs.select(_or_empty(lang_col).alias("lang"), _or_empty(source_col).alias("source"), _or_empty(text_col).alias("text"))
    found = rows.mapInArrow(_shard_rows, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), exact beyond 64 bits."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({count} + {SMOOTH} as decimal(20,0))) div cast({total} + {SMOOTH} * {terms} as decimal(20,0))")


def _pair_sums(shares: DataFrame, sources: DataFrame) -> DataFrame:
    """``lang, source, item, value, seen``: for pairs of sources, the sum of |p - p'| over
    ``seen`` terms, among them all that one of the two has.

    ``shares``: lang, source, term, p.  ``sources``: lang, source, base (the share of a term that the source lacks).  Both carry
    ``sides`` and ``blocks``, the numbers of source groups and term blocks of the language.
    A task holds a block of terms for two groups of sources and gives one row per pair.
    """
    # a source meets its own group and every other
    tile = lambda df: (df.withColumn("side", F.pmod(F.xxhash64("source"), F.col("sides"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)))
                       .withColumns({"x": F.least("side", "other"), "y": F.greatest("side", "other")}))
    dealt = tile(shares).withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    known = tile(sources).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keys = ["lang", "x", "y", "block"]
    schema = pa.schema({"lang": pa.string(), "a": pa.string(), "b": pa.string(), "value": pa.int64(), "seen": pa.int64()})

    def compare(left, right):
        if not left.num_rows:
            return schema.empty_table()
        names, groups = right.column("source").to_pylist(), right.column("side").to_numpy()
        term = left.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
        m = np.repeat(right.column("base").to_numpy()[:, None], term.max() + 1, axis=1)
        at = {name: i for i, name in enumerate(names)}
        m[[at[name] for name in left.column("source").to_pylist()], term] = left.column("p").to_numpy()
        x, y = left.column("x")[0].as_py(), left.column("y")[0].as_py()
        a, b, value = [], [], []
        for i in np.flatnonzero(groups == x):
            others = np.flatnonzero(groups == y)
            others = others[others > i] if x == y else others
            a += [names[i]] * len(others)
            b += [names[j] for j in others]
            value.append(np.abs(m[others] - m[i]).sum(axis=1))
        return pa.table([[left.column("lang")[0].as_py()] * len(a), a, b, np.concatenate(value) if value else np.zeros(0, np.int64), np.full(len(a), m.shape[1])], schema=schema)

    found = dealt.select(*keys, "source", "term", "p").groupBy(*keys).cogroup(known.select(*keys, "source", "side", "base").groupBy(*keys)).applyInArrow(compare, "lang string, a string, b string, value long, seen long")
    sums = found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    return sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value", "seen").unionByName(sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value", "seen"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (language, source) that occurs.

    Part ``pair``: every other source of the language, by the summed difference of shares over
    all kept terms.  Part ``term``: the ``top`` terms of the source whose share exceeds
    the language's, by the excess.  Ranks from 1: value descending, then item by its UTF-8 bytes.  Null
    language, source or text count as ''.  A language without kept terms has pairs of value 0.
    Repeated rows are documents of their own; an empty table gives no rows; extra columns are ignored.
    """
    groups = stored(docs.select(_or_empty(lang_col).alias("lang"), _or_empty(source_col).alias("source")).distinct())
    counts = stored(term_counts(docs, lang_col, source_col, text_col))
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= min_docs).select("lang", "term", "all")
    kept = stored(counts.join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "all"))
    # occurrences of kept terms per source and language, and how many terms are kept
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own_terms"))
    langs = kept.select("lang", "term", "all").distinct().groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("lang_total"))
    found = groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["total", "own_terms", "terms", "lang_total"])
    tiles = found.groupBy("lang").agg(F.ceil(F.count("*") / F.lit(TILE_SOURCES)).alias("sides"), F.ceil((F.sum("own_terms") + 1) / F.lit(TILE_ROWS)).alias("blocks"))
    sources = stored(found.join(tiles, "lang").withColumn("base", F.when(F.col("terms") > 0, _share("0", "total", "terms"))))
    shares = stored(kept.join(sources, ["lang", "source"]).select("lang", "source", "term", "sides", "blocks", _share("n", "total", "terms").alias("p"), _share("`all`", "lang_total", "terms").alias("q")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    sums = _pair_sums(shares.drop("q"), sources.where("terms > 0").select("lang", "source", "base", "sides", "blocks"))
    others = sources.select("lang", F.col("source").alias("item"), F.col("base").alias("other_base"))
    pairs = sources.join(others, "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left")
    # terms that neither has differ by the base shares
    rest = (F.col("terms") - F.coalesce("seen", F.lit(0))) * F.abs(F.col("base") - F.col("other_base"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.when(F.col("terms") > 0, F.coalesce("value", F.lit(0)) + rest).otherwise(0).cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(over).withColumn("rank", F.col("rank").cast("int"))
