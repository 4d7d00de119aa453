"""Language identification with interpolated Kneser-Ney character models.

Training counts every character 4-gram of every training text, per language:
workers pre-aggregate whole partitions with numpy, Spark sums them, and the
Kneser-Ney quantities (continuation counts, discounts, back-off masses) are
DataFrame aggregations over the distinct n-grams.  The model is a stored table
of whole n-grams (16 bits a character; letters beyond the first 65,536 code points are
folded into them) with their values.  A table of at most ``HELD_ENTRIES`` rows
goes to the workers as sorted arrays per language and order.  A larger one stays
where it is: texts are dealt to blocks, and each block's distinct n-grams are
joined with the table, so a worker holds only the entries that its block needs.
Both ways look up the same entries and give the same results.

A text gets the language of the lowest cross-entropy per character.  A
held-out tenth of the training documents calibrates the softmax temperature of
``score`` and, per language, the cross-entropy above which a text is rejected.

Texts are lower-cased; letters stay, every other run is one space.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from riskloom.llm.common import row_groups, share, stored, text_buffer, unpacked

ORDER = 4
HELD_ENTRIES = 1 << 21     # largest model that is sent to the workers whole
BLOCK_BYTES = 8 << 20      # text joined at once with a larger one
CHUNK = 2 << 20            # characters scored at once
CALIBRATION_PARTS = 10     # one of so many training documents calibrates
FALSE_REJECTS = 0.001      # share of good texts that may lie above the threshold
MARGIN = 0.5               # nats a character added to that quantile
PSEUDO_CHARS = 32          # short texts are drawn towards their language's mean
TEMPERATURES = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)
STEP = 0.02                # width of the calibration histogram, nats

_cache: dict = {}


def _letters() -> np.ndarray:
    if "letters" not in _cache:
        _cache["letters"] = np.char.isalpha(np.arange(0x110000, dtype=np.uint32).view("U1"))
    return _cache["letters"]


def char_grams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-grams (16 bits a character) of all texts and their number per text.

    Every text is padded with spaces: three before it, one after it.  A text
    without letters has no n-grams.
    """
    low = [(t or "").lower() for t in texts]
    size = np.fromiter(map(len, low), np.int64, len(low))
    cp = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(low)), size)
    letter = _letters()[cp]
    # a space stands where letters follow other characters inside a text
    gap = letter.copy()
    gap[1:] &= ~letter[:-1]
    seen = np.cumsum(letter)
    before = np.concatenate(([0], seen))[np.concatenate(([0], np.cumsum(size)))[:-1]]   # letters before each text
    gap &= (seen - 1) > before[row]
    at = np.flatnonzero(letter)
    code = (cp[at] ^ ((cp[at] >> 16) * 0x9E37)) & 0xFFFF
    extra = gap[at].astype(np.int64)
    letters = np.bincount(row[at], minlength=len(low))
    gaps = np.bincount(row[at], weights=extra, minlength=len(low)).astype(np.int64)
    kept = letters + gaps
    has = kept > 0
    total = np.where(has, kept + ORDER, 0)       # three spaces before, one after
    base = np.concatenate(([0], np.cumsum(total)))
    seq = np.full(base[-1] + ORDER, 32, np.uint64)
    inner = np.arange(len(at)) + np.cumsum(extra)
    start = np.concatenate(([0], np.cumsum(kept)))
    seq[base[row[at]] + ORDER - 1 + inner - start[row[at]]] = code
    gram = seq[:-3] << np.uint64(48) | seq[1:-2] << np.uint64(32) | seq[2:-1] << np.uint64(16) | seq[3:]
    count = np.where(has, kept + 1, 0)
    place = np.arange(count.sum()) - np.repeat(np.concatenate(([0], np.cumsum(count)))[:-1], count)
    return gram[np.repeat(base[:-1], count) + place], count


def _merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    u, inv = np.unique(keys, return_inverse=True)
    return u, np.bincount(inv, weights=np.concatenate([c for _, c in parts])).astype(np.int64)


def _count_grams(batches):
    """(lang, text) -> (lang, gram, n), summed over the partition.  Held
    entries are flushed beyond 4M, so memory does not depend on the input."""
    held: dict = {}
    size = 0

    def flush():
        for lang, parts in held.items():
            keys, n = _merge(parts)
            yield pa.record_batch({"lang": pa.array([lang] * len(keys), pa.string()), "gram": keys.view(np.int64), "n": n})

    for batch in batches:
        _, off = text_buffer(batch.column("text"))
        for part in row_groups(batch, np.diff(off), CHUNK):
            langs = part.column("lang").to_pylist()
            texts = part.column("text").to_pylist()
            for lang in dict.fromkeys(langs):
                grams, _ = char_grams([t for t, x in zip(texts, langs) if x == lang])
                keys, n = np.unique(grams, return_counts=True)
                held.setdefault(lang, []).append((keys, n))
                size += len(keys)
            if size > 1 << 20:
                for lang in held:
                    held[lang] = [_merge(held[lang])]
                size = sum(len(p[0][0]) for p in held.values())
                if size > 1 << 22:
                    yield from flush()
                    held, size = {}, 0
    yield from flush()


def _kinds(gram: np.ndarray) -> dict:
    """Kind of entry -> the n-gram that a packed 4-gram looks up there."""
    out = {}
    for k in range(1, ORDER + 1):
        tail = gram & np.uint64((1 << 16 * k) - 1)
        out[f"a{k}"] = tail
        if k > 1:
            out[f"g{k}"] = tail >> np.uint64(16)
    return out


def _sorted_tables(entries: pa.Table) -> dict:
    """(lang, kind) -> (sorted n-grams, values) of rows (lang, kind, gram, value)."""
    lang, kind = (entries.column(c).combine_chunks().dictionary_encode() for c in ("lang", "kind"))
    names = [(x, k) for x in lang.dictionary.to_pylist() for k in kind.dictionary.to_pylist()]
    of = lang.indices.to_numpy().astype(np.int64) * len(kind.dictionary) + kind.indices.to_numpy()
    key = entries.column("gram").to_numpy().astype(np.int64).view(np.uint64)
    order = np.lexsort((key, of))
    key, value = key[order], entries.column("value").to_numpy()[order].astype(np.float64)
    cuts = np.searchsorted(of[order], np.arange(len(names) + 1))
    return {name: (key[a:b], value[a:b]) for name, a, b in zip(names, cuts, cuts[1:]) if a < b}


@dataclass
class LanguageModel:
    """Per language: sorted n-grams with values for each kind of entry.
    Kind ``a<k>``: discounted probability of a k-gram; ``g<k>``: back-off mass
    of its context.  ``floor``: probability of an unseen character.  A model with
    ``entries`` has no arrays of its own; each block of texts gets those it needs."""

    langs: list = field(default_factory=list)
    tables: dict | None = field(default_factory=dict)   # (lang, kind) -> (n-grams, values)
    entries: DataFrame | None = None                    # (lang, kind, gram, value)
    floor: dict = field(default_factory=dict)
    temperature: float = 8.0
    mean: dict = field(default_factory=dict)
    threshold: dict = field(default_factory=dict)

    def _look(self, lang: str, kind: str, gram: np.ndarray, missing: float) -> np.ndarray:
        if self.tables is None:
            raise ValueError("the model's entries are in a table: use predict")
        keys, values = self.tables.get((lang, kind), (np.zeros(0, np.uint64), np.zeros(0)))
        if not len(keys):
            return np.full(len(gram), missing)
        at = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
        return np.where(keys[at] == gram, values[at], missing)

    def log_probs(self, gram: np.ndarray) -> np.ndarray:
        """(languages, n-grams) natural log of the interpolated probability."""
        wanted = _kinds(gram)
        out = np.empty((len(self.langs), len(gram)))
        for i, lang in enumerate(self.langs):
            p = np.full(len(gram), self.floor[lang])
            for k in range(1, ORDER + 1):
                mass = self._look(lang, f"g{k}", wanted[f"g{k}"], 1.0) if k > 1 else 1.0
                p = self._look(lang, f"a{k}", wanted[f"a{k}"], 0.0) + mass * p
            out[i] = np.log(np.maximum(p, 1e-12))
        return out

    def cross_entropy(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(languages, texts) nats a character, and scored characters per text."""
        gram, count = char_grams(texts)
        out = np.zeros((len(self.langs), len(texts)))
        if not len(gram):
            return out, count
        keys, inv = np.unique(gram, return_inverse=True)
        logp = self.log_probs(keys)
        has = np.flatnonzero(count)
        start = np.concatenate(([0], np.cumsum(count)))[:-1][has]
        for i in range(len(self.langs)):
            out[i, has] = -np.add.reduceat(logp[i][inv], start) / count[has]
        return out, count


def _tables_of(grams: DataFrame) -> DataFrame:
    """(lang, kind, gram, value): discounted probabilities and back-off masses.  Each order is stored."""
    out, level = None, grams            # counts at the top, continuation counts below
    for k in range(ORDER, 0, -1):
        disc = level.groupBy("lang").agg(F.sum((F.col("n") == 1).cast("double")).alias("n1"), F.sum((F.col("n") == 2).cast("double")).alias("n2"))
        disc = disc.select("lang", F.least(F.lit(0.95), F.greatest(F.lit(0.05), F.try_divide("n1", F.col("n1") + 2 * F.col("n2")))).alias("d"))
        ctx_key = F.shiftrightunsigned("gram", 16) if k > 1 else F.lit(0).cast("long")
        own = level.withColumn("ctx", ctx_key)
        ctx = own.groupBy("lang", "ctx").agg(F.sum("n").cast("double").alias("total"), F.count("*").alias("types"))
        ctx = ctx.join(F.broadcast(disc), "lang").select("lang", "ctx", "total", "d", (F.col("d") * F.col("types") / F.col("total")).alias("mass"))
        a = own.join(ctx, ["lang", "ctx"]).select("lang", F.lit(f"a{k}").alias("kind"), "gram", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")).cast("float").alias("value"))
        g = ctx.select("lang", F.lit(f"g{k}").alias("kind"), F.col("ctx").alias("gram"), F.col("mass").cast("float").alias("value"))
        entries = stored(a.unionByName(g))
        out = entries if out is None else out.unionByName(entries)
        if k > 1:
            mask = (1 << 16 * (k - 1)) - 1
            level = stored(level.select("lang", F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n")))
    return out


def train(docs: DataFrame, lang: Column, text: Column, calibrate: Column) -> LanguageModel:
    """Learn from the rows with a language; ``calibrate`` marks those that are
    held out from the counts to calibrate score and rejection."""
    rows = docs.select(lang.alias("lang"), text.alias("text"), calibrate.alias("hold")).where("lang IS NOT NULL AND text IS NOT NULL")
    counted = rows.where("NOT hold").select("lang", "text").mapInArrow(_count_grams, "lang string, gram long, n long")
    grams = stored(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    entries = _tables_of(grams)
    size = entries.groupBy("lang").agg(F.count("*").alias("n"), F.count(F.when(F.col("kind") == "a1", 1)).alias("symbols"),
                                       F.max(F.when(F.col("kind") == "g1", F.col("value"))).alias("mass")).collect()
    model = LanguageModel(langs=sorted(r["lang"] for r in size), floor={r["lang"]: r["mass"] / (r["symbols"] + 1) for r in size})
    if sum(r["n"] for r in size) <= HELD_ENTRIES:
        model.tables = _sorted_tables(entries.toArrow())
    else:
        model.tables, model.entries = None, entries
    if model.langs:
        _calibrate(model, rows.where("hold"))
    return model


def _ask(table):
    """The distinct entries that one block's texts look up."""
    found: dict = {}
    _, off = text_buffer(table.column("text"))
    for part in row_groups(table, np.diff(off), CHUNK):
        gram, _ = char_grams(part.column("text").to_pylist())
        found.setdefault("gram", []).append(np.unique(gram))
    gram = np.unique(np.concatenate(found["gram"]))
    wanted = {kind: np.unique(keys).view(np.int64) for kind, keys in _kinds(gram).items()}
    return pa.table({"block": pa.array(np.full(sum(map(len, wanted.values())), table.column("block_")[0].as_py()), pa.int64()),
                     "kind": pa.array([kind for kind, keys in wanted.items() for _ in range(len(keys))], pa.string()),
                     "gram": np.concatenate(list(wanted.values()))})


def _with_model(rows: DataFrame, model: LanguageModel, run, schema: str, deal: list) -> DataFrame:
    """``run(model, batch)`` over all ``rows`` (with ``text``), its batches as ``schema``.
    The columns ``deal`` tell rows apart and decide their block."""
    # the table's handle stays here; workers get arrays
    shared = share(rows.sparkSession, replace(model, entries=None))

    def groups(m, data):
        _, off = text_buffer(data.column("text"))
        for part in row_groups(data, np.diff(off), CHUNK):
            yield run(m, part)

    def held(batches):
        for batch in batches:
            yield from groups(unpacked(shared), batch)

    if model.entries is None:
        return rows.mapInArrow(held, schema)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = rows.withColumn("block_", F.pmod(F.xxhash64(*deal), F.lit(max(1, math.ceil(size / BLOCK_BYTES)))))
    # the same columns as below, so that the texts are dealt out once for both
    asked = dealt.groupBy("block_").applyInArrow(_ask, "block long, kind string, gram long")
    found = asked.join(model.entries, ["kind", "gram"]).select("block", "lang", "kind", "gram", "value")

    def joined(left, right):
        m = replace(unpacked(shared), tables=_sorted_tables(right) if right.num_rows else {})
        out = [pa.Table.from_batches([b]) for b in groups(m, left.drop_columns(["block_"]))]
        return pa.concat_tables(out) if out else empty

    empty = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema).empty_table()
    return dealt.groupBy("block_").cogroup(found.groupBy("block")).applyInArrow(joined, schema)


def _calibrate(model: LanguageModel, rows: DataFrame) -> None:
    """Temperature by likelihood, rejection thresholds by quantile; the driver
    gets one histogram per language, not documents."""
    def measure(m, part):
        ce, n = m.cross_entropy(part.column("text").to_pylist())
        true = np.array([m.langs.index(x) if x in m.langs else -1 for x in part.column("lang").to_pylist()])
        use = (n > 0) & (true >= 0)
        best = np.argmin(ce, axis=0)
        nll = []
        for t in TEMPERATURES:
            z = -t * (ce - ce.min(axis=0))
            nll.append(np.log(np.exp(z).sum(axis=0)) - z[true, np.arange(len(true))])
        cols = {"lang": pa.array([m.langs[b] for b in best[use]], pa.string()), "ce": ce.min(axis=0)[use], "chars": n[use], "right": (best == true)[use]}
        cols |= {f"nll{i}": x[use] for i, x in enumerate(nll)}
        return pa.record_batch(cols)

    schema = "lang string, ce double, chars long, right boolean, " + ", ".join(f"nll{i} double" for i in range(len(TEMPERATURES)))
    texts = rows.select("lang", "text")
    if model.entries is not None:
        # equal texts are dealt by their place, which storing keeps
        texts = stored(texts.withColumn("place", F.monotonically_increasing_id()))
    found = stored(_with_model(texts, model, measure, schema, ["place"]))
    nll = found.agg(*[F.sum(f"nll{i}") for i in range(len(TEMPERATURES))]).first()
    if nll[0] is not None:
        model.temperature = TEMPERATURES[int(np.argmin(list(nll)))]
    good = found.where("right")
    for r in good.groupBy("lang").agg(F.avg("ce").alias("mean")).collect():
        model.mean[r["lang"]] = r["mean"]
    if not model.mean:
        return
    means = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in model.mean.items()])
    smooth = (F.col("ce") * F.col("chars") + means * PSEUDO_CHARS) / (F.col("chars") + PSEUDO_CHARS)
    hist = good.groupBy("lang", F.floor(smooth / STEP).alias("bin")).count().collect()
    for name in model.mean:
        bins = sorted((r["bin"], r["count"]) for r in hist if r["lang"] == name)
        left, total = 0, sum(c for _, c in bins)
        for b, c in bins:
            left += c
            if left >= (1 - FALSE_REJECTS) * total:
                model.threshold[name] = (b + 1) * STEP + MARGIN
                break


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc_id, lang_pred, score, rejected, cross_entropy`` for every row.

    A null text or one without letters is ``und`` with score 0 and rejected, and so is
    every text if no language was learned.  Equal cross-entropies go to the
    first language in name order.  ``keep`` names further columns to pass on.
    """
    kept = [c for c in keep or [] if c != id_col]
    source = {c: "text" if c == text_col else f"k_{c}" for c in kept}
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), *[F.col(c).alias(k) for c, k in source.items() if k != "text"])
    id_type = dict(rows.dtypes)["_id"]

    def run(m, part):
        n_rows = part.num_rows
        if m.langs:
            ce, n = m.cross_entropy(part.column("text").to_pylist())
        else:
            ce, n = np.zeros((1, n_rows)), np.zeros(n_rows, np.int64)
        best, low = np.argmin(ce, axis=0), ce.min(axis=0)
        score = 1.0 / np.exp(-m.temperature * (ce - low)).sum(axis=0)
        names = [m.langs[b] if k else "und" for b, k in zip(best, n)]
        smooth = [(c * k + m.mean.get(x, c) * PSEUDO_CHARS) / (k + PSEUDO_CHARS) for c, k, x in zip(low, n, names)]
        reject = [k == 0 or s > m.threshold.get(x, np.inf) for s, k, x in zip(smooth, n, names)]
        whole = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        out = {"doc_id": whole(part.column("_id")), "lang_pred": pa.array(names, pa.string()), "score": np.where(n > 0, score, 0.0),
               "rejected": pa.array(reject, pa.bool_()), "cross_entropy": low}
        for c in kept:
            out[f"k_{c}"] = whole(part.column(source[c]))
        return pa.record_batch(out)

    schema = f"doc_id {id_type}, lang_pred string, score double, rejected boolean, cross_entropy double"
    schema += "".join(f", `k_{c}` {dict(rows.dtypes)[source[c]]}" for c in kept)
    done = _with_model(rows, model, run, schema, ["_id", "text"])
    return done.select("doc_id", "lang_pred", "score", "rejected", "cross_entropy", *[F.col(f"k_{c}").alias(c) for c in kept])


def fit_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id") -> LanguageModel:
    """Model of a documents table; ``held_out`` rows teach nothing."""
    fold = F.coalesce(F.floor(F.crc32(F.col(id_col).cast("string")) / 5) % CALIBRATION_PARTS, F.lit(1))
    return train(docs.where(~F.coalesce(held_out, F.lit(False))), F.col("lang"), F.col("text"), fold == 0)
