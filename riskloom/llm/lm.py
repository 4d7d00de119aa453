"""Language-model scoring by deleted interpolation of word bigrams.

``P(w | v) = l2(b) c(v,w)/c(v) + l1(b) c(w)/N + l0(b)/(V+1)``, with weights for each
bucket ``b`` of the context frequency ``c(v)`` (powers of two).  The context of a
first word is the end token.

Counts never pass the driver.  Documents are dealt to blocks; a block sends each of
its distinct words and bigrams once, with its count, to the task of its hash
range, which adds up all blocks and answers every block in the order of its own
sorted keys, so an answer is just an array of totals.  Frequent words cost one
entry per block, like any other.

Weights: a tenth of the training documents is deleted from the counts in turn for
learning them; expectation-maximisation runs on the held-out events, summed
into bins of (bucket, bigram frequency, word frequency), whose number is bounded.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import mix, parallelism, stored, text_buffer, word_hashes

BLOCK_BYTES = 12 << 20
RANGE_BYTES = 8 << 20       # text bytes whose keys one hash range serves
FOLD = 10                   # one of so many training documents is held out for the weights
BUCKETS = 48
STEPS = 16                  # bins per doubling of a frequency
NONE = 0xFFFF               # bin of a frequency that is zero
ROUNDS = 60
END = np.uint64(0x5BD1E9955BD1E995)
LEARN, TUNE, HELD = 0, 1, 2


def block_tokens(arr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens (an end token closes each text), the contexts, and
    where each text's tokens begin (texts + 1)."""
    raw, off = text_buffer(arr)
    words, first = word_hashes(raw, off)
    rows = len(first) - 1
    start = first + np.arange(rows + 1)
    token = np.full(start[-1], END, np.uint64)
    inner = np.ones(len(token), bool)
    inner[start[1:] - 1] = False
    token[inner] = words
    context = np.empty_like(token)
    if len(token):
        context[0], context[1:] = END, token[:-1]
    return token, context, start


def _keys(token: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of words (highest bit set) and bigrams."""
    word = mix(token) >> np.uint64(1) | np.uint64(1 << 63)
    return word, mix(context * np.uint64(0x9E3779B97F4A7C15) + mix(token)) >> np.uint64(1)


def _by_range(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted ``keys`` by hash range (ascending inside each), and the cuts."""
    part = (keys % np.uint64(ranges)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(ranges + 1))


def _ask(ranges: int):
    """One block's distinct keys with their counts, per hash range."""
    def run(table):
        role, block = table.column("role")[0].as_py(), table.column("block")[0].as_py()
        token, context, _ = block_tokens(table.column("text"))
        out = {"range": [], "keys": [], "counts": []}
        for kind in _keys(token, context):
            keys, counts = np.unique(kind, return_counts=True)
            order, cuts = _by_range(keys, ranges)
            keys, counts = keys[order], counts[order].astype(np.uint32)
            for i in np.flatnonzero(np.diff(cuts)):
                out["range"].append(int(i))
                out["keys"].append(keys[cuts[i]:cuts[i + 1]].tobytes())
                out["counts"].append(counts[cuts[i]:cuts[i + 1]].tobytes() if role != HELD else b"")
        n = len(out["range"])
        return pa.table({"range": pa.array(out["range"], pa.int32()), "block": pa.array([block] * n, pa.int64()), "role": pa.array([role] * n, pa.int32()),
                         "keys": pa.array(out["keys"], pa.binary()), "counts": pa.array(out["counts"], pa.binary())})
    return run


def _answer(table):
    """Adds up one hash range; answers each blob with totals in its key order.
    Two more rows (block -1) tell distinct words and tokens, of all and of the tuning part."""
    roles = table.column("role").to_numpy()
    keys = [np.frombuffer(k.as_py(), np.uint64) for k in table.column("keys")]
    sizes = np.array([len(k) for k in keys])
    counts = [np.frombuffer(c.as_py(), np.uint32) if r != HELD else np.zeros(n, np.uint32) for c, r, n in zip(table.column("counts"), roles, sizes)]
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.concatenate(counts).astype(np.float64)
    total = np.bincount(inverse, count, len(distinct)).astype(np.uint64)
    tune = np.bincount(inverse, count * np.repeat(roles == TUNE, sizes), len(distinct)).astype(np.uint64)
    word = distinct >= np.uint64(1 << 63)
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    out_total = [total[inverse[a:b]].tobytes() for a, b in zip(cuts, cuts[1:])]
    out_tune = [tune[inverse[a:b]].tobytes() if r == TUNE else b"" for a, b, r in zip(cuts, cuts[1:], roles)]
    seen = np.array([(total[word] > 0).sum(), total[word].sum(), tune[word].sum()], np.uint64)
    first = np.array([k[0] >> np.uint64(63) for k in keys], np.int32)
    return pa.table({
        "block": pa.concat_arrays([table.column("block").combine_chunks(), pa.array([-1], pa.int64())]),
        "range": pa.concat_arrays([table.column("range").combine_chunks(), pa.array([-1], pa.int32())]),
        "kind": pa.array([*first.tolist(), 2], pa.int32()),
        "total": pa.array([*out_total, seen.tobytes()], pa.binary()), "tune": pa.array([*out_tune, b""], pa.binary())})


def _block_counts(texts, answers, ranges: int, column: str = "total"):
    """Tokens of a block with their totals: (start, word index, bigram index, context
    index, word totals, bigram totals).  A context's total is its word total."""
    token, context, start = block_tokens(texts)
    found = {(r, k): v for r, k, v in zip(answers.column("range").to_pylist(), answers.column("kind").to_pylist(), answers.column(column))}
    out = []
    for kind, keys in zip((1, 0), _keys(token, context)):
        distinct, inverse = np.unique(keys, return_inverse=True)
        order, cuts = _by_range(distinct, ranges)
        totals = np.zeros(len(distinct), np.float64)
        for i in np.flatnonzero(np.diff(cuts)):
            totals[order[cuts[i]:cuts[i + 1]]] = np.frombuffer(found[int(i), kind].as_py(), np.uint64)
        out.append(totals[inverse])
    word, pair = out
    before = np.empty_like(word)
    if len(word):
        ends = word[start[1:] - 1]                  # the end token's total, the same everywhere
        before[1:] = word[:-1]
        before[start[:-1]] = ends
    return start, word, pair, before


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2(count))."""
    return np.where(context > 0, np.minimum(1 + np.floor(np.log2(np.maximum(context, 1))), BUCKETS - 1), 0).astype(np.int64)


def _bins(freq: np.ndarray) -> np.ndarray:
    """Bins of relative frequencies, STEPS per doubling; NONE for zero."""
    return np.where(freq > 0, np.round(-np.log2(np.where(freq > 0, freq, 1)) * STEPS), NONE).astype(np.int64)


def learn_weights(bins: np.ndarray, n: np.ndarray, vocabulary: int) -> np.ndarray:
    """(BUCKETS, 3) weights of bigram, word and uniform estimates by
    expectation-maximisation; ``bins`` are codes of (bucket, bigram bin, word bin)."""
    bucket, two, one = bins >> 32, bins >> 16 & 0xFFFF, bins & 0xFFFF
    back = lambda b: np.where(b == NONE, 0.0, 2.0 ** (-b / STEPS))
    p = np.stack([back(two), back(one), np.full(len(bins), 1.0 / (vocabulary + 1))], axis=1)
    # one event per estimate keeps all weights positive and covers empty buckets
    weight = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    weight[0] = [0.0, 0.7, 0.3]
    prior = np.where(weight > 0, 1.0 / 3, 0.0)
    for _ in range(ROUNDS):
        joint = weight[bucket] * p
        share = joint / joint.sum(axis=1, keepdims=True) * n[:, None]
        events = prior + np.stack([np.bincount(bucket, share[:, i], BUCKETS) for i in range(3)], axis=1)
        weight = events / events.sum(axis=1, keepdims=True)
    return weight


def score(docs: DataFrame, held_out: Column, fold: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row.

    The rows that ``held_out`` does not hold for are the corpus; those with
    ``fold`` 0 also tune the weights.  Words are split at ASCII white space, A-Z
    lower-cased; a null text is empty and has the end token alone.  Repeated rows
    count and are returned each; an empty table gives no rows.  With an empty corpus the model is uniform.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.when(F.coalesce(held_out, F.lit(False)), HELD).when(fold == 0, TUNE).otherwise(LEARN).alias("role"))
    id_type = dict(rows.dtypes)["doc_id"]
    sizes = {r["role"]: r["bytes"] for r in rows.groupBy("role").agg(F.sum(F.octet_length("text") + 1).alias("bytes")).collect()}
    blocks = {role: max(1, math.ceil(sizes.get(role, 0) / BLOCK_BYTES)) for role in (LEARN, TUNE, HELD)}
    ranges = max(parallelism(spark), math.ceil(sum(sizes.values()) / RANGE_BYTES))
    count = F.when(F.col("role") == HELD, blocks[HELD]).when(F.col("role") == TUNE, blocks[TUNE]).otherwise(blocks[LEARN])
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), count) * 3 + F.col("role"))

    asked = dealt.groupBy("block").applyInArrow(_ask(ranges), "range int, block long, role int, keys binary, counts binary")
    answers = stored(asked.groupBy("range").applyInArrow(_answer, "block long, range int, kind int, total binary, tune binary"))
    seen = np.zeros(3)
    for r in answers.where("block = -1").select("total").collect():
        seen += np.frombuffer(bytes(r["total"]), np.uint64)
    vocabulary, tokens, tuned = int(seen[0]), int(seen[1]), int(seen[2])

    def tune(left, right):
        code = np.zeros(0, np.int64)
        if left.num_rows:
            _, word, pair, before = _block_counts(left.column("text"), right, ranges)
            _, word_t, pair_t, before_t = _block_counts(left.column("text"), right, ranges, "tune")
            word, pair, before = word - word_t, pair - pair_t, before - before_t
            two = pair / np.maximum(before, 1)
            one = word / max(tokens - tuned, 1)
            code = _bucket(before) << 32 | _bins(two) << 16 | _bins(one)
        keys, n = np.unique(code, return_counts=True)
        return pa.table({"code": keys, "n": n})

    answered = answers.where("block >= 0")
    bins = (dealt.where(F.col("role") == TUNE).groupBy("block").cogroup(answered.where(F.col("block") % 3 == TUNE).groupBy("block"))
            .applyInArrow(tune, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow().to_pandas())
    weights = learn_weights(bins["code"].to_numpy().astype(np.int64), bins["n"].to_numpy().astype(float), vocabulary)

    def final(left, right):
        if not left.num_rows:
            left = left.slice(0, 0)
        start, word, pair, before = _block_counts(left.column("text"), right, ranges)
        w = weights[_bucket(before)]
        p = w[:, 0] * pair / np.maximum(before, 1) + w[:, 1] * word / max(tokens, 1) + w[:, 2] / (vocabulary + 1)
        if not tokens:
            p = np.ones(len(word))
        base = np.log10((word + 1) / (tokens + vocabulary + 1))
        add = lambda x: np.add.reduceat(x, start[:-1]) if len(start) > 1 else np.zeros(0)  # noqa: E731  every text has a token
        return pa.table({"doc_id": left.column("doc_id"), "held_out": pa.array(left.column("role").to_numpy() == HELD, pa.bool_()),
                         "n_tokens": np.diff(start), "n_known": add((word > 0).astype(np.int64)),
                         "train_tokens": np.full(len(start) - 1, tokens, np.int64), "base_score": add(base), "score": add(np.log10(p))})

    return (dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(
        final, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
