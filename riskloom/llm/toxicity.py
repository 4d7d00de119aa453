"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

Every word enters as two vectors: one of the word itself (hashed) and the mean of those of its character
3- and 5-grams with word borders, so unseen forms of known insults are recognised.
Two gated recurrent layers read a window of ``WINDOW_WORDS`` words forwards and backwards, attention pools
their states, and a logistic output scores the window.  A text is read in overlapping windows,
one every ``STRIDE`` words to its end, and its score is the calibrated score of its worst window.

Training runs in numpy on the driver, on a bounded sample of labelled texts (``SAMPLE_TOXIC``,
``SAMPLE_CLEAN`` and ``SAMPLE_BYTES``).  Labels mark texts, not windows: each round scores all windows of the
sample, takes the worst window of every text (and a random one of clean texts) as its example,
and takes gradient steps on these, hiding half of the word vectors so that characters are learned too.  Word and character vectors start from the log-odds of
their words and n-grams.  A fifth of the sample calibrates.  Scoring is one pass over the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import WINDOW, lowered, mix, row_groups, share, span_hashes, text_buffer, unpacked

WINDOW_WORDS = 32
STRIDE = 24
HIDDEN = 12                # units of each direction
ATTENTION = 8
WORD_DIM, CHAR_DIM = 6, 6
WORD_BUCKETS = 1 << 15
CHAR_BUCKETS = 1 << 15
ORDERS = (3, 5)            # character n-grams, word borders included
SAMPLE_TOXIC = 1200        # labelled texts that training may see
SAMPLE_CLEAN = 2400
SAMPLE_BYTES = 8192        # longest of them
ROUNDS = 5
PASSES = 2                 # over the examples of a round
BATCH = 256
RATE = 0.01                # of the network, by Adam
VECTOR_RATE = 0.05         # of word and character vectors, by Adagrad
BATCH_WINDOWS = 1024       # windows scored at once
UNKNOWN = 0.5              # share of words that a training step knows by their characters alone
THRESHOLD = 0.3
SEED = 5


def words_of(arr) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with A-Z lower-cased, start, end, first word of each text and the end): words are runs of
    ASCII letters and bytes above 127."""
    raw, off = text_buffer(arr)
    raw = lowered(raw)
    letter = np.zeros(256, bool)
    letter[97:123] = letter[128:] = True
    inside = letter[raw]
    border = np.zeros(len(raw) + 1, bool)
    border[off] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | border[1:-1]
    end[:-1] &= ~inside[1:] | border[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return raw, start, end, np.searchsorted(start, off)


def grams_of(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first gram of each word and the end, buckets) of the words' character n-grams."""
    size = end - start + 2                                   # with a border byte at both ends
    at = np.concatenate(([0], np.cumsum(size)))
    text = np.full(at[-1] + 8, 1, np.uint8)
    inner = np.repeat(at[:-1] + 1 - np.concatenate(([0], np.cumsum(end - start)))[:-1], end - start) + np.arange((end - start).sum())
    text[inner] = raw[np.repeat(start - np.concatenate(([0], np.cumsum(end - start)))[:-1], end - start) + np.arange((end - start).sum())]
    eight = np.lib.stride_tricks.sliding_window_view(text, 8)[:at[-1]].copy().view("<u8").ravel()
    counts = [np.maximum(size - n + 1, 0) for n in ORDERS]
    first = np.concatenate(([0], np.cumsum(sum(counts))))
    out = np.empty(first[-1], np.int64)
    done = np.zeros(len(size), np.int64)
    for n, count in zip(ORDERS, counts):
        within = np.arange(count.sum()) - np.repeat(np.concatenate(([0], np.cumsum(count)))[:-1], count)
        gram = eight[np.repeat(at[:-1], count) + within] & np.uint64((1 << 8 * n) - 1)
        out[np.repeat(first[:-1] + done, count) + within] = (mix(gram + np.uint64(n << 56)) % np.uint64(CHAR_BUCKETS)).astype(np.int64)
        done += count
    return first, out


def window_starts(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word within it) of all windows of texts with ``n`` words: one every STRIDE words,
    until a window reaches the end.  A text without words has none."""
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW_WORDS) // STRIDE)), 0)
    text = np.repeat(np.arange(len(n)), count)
    return text, (np.arange(count.sum()) - np.repeat(np.concatenate(([0], np.cumsum(count)))[:-1], count)) * STRIDE


class Words:
    """Distinct words of some texts, and each text's words as their numbers."""

    def __init__(self, arr):
        raw, start, end, self.first = words_of(arr)
        key, head, self.word = np.unique(span_hashes(raw, start, end), return_index=True, return_inverse=True)
        self.bucket = (key % np.uint64(WORD_BUCKETS)).astype(np.int64)
        self.gram_first, self.grams = grams_of(raw, start[head], end[head])
        self.text, at = window_starts(np.diff(self.first))
        self.begin = self.first[self.text] + at

    def windows(self, pick) -> np.ndarray:
        """(windows, WINDOW_WORDS) numbers of words; behind the text's end: one past the last word."""
        at = self.begin[pick][:, None] + np.arange(WINDOW_WORDS)
        stop = self.first[self.text[pick] + 1][:, None]
        padded = np.append(self.word, len(self.bucket))
        return np.where(at < stop, padded[np.minimum(at, len(self.word))], len(self.bucket))


def _gate(x: np.ndarray) -> np.ndarray:
    """A line between 0 and 1 in place of the logistic curve."""
    np.maximum(x, 0, out=x)
    return np.minimum(x, 1, out=x)


def _curve(x: np.ndarray) -> np.ndarray:
    """An odd rational curve close to tanh that reaches 1 with slope 0 at 3."""
    x = np.minimum(np.maximum(x, -3), 3)
    s = x * x
    return x * (27 + s) / (27 + 9 * s)


def _slope(x: np.ndarray) -> np.ndarray:
    """Slope of ``_curve``."""
    s = np.minimum(x * x, 9)
    return ((9 - s) / (9 + 3 * s)) ** 2


def _sums(rows: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sums of their rows)."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate((key[:1] == key[:1], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(rows[order], first, axis=0) if len(first) else rows[:0]


class Net:
    """The network; ``p`` holds its parameters by name.  Arrays of a window batch have the windows last."""

    def __init__(self, seed: int = SEED, kind=np.float32):
        rng = np.random.default_rng(seed)
        dim, h = WORD_DIM + CHAR_DIM, HIDDEN
        make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(kind)
        self.p = {"words": (0.05 * rng.standard_normal((WORD_BUCKETS, WORD_DIM))).astype(kind), "chars": (0.05 * rng.standard_normal((CHAR_BUCKETS, CHAR_DIM))).astype(kind),
                  "A": make(2 * h, ATTENTION), "c": np.zeros(ATTENTION, kind), "v": make(ATTENTION), "w": make(2 * h), "o": np.zeros(1, kind)}
        for d in "fb":
            self.p |= {f"W{d}": make(dim, 3 * h), f"B{d}": np.zeros(3 * h, kind), f"U{d}": make(h, 3 * h)}
            self.p[f"W{d}"][:, :2 * h] *= 0.25               # a logistic curve's slope at 0
            self.p[f"U{d}"][:, :2 * h] *= 0.25
            self.p[f"B{d}"][:2 * h] = 0.5
        self.slope, self.shift, self.constant = 1.0, 0.0, None

    def inputs(self, bucket: np.ndarray, first: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """(words, WORD_DIM + CHAR_DIM)."""
        chars = np.add.reduceat(self.p["chars"][grams], first[:-1]) / np.diff(first)[:, None] if len(bucket) else np.zeros((0, CHAR_DIM))
        return np.concatenate([self.p["words"][bucket], chars.astype(self.p["words"].dtype)], axis=1)

    def project(self, x: np.ndarray) -> dict:
        """What the words ``x`` add to the gates of either direction."""
        return {d: x @ self.p[f"W{d}"] + self.p[f"B{d}"] for d in "fb"}

    def forward(self, projected: dict, windows: np.ndarray, keep: bool = False):
        """Logit of each window over projected words; with ``keep`` also what ``backward`` needs."""
        p, h, n = self.p, HIDDEN, len(windows)
        kind = p["o"].dtype
        size = (windows < len(projected["f"])).sum(axis=1)
        order = np.argsort(-size, kind="stable")             # longest first: a step's live windows come first
        steps = np.ascontiguousarray(windows[order].T)
        live = [int(k) for k in np.searchsorted(-size[order], -np.arange(WINDOW_WORDS), side="left")]
        states = np.zeros((WINDOW_WORDS, 2 * h, n), kind)
        kept = {}
        for d, walk in (("f", range(WINDOW_WORDS)), ("b", range(WINDOW_WORDS - 1, -1, -1))):
            again = np.ascontiguousarray(p[f"U{d}"].T)
            state, side = np.zeros((h, n), kind), slice(0, h) if d == "f" else slice(h, 2 * h)
            for t in walk:
                m = live[t]
                if not m:
                    continue
                before = state[:, :m]
                a, u = np.ascontiguousarray(projected[d].take(steps[t, :m], axis=0).T), again @ before
                gates = _gate(a[:2 * h] + u[:2 * h])
                z, r = gates[:h], gates[h:]
                into = a[2 * h:] + r * u[2 * h:]
                new = _curve(into)
                after = new + z * (before - new)
                if keep:
                    kept[d, t] = before.copy(), z, r, into, new, u[2 * h:]
                state[:, :m] = after
                states[t, side, :m] = after
        real = np.arange(WINDOW_WORDS)[:, None] < size[order]
        into = p["A"].T @ states + p["c"][:, None]
        look = _curve(into)
        energy = np.where(real, np.einsum("k,tkn->tn", p["v"], look), -1e9)
        weight = np.exp(energy - energy.max(axis=0)) * real
        weight = (weight / weight.sum(axis=0)).astype(kind)
        pooled = np.einsum("tn,thn->hn", weight, states)
        logit = np.empty(n, kind)
        logit[order] = p["w"] @ pooled + p["o"][0]
        return (logit, (order, steps, live, states, kept, into, look, weight, pooled)) if keep else logit

    def backward(self, x: np.ndarray, grad: np.ndarray, saved) -> tuple[dict, np.ndarray]:
        """(gradients by parameter but the word and character vectors, gradient of x) for ``grad`` of the logits."""
        p, h = self.p, HIDDEN
        order, steps, live, states, kept, into, look, weight, pooled = saved
        grad = grad[order]
        kind, n = p["o"].dtype, len(grad)
        g = {"w": pooled @ grad, "o": np.array([grad.sum()], kind)}
        of_pooled = p["w"][:, None] * grad
        of_weight = np.einsum("hn,thn->tn", of_pooled, states)
        of_energy = weight * (of_weight - (weight * of_weight).sum(axis=0))
        of_look = of_energy[:, None, :] * p["v"][:, None] * _slope(into)
        g["v"] = np.einsum("tn,tkn->k", of_energy, look)
        g["A"] = np.einsum("thn,tkn->hk", states, of_look)
        g["c"] = of_look.sum(axis=(0, 2))
        of_states = weight[:, None, :] * of_pooled + p["A"] @ of_look
        of_x = np.zeros(x.shape, kind)
        for d, walk in (("f", range(WINDOW_WORDS - 1, -1, -1)), ("b", range(WINDOW_WORDS))):
            side = slice(0, h) if d == "f" else slice(h, 2 * h)
            of_steps = np.zeros((WINDOW_WORDS, 3 * h, n), kind)
            g[f"U{d}"] = np.zeros_like(p[f"U{d}"])
            carry = np.zeros((h, n), kind)
            for t in walk:
                m = live[t]
                if not m:
                    continue
                before, z, r, into, new, un = kept[d, t]
                total = carry[:, :m] + of_states[t, side, :m]
                of_new = total * (1 - z) * _slope(into)
                of_z = total * (before - new) * ((z > 0) & (z < 1))
                of_r = of_new * un * ((r > 0) & (r < 1))
                of_u = np.concatenate([of_z, of_r, of_new * r])
                of_steps[t, :, :m] = np.concatenate([of_z, of_r, of_new])
                g[f"U{d}"] += before @ of_u.T
                carry[:, :m] = total * z + p[f"U{d}"] @ of_u
            word, own = _sums(of_steps.transpose(0, 2, 1).reshape(-1, 3 * h), steps.ravel())
            word, own = word[word < len(x)], own[word < len(x)]
            g[f"W{d}"] = x[word].T @ own
            g[f"B{d}"] = own.sum(axis=0)
            of_x[word] += own @ p[f"W{d}"].T
        return g, of_x

    def gradients(self, own: Words, windows: np.ndarray, target: np.ndarray, unknown: np.ndarray | None = None) -> tuple[dict, dict]:
        """Gradients of the mean cross-entropy of some windows: {parameter: gradient} and, for the
        word and character vectors, {parameter: (rows, their gradients)}.  ``unknown`` marks words that
        are to be known by their characters alone."""
        used, inner = np.unique(windows, return_inverse=True)
        real = used[used < len(own.bucket)]
        size = np.diff(own.gram_first)[real]
        first = np.concatenate(([0], np.cumsum(size)))
        grams = own.grams[np.repeat(own.gram_first[:-1][real] - first[:-1], size) + np.arange(first[-1])]
        x = self.inputs(own.bucket[real], first, grams)
        known = np.ones((len(real), 1), x.dtype) if unknown is None else (~unknown[real])[:, None].astype(x.dtype)
        x[:, :WORD_DIM] *= known
        logit, saved = self.forward(self.project(x), inner.reshape(windows.shape), keep=True)
        g, of_x = self.backward(x, ((1 / (1 + np.exp(-logit)) - target) / len(target)).astype(x.dtype), saved)
        rows = {"words": _sums(of_x[:, :WORD_DIM] * known, own.bucket[real]),
                "chars": _sums(np.repeat(of_x[:, WORD_DIM:] / size[:, None], size, axis=0), grams)}
        return g, rows

    def window_logits(self, own: Words) -> np.ndarray:
        words = self.project(self.inputs(own.bucket, own.gram_first, own.grams))
        parts = [self.forward(words, own.windows(slice(at, at + BATCH_WINDOWS))) for at in range(0, len(own.begin), BATCH_WINDOWS)]
        return np.concatenate(parts) if parts else np.zeros(0, self.p["o"].dtype)

    def worst(self, own: Words) -> np.ndarray:
        """Largest window logit of each text; a text without words: -inf."""
        out = np.full(len(own.first) - 1, -np.inf)
        np.maximum.at(out, own.text, self.window_logits(own).astype(float))
        return out

    def score(self, arr) -> np.ndarray:
        """Scores of an Arrow string array; a null text or one without words: 0."""
        own = Words(arr)
        has = np.diff(own.first) > 0
        if self.constant is not None:
            return np.where(has, self.constant, 0.0)
        out = np.zeros(len(has))
        z = self.slope * self.worst(own)[has] + self.shift
        out[has] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return out


def _log_odds(entry: np.ndarray, text: np.ndarray, y: np.ndarray, buckets: int) -> np.ndarray:
    """How much likelier an entry is in toxic texts, by presence in texts, clipped to 4."""
    pair = np.unique(entry * len(y) + text)
    entry, toxic = pair // len(y), y[pair % len(y)] > 0
    a = (np.bincount(entry[toxic], minlength=buckets) + 0.5) / (y.sum() + 1)
    b = (np.bincount(entry[~toxic], minlength=buckets) + 0.5) / ((1 - y).sum() + 1)
    few = np.bincount(entry, minlength=buckets)
    return np.clip(np.log(a / b), -4, 4) * few / (few + 3.0)


def train(texts, y: np.ndarray, share_toxic: float, seed: int = SEED) -> Net:
    """A network for 0/1 marks ``y`` of an Arrow string array; ``share_toxic`` is the share of marked
    texts that the scores assume.  Without texts of both classes: a constant score."""
    net, rng = Net(seed), np.random.default_rng(seed)
    own = Words(texts)
    calibrates = np.arange(len(y)) % 5 == 4
    learn = ~calibrates & (np.diff(own.first) > 0)
    if not len(y) or y[learn].min(initial=1) == y[learn].max(initial=0):
        net.constant = share_toxic
        return net
    # vectors start from the log-odds of learning texts
    text_of_word = np.repeat(np.arange(len(y)), np.diff(own.first))
    use = learn[text_of_word]
    net.p["words"][:, 0] = _log_odds(own.bucket[own.word[use]], text_of_word[use], y, WORD_BUCKETS)
    distinct = np.unique(own.word[use] * len(y) + text_of_word[use])
    word, text = distinct // len(y), distinct % len(y)
    size = np.diff(own.gram_first)[word]
    at = np.repeat(own.gram_first[word] - np.concatenate(([0], np.cumsum(size)))[:-1], size) + np.arange(size.sum())
    net.p["chars"][:, 0] = _log_odds(own.grams[at], np.repeat(text, size), y, CHAR_BUCKETS)
    first = {k: np.zeros_like(v) for k, v in net.p.items() if k not in ("words", "chars")}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    # before the first round, the window with the largest input log-odds is the worst
    lead = net.inputs(own.bucket, own.gram_first, own.grams)
    lead = np.append(lead[:, 0] + 2 * lead[:, WORD_DIM], 0)
    value = np.concatenate([lead[own.windows(slice(a, a + BATCH_WINDOWS))].max(axis=1) for a in range(0, len(own.begin), BATCH_WINDOWS)])
    of_text, t = own.text, 0
    for round_ in range(ROUNDS):
        if round_:
            value = net.window_logits(own)
        by = np.lexsort((-value, of_text))
        head = by[np.concatenate(([True], of_text[by][1:] != of_text[by][:-1]))]
        clean = np.flatnonzero(learn[of_text] & (y[of_text] == 0))
        extra = rng.choice(clean, min(len(clean), int((learn & (y == 0)).sum())), replace=False)
        pick = np.concatenate([head[learn[of_text[head]]], extra])
        for _ in range(PASSES):
            rng.shuffle(pick)
            for a in range(0, len(pick), BATCH):
                part = pick[a:a + BATCH]
                g, rows = net.gradients(own, own.windows(part), y[of_text[part]], rng.random(len(own.bucket)) < UNKNOWN)
                norm = np.sqrt(sum(float((v.astype(float) ** 2).sum()) for v in [*g.values(), *(v for _, v in rows.values())]))
                t += 1
                for k, v in g.items():
                    v = v * min(1.0, 1.0 / (norm + 1e-12))
                    first[k] += 0.1 * (v - first[k])
                    second[k] += 0.001 * (v * v - second[k])
                    net.p[k] -= RATE * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)
                for k, (at, v) in rows.items():                  # only the vectors that the batch holds
                    second[k][at] += v * v
                    net.p[k][at] -= VECTOR_RATE * v / (np.sqrt(second[k][at]) + 1e-6)
    worst = net.worst(own)
    check = calibrates & np.isfinite(worst)
    net.slope, net.shift = _calibrate(worst[check], y[check])
    # the sample's classes are not in their true proportion
    prior = np.clip(share_toxic, 1e-6, 1 - 1e-6)
    net.shift += float(np.log(prior / (1 - prior)) - np.log(max(y.sum(), 0.5) / max((1 - y).sum(), 0.5)))
    return net


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit, drawn a little towards (1, 0) so that separable marks stay finite."""
    a, b = 1.0, 0.0
    for _ in range(50 if len(z) else 0):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        w = p * (1 - p)
        grad = np.array([((p - y) * z).sum() + (a - 1), (p - y).sum() + b])
        hess = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1]])
        step = np.linalg.solve(hess, grad)
        step /= max(1.0, float(np.abs(step).max()))
        a, b = a - step[0], b - step[1]
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Net:
    """Train on labelled rows for which ``use`` holds: at most SAMPLE_TOXIC and SAMPLE_CLEAN of them, by smallest
    id hash, with texts of 1 to SAMPLE_BYTES bytes.  Null labels and labels without a document are ignored; an id with
    several labels or texts gives an example for each, within the same bounds."""
    marked = labels.where(use).where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("lid"), (F.col(label_col) > 0).cast("int").alias("y"))
    part = lambda y, n: marked.where(F.col("y") == y).orderBy(F.xxhash64("lid"), "lid").limit(n)
    chosen = part(1, SAMPLE_TOXIC).unionByName(part(0, SAMPLE_CLEAN))
    rows = docs.select(F.col(id_col).alias("lid"), F.col(text_col).alias("text")).where(F.octet_length("text").between(1, SAMPLE_BYTES))
    got = rows.join(F.broadcast(chosen), "lid").orderBy(F.xxhash64("lid"), "lid", "y", "text").limit(SAMPLE_TOXIC + SAMPLE_CLEAN).toArrow()
    mean = marked.agg(F.avg("y")).first()[0]
    return train(got.column("text"), got.column("y").to_numpy().astype(np.float32), float(mean or 0.0))


def predict(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for every row, repeated rows too; a null text, or one without words, scores 0.
    Extra columns are ignored; an empty table gives no rows."""
    shared = share(docs.sparkSession, net)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            _, off = text_buffer(batch.column("text"))
            for part in row_groups(batch, np.diff(off), WINDOW):
                score = unpacked(shared).score(part.column("text"))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "score": score, "predicted": (score >= THRESHOLD).astype(np.int32)})

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, predicted int")
