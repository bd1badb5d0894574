"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as its hashed embedding beside the mean of the hashed embeddings of its byte 4-grams (word ends
marked). Overlapping windows of `WIDTH` words, `STRIDE` apart, cover all words of a text twice and are all scored;
attention pools the states of both directions within a window, and the highest window gives the text's score.

The network is fitted on the driver on a bounded sample of labelled rows: at most `positives` and `negatives` texts,
chosen by a hash of doc_id, without those of more than `longest` bytes. Sampled texts are taken whole. A text's label goes to
random windows at first, then to the one that the network ranks first (multiple instances); the highest windows of clean texts are taken up again as
hard examples. Everything is seeded, so equal inputs give equal scores.

Defined cases: a null or empty text is one window without words; without labels of both kinds every score is the
share of toxic labels (0 without labels); of several labels of a doc_id the highest counts, of several texts the first in order is learned from; repeated rows are scored
one by one; an empty table gives no rows; extra columns are not read, and one that is kept under the name of a result
column is returned as <name>_kept.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columnar import LOWER, U64, WORD_BY_ALNUM, Texts, Words, slices
from .schema import carried, named, with_fields

WIDTH, STRIDE = 32, 16
POSITIVES, NEGATIVES, LONGEST = 1200, 2400, 1 << 16
STEPS = 360
#: Where a cut is set in the gap between clean and toxic texts of the sample; over a half to spare clean texts.
MARGIN = 0.7
WORD_BITS, GRAM_BITS, DIM, HIDDEN = 14, 15, 8, 8
BLOCK = 1 << 20


def held_out(doc_id: Column, remainder: int = 0) -> Column:
    """crc32 of doc_id as text, modulo 5, is `remainder`; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == remainder, F.lit(False))


class Inputs:
    """Network inputs of texts: hashed words, hashed byte 4-grams of each word, and windows of words."""

    def __init__(self, texts: Texts):
        words = Words(texts, WORD_BY_ALNUM, True)
        self.at = words.at
        self.word = (words.hashes() >> U64(64 - WORD_BITS)).astype(np.uint16)
        data = texts.bytes
        inside = np.zeros(len(data) + 4, bool)
        inside[1:-3] = WORD_BY_ALNUM[LOWER][data]
        padded = np.zeros(len(data) + 4, np.uint32)
        padded[1:-3] = LOWER[data]
        padded[~inside] = 0
        where = np.repeat(words.starts - np.concatenate(([0], np.cumsum(words.ends - words.starts)[:-1])), words.ends - words.starts) if len(words) else np.zeros(0, np.int64)
        where = where + np.arange(len(where))
        last = np.zeros(len(data) + 4, bool)
        last[words.ends] = True  # in padded positions, the last byte of a word
        first = np.zeros(len(data) + 4, bool)
        first[words.starts + 1] = True
        p = where + 1
        before = np.where(first[p], 0, padded[p - 1])
        after = np.where(last[p], 0, padded[p + 1])
        beyond = np.where(last[p] | last[p + 1], 0, padded[np.minimum(p + 2, len(padded) - 1)])
        code = (before << 24 | padded[p] << 16 | after << 8 | beyond).astype(np.uint32)
        self.gram = ((code * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)).astype(np.uint16)
        self.gram_at = np.concatenate(([0], np.cumsum(words.ends - words.starts)))

    @staticmethod
    def of_many(texts: Texts, most: int = BLOCK >> 2) -> Inputs:
        """Built from pieces of about `most` bytes, which keeps the temporary arrays small; no piece is held beside the whole."""
        out = object.__new__(Inputs)
        room, n_words, n_grams, row = len(texts.bytes), 0, 0, 0
        out.at = np.zeros(len(texts) + 1, np.int64)
        # Room for the most that there can be; what stays unused is never touched, and so takes no memory.
        out.word, out.gram = np.empty((room + len(texts)) // 2 + 1, np.uint16), np.empty(room, np.uint16)
        out.gram_at = np.zeros(len(out.word) + 1, np.uint32 if room < 1 << 32 else np.int64)
        while row < len(texts):
            end = min(len(texts), max(row + 1, int(np.searchsorted(texts.offsets, texts.offsets[row] + most))))
            part = Inputs(texts.rows(row, end))
            words, grams = n_words + len(part.word), n_grams + len(part.gram)
            out.at[row + 1 : end + 1] = part.at[1:] + n_words
            out.word[n_words:words], out.gram[n_grams:grams] = part.word, part.gram
            out.gram_at[n_words + 1 : words + 1] = part.gram_at[1:] + n_grams
            n_words, n_grams, row = words, grams, end
        out.word, out.gram, out.gram_at = out.word[:n_words], out.gram[:n_grams], out.gram_at[: n_words + 1]
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, words) of all windows; an empty text has one without words."""
        n = np.diff(self.at)
        each = 1 + np.maximum(0, -(-(n - WIDTH) // STRIDE))
        text = np.repeat(np.arange(len(n)), each)
        step = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
        first = self.at[text] + step * STRIDE
        return text, first, np.minimum(WIDTH, self.at[text + 1] - first)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *shape, scale=0.3: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"word": f(1 << WORD_BITS, DIM, scale=0.05), "gram": f(1 << GRAM_BITS, DIM, scale=0.05)}
        for d in "fb":
            self.p |= {f"x{d}": f(2 * DIM, 3 * HIDDEN), f"u{d}": f(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"wa": f(2 * HIDDEN, HIDDEN), "ba": np.zeros(HIDDEN, np.float32), "va": f(HIDDEN), "wo": f(2 * HIDDEN), "bo": np.zeros(1, np.float32)}
        self.square = {k: np.full_like(v, 1e-7) for k, v in self.p.items()}

    def embed(self, inputs: Inputs, words: np.ndarray | slice) -> np.ndarray:
        """Input vectors of words: word embedding, and mean of the 4-gram embeddings."""
        if isinstance(words, slice):
            grams, at = inputs.gram, inputs.gram_at
            own = inputs.word
        else:
            starts = inputs.gram_at[words].astype(np.int64)
            sizes = inputs.gram_at[words + 1] - starts
            grams, at, own = inputs.gram[_ragged(starts, sizes)], np.concatenate(([0], np.cumsum(sizes))), inputs.word[words]
        if not len(own):
            return np.zeros((0, 2 * DIM), np.float32)
        mean = np.add.reduceat(self.p["gram"][grams], at[:-1], axis=0) / np.diff(at)[:, None].astype(np.float32)
        return np.concatenate((self.p["word"][own], mean), 1)

    def _run(self, d: str, px: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of one direction; px: time, window, 3 * HIDDEN."""
        steps, n, _ = px.shape
        u, out = self.p[f"u{d}"], np.zeros((steps, n, HIDDEN), np.float32)
        h = np.zeros((n, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            hu = h @ u
            zr = _sigmoid(px[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(px[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            after = np.where(mask[t][:, None], new + z * (h - new), h)
            if keep is not None:
                keep.append((t, h, z, r, new, hu[:, 2 * HIDDEN :]))
            out[t] = h = after
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray, cache: dict | None = None) -> np.ndarray:
        """x: time, window, input; mask: time, window."""
        p, (steps, n, _) = self.p, x.shape
        kept: dict[str, list | None] = {d: [] if cache is not None else None for d in "fb"}
        states = np.concatenate([self._run(d, (x.reshape(-1, 2 * DIM) @ p[f"x{d}"] + p[f"c{d}"]).reshape(steps, n, -1), mask, kept[d]) for d in "fb"], 2)
        a = np.tanh(states.reshape(-1, 2 * HIDDEN) @ p["wa"] + p["ba"]).reshape(steps, n, HIDDEN)
        e = np.where(mask, a @ p["va"], -1e9)
        w = np.exp(e - e.max(0, keepdims=True)) * mask
        w /= np.maximum(w.sum(0, keepdims=True), 1e-9)
        pooled = np.einsum("tn,tnh->nh", w, states)
        if cache is not None:
            cache.update(states=states, a=a, w=w, pooled=pooled, kept=kept, x=x, mask=mask)
        return pooled @ p["wo"] + p["bo"][0]

    def gradients(self, cache: dict, d_logit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the parameters above the embeddings, and of x."""
        p, g = self.p, {}
        states, a, w, x, mask = (cache[k] for k in ("states", "a", "w", "x", "mask"))
        steps, n, _ = x.shape
        g["wo"], g["bo"] = d_logit @ cache["pooled"], np.array([d_logit.sum()], np.float32)
        d_pooled = d_logit[:, None] * p["wo"]
        d_states = w[:, :, None] * d_pooled
        d_w = np.einsum("tnh,nh->tn", states, d_pooled)
        d_e = w * (d_w - (w * d_w).sum(0, keepdims=True))
        g["va"] = np.einsum("tn,tnh->h", d_e, a)
        d_a = (d_e[:, :, None] * p["va"] * (1 - a * a)).reshape(-1, HIDDEN)
        g["wa"], g["ba"] = states.reshape(-1, 2 * HIDDEN).T @ d_a, d_a.sum(0)
        d_states = d_states + (d_a @ p["wa"].T).reshape(steps, n, -1)
        d_x = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u = p[f"u{d}"]
            d_h, d_u, d_px = np.zeros((n, HIDDEN), np.float32), np.zeros_like(u), np.zeros((steps, n, 3 * HIDDEN), np.float32)
            for t, before, z, r, new, hun in reversed(cache["kept"][d]):
                m = mask[t][:, None]
                total = d_h + d_states[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                live = total * m
                d_new = live * (1 - z) * (1 - new * new)
                d_pre = np.concatenate((live * (before - new) * z * (1 - z), d_new * hun * r * (1 - r), d_new), 1)
                d_hu = np.concatenate((d_pre[:, : 2 * HIDDEN], d_new * r), 1)
                d_u += before.T @ d_hu
                d_px[t] = d_pre
                d_h = np.where(m, live * z, total) + d_hu @ u.T
            flat = d_px.reshape(-1, 3 * HIDDEN)
            g[f"u{d}"], g[f"x{d}"], g[f"c{d}"] = d_u, x.reshape(-1, 2 * DIM).T @ flat, flat.sum(0)
            d_x += (flat @ p[f"x{d}"].T).reshape(x.shape)
        return g, d_x

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        """Adagrad; rows of embeddings come as (rows, gradients)."""
        for k, v in g.items():
            if isinstance(v, tuple):
                rows, inverse = np.unique(v[0], return_inverse=True)
                v = np.stack([np.bincount(inverse, v[1][:, i], len(rows)) for i in range(v[1].shape[1])], 1).astype(np.float32)
            else:
                rows = slice(None)
            self.square[k][rows] += v * v
            self.p[k][rows] -= (4 * rate if k in ("word", "gram") else rate) * v / np.sqrt(self.square[k][rows])

    def window_inputs(self, inputs: Inputs, first: np.ndarray, size: np.ndarray, vectors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(x, mask, word numbers of the masked places) of windows, time first."""
        steps = max(1, int(size.max(initial=1)))
        index = first + np.arange(steps)[:, None]
        mask = np.arange(steps)[:, None] < size
        x = np.zeros((steps, len(first), 2 * DIM), np.float32)
        live = index[mask]
        x[mask] = self.embed(inputs, live) if vectors is None else vectors[live]
        return x, mask, live

    def score_windows(self, inputs: Inputs, first: np.ndarray, size: np.ndarray, block: int = 2048, together: bool = True) -> np.ndarray:
        """together: the vectors of all words are made at once, not window by window."""
        vectors = self.embed(inputs, slice(None)) if together else None
        out = [self.logits(*self.window_inputs(inputs, first[i : i + block], size[i : i + block], vectors)[:2]) for i in range(0, len(first), block)]
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def train_on(self, inputs: Inputs, first: np.ndarray, size: np.ndarray, y: np.ndarray, rate: float) -> float:
        cache: dict = {}
        x, mask, live = self.window_inputs(inputs, first, size)
        prob = _sigmoid(self.logits(x, mask, cache))
        g, d_x = self.gradients(cache, ((prob - y) / len(y)).astype(np.float32))
        starts = inputs.gram_at[live].astype(np.int64)
        rows, sizes = d_x[mask], inputs.gram_at[live + 1] - starts
        g["word"] = (inputs.word[live], rows[:, :DIM])
        g["gram"] = (inputs.gram[_ragged(starts, sizes)], np.repeat(rows[:, DIM:] / np.maximum(sizes, 1)[:, None], sizes, 0))
        self.step(g, rate)
        return float(-np.mean(np.log(np.where(y > 0.5, prob, 1 - prob) + 1e-9)))


def fit(texts: list[str | None] | pa.Array | pa.ChunkedArray, toxic: list[int], steps: int = STEPS, seed: int = 7) -> Network | float:
    """A network, or the share of toxic texts if only one kind is there."""
    y = np.array(toxic, np.float32)
    if len(set(toxic)) < 2:
        return float(y.mean()) if len(y) else 0.0
    r, net = np.random.default_rng(seed), Network(seed)
    inputs = Inputs.of_many(Texts(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts))
    text, first, size = inputs.windows()
    at = np.searchsorted(text, np.arange(len(y) + 1))
    classes = [np.flatnonzero(y == 0), np.flatnonzero(y == 1)]
    hard, warm = np.zeros(0, np.int64), steps // 3
    for step in range(steps):
        if step and step % (steps // 3) == 0:  # the highest window of each clean text
            own = np.flatnonzero(y[text] == 0)
            logit = net.score_windows(inputs, first[own], size[own], 512, together=False)
            order = np.lexsort((logit, text[own]))
            top = order[np.append(text[own][order][1:] != text[own][order][:-1], True)]
            hard = own[top[np.argsort(-logit[top])[: max(32, len(top) // 4)]]]
        docs = np.concatenate([r.choice(own, 48) for own in classes])
        each = np.minimum(at[docs + 1] - at[docs], 2 if step < warm else 8)
        some = np.repeat(at[docs], each) + (r.random(each.sum()) * np.repeat(at[docs + 1] - at[docs], each)).astype(np.int64)
        group = np.repeat(np.arange(len(docs)), each)
        if step >= warm:  # a text's label goes to the highest of these windows
            logit = net.logits(*net.window_inputs(inputs, first[some], size[some])[:2])
            order = np.lexsort((logit, group))
            some, group = some[order[np.append(group[order][1:] != group[order][:-1], True)]], np.arange(len(docs))
        label = y[docs][group]
        if len(hard):
            more = r.choice(hard, 32)
            some, label = np.concatenate((some, more)), np.concatenate((label, np.zeros(32, np.float32)))
        net.train_on(inputs, first[some], size[some], label, 0.05 if step < steps * 2 // 3 else 0.02)
    logit = np.maximum.reduceat(net.score_windows(inputs, first, size, 512, together=False), at[:-1])
    net.p["bo"] = net.p["bo"] - np.float32(threshold(logit, y))
    return net


def threshold(score: np.ndarray, y: np.ndarray) -> float:
    """A point in the first gap between scores at which a cut makes the fewest errors, both kinds weighed alike."""
    order = np.argsort(score, kind="stable")
    score, y = score[order].astype(np.float64), y[order]
    missed = np.concatenate(([0], np.cumsum(y))) / max(y.sum(), 1)
    false = ((1 - y).sum() - np.concatenate(([0], np.cumsum(1 - y)))) / max((1 - y).sum(), 1)
    cut = int(np.argmin(missed + false))
    below, above = score[max(cut - 1, 0)], score[min(cut, len(score) - 1)]
    return float(below + MARGIN * (above - below))


def score_texts(net: Network | float, texts: Texts) -> np.ndarray:
    """The highest window's probability of each text."""
    if isinstance(net, float):
        return np.full(len(texts), net)
    inputs = Inputs(texts)
    text, first, size = inputs.windows()
    if not len(text):
        return np.zeros(0)
    logit = net.score_windows(inputs, first, size).astype(np.float64)
    return _sigmoid(np.maximum.reduceat(logit, np.searchsorted(text, np.arange(len(texts)))))


def _sample(docs: DataFrame, labels: DataFrame, positives: int, negatives: int, longest: int) -> tuple[pa.ChunkedArray, list[int]]:
    """At most `positives` and `negatives` labelled texts of at most `longest` bytes outside the held-out fifth, by a hash of doc_id."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id", F.lit("toxic")))
    parts = [known.where(F.col("toxic") == kind).orderBy("h", "doc_id").limit(most) for kind, most in ((1, positives), (0, negatives))]
    chosen = parts[0].unionByName(parts[1])
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    short = source.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    found = short.join(F.broadcast(chosen), "doc_id").groupBy("h").agg(F.max("toxic").alias("toxic"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = found.select("h", F.col("toxic").cast("int").alias("toxic"), "text").toArrow().sort_by("h")  # one run of bytes, not an object for each text
    return rows.column("text"), rows.column("toxic").to_pylist()


def training_sample(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, longest: int = LONGEST) -> tuple[list[str], list[int]]:
    """The texts that the network learns from and whether they are toxic, by a hash of doc_id."""
    texts, toxic = _sample(docs, labels, positives, negatives, longest)
    return texts.to_pylist(), toxic


def _give_back() -> None:
    """What freed arrays leave in the allocators goes back to the system; else the driver keeps it as long as it lives."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def _fitted(docs: DataFrame, labels: DataFrame, sample: tuple[int, int, int]) -> Network | float:
    net = fit(*_sample(docs, labels, *sample))
    _give_back()
    return net


def _scored(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...], sample: tuple[int, int, int]) -> DataFrame:
    """The columns `keep` as k_0, k_1, ... and the score."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(_fitted(docs, labels, sample))
    source = carried(docs, keep)
    fields = source.schema.fields[:-1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=BLOCK):
            names = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(score_texts(sent.value, Texts(part.column("text"))), pa.float64())], names=[*names, "score"])

    return source.mapInArrow(run, with_fields(fields, "score double"))


def score_toxicity(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), positives: int = POSITIVES, negatives: int = NEGATIVES, longest: int = LONGEST) -> DataFrame:
    """The columns `keep` and `score`, the probability of toxic = 1, of every text."""
    return named(_scored(docs, labels, keep, (positives, negatives, longest)), keep)


def keep_clean(docs: DataFrame, labels: DataFrame, least: float = 0.5, positives: int = POSITIVES, negatives: int = NEGATIVES, longest: int = LONGEST) -> DataFrame:
    """The rows of docs that score below `least`, with all their columns."""
    keep = tuple(docs.columns)
    return named(_scored(docs, labels, keep, (positives, negatives, longest)).where(F.col("score") < least).drop("score"), keep)
