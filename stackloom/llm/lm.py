"""Language-model scores: a log-bilinear model in two levels, with exact corpus counts below it.

Tokens are the lower-cased words of a text and one end. The first level predicts a token's class from the two tokens
before it: the `TOP` most frequent words and the end are classes of their own, all other words share `SUFFIXES` classes
by their last two bytes. The second level predicts the word within a suffix class from the class before: every word
seen `LEAST` times or more in training, the `WORDS` most frequent ones at most, has a vector of its own; the others of
the class are one member, within which a word has its smoothed share of the training tokens, with room for unknown
words. So the probabilities of all tokens sum to one, and the vocabulary with vectors grows with the corpus until the
tables that are sent to the executors reach their bound ((CLASSES + 1) * (WORDS + SUFFIXES) numbers).

Counting covers all training texts. Each group of texts sends its distinct words with their counts to buckets, which
sum them and answer each group in the order it asked: one packed exchange serves both as the corpus count and as the
join of counts back to texts, and a frequent word is sent once a group. Both levels are trained by noise-contrastive
estimation in numpy, on counts over all training texts: every pass weighs each of them by its count and takes the
expectation over the noise instead of drawing it, so no training token is left out at any size. Matrix products over
all contexts then give the normalised log-probabilities.

Defined cases: a null text is empty and has the end only; a null doc_id is in the training part; without training
texts both scores are finite and nothing is known; very long texts are scored whole; repeated rows are counted and
scored one by one; an empty table gives no rows; extra columns are not read, and one that is kept under the name of a
result column is returned as <name>_kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import checkpointed
from .columnar import LOWER, U64, WORD_BY_SPACE, Texts, Words, slices
from .exchange import buckets_for, packed, scatter, unpack, whole_groups
from .groups import deal, in_order
from .schema import column, named, renamed, with_fields
from .toxicity import held_out

TOP, SUFFIXES, DIM, NOISE = 127, 64, 24, 12
#: Passes over all counted contexts, contexts taken up at once, and steps at least (where there are few contexts).
PASSES, BATCH, LEAST_STEPS = 60, 256, 1500
CLASSES = TOP + SUFFIXES + 1
END, START = CLASSES - 1, CLASSES  # the start is a context only
CONTEXTS = CLASSES + 1
#: Words of suffix classes with vectors: seen so often, so many at most; passes over all counts; how far vectors are held back.
LEAST, WORDS, WORD_DIM, WORD_PASSES, HOLD = 16, 16384, 16, 60, 2.0
#: Bins of word counts, eight to a doubling.
_BINS = 8 * 48

ASKED = "bucket int, src int, h binary, n binary, suffix binary"
ANSWERS = "grp int, bucket int, n binary, often_h binary, often_n binary, often_suffix binary, bins binary, tokens binary, types binary"


def suffix_class(words: Words) -> np.ndarray:
    data = LOWER[words.texts.bytes].astype(np.uint32) if len(words) else np.zeros(1, np.uint32)
    last = data[words.ends - 1]
    second = np.where(words.ends - words.starts > 1, data[np.maximum(words.ends - 2, 0)], 0)
    return (((second << 8 | last).astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(26)).astype(np.uint8)


def _words(table: pa.Table) -> Words:
    return Words(Texts(table.column("text")), WORD_BY_SPACE, True)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> U64(20)) % U64(buckets)


def _bins(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(8 * np.log2(n)).astype(np.int64), _BINS - 1)


def _zipped(bounds: np.ndarray, values: np.ndarray) -> pa.Array:
    """One compressed binary a range; counts are mostly small, and checkpoints are written as they are."""
    return pa.array([zlib.compress(values[a:b].tobytes(), 1) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())


def _answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each word's counts, in the order of each asking row; then class totals and the words seen LEAST times or more."""
    names = ("n", "often_h", "often_n", "often_suffix", "bins", "tokens", "types")
    kinds = pa.schema([("grp", pa.int32()), ("bucket", pa.int32()), *[(k, pa.binary()) for k in names]])
    for table in whole_groups(batches, most=16 << 20):
        h, each = unpack(table.column("h"), U64)
        n, suffix = unpack(table.column("n"), np.uint32)[0], unpack(table.column("suffix"), np.uint8)[0]
        words, first, number = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(number, n, len(words)).astype(U64)
        bounds = np.concatenate(([0], np.cumsum(each)))
        none = [pa.nulls(len(each), pa.binary())] * (len(names) - 1)
        yield pa.RecordBatch.from_arrays([table.column("src").combine_chunks(), table.column("bucket").combine_chunks(), _zipped(bounds, total[number]), *none], schema=kinds)
        kind, known = suffix[first], total > 0
        often = np.flatnonzero(total >= LEAST)
        bins = np.bincount(_bins(total[often]), minlength=_BINS)
        cells = [words[often], total[often], kind[often], bins.astype(np.int64), np.bincount(kind, total, SUFFIXES).astype(np.int64), np.bincount(kind[known], minlength=SUFFIXES).astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([-1], pa.int32()), pa.nulls(1, pa.binary()), *[pa.array([c.tobytes()], pa.binary()) for c in cells]], schema=kinds)


@dataclass
class Vocabulary:
    """Class totals over all training texts, the words that are classes of their own, and those with vectors."""

    top: np.ndarray  # sorted hashes
    top_class: np.ndarray
    words: np.ndarray  # sorted hashes of the words with vectors
    word_kind: np.ndarray  # their suffix classes
    rest_n: np.ndarray  # training tokens of each suffix class, without top words and words with vectors
    rest_types: np.ndarray
    n: int
    types: int

    @property
    def members(self) -> int:
        """Words with vectors, then the rest of each suffix class."""
        return len(self.words) + SUFFIXES

    @property
    def kinds(self) -> np.ndarray:
        """The suffix class of each member."""
        return np.concatenate((self.word_kind.astype(np.int64), np.arange(SUFFIXES)))

    def classes(self, h: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        out = suffix.astype(np.int64) + TOP
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, h), len(self.top) - 1)
            out = np.where(self.top[at] == h, self.top_class[at], out)
        return out

    def member(self, h: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        """Of words in suffix classes."""
        out = suffix.astype(np.int64) + len(self.words)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            out = np.where(self.words[at] == h, at, out)
        return out


def _often(least: int):
    """Of the totals' rows: the words seen `least` times or more."""

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n, kind = (unpack(batch.column(c), k)[0] for c, k in (("often_h", U64), ("often_n", U64), ("often_suffix", np.uint8)))
            own = n >= least
            yield pa.RecordBatch.from_arrays([pa.array(h[own].view(np.int64)), pa.array(n[own].astype(np.int64)), pa.array(kind[own].astype(np.int32))], names=["h", "n", "kind"])

    return pick


def _vocabulary(answers: DataFrame, training_texts: int, most: int = WORDS + TOP) -> Vocabulary:
    """From the totals of all buckets. A histogram of counts tells from which count on there are at most `most` words; only those come here."""
    tokens, types, bins = np.zeros(SUFFIXES, np.int64), np.zeros(SUFFIXES, np.int64), np.zeros(_BINS, np.int64)
    totals = answers.where("grp = -1")
    for row in totals.select("tokens", "types", "bins").toLocalIterator():
        tokens += np.frombuffer(row.tokens, np.int64)
        types += np.frombuffer(row.types, np.int64)
        bins += np.frombuffer(row.bins, np.int64)
    above = np.cumsum(bins[::-1])[::-1]
    fits = int(np.argmax(above <= most)) if (above <= most).any() else _BINS - 1
    least = max(LEAST, int(np.ceil(2 ** (fits / 8))))
    rows = totals.select("often_h", "often_n", "often_suffix").mapInArrow(_often(least), "h long, n long, kind int").collect()
    rows.sort(key=lambda r: (-r.n, r.h))
    all_n, all_types = int(tokens.sum()) + training_texts, int(types.sum()) + (training_texts > 0)
    h, n, kind = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    np.subtract.at(tokens, kind, n)
    np.subtract.at(types, kind, 1)
    top, top_class = _sorted(h[:TOP].view(U64), np.arange(len(h[:TOP])))
    words, word_kind = _sorted(h[TOP:].view(U64), kind[TOP:].astype(np.uint8))
    return Vocabulary(top, top_class, words, word_kind, tokens, types, all_n, all_types)


def _sorted(h: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    return h[order], other[order]


def class_trigrams(words: Words, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, cell of two classes before and own class) of all tokens, ends included; the class before each word."""
    n, counts = len(words.texts), words.counts
    at = words.at[:-1] + np.arange(n)  # each text's tokens start here once ends are put in
    token = np.full(len(words) + n, END)
    own = np.arange(len(words)) + np.repeat(np.arange(n), counts)
    token[own] = classes
    text = np.repeat(np.arange(n), counts + 1)
    number = np.arange(len(token)) - np.repeat(at, counts + 1)
    one = np.where(number > 0, token[np.maximum(np.arange(len(token)) - 1, 0)], START)
    two = np.where(number > 1, token[np.maximum(np.arange(len(token)) - 2, 0)], START)
    return text, (two * CONTEXTS + one) * CLASSES + token, one[own]


_CELLS = CONTEXTS * CONTEXTS * CLASSES


def _counts(docs: DataFrame, vocabulary: Vocabulary, partitions: int) -> tuple[np.ndarray, np.ndarray]:
    """Class trigrams, and class before by member, over all texts of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    parts, members = max(64, partitions), vocabulary.members
    cells = _CELLS + CONTEXTS * members

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, voc = np.zeros(cells, np.uint32), sent.value
        for part in slices(batches):
            words = _words(part)
            h, suffix = words.hashes(), suffix_class(words)
            classes = voc.classes(h, suffix)
            _, cell, before = class_trigrams(words, classes)
            np.add.at(total, cell, np.uint32(1))
            within = classes >= TOP
            np.add.at(total, _CELLS + before[within] * members + voc.member(h[within], suffix[within]), np.uint32(1))
        cell = np.flatnonzero(total)
        out = scatter(cell % parts, {"cell": cell.astype(np.uint32), "n": total[cell].astype(np.int64)})
        yield pa.RecordBatch.from_arrays([out["bucket"], out["cell"], out["n"]], names=["bucket", "cell", "n"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, cell, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = total.setdefault(b, np.zeros(-(-cells // parts), np.int64))
                own[np.frombuffer(cell, np.uint32) // parts] += np.frombuffer(n, np.int64)
        for b, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([at.astype(np.uint32).tobytes()], pa.binary()), pa.array([own[at].tobytes()], pa.binary())], names=["bucket", "cell", "n"])

    schema = "bucket int, cell binary, n binary"
    out = np.zeros(cells, np.int64)
    for row in docs.mapInArrow(count, schema).repartition(partitions, "bucket").mapInArrow(add, schema).toLocalIterator():
        out[np.frombuffer(row.cell, np.uint32).astype(np.int64) * parts + row.bucket] += np.frombuffer(row.n, np.int64)
    return out[:_CELLS], out[_CELLS:].reshape(CONTEXTS, members)


def train(counts: np.ndarray, steps: int | None = None, seed: int = 11) -> np.ndarray:
    """log10 P(class | two classes before) as a table over all contexts, by noise-contrastive estimation.

    A step takes up BATCH contexts with all their tokens; without `steps`, each context has its turn PASSES times or more.
    """
    r = np.random.default_rng(seed)
    table = counts.reshape(-1, CLASSES)
    share = table.sum(0) + 0.5
    noise = share / share.sum()
    f = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
    p = {"r": f(CONTEXTS, DIM, scale=0.1), "q": f(CLASSES, DIM, scale=0.1), "c1": f(DIM, DIM, scale=0.2), "c2": f(DIM, DIM, scale=0.2), "b": np.log(noise).astype(np.float32)}
    square = {k: np.full_like(v, 1e-4) for k, v in p.items()}
    tokens = table.sum(1)
    live, all_tokens = np.flatnonzero(tokens), int(tokens.sum())
    log_noise, drawn = np.log(noise * NOISE).astype(np.float32), (noise * NOISE).astype(np.float32)
    batches = -(-len(live) // BATCH)
    steps = (max(PASSES * batches, LEAST_STEPS) if steps is None else steps) if batches else 0
    for step in range(steps):
        if step % batches == 0:
            mixed = r.permutation(live)
        own = mixed[step % batches * BATCH :][:BATCH]
        two, one = own // CONTEXTS, own % CONTEXTS
        n = (table[own] * (len(live) / len(own) / all_tokens)).astype(np.float32)
        context = p["r"][one] @ p["c1"] + p["r"][two] @ p["c2"]
        delta = context @ p["q"].T + p["b"] - log_noise
        chance = 1 / (1 + np.exp(-np.clip(delta, -30, 30)))
        slope = n * (chance - 1) + n.sum(1, keepdims=True) * drawn * chance  # data against expected noise
        d_context = slope @ p["q"]
        g = {"c1": p["r"][one].T @ d_context, "c2": p["r"][two].T @ d_context, "b": slope.sum(0), "q": slope.T @ context, "r": np.zeros_like(p["r"])}
        np.add.at(g["r"], one, d_context @ p["c1"].T)
        np.add.at(g["r"], two, d_context @ p["c2"].T)
        rate = 0.15 * (1 - 0.8 * step / steps)
        for k, v in g.items():
            square[k] += v * v
            p[k] -= (rate * v / np.sqrt(square[k])).astype(np.float32)
    out = np.empty((CONTEXTS * CONTEXTS, CLASSES), np.float32)
    first, second = p["r"] @ p["c1"], p["r"] @ p["c2"]
    for two in range(CONTEXTS):  # all contexts with the same second word at once
        logits = (first + second[two]) @ p["q"].T + p["b"]
        logits -= logits.max(1, keepdims=True)
        out[two * CONTEXTS : (two + 1) * CONTEXTS] = (logits - np.log(np.exp(logits).sum(1, keepdims=True))) / np.log(10)
    return out.ravel()


def train_members(counts: np.ndarray, kinds: np.ndarray, passes: int = WORD_PASSES, seed: int = 13) -> np.ndarray:
    """log10 P(member | its suffix class, class before), context by member, by noise-contrastive estimation.

    The noise of a class is its members' shares, drawn NOISE times for each of its tokens, in expectation. HOLD tokens'
    worth of each vector's length is counted against it, which keeps the vectors of rare words small.
    """
    order = np.argsort(kinds, kind="stable")
    kinds, counts = kinds[order], counts[:, order]
    heads = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1]))
    number = np.cumsum(np.append(False, kinds[1:] != kinds[:-1]))
    share = counts.sum(0) + 0.5
    share = share / np.add.reduceat(share, heads)[number]
    n = counts.astype(np.float32)
    of_class = np.add.reduceat(n, heads, axis=1)[:, number]  # tokens of the member's class in each context
    r = np.random.default_rng(seed)
    f = lambda *shape: (r.standard_normal(shape) * 0.1).astype(np.float32)
    p = {"r": f(len(counts), WORD_DIM), "q": f(len(kinds), WORD_DIM), "b": np.log(share).astype(np.float32)}
    square = {k: np.full_like(v, 1e-4) for k, v in p.items()}
    log_noise, drawn = np.log(share * NOISE).astype(np.float32), (share * NOISE).astype(np.float32)
    weight = 1 / (n.sum(0) + 1)  # every vector is fitted to its own tokens, whatever their number
    for step in range(passes if n.any() else 0):
        delta = p["r"] @ p["q"].T + p["b"] - log_noise
        np.clip(delta, -30, 30, out=delta)
        chance = 1 / (1 + np.exp(-delta))
        slope = (chance - 1) * n + chance * of_class * drawn
        g = {"q": (slope.T @ p["r"] + HOLD * p["q"]) * weight[:, None], "b": slope.sum(0) * weight, "r": slope @ p["q"]}
        rate = 0.2 * (1 - 0.8 * step / passes)
        for k, v in g.items():
            square[k] += v * v
            p[k] -= (rate * v / np.sqrt(square[k])).astype(np.float32)
    logits = p["r"] @ p["q"].T + p["b"]
    logits -= np.logaddexp.reduceat(logits, heads, axis=1)[:, number]
    out = np.empty(logits.shape, np.float32)
    out[:, order] = logits / np.log(10)
    return out


SCHEMA = "n_tokens long, n_known long, base_score double, score double"


def score_texts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), remainder: int = 1) -> tuple[DataFrame, Vocabulary]:
    """(keep, n_tokens, n_known, base_score and score of every text; totals). Texts of doc_id held out are not learned from."""
    spark = docs.sparkSession
    text = F.col("text").cast("string").alias("text")
    learned = ~held_out(F.col("doc_id"), remainder)
    carried = docs.select("doc_id", "text", *[column(c).alias(f"kept_{i}") for i, c in enumerate(keep)], learned.alias("learned"))
    dealt, partitions = deal(carried, (*[f"kept_{i}" for i in range(len(keep))], "learned"))
    buckets = buckets_for(partitions)
    learn = f"k_{len(keep)}"
    texts = dealt.groupBy("grp")

    def ask(table: pa.Table) -> pa.Table:
        table = in_order(table)
        words = _words(table)
        train = np.repeat(np.array(table.column(learn).to_pylist(), bool), words.counts)
        h, first, number = np.unique(words.hashes(), return_index=True, return_inverse=True)
        n = np.bincount(number, train, len(h)).astype(np.uint32)
        out = scatter(_bucket(h, buckets), {"h": h, "n": n, "suffix": suffix_class(words)[first]})
        return pa.table({"bucket": out["bucket"], "src": pa.array(np.full(len(out["bucket"]), table.column("grp")[0].as_py(), np.int32)), **{k: out[k] for k in ("h", "n", "suffix")}})

    asked = texts.applyInArrow(ask, ASKED).repartition(partitions, "bucket").sortWithinPartitions("bucket")
    answers = checkpointed(asked.mapInArrow(_answer, ANSWERS))
    training = docs.where(learned).select(text)
    n_texts = docs.where(learned).count()
    vocabulary = _vocabulary(answers, n_texts)
    trigrams, within = _counts(training, vocabulary, partitions)
    sent = spark.sparkContext.broadcast((vocabulary, train(trigrams), train_members(within, vocabulary.kinds)))
    del trigrams, within

    def score(table: pa.Table, found: pa.Table) -> pa.Table:
        voc, log_class, log_member = sent.value
        table = in_order(table)
        words = _words(table)
        own, suffix = words.hashes(), suffix_class(words)
        h, number = np.unique(own, return_inverse=True)
        found = found.combine_chunks().sort_by("bucket")
        n = np.empty(len(h), np.int64)
        n[np.argsort(_bucket(h, buckets), kind="stable")] = np.frombuffer(b"".join(map(zlib.decompress, found.column("n").to_pylist())), U64)
        n = n[number]
        doc, count = words.doc, len(words.texts)
        classes = voc.classes(own, suffix)
        text_of, cell, before = class_trigrams(words, classes)
        base = np.bincount(doc, np.log10(n + 0.5), count) + np.log10(n_texts + 0.5) - (words.counts + 1) * np.log10(voc.n + 0.5 * (voc.types + 1))
        inside = np.zeros(len(own))
        within = np.flatnonzero(classes >= TOP)
        member, kind = voc.member(own[within], suffix[within]), suffix[within]
        share = np.log10((n[within] + 0.5) / (voc.rest_n[kind] + 0.5 * (voc.rest_types[kind] + 1)))
        inside[within] = log_member[before[within], member] + np.where(member >= len(voc.words), share, 0.0)
        model = np.bincount(text_of, log_class[cell].astype(np.float64), count) + np.bincount(doc, inside, count)
        out = {f"k_{i}": table.column(f"k_{i}") for i in range(len(keep))}
        return pa.table(out | {"n_tokens": pa.array(words.counts + 1), "n_known": pa.array(np.bincount(doc, n > 0, count).astype(np.int64) + (n_texts > 0)), "base_score": pa.array(base), "score": pa.array(model)})

    scored = texts.cogroup(answers.where("grp >= 0").select("grp", "bucket", "n").groupBy("grp")).applyInArrow(score, with_fields(renamed(docs, keep), SCHEMA))
    return named(scored, keep), vocabulary
