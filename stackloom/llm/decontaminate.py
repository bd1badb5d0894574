"""Benchmark decontamination with suffix arrays over the training texts.

Each block of training texts is a shard. Its words become numbers of the benchmark's vocabulary; stretches of known
words that are long enough for the shortest window are kept, and their suffixes are sorted by prefix doubling. Every
benchmark suffix that starts a window is then binary-searched in the shard: the range it spans gives all verbatim
places of the window, and comparing onwards gives the longest match from each place. Shards are independent, so a
lost task is simply run again.

The benchmark is broadcast in blocks of about `BLOCK_WORDS` words; all blocks are searched in one pass over the texts,
each shard block by block, so findings of one row never meet those of another and a worker holds one block at a time.

Defined cases: null texts have no words; empty tables give empty or unmarked results; an item without words has no
window; a null item_id is listed as the empty string; repeated rows are searched one by
one; very long texts are searched whole; extra columns stay out, and one that is kept under the name of a result column
is returned as <name>_kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columnar import U64, WORD_BY_ALNUM, Texts, Words, slices
from .schema import carried, named, with_fields

WINDOW = 10
BLOCK_WORDS = 1 << 20
_BITS = 20


@dataclass
class TestSuffixes:
    """The window-starting suffixes of some benchmark items, as vocabulary numbers from 1."""

    ids: list[str]
    vocabulary: np.ndarray  # sorted word hashes
    known: np.ndarray  # bitmap over hash bits, to skip most look-ups
    tokens: np.ndarray  # all items' words, each item followed by 0
    starts: np.ndarray  # in tokens, of each window
    lengths: np.ndarray
    items: np.ndarray  # number of each window's item

    @staticmethod
    def of(rows: list[tuple[str, np.ndarray]], window: int) -> TestSuffixes:
        every = np.concatenate([h for _, h in rows]) if rows else np.zeros(0, U64)
        vocabulary = np.unique(every)
        known = np.zeros(1 << _BITS, bool)
        known[(vocabulary >> U64(64 - _BITS)).astype(np.int64)] = True
        tokens, starts, lengths, items, at = [], [], [], [], 0
        for i, (_, h) in enumerate(rows):
            tokens += [np.searchsorted(vocabulary, h) + 1, np.zeros(1, np.int64)]
            length = min(window, len(h))
            own = np.arange(len(h) - length + 1) if len(h) else np.zeros(0, np.int64)
            starts.append(at + own)
            lengths.append(np.full(len(own), length))
            items.append(np.full(len(own), i))
            at += len(h) + 1
        cat = lambda xs: np.concatenate(xs).astype(np.int64) if xs else np.zeros(0, np.int64)
        return TestSuffixes([k for k, _ in rows], vocabulary, known, cat(tokens), cat(starts), cat(lengths), cat(items))

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of word hashes, 0 for others."""
        out = np.zeros(len(h), np.int64)
        maybe = np.flatnonzero(self.known[(h >> U64(64 - _BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), len(self.vocabulary) - 1)
        same = self.vocabulary[at] == h[maybe]
        out[maybe[same]] = at[same] + 1
        return out


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Positions of tokens other than 0, sorted by what follows them, at least `depth` tokens deep."""
    n = len(tokens)
    rank, k = tokens.astype(np.int64), 1
    while k < depth and n:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] if k < n else 0
        _, rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)
        k *= 2
    own = np.flatnonzero(tokens)
    return own[np.argsort(rank[own], kind="stable")]


def _compare(text: np.ndarray, at: np.ndarray, tests: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """-1, 0 or 1: how the tokens at `at` order against each test window (a matrix), by its first `length` tokens."""
    width = np.arange(tests.shape[1])
    theirs = text[np.minimum(at[:, None] + width, len(text) - 1)]
    differ = (theirs != tests) & (width < lengths[:, None])
    first = differ.argmax(1)
    row = np.arange(len(at))
    return np.where(differ[row, first], np.sign(theirs[row, first] - tests[row, first]), 0)


def search(text: np.ndarray, order: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window number, place, length of the longest match from there) of every occurrence of every window."""
    width = int(test.lengths.max(initial=1))
    tests = test.tokens[np.minimum(test.starts[:, None] + np.arange(width), max(len(test.tokens) - 1, 0))]
    bounds = []
    for least in (0, 1):  # first suffix not below the window, first suffix above it
        low, high = np.zeros(len(tests), np.int64), np.full(len(tests), len(order))
        while (open_ := low < high).any():
            mid = (low + high) // 2
            below = _compare(text, order[np.minimum(mid, len(order) - 1)], tests, test.lengths) < least
            low, high = np.where(open_ & below, mid + 1, low), np.where(open_ & ~below, mid, high)
        bounds.append(low)
    spans = bounds[1] - bounds[0]
    which = np.repeat(np.arange(len(tests)), spans)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(spans) - spans, spans)
    place = order[np.repeat(bounds[0], spans) + offset]
    length, growing = test.lengths[which].copy(), np.arange(len(which))
    while len(growing):
        a, b = place[growing] + length[growing], test.starts[which[growing]] + length[growing]
        inside = (a < len(text)) & (b < len(test.tokens))
        growing, a, b = growing[inside], a[inside], b[inside]
        growing = growing[(text[a] == test.tokens[b]) & (text[a] > 0)]
        length[growing] += 1
    return which, place, length


def _find(words: Words, h: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window number, word number and match length of each occurrence in a shard; h: hashes of its words."""
    none = np.zeros(0, np.int64)
    if not len(test.starts) or not len(words):
        return none, none, none
    number = test.numbers(h)
    # Stretches of known words within one text, at least as long as the shortest window.
    stop = number == 0
    start_of = np.zeros(len(number), bool)
    start_of[words.at[:-1][words.at[:-1] < len(number)]] = True
    begins = np.flatnonzero(~stop & (start_of | np.concatenate(([True], stop[:-1]))))
    ends_at = np.flatnonzero(~stop & np.concatenate((start_of[1:] | stop[1:], [True]))) + 1
    long_enough = ends_at - begins >= test.lengths.min()
    begins, sizes = begins[long_enough], (ends_at - begins)[long_enough]
    if not len(begins):
        return none, none, none
    where = np.repeat(begins - np.concatenate(([0], np.cumsum(sizes + 1)[:-1])), sizes + 1) + np.arange((sizes + 1).sum())
    text = np.where(np.repeat(begins + sizes, sizes + 1) > where, number[np.minimum(where, len(number) - 1)], 0)
    which, place, length = search(text, suffix_array(text, int(test.lengths.max())), test)
    return which, where[place], length


SCHEMA = "n_words long, spans array<struct<first:long,last:long>>, items array<string>, longest array<struct<item_id:string,item_word:long,doc_word:long,n_words:long>>"


def _digest(part: pa.RecordBatch, tests: TestSuffixes | Iterable[TestSuffixes]) -> list[pa.Array]:
    """The columns of SCHEMA: findings of one or several benchmark blocks in each text of a shard."""
    words = Words(Texts(part.column("text")), WORD_BY_ALNUM, True)
    h, n = words.hashes(), len(words.texts)
    edge = np.zeros(len(words) + 1, np.int64)
    items: list[set] = [set() for _ in range(n)]
    longest: list[list[dict]] = [[] for _ in range(n)]
    for test in [tests] if isinstance(tests, TestSuffixes) else tests:
        which, at, length = _find(words, h, test)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + test.lengths[which], -1)
        firsts = np.concatenate(([0], np.flatnonzero(test.tokens == 0) + 1))
        where = np.searchsorted(words.at, at, "right") - 1
        item, place = test.items[which], at - words.at[where]
        start = test.starts[which] - firsts[item] if len(which) else which
        order = np.lexsort((start, place, -length, item, where))  # of each text and item, the longest match first, then the foremost
        head = np.append(True, (where[order][1:] != where[order][:-1]) | (item[order][1:] != item[order][:-1])) if len(order) else np.zeros(0, bool)
        top = order[head]
        for d, i, s, a, k in zip(*(x[top].tolist() for x in (where, item, start, place, length)), strict=True):
            items[d].add(test.ids[i])
            longest[d].append({"item_id": test.ids[i], "item_word": s, "doc_word": a, "n_words": k})
    hit = np.cumsum(edge[:-1]) > 0
    heads = np.zeros(len(words), bool)
    heads[words.at[:-1][words.at[:-1] < len(words)]] = True
    first = np.flatnonzero(hit & (heads | np.concatenate(([True], ~hit[:-1])))) if len(words) else np.zeros(0, np.int64)
    last = np.flatnonzero(hit & np.concatenate((heads[1:] | ~hit[1:], [True]))) if len(words) else first
    doc = np.searchsorted(words.at, first, "right") - 1
    spans: list[list] = [[] for _ in range(n)]
    for d, a, b in zip(doc.tolist(), (first - words.at[doc]).tolist(), (last - words.at[doc]).tolist(), strict=True):
        spans[d].append({"first": a, "last": b})
    match = pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())])
    return [
        pa.array(words.counts),
        pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
        pa.array(longest, pa.list_(match)),
    ]


def _benchmark_blocks(benchmark: DataFrame, window: int, most: int) -> Iterator[TestSuffixes]:
    rows, size = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text").cast("string")).toLocalIterator():
        h = Words(Texts(pa.array([row[1]], pa.string())), WORD_BY_ALNUM, True).hashes()
        rows.append((row[0], h))
        size += len(h)
        if size >= most:
            yield TestSuffixes.of(rows, window)
            rows, size = [], 0
    yield TestSuffixes.of(rows, window)


def _found(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...], window: int, block_words: int) -> DataFrame:
    """The columns `keep` as k_0, k_1, ... and the findings."""
    spark = docs.sparkSession
    source = carried(docs, keep)
    fields = source.schema.fields[:-1]

    sent = [spark.sparkContext.broadcast(test) for test in _benchmark_blocks(benchmark, window, block_words)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            names = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *_digest(part, _values(sent))], names=[*names, "n_words", "spans", "items", "longest"])

    return source.mapInArrow(run, with_fields(fields, SCHEMA))


def _values(sent: list[Broadcast]) -> Iterator[TestSuffixes]:
    """The blocks one after another; one of several is let go before the next and is read again from its file if need be."""
    for block in sent:
        yield block.value
        if len(sent) > 1 and getattr(block, "_path", None):
            block.__dict__.pop("_value", None)


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each text: n_words, hit word spans, items with occurring windows, and the longest match with each item."""
    return named(_found(docs, benchmark, keep, window, block_words), keep)


def n_hit() -> Column:
    """Words in hit spans."""
    return F.expr("aggregate(spans, 0L, (n, s) -> n + s.last - s.first + 1)")


def items_digest() -> Column:
    """sha256 of the item ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join("items", ",").cast("binary"), 256)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs without any occurrence of a benchmark window, with all their columns."""
    keep = tuple(docs.columns)
    clean = _found(docs, benchmark, keep, window, block_words).where(F.size("items") == 0)
    return named(clean.select(*[f"k_{i}" for i in range(len(keep))]), keep)
