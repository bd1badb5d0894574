"""Exact Jaccard self-join of texts on word n-grams, with vertical partitioning.

Texts with equal n-gram sets form one set; links are sought between different sets only.

1. The global n-gram order is by frequency class, then hash. Each group of texts sends its n-grams to the buckets of
   their order key and is answered with the classes; only the key's leading bits are sent, as any order will do. From
   then on an n-gram is one number, its place in the global order: the class in the top bits, the hash below.
2. In that order, two sets that reach the threshold share an n-gram among their first ones (prefix). N-grams that
   occur once have no partner and are not sent; a set whose prefix holds only such is done. The others post their prefix.
3. Among the sets that post an n-gram, the one that has it foremost is the pivot; every other one is paired with the
   pivot it meets most often. That takes one pair a set, however large a family of near copies is.
4. Pairs are verified on vertical fragments: the global order is cut into `FRAGMENTS` ranges at its measured quantiles,
   the overlap within each range is counted by itself, and the partial counts are summed per pair. The fragments of a
   set travel in sheets: all in one row up to `SHEET` n-grams, else a row for each fragment, so that no row grows with
   the text.
5. Verified links give components. All posted pairs that still join two different components and pass the size and
   position bounds are verified, too; with those links the components are final, and no link was left out that could
   change them. A posting list of any length is compared in blocks of `BLOCK`, which are dealt out as separate work.

A set is known by two 64-bit sums over its n-grams; should the first ones of two sets collide, they are told apart by
the second (`_apart`).

Defined cases: texts without words have an empty set and are linked with nothing; fewer words than the n-gram make
one n-gram; repeated rows are copies of each other; a null doc_id takes part and is never the smallest; very long texts
are cut into rows by fragment; an empty table gives no rows; extra columns are not read, and
one that is kept under the name of a result column is returned as <name>_kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import checkpointed
from .columnar import U64, WORD_BY_SPACE, Texts, Words, mix64
from .components import components
from .exchange import buckets_for, packed, scatter, unpack, whole_groups
from .groups import deal, in_order
from .schema import named, renamed, with_fields

FRAGMENTS = 8
#: Sets of up to so many n-grams that others may have carry all their fragments in one row.
SHEET = 4096
#: Sets of a posting list that are compared with as many others at a time.
BLOCK = 4096
#: Copies of a set are first thinned out within so many parts, so that one of many copies meets few rows in a task.
SALT = 16


@dataclass(frozen=True)
class Threshold:
    """Linked when of * intersection >= least * union."""

    least: int
    of: int

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - -(-self.least * n // self.of) + 1

    def overlap(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The fewest elements that linked sets of n and m share."""
        return -(-self.least * (n + m) // (self.least + self.of))

    def possible(self, n: np.ndarray, at_n: np.ndarray, m: np.ndarray, at_m: np.ndarray) -> np.ndarray:
        """Whether sets whose first common element has these places can be linked: neither shares what comes before."""
        fewest = self.overlap(n, m)
        return (at_n + fewest <= n) & (at_m + fewest <= m)

    def bands(self, most: int) -> np.ndarray:
        """Where bands of set lengths begin: linked sets are in the same or in neighbouring bands."""
        out = [1]
        while out[-1] <= most:
            out.append(out[-1] * self.of // self.least + 1)
        return np.array(out)

    def linked(self, shared: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return self.of * shared >= self.least * (n + m - shared)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct n-grams of all texts, sorted."""
    h = words.hashes()
    parts = [words.windows(h, k)]
    for size in range(1, k):
        starts, own = words.windows(h, size)
        alone = words.counts[words.doc[starts]] == size if len(starts) else np.zeros(0, bool)
        parts.append((starts[alone], own[alone]))
    value = np.concatenate([p[1] for p in parts])
    doc = words.doc[np.concatenate([p[0] for p in parts])]
    order = np.argsort(value)
    small = doc[order]
    order = order[np.argsort(small.astype(np.uint16) if len(words.texts) < 1 << 16 else small, kind="stable")]
    doc, value = doc[order], value[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])) if len(doc) else np.zeros(0, bool)
    return doc[new], value[new]


def _planes(low: np.ndarray) -> bytes:
    """Differences of sorted 32-bit keys, byte by byte: the high bytes are mostly zero."""
    return np.diff(low, prepend=np.uint32(0)).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _keys(planes: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel(), dtype=np.uint32)


ASKED = "bucket int, src int, low binary, n binary"
ANSWERS = "grp int, bucket int, kind binary"


def _classes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frequency classes of keys, in the order of each asking row: 0 for one text, else the logarithm of the count."""
    for table in whole_groups(batches, most=12 << 20):
        lows = [_keys(b) for b in table.column("low").to_pylist()]
        sizes = np.array([len(x) for x in lows])
        key = np.concatenate(lows).astype(U64) | np.repeat(table.column("bucket").to_numpy().astype(U64) << U64(32), sizes)
        n = unpack(table.column("n"), np.uint16)[0]
        order = np.argsort(key)
        ranked = key[order]
        first = np.append(True, ranked[1:] != ranked[:-1])
        total = np.add.reduceat(n[order].astype(np.int64), np.flatnonzero(first))
        kind = np.empty(len(key), np.uint8)
        kind[order] = np.ceil(np.log2(total)).astype(np.uint8)[np.cumsum(first) - 1]
        yield pa.RecordBatch.from_arrays([table.column("src").combine_chunks(), table.column("bucket").combine_chunks(), packed(np.concatenate(([0], np.cumsum(sizes))), kind)], names=["grp", "bucket", "kind"])


SETS = "sid long, sid2 long, n long, posted binary, posted_at binary, tokens binary"


def ordered(kind: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in the global n-gram order: 6 bits of frequency class, 58 of hash."""
    return kind.astype(U64) << U64(58) | h >> U64(6)


def _pairs(h: np.ndarray, sid: np.ndarray, n: np.ndarray, at: np.ndarray, t: Threshold) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, pivot, times they meet) for postings sorted by n-gram and place; equal sets are taken as one."""
    first = np.append(True, h[1:] != h[:-1])
    start = np.flatnonzero(first)
    pivot = np.repeat(start, np.diff(np.append(start, len(h))))
    ok = (sid != sid[pivot]) & t.possible(n, at, n[pivot], at[pivot])
    both = np.stack((sid[ok], sid[pivot][ok]), 1)
    if not len(both):
        return (np.zeros(0, np.int64),) * 3
    pair, times = np.unique(both, axis=0, return_counts=True)
    return pair[:, 0], pair[:, 1], times


def _cross(x: np.ndarray, y: np.ndarray, t: Threshold) -> np.ndarray:
    """Pairs (greater, smaller set) of different components between two blocks of one posting list; rows: set, size, place, component."""
    found = [np.zeros((0, 2), np.int64)]
    for a in range(0, len(x), 512):
        sid, n, at, comp = (c[:, None] for c in x[a : a + 512].T)
        i, j = np.nonzero((comp != y[:, 3]) & t.possible(n, at, y[:, 1], y[:, 2]))
        one, other = x[a : a + 512][i, 0], y[j, 0]
        found.append(np.stack((np.maximum(one, other), np.minimum(one, other)), 1))
    return np.concatenate(found)


def _blocks(h: np.ndarray, rows: np.ndarray, t: Threshold) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Blocks of each posting list to be crossed, and whether they are all of the list; lists of one component have none."""
    start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    size = np.diff(np.append(start, len(h)))
    mixed = np.maximum.reduceat(rows[:, 3], start) != np.minimum.reduceat(rows[:, 3], start)
    for s, m in zip(start[mixed].tolist(), size[mixed].tolist(), strict=True):
        own = rows[s : s + m]
        if m <= BLOCK:
            yield own, own, True
            continue
        own = own[np.argsort(own[:, 1], kind="stable")]
        parts = [own[a : a + BLOCK] for a in range(0, m, BLOCK)]
        for i, x in enumerate(parts):
            for y in parts[i:]:  # of greater sets; too great ones end the row
                if t.overlap(x[-1, 1], y[0, 1]) > x[-1, 1]:
                    break
                yield x, y, False


def _posted(sets: DataFrame, partitions: int, buckets: int, t: Threshold, with_comp: bool, banded: bool) -> DataFrame:
    """Postings, met by n-gram; banded: by band of set length and n-gram."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                h, each = unpack(part.column("posted"), U64)
                if not len(h):
                    continue
                at = unpack(part.column("posted_at"), np.uint32)[0]
                rep = lambda c: np.repeat(part.column(c).to_numpy(), each)  # noqa: B023, E731
                cols = {"sid": rep("sid"), "n": rep("n").astype(np.uint32), "at": at} | ({"comp": rep("comp")} if with_comp else {})
                if banded:  # a set posts to its own band and, as the smaller one, to the next
                    band = np.searchsorted(t.bands(int(cols["n"].max())), cols["n"], "right").astype(U64)
                    cols = {k: np.concatenate((v, v)) for k, v in cols.items()}
                    h = mix64(np.concatenate((h, h)) ^ mix64(np.concatenate((band, band + U64(1)))))
                yield pa.RecordBatch.from_pydict(scatter((h >> U64(20)) % U64(buckets), {"h": h} | cols))

    columns = ["bucket int", "h binary", "sid binary", "n binary", "at binary", *(["comp binary"] if with_comp else [])]
    return sets.mapInArrow(send, ", ".join(columns)).repartition(partitions, "bucket").sortWithinPartitions("bucket")


def _postings(table: pa.Table, *more: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, rows of set, size, place and more) by n-gram and place, each set once an n-gram."""
    h = unpack(table.column("h"), U64)[0]
    kinds = {"sid": np.int64, "n": np.uint32, "at": np.uint32, "comp": np.int64}
    rows = np.stack([unpack(table.column(c), kinds[c])[0].astype(np.int64) for c in ("sid", "n", "at", *more)], 1)
    order = np.lexsort((rows[:, 0], rows[:, 2], h))
    h, rows = h[order], rows[order]
    one = np.append(True, (h[1:] != h[:-1]) | (rows[1:, 0] != rows[:-1, 0])) if len(h) else np.zeros(0, bool)
    return h[one], rows[one]


def _with_pivots(sets: DataFrame, partitions: int, buckets: int, t: Threshold, banded: bool) -> DataFrame:
    """Candidate pairs of sets and pivots, and how often they meet."""

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, most=16 << 20):
            h, rows = _postings(table)
            a, b, times = _pairs(h, rows[:, 0], rows[:, 1], rows[:, 2], t)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(times)], names=["a", "b", "times"])

    return _posted(sets, partitions, buckets, t, False, banded).mapInArrow(meet, "a long, b long, times long")


def _between_components(sets: DataFrame, partitions: int, buckets: int, t: Threshold, banded: bool) -> DataFrame:
    """Candidate pairs of sets of different components. Blocks of long posting lists are dealt out and crossed by other tasks."""

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("unit", pa.int64()), ("x", pa.binary()), ("y", pa.binary())])
        unit = 0
        for table in whole_groups(batches, most=16 << 20):
            found, held = [np.zeros((0, 2), np.int64)], 0
            for x, y, whole in _blocks(*_postings(table, "comp"), t):
                if whole:
                    found.append(_cross(x, y, t))
                    held += len(found[-1])
                else:
                    unit += 1
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([unit], pa.int64()), pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], schema=schema)
                if held > 1 << 20:
                    found, held = [np.unique(np.concatenate(found), axis=0)], 0
            both = np.unique(np.concatenate(found), axis=0)
            none = pa.nulls(len(both), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.nulls(len(both), pa.int64()), none, none], schema=schema)

    def cross(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_hand = batch.filter(pc.is_valid(batch.column("a")))
            yield at_hand.select(["a", "b"])
            for x, y in zip(*(batch.filter(pc.is_valid(batch.column("unit"))).column(c).to_pylist() for c in ("x", "y")), strict=True):
                both = np.unique(_cross(np.frombuffer(x, np.int64).reshape(-1, 4), np.frombuffer(y, np.int64).reshape(-1, 4), t), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    met = _posted(sets, partitions, buckets, t, True, banded).mapInArrow(meet, "a long, b long, unit long, x binary, y binary")
    dealt = met.repartition(partitions, F.xxhash64("a", "b", "unit", "x"))
    return dealt.mapInArrow(cross, "a long, b long").distinct()


def _cuts(sets: DataFrame) -> np.ndarray:
    """Places that cut the global n-gram order into FRAGMENTS ranges of about as many n-grams, from a histogram of 512 bins."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(512, np.int64)
        for batch in batches:
            total += np.bincount((unpack(batch.column("tokens"), U64)[0] >> U64(55)).astype(np.int64), minlength=512)
        bins = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(total[bins])], names=["bin", "n"])

    rows = sets.select("tokens").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(512, np.int64)
    for r in rows:
        total[r.bin] = r.n
    upto = np.cumsum(total)
    return (np.minimum(np.searchsorted(upto, upto[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS), 510).astype(U64) + U64(1)) << U64(55)


def _sheets(t: Threshold, cuts: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a set's fragments: all on sheet -1, or one by one for large sets and for those with larger partners."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["sid", "n", "part", "tokens"]
        for batch in batches:
            one = batch.filter(pc.less_equal(batch.column("n"), SHEET))
            if one.num_rows:
                yield pa.RecordBatch.from_arrays([one.column("sid"), one.column("n"), pa.array(np.full(one.num_rows, -1, np.int32)), one.column("tokens")], names=names)
            large = batch.filter(pc.greater(batch.column("n"), SHEET * t.least // t.of))
            if not large.num_rows:
                continue
            h, each = unpack(large.column("tokens"), U64)
            row = np.repeat(np.arange(large.num_rows), each)
            key = row * FRAGMENTS + np.searchsorted(cuts, h, "right")
            at = np.searchsorted(key, np.arange(large.num_rows * FRAGMENTS + 1))
            sid, n = (np.repeat(large.column(c).to_numpy(), FRAGMENTS) for c in ("sid", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array(n), pa.array(np.tile(np.arange(FRAGMENTS, dtype=np.int32), large.num_rows)), packed(at, h)], names=names)

    return cut


def _overlap(cuts: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Partial overlaps of the fragments on two sheets, each counted by itself."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                part = batch.slice(s, 4096)
                x, nx = unpack(part.column("x"), U64)
                y, ny = unpack(part.column("y"), U64)
                row = np.concatenate((np.repeat(np.arange(part.num_rows), nx), np.repeat(np.arange(part.num_rows), ny)))
                both = np.concatenate((x, y))
                order = np.lexsort((both, row))
                both, row = both[order], row[order]
                same = np.flatnonzero((both[1:] == both[:-1]) & (row[1:] == row[:-1]))
                fragment = np.searchsorted(cuts, both[same], "right")
                partial = np.bincount(row[same] * FRAGMENTS + fragment, minlength=part.num_rows * FRAGMENTS)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * FRAGMENTS), pa.array(partial.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), part.column("n_a"), part.column("n_b"), lists], names=["a", "b", "n_a", "n_b", "partial"])

    return count


def verified(pairs: DataFrame, sets: DataFrame, t: Threshold, cuts: np.ndarray) -> DataFrame:
    """The pairs (a, b) that reach the threshold: partial overlaps of each fragment, summed per pair."""
    named = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    cut = sets.join(named, "sid", "left_semi").select("sid", "n", "tokens").mapInArrow(_sheets(t, cuts), "sid long, n long, part int, tokens binary")
    cut = checkpointed(cut)
    left = cut.select(F.col("sid").alias("a"), F.col("n").alias("n_a"), "part", F.col("tokens").alias("x"))
    right = cut.select(F.col("sid").alias("b"), F.col("n").alias("n_b"), "part", F.col("tokens").alias("y"))
    whole = (F.col("n_a") <= SHEET) & (F.col("n_b") <= SHEET)
    met = pairs.join(left, "a").join(right, ["b", "part"]).where((F.col("part") < 0) | ~whole).select("a", "b", "n_a", "n_b", "x", "y")
    counted = met.mapInArrow(_overlap(cuts), "a long, b long, n_a long, n_b long, partial array<long>")
    partial = F.aggregate("partial", F.lit(0).cast("long"), lambda s, x: s + x)
    return counted.groupBy("a", "b", "n_a", "n_b").agg(F.sum(partial).alias("shared")).where(F.col("shared") * t.of >= (F.col("n_a") + F.col("n_b") - F.col("shared")) * t.least).select("a", "b")


def _apart(ordered: DataFrame) -> DataFrame:
    """Sets whose first sums collide get another one, made of both sums; in all but freak cases there are none."""
    sums = ordered.where("sid is not null").groupBy("sid").agg(F.min("sid2").alias("low"), F.max("sid2").alias("high"))
    same = checkpointed(sums.where("low <> high").select(F.col("sid").alias("twice")))
    if same.isEmpty():
        return ordered
    hit = ordered.join(same, F.col("sid") == F.col("twice"), "left")
    return checkpointed(hit.withColumn("sid", F.when(F.col("twice").isNotNull(), F.xxhash64("sid", "sid2")).otherwise(F.col("sid"))).drop("twice"))


def _sums(h: np.ndarray, doc: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each text's set, by a sum over its n-grams."""
    total = np.zeros(len(size), U64)
    np.add.at(total, doc, mix64(h ^ U64(seed)))
    return mix64(total + size.astype(U64) * U64(0x9E3779B97F4A7C15)).view(np.int64)


def link_texts(
    docs: DataFrame, k: int = 5, least: int = 80, of: int = 100, keep: tuple[str, ...] = ("doc_id",), sets: Callable[[Texts], tuple[np.ndarray, np.ndarray]] | None = None, banded: bool = False
) -> DataFrame:
    """keep, n_shingles, sid (the set), comp (the smallest sid reachable) and component_id, the smallest doc_id there.

    sid and comp are null for empty sets. sets: makes other sets than k-word shingles from texts, as `shingles` does.
    banded: sets are partitioned by length, and meet only within a band of lengths and with its neighbour.
    """
    t = Threshold(least, of)
    fields = (*keep, *(["doc_id"] if "doc_id" not in keep else []))
    dealt, partitions = deal(docs, fields)
    buckets = buckets_for(partitions)
    bits = max(8, (buckets - 1).bit_length())
    id_at = f"k_{fields.index('doc_id')}"
    texts = dealt.groupBy("grp")

    def sets_of(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
        content = Texts(table.column("text"))
        return len(content), *(sets(content) if sets else shingles(Words(content, WORD_BY_SPACE, True), k))

    def ask(table: pa.Table) -> pa.Table:
        _, _, h = sets_of(in_order(table))
        key, n = np.unique(h >> U64(32 - bits), return_counts=True)
        bucket = (key >> U64(32)).astype(np.int64)
        ids, first = np.unique(bucket, return_index=True)
        bounds = np.append(first, len(key))
        low = (key & U64(0xFFFFFFFF)).astype(np.uint32)
        rows = [_planes(low[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        src = np.full(len(ids), table.column("grp")[0].as_py(), np.int32)
        return pa.table({"bucket": pa.array(ids.astype(np.int32)), "src": pa.array(src), "low": pa.array(rows, pa.binary()), "n": packed(bounds, np.minimum(n, 65535).astype(np.uint16))})

    def order(table: pa.Table, found: pa.Table) -> pa.Table:
        table = in_order(table)
        count, doc, h = sets_of(table)
        size = np.bincount(doc, minlength=count)
        key = h >> U64(32 - bits)
        kind = unpack(found.combine_chunks().sort_by("bucket").column("kind"), np.uint8)[0][np.searchsorted(np.unique(key), key)] if len(h) else np.zeros(0, np.uint8)
        sid, sid2 = (_sums(h, doc, size, seed) for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
        place_of = ordered(kind, h)
        rank = np.lexsort((place_of, doc))
        heads = np.concatenate(([0], np.cumsum(size)))
        place = np.arange(len(h)) - heads[:-1][doc]
        post = (place < t.prefix(size)[doc]) & (kind[rank] > 0)
        own, at = rank[post], place[post]
        posts = np.concatenate(([0], np.cumsum(np.bincount(doc[own], minlength=count))))
        sent = (np.diff(posts) > 0)[doc] & (kind[rank] > 0)
        bounds = np.concatenate(([0], np.cumsum(np.bincount(doc[sent], minlength=count))))
        out = {f"k_{i}": table.column(f"k_{i}") for i in range(len(fields))}
        empty = size == 0
        return pa.table(out | {"sid": pa.array(sid, mask=empty), "sid2": pa.array(sid2, mask=empty), "n": pa.array(size), "posted": packed(posts, place_of[own]), "posted_at": packed(posts, at.astype(np.uint32)), "tokens": packed(bounds, place_of[rank[sent]])})

    asked = texts.applyInArrow(ask, ASKED).repartition(partitions, "bucket").sortWithinPartitions("bucket")
    answers = asked.mapInArrow(_classes, ANSWERS)
    found = _apart(checkpointed(texts.cogroup(answers.groupBy("grp")).applyInArrow(order, with_fields(renamed(docs, fields), SETS))))
    posting = found.where(F.octet_length("posted") > 0).select("sid", "n", "posted", "posted_at", "tokens", F.pmod(F.xxhash64(id_at), F.lit(SALT)).alias("salt"))
    distinct = checkpointed(posting.dropDuplicates(["sid", "salt"]).drop("salt").dropDuplicates(["sid"]))
    cuts = _cuts(distinct)

    met = _with_pivots(distinct, partitions, buckets, t, banded).groupBy("a", "b").agg(F.sum("times").alias("times"))
    best = met.groupBy("a").agg(F.max_by("b", F.struct("times", "b")).alias("b"))
    links = checkpointed(verified(checkpointed(best), distinct, t, cuts))
    first = components(links)
    labelled = distinct.join(first, F.col("sid") == F.col("node"), "left").select("sid", "n", "posted", "posted_at", F.coalesce("comp", "sid").alias("comp"))
    more = checkpointed(_between_components(labelled, partitions, buckets, t, banded))
    if not more.isEmpty():
        links = checkpointed(links.unionByName(verified(more, distinct, t, cuts)))
        # Links between components of the first round, on top of its labels.
        to = first.select(F.col("node").alias("of"), F.col("comp").alias("c"))
        up = links.join(to, F.col("a") == F.col("of"), "left").select(F.coalesce("c", "a").alias("a"), "b")
        up = up.join(to, F.col("b") == F.col("of"), "left").select("a", F.coalesce("c", "b").alias("b"))
        second = components(up).select(F.col("node").alias("old"), F.col("comp").alias("new"))
        every = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(first, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
        first = checkpointed(checkpointed(every).join(second, F.col("comp") == F.col("old"), "left").select("node", F.coalesce("new", "comp").alias("comp")))

    rows = found.select(*[f"k_{i}" for i in range(len(fields))], F.col("n").alias("n_shingles"), "sid")
    labelled = checkpointed(rows.join(first, F.col("sid") == F.col("node"), "left").select(*rows.columns, F.coalesce("comp", "sid").alias("comp")))
    least_id = checkpointed(labelled.where("comp is not null").groupBy("comp").agg(F.min(id_at).alias("least")).withColumnRenamed("comp", "of_comp"))
    full = labelled.join(least_id, F.col("comp") == F.col("of_comp"), "left")
    component = F.when(F.col("comp").isNull(), F.col(id_at)).otherwise(F.col("least"))
    return named(full.select(*[f"k_{i}" for i in range(len(keep))], "n_shingles", "sid", "comp", component.alias("component_id")), keep)
