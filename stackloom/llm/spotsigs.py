"""SpotSigs fingerprints: chains of content words that follow common words.

Every common word of a text (and its start) anchors a signature: the anchor and the next `CHAIN` words that are not
common; the end of the text anchors the last `CHAIN` of them. Where `RUN` words or more follow each other without a common one, as in other languages, lists and tables,
each of them is an anchor, too: no stretch of a text goes without signatures, and an edit changes only those around
it. The set of signatures is the fingerprint, written as base64 of the sorted 32-bit hashes. Likeness is the
Jaccard coefficient of two sets; comparing is pruned by the sets' lengths, which bound it from above. `near_duplicates`
partitions all sets by length: a set meets only sets of its own band of lengths and of the neighbouring ones, by their
rarest signatures, and pairs that the lengths and the places of common signatures rule out are not compared.

A text is also fingerprinted after an edit that replaces its end by the beginning of the next document. For that,
documents are dealt out by ranges of doc_id; the first document of each range is also sent to the range before it, so
each text meets its neighbour with one shuffle of the texts. A doc_id that many rows share, or their lack of one, is
cut further, by ranges of the hash that orders its rows. A range is sorted by Spark and streamed, never held.

Defined cases: null texts are empty; an empty text has an empty fingerprint, like only other empty ones; a text
without words has the hash of its bytes for its only signature; equal doc_ids are ordered by a hash of their texts,
null doc_ids come last; a lone document is its own neighbour; very long texts are fingerprinted whole; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columnar import U64, WORD_BY_ALNUM, Texts, Words, mix64, slices
from .groups import LEAST_GROUPS, partitions_for
from .ngram_join import link_texts

CHAIN = 2
#: Words in a row without a common one, from which on each is an anchor.
RUN = 8
#: Ranges of doc_id at most, as their bounds are held by the driver and in the plan; beyond, ranges are longer.
MOST_RANGES = 1 << 14

# Common words of four languages.
COMMON = """
a an and are as at be but by for from had has have he her his i in is it its no not of on or she that the their they
this to was were which will with you
au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne ou par pas pour que qui sa se ses son
sur un une
als auch auf aus bei das dem den der des die ein eine einen einer es für ich im ist mit nach nicht oder sich sie sind
und von war werden wie zu zum zur
al como con del el ella era este esta la las lo los más mi muy no nos o para pero por que se sin su sus una uno y ya
"""


def _common() -> np.ndarray:
    words = " ".join(sorted(set(COMMON.split())))
    return np.sort(Words(Texts(pa.array([words])), WORD_BY_ALNUM, True).hashes())


_COMMON = _common()


def _in_long_runs(content: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Which words stand in runs of at least RUN content words; heads: the first words of texts."""
    begins = content.copy()
    begins[1:] &= ~content[:-1]
    begins[heads] = content[heads]
    first = np.flatnonzero(begins)
    number = np.cumsum(begins)[content] - 1  # the run of each content word
    out = np.zeros(len(content), bool)
    out[content] = np.bincount(number, minlength=len(first))[number] >= RUN
    return out


def signatures(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct signatures of all texts, where each text's signatures start)."""
    words = Words(texts, WORD_BY_ALNUM, True)
    h, doc, n = words.hashes(), words.doc, len(texts)
    at = np.minimum(np.searchsorted(_COMMON, h), len(_COMMON) - 1)
    common = _COMMON[at] == h
    content = np.flatnonzero(~common)
    # Anchors: the common words, those of long runs without one, and each text's start (just before its first word).
    texts_with_words = np.flatnonzero(words.counts)
    own = common | _in_long_runs(~common, words.at[:-1][texts_with_words])
    place = np.concatenate((np.flatnonzero(own), words.at[:-1][texts_with_words] - 1))
    owner = np.concatenate((doc[own], texts_with_words))
    value = np.concatenate((h[own], np.full(len(texts_with_words), 1, U64)))
    next_ = np.searchsorted(content, place, "right")
    for k in range(CHAIN):
        word = content[np.minimum(next_ + k, max(len(content) - 1, 0))] if len(content) else np.zeros(len(place), np.int64)
        inside = (next_ + k < len(content)) & (word < words.at[owner + 1])
        value = mix64(value * U64(0x9E3779B97F4A7C15) + np.where(inside, h[word] if len(h) else U64(0), U64(k + 1)))
    tail = np.full(len(texts_with_words), 2, U64)
    before = np.searchsorted(content, words.at[1:][texts_with_words]) - 1
    for k in range(CHAIN):
        word = content[np.maximum(before - k, 0)] if len(content) else np.zeros(len(tail), np.int64)
        inside = (before - k >= 0) & (word >= words.at[:-1][texts_with_words])
        tail = mix64(tail * U64(0x9E3779B97F4A7C15) + np.where(inside, h[word] if len(h) else U64(0), U64(k + 1)))
    owner, value = np.concatenate((owner, texts_with_words)), np.concatenate((value, tail))
    bare = np.flatnonzero((words.counts == 0) & (np.diff(texts.offsets) > 0))
    if len(bare):
        own = [int.from_bytes(hashlib.blake2b(texts.raw(i), digest_size=8).digest(), "little") for i in bare]
        owner, value = np.concatenate((owner, bare)), np.concatenate((value, np.array(own, U64)))
    both = np.unique(owner.astype(U64) << U64(32) | value >> U64(32))
    return (both & U64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(both >> U64(32), np.arange(n + 1).astype(U64))


def written(sigs: np.ndarray) -> str:
    return base64.b64encode(sigs.astype("<u4").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard coefficient of two sorted sets; 0 where it can't reach `least` by their lengths. Empty sets are alike."""
    few, many = sorted((len(a), len(b)))
    if not many:
        return 1.0
    if not few or few < least * many:
        return 0.0
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def signature_sets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all signatures, sorted, for the set join."""
    sigs, at = signatures(texts)
    doc, h = np.repeat(np.arange(len(texts)), np.diff(at)), mix64(sigs.astype(U64))
    order = np.lexsort((h, doc))
    return doc[order], h[order]


def near_duplicates(docs: DataFrame, least: int = 80, of: int = 100, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Components of documents whose signature sets have Jaccard least / of or more: keep, n_shingles (set length), component_id.

    Sets are partitioned by length, met there by their rarest signatures, and compared only within the bounds that
    lengths and places leave.
    """
    return link_texts(docs, least=least, of=of, keep=keep, sets=signature_sets, banded=True)


_FIELDS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(rows: pa.Table) -> pa.RecordBatch:
    """Results of all rows but the last; each row's neighbour is the next one. Rows that are only neighbours get none."""
    texts = Texts(rows.column("text"))
    grp, halo = rows.column("grp").to_numpy(), np.array(rows.column("halo").to_pylist(), bool)
    own = [i for i in range(len(texts) - 1) if not halo[i]]
    assert all(grp[i] == grp[i + 1] for i in own), "a range must end with its neighbour"
    text = [texts.raw(i).decode() for i in range(len(texts))]
    edited = []
    for i in own:
        take = len(text[i]) // 3
        edited.append(text[i][: len(text[i]) - take] + text[i + 1][:take])
    sigs, at = signatures(texts)
    other, other_at = signatures(Texts(pa.array(edited, pa.large_string())))
    mine = [sigs[at[i] : at[i + 1]] for i in range(len(texts))]
    theirs = [other[other_at[k] : other_at[k + 1]] for k in range(len(own))]
    kept = rows.take(pa.array(own, pa.int64())).column("doc_id").combine_chunks()
    return pa.RecordBatch.from_arrays(
        [
            kept if isinstance(kept, pa.Array) else pa.concat_arrays(kept.chunks),
            pa.array([len(text[i]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([written(mine[i]) for i in own], pa.string()),
            pa.array([written(t) for t in theirs], pa.string()),
            pa.array([likeness(mine[i], t) for i, t in zip(own, theirs, strict=True)], pa.float64()),
            pa.array([likeness(mine[i], mine[i + 1]) for i in own], pa.float64()),
        ],
        names=list(_FIELDS),
    )


def _stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: pa.Table | None = None
    for part in slices(batches):
        rows = pa.Table.from_batches([part])
        rows = rows if held is None else pa.concat_tables([held, rows])
        if rows.num_rows > 1:
            yield _compare(rows)
        held = rows.slice(rows.num_rows - 1)


def _rank(column: Column, cuts: list) -> Column:
    """How many of the descending cuts are greater: a binary search, step by step, in a constant array."""
    if not cuts:
        return F.lit(0)
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    array = F.array(*[F.lit(c) for c in cuts])
    return F.aggregate(F.array(*[F.lit(k) for k in steps]), F.lit(0), lambda at, step: F.when(F.coalesce(F.try_element_at(array, at + step) > column, F.lit(False)), at + step).otherwise(at))


def _range(doc_id: Column, rid: Column, bounds: dict, nulls: int) -> tuple[Column, Column, Column]:
    """rank, parts and grp, each made from those before; grp numbers ranges in the order of rows: descending doc_id, nulls last, then rid.

    bounds: values of doc_id, and how many ranges the rows with just this value fill; nulls: ranges of rows without one.
    """
    cuts = sorted(bounds, reverse=True)
    rank = F.when(doc_id.isNull(), len(cuts) + 1).otherwise(_rank(doc_id, cuts))
    parts = F.lit(1)
    if cuts:
        own, at = F.array(*[F.lit(bounds[c]) for c in cuts]), F.col("rank") + 1
        here = F.try_element_at(F.array(*[F.lit(c) for c in cuts]), at) == doc_id
        parts = F.coalesce(F.when(here, F.try_element_at(own, at)), parts)
    parts = F.when(doc_id.isNull(), nulls).otherwise(parts)
    part = F.least(F.floor((rid.cast("double") / 2.0**64 + 0.5) * F.col("parts")), F.col("parts") - 1)
    grp = F.col("rank").cast("long") * (max(nulls, *bounds.values(), 1) + 1) + F.when(F.col("parts") > 1, part + 1).otherwise(0)
    return rank.alias("rank"), parts.alias("parts"), grp.cast("long").alias("grp")


def fingerprint_with_neighbours(docs: DataFrame) -> DataFrame:
    """doc_id and SCHEMA for every document; the neighbour is the next in descending doc_id, the first for the last."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("doc_id", text).alias("rid"), text.alias("text"))
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known"), F.sum(F.octet_length(F.col("text").cast("string"))).alias("bytes")).first()
    n = size.n
    result = f"doc_id {kind}, {SCHEMA}"
    if not n:
        return spark.createDataFrame([], result)
    partitions = partitions_for(docs, size.bytes or 0)
    ranges = min(n, MOST_RANGES, max(LEAST_GROUPS, 4 * partitions))
    cuts = docs.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 20 * ranges)).first()[0]
    rank, parts, grp = _range(F.col("doc_id"), F.col("rid"), Counter(cuts or []), max(1, (n - size.known) * ranges // n))
    placed = rows.select("*", rank).select("*", parts).select("doc_id", "rid", "text", grp)
    order = F.struct(F.col("doc_id").isNotNull(), "doc_id", F.bitwise_not("rid"))
    firsts = placed.drop("text").groupBy("grp").agg(F.max_by(F.struct("doc_id", "rid"), order).alias("f")).orderBy("grp").collect()
    used = [r.grp for r in firsts]
    halo = spark.createDataFrame([(used[i - 1], r.f.doc_id, r.f.rid) for i, r in enumerate(firsts)], f"to long, h_id {kind}, h_rid long")
    # One row of each first document goes to the range before; equal rows are interchangeable.
    guests = rows.join(F.broadcast(halo), F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("rid") == F.col("h_rid"))).dropDuplicates(["to"])
    sent = placed.select("grp", F.lit(False).alias("halo"), "doc_id", "rid", "text").unionByName(guests.select(F.col("to").alias("grp"), F.lit(True).alias("halo"), "doc_id", "rid", "text"))
    sorted_ = sent.repartition(partitions, "grp").sortWithinPartitions("grp", "halo", F.desc_nulls_last("doc_id"), "rid")
    return sorted_.mapInArrow(_stream, result)
