"""Removal of long passages that occur more than once, found through difference-cover anchors.

Windows of `window` words are compared by content. To find them without hashing every window of every text, shorter
anchors are hashed only where the word number modulo a period lies in a difference cover: for any two places there is
an offset below the period at which both fall into the cover, so two equal windows always share an aligned anchor.
Places whose anchors repeat are then extended: only windows around them are hashed in full (96 bits) and counted.

Every step works on groups of texts and packed keys. A passage shared by very many texts reaches each bucket once a
group; nothing is compared pair by pair.

Defined cases: null and empty texts have no words; texts shorter than a window lose nothing; repeated rows count as
separate documents, whose windows repeat each other; very long texts are compared whole; an empty table gives no rows;
extra columns are carried along only if asked for, and one called like a result column is returned as <name>_kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .columnar import U64, WORD_BY_SPACE, Texts, Words
from .exchange import buckets_for
from .groups import deal, in_order
from .schema import named, renamed, with_fields
from .repeats import PROBES, places, probes, repeated_places

WINDOW = 35

# Perfect difference sets, period and cover.
COVERS = ((21, (0, 1, 4, 14, 16)), (7, (1, 2, 4)), (1, (0,)))


def cover_for(window: int) -> tuple[int, np.ndarray]:
    """The longest period that leaves anchors of more than a third of the window."""
    period, cover = next(c for c in COVERS if 3 * (window - c[0] + 1) > window)
    mask = np.zeros(period, bool)
    mask[list(cover)] = True
    return period, mask


def _words(table: pa.Table) -> Words:
    return Words(Texts(table.column("text")), WORD_BY_SPACE)


def _number(words: Words) -> np.ndarray:
    """Each word's number within its text."""
    return np.arange(len(words)) - np.repeat(words.at[:-1], words.counts)


def covered(words: Words, starts: np.ndarray, length: int) -> np.ndarray:
    """Marks `length` words from each start."""
    edge = np.zeros(len(words) + length + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge)[: len(words)] > 0


def candidate_starts(words: Words, anchors: np.ndarray, window: int) -> np.ndarray:
    """Starts of windows that hold one of the anchors."""
    period, _ = cover_for(window)
    near = np.zeros(len(words) + 1, np.int64)
    np.add.at(near, np.maximum(anchors - period + 1, 0), 1)
    np.add.at(near, anchors + 1, -1)
    room = np.repeat(words.at[1:], words.counts) - np.arange(len(words)) >= window
    return np.flatnonzero((np.cumsum(near)[:-1] > 0) & room)


def _joined(found: pa.Table) -> np.ndarray:
    parts = [places(b) for b in found.column("at").to_pylist()]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """keep, n_words, n_removed, kept_sha256 and, if asked for, the text without the removed words.

    A word goes if it lies in a window whose word sequence also starts anywhere else. What stays of the text keeps its
    own white space; kept_sha256 is of the kept words joined by single spaces.
    """
    dealt, partitions = deal(docs, keep)
    buckets = buckets_for(partitions)
    period, cover = cover_for(window)
    short = window - period + 1

    def send_anchors(table: pa.Table) -> pa.Table:
        table = in_order(table)
        words = _words(table)
        starts, h = words.windows(words.hashes(), short)
        own = cover[_number(words)[starts] % period]
        starts, h = starts[own], h[own]
        return probes(table.column("grp")[0].as_py(), buckets, h, np.zeros(len(h), np.uint32), starts)

    def send_windows(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows or not found.num_rows:
            return probes(0, buckets, np.zeros(0, U64), np.zeros(0, np.uint32), np.zeros(0, np.int64))
        table = in_order(table)
        words = _words(table)
        chosen = candidate_starts(words, _joined(found), window)
        starts, h = words.windows(words.hashes(0), window)
        _, h2 = words.windows(words.hashes(1), window, 0)
        at = np.searchsorted(starts, chosen)
        return probes(table.column("grp")[0].as_py(), buckets, h[at], (h2[at] >> U64(32)).astype(np.uint32), chosen)

    def cut(table: pa.Table, found: pa.Table) -> pa.Table:
        table = in_order(table)
        words = _words(table)
        gone = covered(words, _joined(found), window)
        lost = np.concatenate(([0], np.cumsum(gone)))[words.at]
        sha, left = [], []
        for i in range(len(words.texts)):
            raw = words.texts.raw(i)
            a, b = words.at[i], words.at[i + 1]
            parts = raw.split()
            if lost[i + 1] > lost[i]:
                stay = ~gone[a:b]
                parts = [w for w, k in zip(parts, stay.tolist(), strict=True) if k]
                if with_text:
                    left.append(_without(raw, words.starts[a:b] - words.texts.offsets[i], gone[a:b]))
            elif with_text:
                left.append(raw.decode())
            sha.append(hashlib.sha256(b" ".join(parts)).hexdigest())
        out = {f"k_{i}": table.column(f"k_{i}") for i in range(len(keep))}
        out |= {"n_words": pa.array(words.counts), "n_removed": pa.array(np.diff(lost)), "kept_sha256": pa.array(sha, pa.string())}
        return pa.table(out | ({"text": pa.array([t if v is not None else None for t, v in zip(left, table.column("text").to_pylist(), strict=True)], pa.string())} if with_text else {}))

    schema = with_fields(renamed(docs, keep), "n_words long, n_removed long, kept_sha256 string" + (", text string" if with_text else ""))
    texts = dealt.groupBy("grp")
    anchors = repeated_places(texts.applyInArrow(send_anchors, PROBES), partitions)
    windows = repeated_places(texts.cogroup(anchors.groupBy("grp")).applyInArrow(send_windows, PROBES), partitions)
    done = texts.cogroup(windows.groupBy("grp")).applyInArrow(cut, schema)
    return named(done, keep)


def _without(raw: bytes, starts: np.ndarray, gone: np.ndarray) -> str:
    """raw without the words marked as gone, each with the white space after it."""
    bounds = np.append(starts, len(raw))
    first = np.flatnonzero(gone & np.append(True, ~gone[:-1]))
    last = np.flatnonzero(gone & np.append(~gone[1:], True))
    parts, at = [], 0
    for a, b in zip(bounds[first].tolist(), bounds[last + 1].tolist(), strict=True):
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]]).decode()


