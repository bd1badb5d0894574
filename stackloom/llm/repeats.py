"""Which keys occur more than once, over all groups of texts, as a packed exchange.

A group sends each distinct key once to the key's bucket, with the key's place; keys that repeat within the group are
settled there, and only a bare copy goes out to tell other groups. So a key that a third of all rows share reaches its
bucket once a group, not once a row. Buckets find keys sent by several groups and report the places back by group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .columnar import U64
from .exchange import packed, scatter, unpack, whole_groups

NO_PLACE = np.uint32(0xFFFFFFFF)
PROBES = "bucket int, src int, h binary, h2 binary, at binary"
PLACES = "grp int, at binary"


def probes(src: int, buckets: int, h: np.ndarray, h2: np.ndarray, at: np.ndarray) -> pa.Table:
    """Rows for the buckets of one group's keys (h, h2) at places `at`."""
    order = np.lexsort((at, h2, h))
    a, b = h[order], h2[order]
    fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
    number = np.cumsum(fresh) - 1
    several = np.bincount(number, minlength=0)[number] > 1 if len(a) else fresh
    settled = np.sort(at[order][several])
    sent = order[fresh]
    place = np.where(several[fresh], NO_PLACE, at[sent]).astype(np.uint32)
    sent, place = sent[np.argsort(at[sent], kind="stable")], place[np.argsort(at[sent], kind="stable")]
    out = scatter((h[sent] >> U64(20)) % U64(buckets), {"h": h[sent], "h2": h2[sent].astype(np.uint32), "at": place})
    rows = [pa.table({"bucket": out["bucket"], "src": pa.array(np.full(len(out["bucket"]), src, np.int32)), "h": out["h"], "h2": out["h2"], "at": out["at"]})]
    if len(settled):
        none = pa.array([b""], pa.binary())
        rows.append(pa.table({"bucket": pa.array([buckets + src], pa.int32()), "src": pa.array([src], pa.int32()), "h": none, "h2": none, "at": pa.array([_delta(settled.astype(np.uint32))], pa.binary())}))
    return pa.concat_tables(rows)


def _delta(sorted_places: np.ndarray) -> bytes:
    return np.diff(sorted_places, prepend=np.uint32(0)).astype(np.uint32).tobytes()


def places(blob: bytes | None) -> np.ndarray:
    """Word numbers from one binary of `PLACES`."""
    return np.cumsum(np.frombuffer(blob or b"", np.uint32), dtype=np.int64)


def _report(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, most=16 << 20):
        h, n = unpack(table.column("h"), U64)
        src = table.column("src").to_numpy()
        settled = n == 0
        known = table.filter(pa.array(settled))
        if known.num_rows:
            yield pa.RecordBatch.from_arrays([known.column("src").combine_chunks(), known.column("at").combine_chunks()], names=["grp", "at"])
        if not len(h):
            continue
        rest = table.filter(pa.array(~settled))
        h2, at = unpack(rest.column("h2"), np.uint32)[0], unpack(rest.column("at"), np.uint32)[0]
        order = np.lexsort((h2, h))
        a, b = h[order], h2[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        twice = np.append(False, same) | np.append(same, False)
        hit = order[twice]
        hit = hit[at[hit] != NO_PLACE]
        owner = np.repeat(src[~settled], n[~settled])[hit]
        by = np.lexsort((at[hit], owner))
        owner, at = owner[by], at[hit][by]
        groups, first = np.unique(owner, return_index=True)
        step = np.diff(at, prepend=np.uint32(0)).astype(np.uint32)
        step[first] = at[first]
        yield pa.RecordBatch.from_arrays([pa.array(groups.astype(np.int32)), packed(np.append(first, len(at)), step)], names=["grp", "at"])


def repeated_places(sent: DataFrame, partitions: int) -> DataFrame:
    """PLACES of all keys of `probes` rows that occur more than once."""
    dealt = sent.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_report, PLACES)
