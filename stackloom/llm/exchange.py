"""Packed exchange: arrays of keys go to buckets as a few binary rows instead of one row a key.

`scatter` sorts the entries of one block by bucket and lays each bucket's part out as one row; Spark moves, sorts and
spills those rows as any others; `gather` reads whole buckets back as numpy arrays. The rows carry binary columns, so
neither the JVM nor Arrow touches single entries.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Entries that a reducer takes up together at least, in whole buckets.
GATHER = 1 << 20


def packed(bounds: np.ndarray, values: np.ndarray) -> pa.Array:
    """One binary a range between bounds (entry numbers) of values."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())


def scatter(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> dict[str, pa.Array]:
    """bucket and, by bucket, the packed columns; only buckets with entries get a row."""
    order = np.argsort(bucket.astype(np.uint16) if bucket.size and bucket.max() < 1 << 16 else bucket, kind="stable")
    ids, first = np.unique(bucket[order], return_index=True)
    bounds = np.append(first, len(order))
    return {"bucket": pa.array(ids.astype(np.int32))} | {k: packed(bounds, v[order]) for k, v in columns.items()}


def unpack(array: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """(all entries of a packed column, entries of each row)."""
    array = (array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array).cast(pa.large_binary())
    n, (_, offsets, data) = len(array), array.buffers()
    if not n:
        return np.zeros(0, kind), np.zeros(0, np.int64)
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + n + 1]
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw.copy().view(kind), np.diff(at) // size


def whole_groups(batches: Iterable[pa.RecordBatch], key: str = "bucket", most: int = 32 << 20) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by key: as many groups as make up `most` bytes, or one."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < most:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield table.slice(0, cut)
            rest = table.slice(cut).combine_chunks()
            held = rest.to_batches()
            size = sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held)


def buckets_for(partitions: int, least: int = 256) -> int:
    """Buckets to scatter into: a few for each shuffle partition."""
    return max(least, 2 * partitions)
