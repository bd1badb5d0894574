"""Comparing every row of one table with every row of another, without a shuffle of the pairs.

Left rows are dealt into blocks and the right rows are sent to every block, so what moves grows with the rows times the
blocks. A task holds its left block and streams through the right rows; pairs exist only in what it returns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Left rows of a block, and the number of blocks from which blocks grow instead.
ROWS = 1024
BLOCKS = 64
#: Pairs of a batch that is returned.
EMIT = 1 << 16

Body = Callable[[pa.RecordBatch, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def crossed(left: DataFrame, right: DataFrame, order: list[str], body: Body, schema: str, least: int | None = None) -> DataFrame:
    """body(a block of left, all of right sorted by `order` in batches) of every block. left is read twice.

    least: left rows of a block, where a row stands for much work.
    """
    parallel = left.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, min(-(-left.count() // (least or ROWS)), max(BLOCKS, parallel)))
    to = "__block"
    a = left.select(F.struct(*left.columns).alias("__left"), F.pmod(F.xxhash64(*left.columns), F.lit(blocks)).cast("int").alias(to))
    b = right.select(F.struct(*right.columns).alias("__right"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias(to))
    rows = a.unionByName(b, allowMissingColumns=True).repartitionById(blocks, F.col(to))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rest = [], None
        for batch in batches:
            n = len(batch) - batch["__left"].null_count
            if n:
                held.append(batch["__left"][:n])
            if n < len(batch):
                rest = batch["__right"][n:]
                break
        if not held:
            return

        def stream() -> Iterator[pa.RecordBatch]:
            if rest is not None:
                yield _flat(rest)
            for batch in batches:
                yield _flat(batch["__right"])

        yield from body(_flat(pa.concat_arrays(held)), stream())

    return rows.sortWithinPartitions(F.col("__right").isNotNull(), *[F.col(f"__right.{c}") for c in order]).mapInArrow(run, schema)


def _flat(rows: pa.StructArray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(rows.flatten(), names=[f.name for f in rows.type])


def packed(lists: pa.ListArray) -> np.ndarray:
    """Lists of numbers from 0 as rows of bits, in words of 64; as many words as the largest number needs."""
    at, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    words = int(at.max()) // 64 + 1 if len(at) else 1
    bits = np.zeros((len(lists), words * 8), np.uint8)
    row = np.repeat(np.arange(len(lists)), np.diff(offsets))
    np.bitwise_or.at(bits, (row, at >> 3), np.left_shift(1, at & 7).astype(np.uint8))
    return bits.view(np.uint64)


def widened(bits: np.ndarray, words: int) -> np.ndarray:
    """With further words of zeros."""
    return bits if bits.shape[1] >= words else np.pad(bits, ((0, 0), (0, words - bits.shape[1])))


class Pairs:
    """Pairs of a row of left and rows of right, returned in batches of two columns."""

    def __init__(self, names: list[str], left: pa.Array, right: pa.Array):
        self.names, self.of = names, (left, right)
        self.left, self.right, self.n = [], [], 0

    def add(self, left: int, right: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.left.append(np.full(len(right), left))
        self.right.append(right)
        self.n += len(right)
        if self.n >= EMIT:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            columns = [of.take(pa.array(np.concatenate(at))) for of, at in zip(self.of, (self.left, self.right), strict=True)]
            self.left, self.right, self.n = [], [], 0
            yield pa.RecordBatch.from_arrays(columns, names=self.names)
