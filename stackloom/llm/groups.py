"""Texts dealt out once into groups of a few MB, which later steps meet again in the same order.

Every step that needs texts reads the same exchange, keyed by `grp`. Within a group rows are ordered by `rid` and
`rid2`, two hashes of doc_id and text (128 bits, nulls told from values), so a place in a group means the same words
whenever and wherever the group is built: findings of other stages are sent back as (group, word number). Rows with
equal hashes hold the same document and text.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import column

GROUP_BYTES, MOST_BYTES, LEAST_GROUPS = 4 << 20, 32 << 20, 384
#: Text that a shuffle partition has at most, on average; beyond, there are more partitions than the session sets.
PARTITION_BYTES = 128 << 20


def row_keys(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes that together stand for a row; a null differs from any value."""
    none = F.when(doc_id.isNull(), 1).otherwise(0) + F.when(text.isNull(), 2).otherwise(0)
    return F.xxhash64(none, doc_id, text), F.xxhash64(text, F.lit("second"), doc_id, none)


def partitions_for(docs: DataFrame, total: int) -> int:
    """Shuffle partitions for `total` bytes of text: as many as the session sets, or more."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))


def deal(docs: DataFrame, keep: tuple[str, ...], bytes_each: int | None = None) -> tuple[DataFrame, int]:
    """(rows grp, rid, rid2, keep..., text in groups of about bytes_each; number of shuffle partitions for them).

    Groups have 4 MB of text, and up to 32 MB where a shuffle partition would hold many of them: the larger a group,
    the more of its keys share a packed row, and the fewer times a common key is sent.
    """
    text = F.col("text").cast("string")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    set_ = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = partitions_for(docs, total)
    share = total // (16 * partitions)
    groups = max(LEAST_GROUPS, -(-total // (bytes_each or min(MOST_BYTES, max(GROUP_BYTES, share)))))
    rid, rid2 = row_keys(F.col("doc_id"), text)
    dealt = docs.select(F.pmod(F.xxhash64(rid, F.lit("deal")), F.lit(groups)).cast("int").alias("grp"), rid.alias("rid"), rid2.alias("rid2"), *[column(c).alias(f"k_{i}") for i, c in enumerate(keep)], text.alias("text"))
    return (dealt.repartition(partitions, "grp") if partitions > set_ else dealt), partitions


def in_order(table: pa.Table) -> pa.Table:
    """The rows of one group in their lasting order."""
    table = table.combine_chunks()
    return table.take(pc.sort_indices(table, sort_keys=[("rid", "ascending"), ("rid2", "ascending")]))
