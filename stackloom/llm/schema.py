"""Result schemas: columns that are carried along, under neutral names inside operators, and new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def column(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_fields(carried: list[StructField], new: str) -> StructType:
    return StructType([*carried, *StructType.fromDDL(new).fields])


def renamed(df: DataFrame, columns: tuple[str, ...]) -> list[StructField]:
    """The fields of columns as k_0, k_1, ..."""
    return [StructField(f"k_{i}", df.schema[c].dataType) for i, c in enumerate(columns)]


def carried(df: DataFrame, columns: tuple[str, ...], text: str = "text") -> DataFrame:
    """columns as k_0, k_1, ... and the text: nothing else goes to the operators, so no name can clash with theirs."""
    return df.select(*[column(c).alias(f"k_{i}") for i, c in enumerate(columns)], column(text).cast("string").alias("text"))


def named(result: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """k_0, k_1, ... under their own names again; one that is called like a result column becomes <name>_kept."""
    own = [c for c in result.columns if not (c.startswith("k_") and c[2:].isdigit())]
    taken = {c.lower() for c in own}
    return result.select(*[F.col(f"k_{i}").alias(f"{c}_kept" if c.lower() in taken else c) for i, c in enumerate(columns)], *own)
