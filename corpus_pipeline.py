"""A corpus pipeline of five stages: what each one decides takes effect, and the next works on all that it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. Columns
other than doc_id and text are carried through under neutral names, so they may be called anything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.llm import decontaminate, ngram_join, pieces, substrings, toxicity
from stackloom.llm.groups import row_keys
from stackloom.plans.session import checkpointed, drop_table, table_folder


def _neutral(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """(doc_id, text and the other columns as c0, c1, ...; the names of all but text)."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    plain = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    return plain, ("doc_id", *[f"c{i}" for i in range(len(others))])


def _named(plain: DataFrame, docs: DataFrame) -> DataFrame:
    """Back to the columns of docs, in their order."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    at = {c: f"c{i}" for i, c in enumerate(others)}
    return plain.select(*[F.col(at.get(c, c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the texts that score 0.5 or more."""
    plain, _ = _neutral(docs)
    return _named(toxicity.keep_clean(plain, spark.read.parquet(f"{sf_dir}/labels.parquet")), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with Jaccard 0.8 or more on five words: the one with the smallest doc_id.

    Equal doc_ids within a component are told apart by 128 bits of hashes of row and text; of rows equal in both, one stays. Texts
    without words are in no component and stay.
    """
    rid, rid2 = row_keys(F.col("doc_id"), F.col("text").cast("string"))
    keyed = docs.select("doc_id", "text", rid.alias("rid"), rid2.alias("rid2"))
    linked = ngram_join.link_texts(keyed, k=5, least=80, of=100, keep=("doc_id", "rid", "rid2")).where("comp is not null")
    linked = checkpointed(linked.select("comp", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "rid2").alias("at")))
    first = checkpointed(linked.groupBy("comp").agg(F.min("at").alias("stays")).select(F.col("comp").alias("of"), "stays"))
    lost = linked.join(first, F.col("comp") == F.col("of")).where((F.col("at.rid") != F.col("stays.rid")) | (F.col("at.rid2") != F.col("stays.rid2"))).select(F.col("at.rid").alias("gone"), F.col("at.rid2").alias("gone2"))
    plain, _ = _neutral(docs)
    same = (F.col("rid") == F.col("gone")) & (F.col("rid2") == F.col("gone2"))
    kept = plain.withColumn("rid", rid).withColumn("rid2", rid2).join(checkpointed(lost.distinct()), same, "left_anti")
    again = checkpointed(keyed.groupBy("rid", "rid2").agg(F.count(F.lit(1)).alias("n"), F.max(F.length(F.trim(F.coalesce(F.col("text"), F.lit(""))))).alias("chars")).where("n > 1 and chars > 0").select("rid", "rid2"))
    if not again.isEmpty():  # rows that repeat doc_id and text: one of each
        twice = kept.join(again, ["rid", "rid2"], "left_semi").dropDuplicates(["rid", "rid2"])
        kept = kept.join(again, ["rid", "rid2"], "left_anti").unionByName(twice)
    return _named(kept, docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without words in passages of 35 words or more that occur anywhere else; other texts stay as they are."""
    plain, keep = _neutral(docs)
    cut = substrings.remove_repeats(plain, keep, with_text=True)
    if "n_chars" in docs.columns:
        at = f"c{[c for c in docs.columns if c not in ('doc_id', 'text')].index('n_chars')}"
        cut = cut.withColumn(at, F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(at)))
    return _named(cut, docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the texts that hold ten consecutive words of a benchmark item, or a whole shorter item."""
    plain, _ = _neutral(docs)
    return _named(decontaminate.remove_leaks(plain, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of docs, piece ids and their number."""
    plain, keep = _neutral(docs)
    ids = pieces.encode_texts(plain.withColumn("body", F.col("text")), (*keep, "body"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    at = {"text": "body"} | {c: f"c{i}" for i, c in enumerate(others)}
    taken = {c.lower() for c in docs.columns}
    new = [F.col(c).alias(c if c not in taken else f"piece_{c}") for c in ("ids", "n_tokens")]
    return ids.select(*[F.col(at.get(c, c)).alias(c) for c in docs.columns], *new)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontaminate", drop_leaks),
    ("sentencepiece", encode),
]

#: No SQL: a trained network decides the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet to the shared folder and read again.

    A stage's table is removed once the next one is written. The last one's stays, as the result reads it.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = table_folder(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            drop_table(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
