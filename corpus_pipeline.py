"""A corpus pipeline: documents in, token digests of what is worth keeping out.

Each stage works on all that the one before it kept; its table is written as
Parquet to the shared folder and read again, so a lost executor costs the
running stage at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe_automaton, decontaminate, lines, quality, setsketch
from lodestone.llm.common import staged
from lodestone.llm.decontaminate import bloom_filter
from lodestone.llm.queries import table, vocabulary


def _carrying(docs: DataFrame) -> DataFrame:
    """Id and text with the whole row beside them, whatever other columns are called."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and every rule of the cascade."""
    return quality.quality(_carrying(docs), keep=["__row"]).where("kept").select("__row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line stands for; one that only had such lines goes."""
    out = lines.dedup_lines(_carrying(docs), keep=["__row"], width=lines.SHORT_WIDTH).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    row = {c: F.col(f"__row.`{c}`") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in row:
        row["n_chars"] = F.when(F.col("n_removed") == 0, row["n_chars"]).otherwise(F.char_length("text")).cast(dict(docs.dtypes)["n_chars"])
    return out.select(*[row[c].alias(c) for c in docs.columns])


def _without(docs: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """``docs`` without the rows whose ``key`` (a hash) is among ``gone`` (``key``).

    Rows that a filter of bounded size rules out stay without being shuffled.
    """
    gone = staged(gone.select("key").distinct(), "pipeline-gone")
    maybe = bloom_filter(gone)(key)
    left = docs.where(maybe).join(gone.withColumnRenamed("key", "__gone"), key == F.col("__gone"), "left_anti")
    return docs.where(~maybe).unionByName(left)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near-duplicates."""
    gone = setsketch.near_duplicates(docs).where(~F.col("kept")).select(F.xxhash64("doc_id").alias("key"))
    return _without(docs, gone, F.xxhash64("doc_id"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a full window of a benchmark item and, for items shorter
    than a window, without a share of them that op4 calls contaminated.

    A long document that holds a whole passage goes as well, however small the passage's share.
    """
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    gone = found.where("contaminated or full").select(F.xxhash64("doc_id", "text_hash").alias("key"))
    return _without(docs, gone, F.xxhash64("doc_id", F.xxhash64("text")))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the round trip through them, as digests."""
    return bpe_automaton.encode_decode(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe", bpe),
]

#: SQL cannot express fuzzy lines, near-duplicates or tokenization; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"pipeline-{name}")
    return docs
