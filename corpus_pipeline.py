"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept; all but the last return the columns of documents. An empty table, or one of
which a stage keeps nothing, passes through the stages as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.llm.decontaminate import decontaminated
from scrivener.llm.packing import packed_documents
from scrivener.llm.pseudonyms import pseudonymised
from scrivener.llm.quality_rules import judged
from scrivener.llm.shared import Scratch, fresh
from scrivener.llm.simhash import near_duplicates
from scrivener.session import table

KEY = "a key for demonstration"


def _numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """docs, written with a number per row, and the name of that column: rows can share an id or have none."""
    row = fresh(docs, "row_number")
    return scratch.save(docs.withColumn(row, F.monotonically_increasing_id())), row


def _semi(docs: DataFrame, rows: DataFrame, row: str) -> DataFrame:
    """Rows of docs whose number is among rows, without it."""
    return docs.join(rows.select(row), row, "left_semi").drop(row)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, each row by itself. Null and empty texts fail them."""
    numbered, row = _numbered(docs, Scratch(spark))
    return _semi(numbered, judged(numbered, table(spark, sf_dir, "labels"), row=row).filter("kept"), row)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest doc_id (none is the largest), and one row of it."""
    scratch = Scratch(spark)
    numbered, row = _numbered(docs, scratch)
    groups = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    ids = groups.join(numbered.select(row, F.col("doc_id").cast("long").alias("doc_id")), row)
    kept = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row)).alias("first"))
    return _semi(numbered, kept.select(F.col(f"first.{row}").alias(row)), row)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, each row by itself. Null and empty texts contain none."""
    numbered, row = _numbered(docs, Scratch(spark))
    return decontaminated(numbered, table(spark, sf_dir, "benchmark"), row=row).drop(row)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars is that of the new text. Null texts stay null; rows that are repeated
    stay so."""
    out = pseudonymised(docs, KEY)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_pseudonyms") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, each with its sequence and place there. A null or empty text is an end id; repeated
    rows are packed each by itself."""
    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", near_dedup), ("decontamination", decontamination), ("pseudonyms", pseudonyms), ("packing", packing)]

#: Hashing, tokens and packing are beyond SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet before the next one reads it."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
