"""The corpus pipeline: from raw documents to packed training sequences.

STAGES in order: documents that the quality classifier rejects go; lines whose template
recurs go, and with them documents that have nothing else; of each group of near copies one document stays; the rest is
packed. All but the last stage return the columns of their input (n_chars, where there is one, follows the text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.llm import linededup, minhash, packing, quality
from strandloom.runtime import Scratch, free_name, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling keeps, with the columns of docs.

    Null and empty texts weigh 0, like a text of which nothing is known. Rows tied with the last one kept stay, and equal rows share their fate. Without good
    or without bad labels, and for an empty table, nothing goes. Rows without a doc_id are never labelled.
    """
    return quality.Selection(docs, table(spark, sf_dir, "labels")).filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the lines whose template another document had first.

    A document goes if it has lost lines and holds no word any more: all it had stays where it came first. Null texts, rows without a doc_id and
    lines without a word stay as they are; of equal templates the smallest doc_id has the first; rows of one doc_id count as
    one document; an empty table stays empty. n_chars, where there is one, follows the text.
    """
    n_lines, n_dropped = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    out = linededup.dedup_lines(docs, n_lines=n_lines, n_dropped=n_dropped)
    out = out.filter((F.col(n_dropped) == 0) | F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(n_dropped) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.80 or more), with the columns of docs.

    The smallest doc_id stays. Documents without a word, with a null text or without a doc_id are no copies of anything and stay; of rows that
    agree in doc_id and text one stays; an empty table stays empty.
    """
    return minhash.keep_one(docs, 80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence; see ``packing.pack_documents``. Null texts pack as empty ones, repeated rows each by themselves."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality_filter), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", pack)]

#: The stages need hashed models, MinHash and least squares, which SQL cannot express; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
