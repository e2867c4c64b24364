"""Sequence filters over a stream of FASTA files: the same narrow expressions as in batch.

Each record is judged by itself, so there is no state and no watermark; a file is picked up once, when it appears.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strandloom.operators.candidates import filter_n
from strandloom.sources.formats import parse_fasta


def fasta_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(name, seq) of the records of each file that appears in a folder."""
    return parse_fasta(spark.readStream.option("lineSep", "\n>").text(folder))


def filtered_stream(spark: SparkSession, folder: str, most: float = 0.2) -> DataFrame:
    return filter_n(fasta_stream(spark, folder), most)


def write_stream(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there to Parquet and ends; run it again for what has come since."""
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
