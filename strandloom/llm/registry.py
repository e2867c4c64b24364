"""The llm queries by name, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from strandloom.llm import bpe, chat, embeddings, licenses, linededup, media, minhash, packing, quality, sharding
from strandloom.runtime import table


def queries() -> dict:
    return {
        "op1_sharding": lambda spark, d: sharding.shard_documents(table(spark, d, "documents"), 24),
        "op2_embedding_dedup": lambda spark, d: embeddings.dedup_embeddings(table(spark, d, "embeddings")),
        "op3_importance_resampling": lambda spark, d: quality.select_documents(table(spark, d, "documents"), table(spark, d, "labels")),
        "op4_media_columns": lambda spark, d: media.document_media(table(spark, d, "documents")),
        "op5_license_scan": lambda spark, d: licenses.scan_licenses(table(spark, d, "documents")),
        "op6_byte_bpe": lambda spark, d: bpe.digest_documents(table(spark, d, "documents")),
        "op7_pattern_packing": lambda spark, d: packing.pack_documents(table(spark, d, "documents")),
        "op8_minhash_dedup": lambda spark, d: minhash.near_duplicates(table(spark, d, "documents")),
        "op9_chat_format": lambda spark, d: chat.op9(spark, table(spark, d, "conversations")),
        "op10_line_templates": lambda spark, d: linededup.op10(table(spark, d, "documents")),
    }


def oracle_sql() -> dict:
    return {"op2_embedding_dedup": embeddings.ORACLE_SQL, "op8_minhash_dedup": minhash.ORACLE_SQL, "op10_line_templates": linededup.ORACLE_SQL, "op5_license_scan": licenses.oracle_sql(), "op9_chat_format": chat.ORACLE_SQL}
