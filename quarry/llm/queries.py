"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from quarry.llm import bpe, chat, ego_join, huffman, langid, mixing, order_minhash, quality, resampling, secret_scan, suffix_dedup, toxicity, vector_codes
from quarry.session import spread, table


def tokenizer_path() -> str:
    """The byte-level BPE vocabulary; QUARRY_TOKENIZER names another file."""
    if found := os.environ.get("QUARRY_TOKENIZER"):
        return found
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"))


def op1_mix(spark, sf_dir):
    return mixing.mix_report(_documents(spark, sf_dir))


def op2_bpe(spark, sf_dir):
    both = bpe.encode_and_decode(_documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path())
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op3_embedding_dedup(spark, sf_dir):
    return ego_join.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_quality(spark, sf_dir):
    return quality.quality_report(_documents(spark, sf_dir))


def op5_language(spark, sf_dir):
    return langid.language_report(_documents(spark, sf_dir))


def op6_near_dedup(spark, sf_dir):
    return order_minhash.near_duplicates(_documents(spark, sf_dir))


def op7_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup_report(_documents(spark, sf_dir))


def op8_chat(spark, sf_dir):
    return chat.repair(table(spark, sf_dir, "conversations"))


def op9_token_files(spark, sf_dir):
    return huffman.token_report(_documents(spark, sf_dir), tokenizer_path())


def op10_secrets(spark, sf_dir):
    return secret_scan.scan_report(_documents(spark, sf_dir))


def op11_importance(spark, sf_dir):
    return resampling.resample_report(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op12_toxicity(spark, sf_dir):
    return toxicity.toxicity_report(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op13_vector_codes(spark, sf_dir):
    return vector_codes.code_report(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_mix": op1_mix,
    "op2_bpe": op2_bpe,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_quality": op4_quality,
    "op5_language": op5_language,
    "op6_near_dedup": op6_near_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_chat": op8_chat,
    "op9_token_files": op9_token_files,
    "op10_secrets": op10_secrets,
    "op11_importance": op11_importance,
    "op12_toxicity": op12_toxicity,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES = {
    "op1_mix": mixing.oracle_sql(),
    "op4_quality": quality.oracle_sql(),
    "op11_importance": resampling.oracle_sql(),
    "op13_vector_codes": vector_codes.oracle_sql(),
}
