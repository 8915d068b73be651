"""The subpackage's queries, one an operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import additive_ann, binary_topk, bitplanes, chat, mixing, packing, resampling, simhash, tokencount, warc


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and tokens of all documents under a synthetic unigram model: Zipf's law over the pieces of a public file."""
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), tokencount.unigram_pieces(tokenizer("piece_bpe_32k.model")))


def op4_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_ann.nearest_vectors(_table(spark, sf_dir, "embeddings"))


def op5_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.token_file_digests(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(_table(spark, sf_dir, "pages"))


def op8_binary_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_topk.nearest_codes(_table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digests(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted_conversations(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_source_mix, op2_simhash, op3_token_counts, op4_additive_ann, op5_resampling, op6_token_planes, op7_warc_bundles, op8_binary_topk, op9_packing, op10_chat)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mix": mixing.MIXTURE_SQL, "op7_warc_bundles": warc.ARCHIVED_SQL, "op8_binary_topk": binary_topk.NEAREST_SQL, "op10_chat": chat.FORMATTED_SQL}
