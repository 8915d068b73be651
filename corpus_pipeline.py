"""A training corpus from ``documents``: good text, one document of a kind, mixed, packed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; each
result is written as Parquet to the shared folder and read again. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import mixing, packing, resampling, similar
from gridloom.llm._base import sent, written
from gridloom.llm.entry import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps; those it rejects go.

    Null and empty texts weigh 0, copies stand or fall together: see :func:`gridloom.llm.resampling.resample`.
    """
    return resampling.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, which share 0.8 or more of their five-word shingles (Jaccard).

    Links are those of SimHash, verified, and those that it can't see: see :func:`gridloom.llm.similar.groups`.
    It is the row with the smallest doc_id, a null one last; of several, that with the smallest
    hash of the text. Rows are told apart by a written key, so repeated and null ids are no matter. Null and blank
    texts are copies of each other. Any other columns are kept, but ``__row``; an empty table gives no row.
    """
    tie = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("t"), F.col("__row").alias("row"))
    keyed = written(docs.withColumn("__row", F.monotonically_increasing_id()), "keyed")
    marked = written(similar.groups(keyed, "__row").join(keyed.select(F.col("__row").alias("row"), tie.alias("tie")), "row"), "groups")
    first = marked.groupBy("g").agg(F.min("tie").alias("first"))
    gone = marked.join(first, "g").filter("row <> first.row").select(F.col("row").alias("__row"))
    return keyed.join(sent(written(gone, "gone")), "__row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each row as often as its source's target asks for.

    A null source is a source; rows are judged one by one: see :func:`gridloom.llm.mixing.mixed_documents`.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed sequences: one row a piece, with the CRC of its ids.

    A null text is its end id only; null ids stay; repeated rows are packed once each: see :func:`gridloom.llm.packing.pack`.
    """
    return packing.packed_digests(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing_stage), ("packing", pack)]

#: SQL can't express the resampling, the links between near-duplicates or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
