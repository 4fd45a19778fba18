"""From documents to packed training sequences: quality rules, near-duplicate removal, secret removal, packing.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept. ``run`` writes every stage as Parquet in the
shared checkpoint folder and rereads it, so a lost executor never repeats an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from econspark.llm import near_dedup, packing, secret_scan, tokeniser_quality
from econspark.llm._shared import table, written
from econspark.llm.queries import Query, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fertility rules (with the base rules) keep."""
    judged = tokeniser_quality.add_quality(docs, vocabulary("piece_bpe_32k.model"), vocabulary("word_bpe_49k.json"))
    return judged.where("quality.kept").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the class's smallest id; documents with null text or id stay."""
    return near_dedup.drop_near_duplicates(docs).select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with every secret replaced by a mark; ``n_chars`` follows the text."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in full sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), keep_ids=False).drop("ids")


STAGES = [("quality", quality), ("near_dedup", one_of_each), ("secrets", without_secrets), ("packing", packed)]
#: No stage can be stated in SQL: tokenizers, sampling and decoding have no SQL form. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


ENTRY = Query("pipeline", run, ORACLE_SQL)
