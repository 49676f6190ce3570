"""A corpus pipeline of chained stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Nulls,
empty texts, repeated rows and empty tables are handled as the operators' docstrings say; columns of any other name come through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.llm import bpe, exact, language, mixing, simhash
from bandloom.llm.shared import materialize, nested


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without letters, or that no language fits clearly, go."""
    return language.known(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.deduplicated(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component of near-duplicates; of rows that repeat it and its text, one.

    The join is with the ids that go, which are far fewer than those that stay; they are written on their own, so that
    their real size tells whether texts have to move for it.
    """
    stays = F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id")))
    ids = materialize(simhash.near_duplicates(docs).groupBy(F.col("doc_id").alias("id")).agg(stays.alias("stays"), F.count("*").alias("n")), "near-ids")
    gone = materialize(ids.where("NOT stays").select(F.col("id").alias("other")), "near-gone")
    same = F.col("id").eqNullSafe(F.col("other"))
    rows = nested(docs, F.col("doc_id").cast("long").alias("id"))  # as one struct, so that no column's name can clash
    kept = rows.join(gone, same, "left_anti")
    twins = ids.where("stays AND n > 1").select(F.col("id").alias("other"))
    if twins.isEmpty():
        return kept.select("row.*")
    first = kept.join(twins, same, "left_semi").withColumn("text", F.col("row.text")).dropDuplicates(["id", "text"])
    return kept.join(twins, same, "left_anti").select("row").unionByName(first.select("row")).select("row.*")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of every document taken."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("source mixing", source_mixing),
    ("byte-level BPE", byte_bpe),
]

#: Language identification has no SQL form; the tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each over the table that the stage before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs
