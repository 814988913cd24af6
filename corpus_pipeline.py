"""The corpus pipeline: quality, near-duplicates, benchmark leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage
works on all rows that its predecessor kept, and a stage that rejects documents leaves them out.

Every stage takes empty tables, null ids and texts, empty and very long texts, and further columns, whatever their names. A null text counts as an empty one; rows
without id are never near duplicates. Repeated rows are judged alike, so they stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.llm import leaks, neardup, pieces, quality, secrets
from inkstrata.llm.common import table
from inkstrata.session import ship

#: Sampling and model-based stages have no SQL form; they are tested against brute-force versions.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance draw keeps."""
    return quality.resample(docs, table(spark, sf_dir, "labels")).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each near-duplicate group, on shingles of five words; documents without id stay."""
    found = neardup.groups(docs, words=5)
    gone = found.where("doc_id is not null and not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    found = leaks.leaks(docs, table(spark, sf_dir, "benchmark"), "_leaks")
    return found.where(F.size(F.col(found.columns[-1])) == 0).select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked and n_chars counted anew."""
    got = secrets.scan(docs, "_spans")
    text = secrets.redact(F.col("text"), F.col(got.columns[-1]))
    return got.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces, lossless and piece_ids of all documents."""
    got = pieces.encode(docs)
    return got.select("doc_id", "lang", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "lossless", "piece_ids")


STAGES = [("quality", quality_stage), ("near duplicates", near_stage), ("benchmark leaks", leak_stage), ("secrets", secret_stage), ("pieces", token_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(ship(spark), sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
