"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ballkmeans, bytebpe, hnsw, langid, leaks, licenses, neardup, pieces, quality, secrets, sharding, sql, suffixes, vafile
from .common import table


def op1_shard_minimax(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.shard(table(spark, sf_dir, "documents"), 16)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = quality.resample(docs, table(spark, sf_dir, "labels"))
    return got.select("doc_id", F.col("_features").alias("n_features"), F.col("_log_weight").alias("log_weight"), F.col("_draw").alias("draw"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    s = F.col("spans")
    n = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long")
    return got.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                      F.sha2(secrets.digest(s, [0, 1, 2]), 256).alias("base_sha256"), secrets.digest(s).alias("spans"))


def op4_sentencepiece_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "lossless", "piece_ids")


def op5_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffixes.removed(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = leaks.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")


def op7_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op8_language_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    got = langid.identify(docs, fold != 2)
    return got.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), words=4)


def op10_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("body")


def op11_ball_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ballkmeans.clusters(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, salt="2:")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vafile.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), every=100, positives=5, negatives=10, low=30, high=90)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = bytebpe.decode(bytebpe.encode(docs))
    return got.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2("token_bytes.packed", 256).alias("ids_sha256"), F.sha2("token_bytes.body", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_shard_minimax, op2_quality_resampling, op3_secret_scan, op4_sentencepiece_sample, op5_suffix_repeats, op6_benchmark_leaks, op7_hnsw_neighbours, op8_language_cross_parsing, op9_near_duplicates, op10_license_windows, op11_ball_clusters, op12_hard_negatives, op13_byte_bpe)}
SQL: dict[str, str] = {"op3_secret_scan": sql.secret_scan(), "op9_near_duplicates": sql.near_duplicates(),
                       "op11_ball_clusters": sql.ball_clusters(), "op12_hard_negatives": sql.hard_negatives()}
