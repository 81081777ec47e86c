"""The queries of this subpackage, with production parameters over whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terseflow.llm import ivf_pq, langid, line_edit_join, media_shards, mixing, order_minhash, secret_scan, sentencepiece_trie, site_templates, substring_repeats


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.duplicates(table(spark, sf_dir, "documents"))


def op2_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_templates.extract(table(spark, sf_dir, "pages"))


def op3_media_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places and metadata of all media; the shard folder's name, which differs from run to run, is cut off."""
    packed = media_shards.pack(media_shards.rendered(table(spark, sf_dir, "embeddings")), "payload")
    return media_shards.describe(packed).withColumn("shard", F.substring_index("shard", "/", -1))


def op4_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows whose id is divisible by QUERY_EVERY against all rows."""
    return ivf_pq.neighbours(table(spark, sf_dir, "embeddings"), every=ivf_pq.QUERY_EVERY)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_trie.encode_documents(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_repeats.repeats(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_edit_join.dedup_lines(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_order_minhash, op2_site_templates, op3_media_shards, op4_ivf_pq, op5_sentencepiece, op6_secret_scan, op7_substring_dedup, op8_language_id, op9_source_mixing, op10_line_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op9_source_mixing": mixing.ORACLE_SQL, "op10_line_dedup": line_edit_join.ORACLE_SQL}
