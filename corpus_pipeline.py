"""A training corpus from raw documents: language, lines, near-duplicates, source weights, tokens.

Each stage is (name, function of (spark, docs, sf_dir)) and works on all that its predecessor kept. run() writes what a
stage returns as Parquet to the shared folder and reads it for the next, so a lost executor costs one stage at most.
ORACLE_SQL is None: nearest centroids, Order MinHash and SentencePiece are not SQL; tests/llm holds the stages against
brute force.

Defined cases, for every stage: a null text is no known language and goes at the first stage; an empty one likewise; null
doc_ids, sources and labels stay (null ids are in no group of near-duplicates); repeated rows are told apart nowhere: they
are kept or lost together by the first two stages, all kept or all gone after the third, and share their coin in the
fourth; the earlier of equal lines and the lowest id of a group win ties; texts of any length are read whole; an empty
table stays empty. Columns besides those of documents, whatever they are called, come back from every stage but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terseflow.llm import langid, line_edit_join, mixing, order_minhash, sentencepiece_trie
from terseflow.llm.common import materialize

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay; those that no language's centroids are near to go."""
    return langid.keep_identified(docs, langid.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of equal or nearly equal lines stays; documents without any line left go."""
    return line_edit_join.dedup_lines(docs, drop_emptied=True, numbered=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the lowest id stays."""
    return order_minhash.drop_near_duplicates(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal weights for all sources, at most mixing.MAX_EPOCHS passes over any; a document comes as often as it is sampled."""
    return mixing.mix_sources(docs, numbered=False)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with a check that they decode to its text."""
    return sentencepiece_trie.encode_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
