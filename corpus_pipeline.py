"""The corpus pipeline: stages over `documents`, each of whose results is written and read again by the next.

All stages but the last return the columns of documents; n_chars follows a text that a stage changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm import langid, linechunks, minhash, packing, secretscan
from factgraph.llm.common import stored, table


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that `lang` names; those without a letter or in none of them go."""
    found = langid.identify(docs, langid.learn(langid.learnable(docs)))
    return found.where((F.col("lang_pred") != "und") & (F.col("share_known") >= langid.REJECT)).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the passages of several lines that an earlier document has; documents of which nothing is left go."""
    found = linechunks.without_repeats(docs)
    return _with_length(found.where(r"n_removed = 0 OR text RLIKE '\\S'").select(docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, by shingles of five words, the document with the smallest id."""
    return minhash.one_of_each(docs, words=5, percent=80).select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With [kind] in place of each secret."""
    return _with_length(secretscan.without_secrets(docs, secretscan.learn(docs)).select(docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids with their places in sequences of at most 4096."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]

#: The stages can't be said in SQL; tests/llm holds them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
