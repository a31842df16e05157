"""A training corpus from ``documents``: quality rules, one document of each
group of near copies, benchmark decontamination, secret redaction, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet and reads again as the next stage's input. All but the last
return the columns of documents. Rows of one stage depend on nothing but its
input, so a stage can be run again after a failure from the written one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roundlearn.llm import decontaminate, ngram_join, quality, secrets, subword
from roundlearn.llm.common import read_table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and every certified cutoff."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies."""
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items, without the
    passages of a whole window or more that they share with one."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"), max_run=decontaminate.WINDOW, length_col="n_chars")


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret span put as its kind."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the token ids of each document."""
    ids = subword.encode(docs, keep=["lang", "source"])
    return ids.select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_redaction", secret_redaction),
    ("encode", encode),
]

#: Set verification, the automaton and seeded merges have no SQL form; the
#: pipeline is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
