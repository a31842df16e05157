"""The registered queries of this subpackage: each applies one operator, with
production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundlearn.llm import (alignment, decontaminate, html_text, langid, licenses, ngram_join, periodic, quality, secrets,
                            sharding, subword, token_counts, toxicity)
from roundlearn.llm.common import held_out, read_table


def op1_ngram_join(spark: SparkSession, d: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets are 0.8 similar."""
    return ngram_join.link_components(read_table(spark, d, "documents"))


def op2_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    """Ids of each document under seeded merge dropout (count and digest),
    and whether they decode to its text."""
    return subword.encode(read_table(spark, d, "documents"), with_ids=False)


def op3_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark words, items and verdict for each document."""
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.match(docs, read_table(spark, d, "benchmark"))).drop("hit_spans", "hit_items")


def op4_license_scan(spark: SparkSession, d: str) -> DataFrame:
    """Licence of each document, own or inherited. The path of a document is
    source/lang/doc_id; one of at most 64 words that has a licence line
    stands as a licence file of its directory."""
    docs = read_table(spark, d, "documents")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    short = F.size(F.split(F.trim("text"), "\\s+")) <= 64
    return licenses.scan(docs, path, short & licenses.header(F.col("text")).isNotNull())


def op5_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    """Base counts and the verdict of risk-controlled rules."""
    return (quality.verdicts(read_table(spark, d, "documents"), read_table(spark, d, "labels"))
            .withColumn("broken", F.array_join("broken", ",")))


def op6_sharding(spark: SparkSession, d: str) -> DataFrame:
    """Shard and slot of each document by a keyed permutation."""
    rows = sharding.shard(read_table(spark, d, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op8_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    """Secrets of each document: base counts and digest, all spans."""
    return secrets.find_secrets(read_table(spark, d, "documents")).drop("span_list")


def op7_toxicity(spark: SparkSession, d: str) -> DataFrame:
    """Score and verdict of each document; the rows that crc32 holds out are
    not learned from."""
    docs = read_table(spark, d, "documents")
    model = toxicity.fit(docs, read_table(spark, d, "labels"), ~held_out(F.col("doc_id")))
    return toxicity.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.size("sentences").alias("n_sentences"))


def op9_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Unigram token count and log probability of each document."""
    return token_counts.count_tokens(read_table(spark, d, "documents")).withColumn("log_prob", F.round("log_prob", 6))


def op10_language_id(spark: SparkSession, d: str) -> DataFrame:
    """Language and score of each document; the rows that crc32 holds out are
    not learned from."""
    docs = read_table(spark, d, "documents")
    model = langid.fit(docs, ~held_out(F.col("doc_id")))
    return langid.predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_token_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Groups, links and corpus-wide link counts of two tokenizers' tokens."""
    return alignment.align(read_table(spark, d, "documents"))


def op12_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of each document's words, and its text with each run kept once."""
    docs = read_table(spark, d, "documents")
    return periodic.runs_digest(docs, rewrite=periodic.planted_tail)


def op13_html_text(spark: SparkSession, d: str) -> DataFrame:
    """Main text of each page."""
    return html_text.extract(read_table(spark, d, "pages"))


QUERIES = {f.__name__: f for f in (
    op1_ngram_join, op2_sentencepiece, op3_decontaminate, op4_license_scan, op5_quality_rules, op6_sharding,
    op7_toxicity, op8_secret_scan, op9_token_counts, op10_language_id, op11_token_alignment, op12_periodic_runs,
    op13_html_text)}
ORACLE: dict[str, str] = {}
