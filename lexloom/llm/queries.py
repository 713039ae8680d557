"""The registered queries of this subpackage: each applies one operator to its whole table and derives the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import decontam, html_text, jaccard, lm, pieces, pii, quality, secrets, simhash, spans
from lexloom.llm.columns import count_kind, span_digest, span_text


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_report(_docs(spark, sf_dir))


def op1_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that op1_simhash counts in n_near, by class."""
    return simhash.near_classes(_docs(spark, sf_dir))


def _span_report(found: DataFrame, base: tuple[str, ...], *more: Column) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans in text form."""
    own = found.withColumn("base", F.filter("spans", lambda s: s["kind"].isin(*base)))
    return own.select(
        F.col("id").alias("doc_id"), *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in base],
        span_digest(F.col("base")).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), *more,
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_report(secrets.scan_secrets(_docs(spark, sf_dir)), secrets.KINDS[:3])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside what all spans are: their scores, and how many of them redaction replaces."""
    found = pii.find_pii(_docs(spark, sf_dir))
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",")
    return _span_report(found, pii.KINDS[:4], scores.alias("scores"), F.size(F.filter("spans", lambda s: s["score"] >= pii.LEAST_SCORE)).cast("bigint").alias("n_sure"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_docs(spark, sf_dir))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_docs(spark, sf_dir))


def op9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.drop_repeats(_docs(spark, sf_dir))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job: op9_spans is bound to its SQL, which knows runs of three sentences alone."""
    return spans.drop_passages(_docs(spark, sf_dir))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every text, and the digest of what they decode to."""
    both = pieces.round_trip(_docs(spark, sf_dir), pieces.load_model())
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op1_partners, op2_secrets, op3_quality, op4_pii, op5_html, op6_decontamination, op7_jaccard, op8_lm, op9_spans, op9_passages, op10_pieces)}


def oracle_sql() -> dict[str, str]:
    return {"op6_decontamination": decontam.ORACLE_SQL, "op9_spans": spans.ORACLE_SQL}
