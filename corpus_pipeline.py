"""A corpus in five stages: classify, join copies, decontaminate, redact, encode.

Each stage takes and, but for the last, returns the columns of ``documents``, whatever further columns these have. Rows
without an id pass the filtering stages; ids are expected to be unique, and rows that repeat one stay or go together.
Null and empty texts have weight 0 in the first stage, are in no group of copies and hold no benchmark item; from the PII
stage on a null text is empty. Documents that tie stay or go together. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import decontam, jaccard, pieces, pii, quality
from lexloom.plans.shared import small, stored

#: No SQL form: the classifier's models, the transitive closure of links and the tokenizer have none.
ORACLE_SQL = None
#: Near copies are judged on shingles of five words at a similarity of 80 / 100; four words and 85 / 100 belong to op7_jaccard alone.
COPIES = {"k": 5, "num": 80, "den": 100}


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The documents whose id is not among (doc_id); texts are only shuffled where those ids are too many to broadcast."""
    return docs.join(small(stored(rejected.select("doc_id").distinct(), "rejected")), "doc_id", "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance-resampling classifier keeps."""
    judged = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, judged.where(~F.col("keep")))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram Jaccard join, the document with the smallest id."""
    found = jaccard.jaccard_components(docs, **COPIES)
    return _without(docs, found.where(F.col("doc_id") != F.col("component_id")))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return _without(docs, decontam.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    clean = pii.redact(docs.select(F.struct(*rest).alias("rest"), "text"), "rest", "text")
    return clean.select("id.*", "text", F.length("text").cast("bigint").alias("n_chars")).select(*docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every document."""
    both = pieces.round_trip(docs, pieces.load_model())
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("jaccard", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("pieces", pieces_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's are written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
