"""Annotated documents: the best round, the vocabulary and its growth, statistics of rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions.text import vocab_descriptor


def best_index(similarity: Column | str) -> Column:
    """The index, from 0, of the first maximum; NaN is above all numbers. Null for an empty or null array."""
    s = F.col(similarity) if isinstance(similarity, str) else similarity
    return F.when(F.size(s) > 0, (F.array_position(s, F.array_max(s)) - 1).cast("int"))


def best_round(descriptors: Column | str, similarity: Column | str, on_empty: str = "first") -> Column:
    """The descriptors of the best round.

    Where no similarities are given: ``first`` takes the first round, ``all`` the rounds joined, ``error`` raises.
    """
    d = F.col(descriptors) if isinstance(descriptors, str) else descriptors
    rest = {"first": F.get(d, F.lit(0)), "all": F.flatten(d), "error": F.raise_error(F.lit("no similarities to choose a round by"))}[on_empty]
    index = best_index(similarity)
    return F.when(index.isNotNull(), F.get(d, index)).otherwise(rest)


def best_margin(similarity: Column | str) -> Column:
    """The best less the second best similarity; null where the first round is the best or is alone."""
    s = F.col(similarity) if isinstance(similarity, str) else similarity
    ordered = F.sort_array(s, asc=False)
    return F.when((best_index(s) > 0) & (F.size(s) > 1), F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1)))


def vocabulary(docs: DataFrame, descriptors: str = "descriptors") -> DataFrame:
    """(descriptor, n): how often each descriptor occurs in all rounds of all documents."""
    return docs.select(F.explode(F.flatten(descriptors)).alias("d")).select(vocab_descriptor("d").alias("descriptor")).groupBy("descriptor").agg(F.count("*").alias("n"))


def growth(rows: DataFrame, batch: str = "batch", descriptor: str = "descriptor") -> DataFrame:
    """(batch, n_new, n_total): descriptors first met in each batch, and so far. Batches without new ones have 0.

    Only the first batch of each descriptor is kept before counting; what is ordered is one row per batch.
    """
    first = rows.groupBy(descriptor).agg(F.min(batch).alias(batch)).groupBy(batch).agg(F.count("*").alias("n_new"))
    every = rows.select(batch).distinct().join(first, batch, "left").na.fill(0, ["n_new"])
    return every.select(F.col(batch).alias("batch"), "n_new", F.sum("n_new").over(Window.orderBy(batch)).alias("n_total"))


def round_averages(docs: DataFrame, similarity: str = "similarity", rounds: int | None = None) -> DataFrame:
    """(round, n, average) over the documents that have the round."""
    each = docs.select(F.posexplode(similarity).alias("round", "s"))
    each = each if rounds is None else each.where(F.col("round") < rounds)
    return each.groupBy("round").agg(F.count("s").alias("n"), F.avg("s").alias("average"))


def batches(df: DataFrame, size: int, order: str, skip: int = 0) -> DataFrame:
    """Rows after the first ``skip`` in the order of a dense row number, with their batch of ``size`` rows."""
    return df.where(F.col(order) >= skip).withColumn("batch", F.floor((F.col(order) - skip) / size))
