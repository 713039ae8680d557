"""Harmonising: documents' descriptors take the schema's, by nearest neighbours and a decider."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions.text import choice_key, pair_text
from lexloom.operators import neighbors as nn


def candidates(queries: DataFrame, schema: DataFrame, k: int, least: float) -> DataFrame:
    """(id, neighbor, score, rank): of the k nearest schema rows those with at least ``least``, or else the first."""
    return nn.with_fallback(nn.top_k(queries, schema, k), least)


def choose_by_score(found: DataFrame, above: float) -> DataFrame:
    """(id, chosen): the reranker's best candidate if its score is above the threshold, else null."""
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "neighbor"))).where("n = 1")
    return best.select("id", F.when(F.col("score") > above, F.col("neighbor")).alias("chosen"))


def choose_by_index(found: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, chosen): the candidate of the answered rank (id, answer), the first if there is no such; null answers choose none."""
    first = found.where("rank = 1").select("id", F.col("neighbor").alias("first"))
    named = answers.join(found.select("id", F.col("rank").alias("answer"), "neighbor"), ["id", "answer"], "left")
    return first.join(named, "id", "left").select("id", F.when(F.col("answer").isNotNull(), F.coalesce("neighbor", "first")).alias("chosen"))


def decide_cached(found: DataFrame, texts: DataFrame, cache: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Decisions from a cache (key, chosen) where it has them, else from ``decide``: (decisions, new cache rows).

    A key names the query's text (id, text) and its candidates in order; a cached null means no match.
    """
    listed = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("neighbor").cast("string").alias("n")))).alias("c"))
    keyed = listed.join(texts, "id").select("id", choice_key(F.col("text"), F.col("c.n")).alias("key"))
    known = keyed.join(cache, "key").select("id", "chosen")
    fresh_ids = keyed.join(cache, "key", "left_anti")
    fresh = decide(found.join(fresh_ids.select("id"), "id", "left_semi"))
    return known.union(fresh.select("id", "chosen")), fresh.join(fresh_ids, "id").select("key", "chosen").distinct()


def harmonized_documents(owners: DataFrame, decisions: DataFrame, schema: DataFrame, dedup: bool = True) -> DataFrame:
    """(doc_id, harmonized): each document's schema strings in the order of its descriptors; documents without any keep [].

    owners: (doc_id, pos, id), decisions: (id, chosen), schema: (id, descriptor, explainer). With ``dedup`` only the
    first of equal strings stays.
    """
    named = decisions.where("chosen is not null").join(schema.select(F.col("id").alias("chosen"), pair_text("descriptor", "explainer").alias("text")), "chosen")
    each = owners.join(named.select("id", "text"), "id", "left")
    listed = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("pos", "text")))).alias("l"))
    return listed.select("doc_id", (F.array_distinct("l.text") if dedup else F.col("l.text")).alias("harmonized"))


def decision_log(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row per query: the chosen id with its similarity, or the candidates where nothing was chosen."""
    listed = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbor", "score"))).alias("candidates"))
    full = listed.join(decisions, "id", "left")
    hit = F.filter("candidates", lambda c: c["neighbor"] == F.col("chosen"))
    return full.select("id", F.col("chosen").isNotNull().alias("is_synonym"), F.col("chosen").alias("chosen_id"), F.get(hit, F.lit(0))["score"].alias("embed_sim"), F.when(F.col("chosen").isNull(), F.col("candidates")).alias("candidates"))
