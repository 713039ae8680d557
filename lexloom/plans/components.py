"""Connected components of an undirected edge table, by alternating large-star and small-star rounds.

Every round is two aggregations (with map-side partials) and two equi-joins, so a vertex with very many neighbours is
never gathered in one task: its minimum is a partial aggregate and its edges stay splittable rows of a sort-merge join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.plans.shared import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every vertex of ``edges``; the component is its smallest vertex.

    Self loops and repeated edges are allowed; rows with a null end are ignored. A vertex met only in a self loop is
    its own component. An empty table gives an empty result. Raises RuntimeError after ``max_rounds`` rounds.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    pairs = stored(pairs.distinct(), "cc-edges")
    loops = pairs.where("x = y").select(F.col("x").alias("node"))
    cur = stored(pairs.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "cc")
    before = _state(cur)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        inner = large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        cur = stored(inner.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "cc")
        after = _state(cur)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    found = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node")).union(loops).distinct().join(found.select("node"), "node", "left_anti")
    return found.union(roots.select("node", F.col("node").alias("component")))
