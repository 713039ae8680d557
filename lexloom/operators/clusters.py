"""Threshold groups around seeds, and medoids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.plans.shared import stored

MAX_ROUNDS = 200


def threshold_groups(ids: DataFrame, pairs: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(id, seed): groups as a scan in id order makes them: the first ungrouped id is a seed and takes all ungrouped ids
    that ``pairs`` (a, b; either order) links to it.

    In rounds: an id without an undecided smaller neighbour is a seed; neighbours of seeds are taken by the smallest.
    Raises RuntimeError after ``max_rounds``.
    """
    links = stored(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    left = stored(ids.select("id").where("id is not null").distinct(), "left")
    seeds = None
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        smaller = links.where("b < a").join(left.select(F.col("id").alias("b")), "b", "left_semi").select(F.col("a").alias("id")).distinct()
        new = stored(left.join(smaller, "id", "left_anti"), "seeds")
        seeds = new if seeds is None else seeds.union(new)
        taken = links.join(new.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        left = stored(left.join(new, "id", "left_anti").join(taken, "id", "left_anti"), "left")
    else:
        raise RuntimeError("ids are left after the last round")
    if seeds is None:
        return left.select("id", F.col("id").alias("seed"))
    near = links.join(seeds.select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("seed"))
    others = near.join(seeds, "id", "left_anti")
    return seeds.select("id", F.col("id").alias("seed")).union(others.join(ids.select("id").distinct(), "id", "left_semi").select("id", "seed"))


def medoids(pairs: DataFrame, group: str, a: str = "a", b: str = "b", distance: str = "distance") -> DataFrame:
    """(group, medoid, total): the member with the least summed distance to the others, of symmetric pairs within groups."""
    ends = pairs.select(group, F.col(a).alias("m"), distance).union(pairs.select(group, F.col(b).alias("m"), distance))
    sums = ends.groupBy(group, "m").agg(F.sum(distance).alias("total"))
    first = sums.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(F.round("total", 9), "m"))).where("n = 1")
    return first.select(group, F.col("m").alias("medoid"), F.round("total", 6).alias("total"))
