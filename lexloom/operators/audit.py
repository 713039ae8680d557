"""Audits: each rule gives the rows that break it, as (rule, id); a lineage passes if there are none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of two tables that one task compares.
COUNTED_ROWS = 4_000_000


def _rule(name: str, rows: DataFrame, col: str = "id") -> DataFrame:
    return rows.select(F.lit(name).alias("rule"), F.col(col).cast("string").alias("id")).distinct()


def lineage_audit(originals: DataFrame, events: DataFrame, finals: DataFrame) -> DataFrame:
    """Rules over originals (id), events (dst, src) and finals (id).

    missing: an original that is neither a source nor final; unknown_source: a source that nothing made; untraceable: a
    final that is no original and that no event made; repeated_final; reused_id: a new id that is an original; dropped:
    a new id that is neither merged on nor final; several_targets: a source of more than one new id; same_sources: new
    ids with equal source sets.
    """
    ids, made = originals.select("id").distinct(), events.select(F.col("dst").alias("id")).distinct()
    used, ends = events.select(F.col("src").alias("id")).distinct(), finals.select("id").distinct()
    anti = lambda a, *others: reduce(lambda x, y: x.join(y, "id", "left_anti"), others, a)
    sets = events.distinct().groupBy("dst").agg(F.array_join(F.array_sort(F.collect_set(F.col("src").cast("string"))), ",").alias("s"))
    twins = sets.groupBy("s").agg(F.count("*").alias("n"), F.min("dst").alias("id")).where("n > 1")
    return reduce(DataFrame.union, [
        _rule("missing", anti(ids, used, ends)),
        _rule("unknown_source", anti(used, ids, made)),
        _rule("untraceable", anti(ends, ids, made)),
        _rule("repeated_final", finals.groupBy("id").count().where("count > 1")),
        _rule("reused_id", made.join(ids, "id", "left_semi")),
        _rule("dropped", anti(made, used, ends)),
        _rule("several_targets", events.distinct().groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("n")).where("n > 1")),
        _rule("same_sources", twins),
    ])


def coverage(left: DataFrame, right: DataFrame, col: str = "id") -> DataFrame:
    """One row: distinct values of both sides, in both, only left, only right."""
    a, b = left.select(col).distinct().withColumn("l", F.lit(1)), right.select(col).distinct().withColumn("r", F.lit(1))
    both = a.join(b, col, "full_outer")
    return both.agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_both"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"))


def same_multiset(left: DataFrame, right: DataFrame) -> bool:
    """Whether both tables hold the same rows equally often.

    Tables of different sizes differ. Else rows, those of one side counting against those of the other, are dealt out by
    their values before they are summed up, at most about COUNTED_ROWS of both sides to a task: what a task has in memory
    hangs neither on how the tables are partitioned nor on their sizes.
    """
    n = left.count()
    if n != right.count():
        return False
    both = left.withColumn("_side", F.lit(1).cast("bigint")).union(right.withColumn("_side", F.lit(-1).cast("bigint")))
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * n // COUNTED_ROWS))
    columns = [F.col(f"`{c}`") for c in left.columns]
    return both.repartition(parts, *columns).groupBy(*columns).agg(F.sum("_side").alias("_more")).where("_more <> 0").isEmpty()


def conservation(originals: DataFrame, traced: DataFrame) -> DataFrame:
    """One row: total of the originals' counts (n), of the traced ones (contribution_count), and whether they agree."""
    a, b = originals.agg(F.sum("n").alias("original_total")), traced.agg(F.sum("contribution_count").alias("traced_total"))
    return a.crossJoin(b).withColumn("conserved", F.col("original_total").eqNullSafe(F.col("traced_total")))
