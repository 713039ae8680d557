"""Places of rows in a total order, without one task that orders them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.plans.shared import stored


def ranked(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """The rows with their place from 0 in an order, which should be total.

    Rows are dealt out by ranges, stored in order, and numbered by their place within the range and the sizes of those
    before: what one task orders is one row a range.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    own = stored(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    sizes = own.groupBy("_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = sizes.select("_range", "_first", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    placed = own.join(F.broadcast(before), "_range")  # one row a range
    return placed.select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias(name))


def ranked_within(df: DataFrame, keys: list[str], order: list[str | Column], name: str) -> DataFrame:
    """The rows with their place from 0 among those with equal keys: a frequent key is spread over ranges like the others."""
    placed = ranked(df, [*keys, *order], "_all")
    first = placed.groupBy(*keys).agg(F.min("_all").alias("_begin"))
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    joined = placed.alias("p").join(first.alias("f"), same)
    return joined.select(*[F.col(f"p.`{c}`") for c in df.columns], (F.col("p._all") - F.col("f._begin")).alias(name))
