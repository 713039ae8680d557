"""Evaluation: score statistics, histograms, labels with percentages, deciles, vocabularies, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.plans.ranks import ranked


def score_stats(df: DataFrame, value: str, *keys: str, places: int = 3) -> DataFrame:
    """(keys, n, mean, std, low, high), rounded; std is of the population."""
    r = lambda c: F.round(c, places)
    return df.groupBy(*keys).agg(F.count(value).alias("n"), r(F.avg(value)).alias("mean"), r(F.stddev_pop(value)).alias("std"), r(F.min(value)).alias("low"), r(F.max(value)).alias("high"))


def histogram_right(df: DataFrame, value: str, *keys: str, width: float = 0.05) -> DataFrame:
    """(keys, bin, n): bins of (bin * width, (bin + 1) * width] over 0 to 1, the first with 0; values outside fall in none."""
    v = F.col(value)
    at = F.when(v == 0, 0).otherwise(F.ceil(F.round(v / width, 9)) - 1).cast("bigint")
    return df.where((v >= 0) & (v <= 1)).groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))


def histogram_left(df: DataFrame, value: str, width: float = 0.1) -> DataFrame:
    """(bin, low, n): bins of [low, low + width) from the minimum rounded to a place; the last is closed. What rounding
    leaves outside is in none. Bins without rows are not returned."""
    ends = df.agg(F.round(F.min(value), 1).alias("first"), F.round(F.max(value), 1).alias("last"))
    v = F.col(value)
    at = F.floor(F.round((v - F.col("first")) / width, 9))
    top = F.greatest(F.round((F.col("last") - F.col("first")) / width, 0) - 1, F.lit(0))
    inside = df.crossJoin(F.broadcast(ends)).where((v >= F.col("first")) & (v <= F.col("last")))
    placed = inside.withColumn("bin", F.least(at, top).cast("bigint"))
    return placed.groupBy("bin").agg(F.round(F.min(F.col("first") + F.col("bin") * width), 6).alias("low"), F.count("*").alias("n"))


def label_distribution(df: DataFrame, label: str, labels: DataFrame) -> DataFrame:
    """(label, n, percent) for each of ``labels`` (label), those without rows included; percent to two places."""
    counted = labels.join(df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")), "label", "left").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy())
    return counted.select("label", "n", F.round(F.coalesce(F.try_divide(F.lit(100.0) * F.col("n"), total), F.lit(0.0)), 2).alias("percent"))


def equal_bins(df: DataFrame, order: list[Column], bins: int = 10) -> DataFrame:
    """The rows with ``bin``: n div bins rows each in the given order, the remainder in the last.

    With fewer rows than bins all are in the last.
    """
    placed = ranked(df, order, "_place")
    n = placed.count()
    at = F.least(F.floor(F.col("_place") / max(n // bins, 1)), F.lit(bins - 1))
    return placed.withColumn("bin", at if n >= bins else F.lit(bins - 1).cast("bigint")).drop("_place")


def observed(df: DataFrame, name: str, tokens: str) -> tuple[DataFrame, Observation]:
    """The rows, and their number and tokens as metrics of whatever action reads them: no pass of their own."""
    metrics = Observation(name)
    return df.observe(metrics, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens")), metrics


def throughput(metrics: Observation, seconds: float) -> dict[str, float]:
    """Rows and tokens a second of a finished action that took so long."""
    return {f"{k}_per_second": v / seconds if seconds > 0 else 0.0 for k, v in metrics.get.items()}


def token_stats(df: DataFrame, length: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(length), 4).alias("average"), F.max(length).alias("longest"), F.min(length).alias("shortest"))


def strip_suffixes(c: Column | str, suffixes: tuple[str, ...] = (" tone", " style", " content", " language")) -> Column:
    """The descriptor without any of the words, wherever they stand."""
    c = F.col(c) if isinstance(c, str) else c
    for s in suffixes:
        c = F.replace(c, F.lit(s), F.lit(""))
    return F.trim(c)


def singleton_ratio(counts: DataFrame, n: str = "n") -> DataFrame:
    """One row: different descriptors, those found once, and their share."""
    return counts.agg(F.count("*").alias("n_distinct"), F.count_if(F.col(n) == 1).alias("n_singletons")).withColumn("ratio", F.round(F.try_divide("n_singletons", "n_distinct"), 6))


def pairwise_cosine(df: DataFrame, group: str, item: str, vec: str) -> DataFrame:
    """(group, n_pairs, low, mean, high) of the cosine similarities of all pairs within each group of a few vectors.

    A group is what one row of a calibration list holds; it is bounded by that list, and expanded as an array.
    """
    from lexloom.functions.vector import cosine

    listed = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(item).alias("i"), F.col(vec).alias("v")))).alias("l"))
    pairs = F.flatten(F.transform("l", lambda a: F.transform(F.filter("l", lambda b: b["i"] > a["i"]), lambda b: cosine(a["v"], b["v"]))))
    return listed.select(group, F.explode(pairs).alias("s")).groupBy(group).agg(F.count("*").alias("n_pairs"), F.round(F.min("s"), 6).alias("low"), F.round(F.avg("s"), 6).alias("mean"), F.round(F.max("s"), 6).alias("high"))


def replicated_curves(df: DataFrame, group: str, run: str, batch: str, value: str) -> DataFrame:
    """(group, batch, n, mean, std) over the runs of each group, cut to its shortest run."""
    lengths = df.groupBy(group, run).agg(F.max(batch).alias("last")).groupBy(group).agg(F.min("last").alias("last"))
    kept = df.join(lengths, group).where(F.col(batch) <= F.col("last"))
    return kept.groupBy(group, batch).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"))


def dummies(df: DataFrame, key: str, items: str, kinds: list[str]) -> DataFrame:
    """(key, a count for each kind, empty): how often each kind is among the items (an array) of a key's rows, and how many
    of its rows have none."""
    each = df.select(key, F.explode(F.when(F.size(items) > 0, F.col(items)).otherwise(F.array(F.lit("empty")))).alias("kind"))
    return each.groupBy(key).pivot("kind", [*kinds, "empty"]).count().na.fill(0)


def merge_markers(df: DataFrame, value: str, *keys: str, marker: str = "|M|") -> DataFrame:
    """One row, or one for each iteration or other keys: values without a marker, with equal parts only, with differing ones; largest and mean number of parts."""
    from re import escape

    parts = F.split(F.col(value), escape(marker))
    kind = F.when(F.size(parts) == 1, "unmerged").when(F.size(F.array_distinct(parts)) == 1, "same").otherwise("differing")
    rows = df.select(*keys, kind.alias("kind"), F.size(parts).alias("size"))
    return rows.groupBy(*keys).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("unmerged", "same", "differing")], F.max("size").alias("largest"), F.round(F.avg("size"), 6).alias("mean"))


def energy(lines: DataFrame, value: str = "value") -> DataFrame:
    """One row: the summed Wh of TOTAL lines, and the GPU hours of lines with seconds."""
    total = F.regexp_extract(value, r"TOTAL:\s*([0-9.]+)\s*Wh", 1)
    seconds = F.regexp_extract(value, r"GPU.*\(([0-9.]+)\s*s\)", 1)
    return lines.agg(F.round(F.sum(F.when(total != "", total.cast("double"))), 4).alias("total_wh"), F.round(F.sum(F.when(seconds != "", seconds.cast("double"))) / 3600, 6).alias("gpu_hours"))
