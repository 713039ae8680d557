"""Sampling, splitting, filtering and chat examples for training data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions.text import truncate_quick
from lexloom.plans.ranks import ranked, ranked_within


def hash_unit(key: Column | str, seed: int) -> Column:
    """A number in [0, 1) that depends on key and seed alone, so that a repeated task draws the same: 32 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col(key) if isinstance(key, str) else key).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def bernoulli(df: DataFrame, key: str, p: float, seed: int = 0) -> DataFrame:
    return df.where(hash_unit(key, seed) < p)


def sample_exactly(df: DataFrame, key: str, n: int, p: float = 1.0, seed: int = 0) -> DataFrame:
    """n rows without replacement of those a first draw of share p leaves; all if they are fewer."""
    return bernoulli(df, key, p, seed).orderBy(hash_unit(key, seed + 1), key).limit(n)


def length_between(length: Column | str, low: int, high: int | None) -> Column:
    """low < length <= high; no upper bound if it is null or not positive."""
    c = F.col(length) if isinstance(length, str) else length
    return (c > low) if high is None or high <= 0 else (c > low) & (c <= high)


def near_equal_parts(df: DataFrame, parts: int, order: list) -> DataFrame:
    """The rows with ``part`` from 1: contiguous parts whose sizes differ by at most one, the larger ones first."""
    placed = ranked(df, order, "_place")
    q, r = divmod(placed.count(), parts)
    place = F.col("_place")
    part = F.when(place < r * (q + 1), F.floor(place / (q + 1))).otherwise(r + F.floor((place - r * (q + 1)) / max(q, 1)))
    return placed.withColumn("part", (part + 1).cast("int")).drop("_place")


def split_rows(df: DataFrame, key: str, test: float, validation: float, seed: int = 0) -> DataFrame:
    """The rows with ``split``: train, validation or test, by a hash of the key."""
    u = hash_unit(key, seed)
    return df.withColumn("split", F.when(u < test, "test").when(u < test + validation, "validation").otherwise("train"))


def split_exactly(df: DataFrame, key: str, test: int, validation: int, train: int | None = None, seed: int = 0) -> DataFrame:
    """The rows with ``split``, of sizes that hold exactly: by the order of a hash of the key. ``train=None`` takes the rest.

    Raises ValueError if the table has too few rows. The cuts are the hashes at the sizes, found without ordering all rows
    in one task.
    """
    n = df.count()
    wanted = test + validation + (1 if train is None else train)
    if min(test, validation, train or 0) < 0 or wanted > n:
        raise ValueError(f"{wanted} rows are asked for, the table has {n}")
    placed = ranked(df.withColumn("_u", hash_unit(key, seed)), ["_u", key], "_place")
    place, end = F.col("_place"), n if train is None else test + validation + train
    split = F.when(place < test, "test").when(place < test + validation, "validation").when(place < end, "train")
    return placed.withColumn("split", split).where("split is not null").drop("_u", "_place")


def shuffled_parts(df: DataFrame, key: str, parts: int, seed: int | None = None) -> DataFrame:
    """The rows with ``part`` from 1, of near-equal sizes: in the order of the key, or of a seeded hash of it."""
    if seed is None:
        return near_equal_parts(df, parts, [key])
    return near_equal_parts(df.withColumn("_u", hash_unit(key, seed)), parts, ["_u", key]).drop("_u")


def at_most(df: DataFrame, length: str, most: int | None) -> DataFrame:
    """The rows whose length is at most ``most``; all of them if that is null or not positive, or there is no such column."""
    return df if most is None or most <= 0 or length not in df.columns else df.where(F.col(length) <= most)


def threshold_parts(df: DataFrame, value: str, cut: float) -> DataFrame:
    """The rows with ``side``: low up to the cut, high above it, none where the value is null."""
    return df.withColumn("side", F.when(F.col(value) <= cut, "low").when(F.col(value) > cut, "high").otherwise("none"))


def interleave(df: DataFrame, source: str, order: str, k: int, seed: int = 0) -> DataFrame:
    """The rows with ``round`` and ``place``: k rows of each source per round, shuffled within a round by a seeded hash."""
    rounds = ranked_within(df, [source], [order], "_place").withColumn("round", F.floor(F.col("_place") / k)).drop("_place")
    return rounds.withColumn("place", F.row_number().over(Window.partitionBy("round").orderBy(hash_unit(order, seed), order)))


def chat_examples(df: DataFrame, text: str, descriptors: str, system: str, max_tokens: int) -> DataFrame:
    """The rows with ``messages``: system, user (the text, cut to the budget) and assistant (compact JSON of descriptors)."""
    part = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    answer = F.to_json(F.struct(F.col(descriptors).alias("descriptors")))
    return df.withColumn("messages", F.array(part("system", F.lit(system)), part("user", truncate_quick(text, max_tokens)), part("assistant", answer)))


def usable(df: DataFrame, text: str, descriptors: str, min_tokens: int, max_tokens: int, chars_per_token: int = 3) -> DataFrame:
    """Rows with a text within the token budget, both ends included, and at least one descriptor."""
    size = F.length(text)
    return df.where((size >= min_tokens * chars_per_token) & (size <= max_tokens * chars_per_token) & (size > 0) & (F.size(descriptors) > 0))


def sample_forecast(n_files: int, files_done: int, n_sampled: int, wanted: int) -> tuple[int, str]:
    """The sample size that the share of files read so far points to, with a warning if it misses the wanted size."""
    size = int(n_files * (n_sampled / files_done)) if files_done else 0
    return size, "too few" if size < wanted else "far too many" if size > 5 * wanted else "ok"
