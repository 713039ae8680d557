"""Pairs to descriptor groups, and the loop that takes groups apart until each descriptor has one meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions.text import lexical_overlap, merged_id, normalize_tracer, split_strict, split_tracer, stable_id, strip
from lexloom.operators.annotate import best_round
from lexloom.plans.ranks import ranked_within
from lexloom.plans.shared import small, stored


def extract_pairs(rows: DataFrame, pair: str = "pair", compat: bool = True) -> DataFrame:
    """The rows with descriptor, explainer, ok and the stable id of their pair; malformed ones have ok false and no id."""
    split = rows.withColumn("_p", split_strict(pair, compat)).select("*", "_p.*").drop("_p")
    return split.withColumn("id", F.when(F.col("ok"), stable_id("descriptor", "explainer")))


def first_pairs(pairs: DataFrame, order: list[str]) -> DataFrame:
    """One row of each (descriptor, explainer): the first in ``order``, as (descriptor, explainer, id, n_rows, order...).

    A minimum with map-side partials, so a pair found in very many rows is not gathered.
    """
    first = pairs.where("ok").groupBy("descriptor", "explainer").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n_rows"))
    return first.select("descriptor", "explainer", stable_id("descriptor", "explainer").alias("id"), "n_rows", "first.*")


def groups(pairs: DataFrame, order: list[str]) -> DataFrame:
    """(descriptor, explainers): its (id, explainer) in order of appearance."""
    listed = F.array_sort(F.collect_list(F.struct(*order, "id", "explainer")))
    return pairs.groupBy("descriptor").agg(F.transform(listed, lambda x: F.struct(x["id"].alias("id"), x["explainer"].alias("explainer"))).alias("explainers"))


def placed_groups(pairs: DataFrame, order: list[str]) -> DataFrame:
    """(descriptor, pos, id, explainer): the rows of ``groups``, which a frequent descriptor spreads over many tasks."""
    placed = ranked_within(pairs, ["descriptor"], [*order, "id"], "pos")
    return placed.select("descriptor", "pos", "id", "explainer")


def largest_groups(pairs: DataFrame, n: int = 5) -> DataFrame:
    """(descriptor, n): the descriptors with most pairs, by name on a tie."""
    return pairs.groupBy("descriptor").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "descriptor").limit(n)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(descriptor, explainer, n) of original rows of either kind: those with rounds of pairs (descriptors, similarity), of
    which the best round counts, or those that are pairs (descriptor, explainer) themselves."""
    if "descriptors" in rows.columns:
        each = rows.select(F.explode(best_round("descriptors", "similarity", "all")).alias("pair")).select(split_tracer("pair").alias("p")).where("p is not null").select("p.*")
    else:
        each = rows.select(normalize_tracer("descriptor").alias("descriptor"), strip("explainer").alias("explainer")).where("descriptor <> '' and explainer <> ''")
    return each.groupBy("descriptor", "explainer").agg(F.count("*").alias("n"))


def mapped_indices(chunks: DataFrame) -> DataFrame:
    """(chunk, grp, id, text) of answered indices: chunks have chunk, ids and explainers (arrays) and groups (an array of
    structs with indices and text).

    Indices out of range and repeated ones are passed over, as are groups without any; without a group all ids form one
    under the first explainer.
    """
    n = F.size("ids")
    own = F.transform("groups", lambda g: F.struct(F.array_distinct(F.filter(g["indices"], lambda i: (i >= 0) & (i < n))).alias("indices"), g["text"].alias("text")))
    some = F.filter(F.coalesce(own, F.array().cast("array<struct<indices:array<int>,text:string>>")), lambda g: F.size(g["indices"]) > 0)
    whole = F.array(F.struct(F.sequence(F.lit(0), n - 1).alias("indices"), F.get("explainers", F.lit(0)).alias("text")))
    each = chunks.where(n > 0).select("chunk", "ids", F.posexplode(F.when(F.size(some) > 0, some).otherwise(whole)).alias("grp", "g"))
    return each.select("chunk", F.col("grp").cast("bigint").alias("grp"), F.col("g.text").alias("text"), F.explode(F.transform("g.indices", lambda i: F.get("ids", i))).alias("id"))


def merge_events(groups: DataFrame) -> DataFrame:
    """(new_descriptor, new_explainer, new_pair_id, source_pair_ids) of groups (descriptor, explainer, sources); a group
    without a name, without sources or with a null one fails the job."""
    sources = F.array_sort(F.array_distinct("sources"))
    good = (strip("descriptor") != "") & (strip("explainer") != "") & (F.size("sources") > 0) & ~F.exists("sources", lambda x: x.isNull())
    new = F.when(good, merged_id(sources, F.col("descriptor"), F.col("explainer"))).otherwise(F.raise_error(F.lit("a merge lacks a name or sources")))
    return groups.select(F.col("descriptor").alias("new_descriptor"), F.col("explainer").alias("new_explainer"), new.alias("new_pair_id"), sources.alias("source_pair_ids"))


def packed_prompts(prompts: DataFrame, key: str, chars: str, most_prompts: int = 512, most_chars: int = 2_000_000) -> DataFrame:
    """(key, id, batch): prompts of a cohort (key) in batches, shortest first: a batch is closed when one more would exceed
    either bound. A cohort is what one pass of the loop sends to the model, so it is bounded by that."""

    def run(table):
        import pyarrow as pa

        rows = sorted(zip(table.column("chars").to_pylist(), table.column("id").to_pylist()))
        batch, n, size, out = 0, 0, 0, []
        for c, _ in rows:
            if n and (n + 1 > most_prompts or size + c > most_chars):
                batch, n, size = batch + 1, 0, 0
            n, size = n + 1, size + c
            out.append(batch)
        return pa.table({"key": table.column("key")[: len(rows)], "id": pa.array([i for _, i in rows], pa.int64()), "batch": pa.array(out, pa.int64())})

    base = prompts.select(F.col(key).cast("bigint").alias("key"), F.col("id").cast("bigint").alias("id"), F.col(chars).cast("bigint").alias("chars"))
    return base.groupBy("key").applyInArrow(run, "key bigint, id bigint, batch bigint")


def group_statistics(pairs: DataFrame) -> DataFrame:
    """One row: descriptors, pairs, descriptors with one and with more explainers, and their average."""
    sizes = pairs.groupBy("descriptor").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("n_descriptors"), F.sum("n").alias("n_pairs"), F.count_if(F.col("n") == 1).alias("n_single"),
        F.count_if(F.col("n") > 1).alias("n_multi"), F.avg("n").alias("average"), F.max("n").alias("largest"),
    )


def chunked(pairs: DataFrame, key: list[str], order: str, size: int = 20) -> DataFrame:
    """The rows with ``chunk``: at most ``size`` explainers each, in order, within a key."""
    return ranked_within(pairs, key, [order], "_place").withColumn("chunk", F.floor(F.col("_place") / size)).drop("_place")


def repair(members: DataFrame, answers: DataFrame) -> DataFrame:
    """A partition of ``members`` (chunk, id, pos, explainer) from a model's ``answers`` (chunk, grp, pos, id, text).

    Of an id named more than once the first place holds; unknown ids and empty groups go; an id that no group names
    joins the group whose text shares most words with it (the first on a tie); without any group all form one, with
    the first explainer as its text. Returns (chunk, grp, id, text).
    """
    known = answers.join(members.select("chunk", "id"), ["chunk", "id"], "left_semi")
    held = known.groupBy("chunk", "id").agg(F.min(F.struct("grp", "pos")).alias("at")).select("chunk", "id", F.col("at.grp").alias("grp"))
    texts = answers.groupBy("chunk", "grp").agg(F.min("text").alias("text")).join(held.select("chunk", "grp").distinct(), ["chunk", "grp"], "left_semi")
    lost = members.join(held, ["chunk", "id"], "left_anti")
    scored = lost.join(texts, "chunk").withColumn("overlap", lexical_overlap("explainer", "text"))
    best = scored.groupBy("chunk", "id").agg(F.min(F.struct((-F.col("overlap")).alias("o"), "grp")).alias("at")).select("chunk", "id", F.col("at.grp").alias("grp"))
    bare = members.join(texts.select("chunk").distinct(), "chunk", "left_anti")
    only = bare.join(bare.groupBy("chunk").agg(F.min(F.struct("pos", "explainer")).alias("f")), "chunk").select("chunk", F.lit(0).cast("bigint").alias("grp"), "id", F.col("f.explainer").alias("text"))
    return held.union(best).join(texts, ["chunk", "grp"]).select("chunk", F.col("grp").cast("bigint").alias("grp"), "id", "text").union(only)


def cluster_by_first_word(members: DataFrame) -> DataFrame:
    """A deterministic stand-in for the grouping model: explainers that begin with the same word mean the same."""
    word = F.lower(F.regexp_extract("explainer", r"(\S*)", 1))
    w = Window.partitionBy("chunk").orderBy("word")
    with_word = members.withColumn("word", word).withColumn("grp", F.dense_rank().over(w) - 1)
    return with_word.select("chunk", F.col("grp").cast("bigint").alias("grp"), "pos", "id", F.min("explainer").over(Window.partitionBy("chunk", "grp")).alias("text"))


def _settled(cur: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a frontier that are alone in their parent group under their descriptor, and the others.

    Most are alone, and they are not moved: hashes of the other groups' keys, where they are few enough to broadcast,
    choose the rows that are joined with the keys themselves.
    """
    keys = ["parent", "descriptor"]
    many = stored(cur.groupBy(*keys).agg(F.count("*").alias("size")).where("size > 1").drop("size"), "many")
    hashed = small(stored(many.select(F.xxhash64(*keys).alias("_h")).distinct(), "hashes"))
    marked = cur.withColumn("_h", F.xxhash64(*keys))
    chosen = marked.join(hashed, "_h", "left_semi").drop("_h")
    alone = marked.join(hashed, "_h", "left_anti").drop("_h").union(chosen.join(many, keys, "left_anti").select(cur.columns))
    return alone, stored(chosen.join(many, keys).select(cur.columns), "more", "zstd")


def disambiguate(pairs: DataFrame, grouper: Callable[[DataFrame], DataFrame] = cluster_by_first_word, max_passes: int = 20, chunk_size: int = 20) -> tuple[DataFrame, DataFrame]:
    """Take groups apart until each descriptor of a parent group has one explainer: (finals, lineage).

    ``pairs`` has descriptor, explainer, id. Groups of one are final. The others go to ``grouper`` in chunks, its answer
    is repaired to a partition, and each part becomes a new pair with a repeatable id. New pairs are grouped by
    descriptor within their parent group only; the whole frontier is one pass. Lineage has (pass, id, source_id).
    Raises RuntimeError if groups are left after ``max_passes``.
    """
    cur = stored(pairs.select("descriptor", "explainer", "id", F.sha1("descriptor").alias("parent")), "frontier", "zstd")
    finals, lineage = [], []
    for n in range(max_passes):
        alone, more = _settled(cur)
        finals.append(alone.select("descriptor", "explainer", "id"))
        if more.isEmpty():
            break
        placed = chunked(more, ["parent", "descriptor"], "id", chunk_size)
        placed = placed.withColumn("chunk", F.sha1(F.concat_ws("|", "parent", "descriptor", F.col("chunk").cast("string"))))
        placed = placed.withColumn("pos", F.row_number().over(Window.partitionBy("chunk").orderBy("id")).cast("bigint"))
        members = stored(placed.select("chunk", "parent", "descriptor", "id", "pos", "explainer"), "members")
        parts = repair(members.select("chunk", "id", "pos", "explainer"), grouper(members))
        full = parts.join(members.select("chunk", "id", "parent", "descriptor"), ["chunk", "id"])
        made = full.groupBy("chunk", "grp", "parent", "descriptor").agg(F.array_sort(F.collect_list("id")).alias("sources"), F.min("text").alias("explainer"))
        # with one part left of several the grouper will not take them further apart: the descriptor is settled
        made = made.withColumn("new_id", merged_id(F.col("sources"), F.col("descriptor"), F.col("explainer")))
        made = stored(made, "made")
        lineage.append(made.select(F.lit(n).alias("pass"), F.col("new_id").alias("id"), F.explode("sources").alias("source_id")))
        named = made.join(made.groupBy("parent", "descriptor").agg(F.count("*").alias("parts")), ["parent", "descriptor"])
        name = F.when(F.col("parts") > 1, F.concat_ws(" / ", "descriptor", F.regexp_extract("explainer", r"(\S*)", 1))).otherwise(F.col("descriptor"))
        cur = stored(named.select(name.alias("descriptor"), "explainer", F.col("new_id").alias("id"), "parent"), "frontier")
    else:
        raise RuntimeError("groups are left after the last pass")
    union = lambda frames: frames[0] if len(frames) == 1 else union([frames[0].union(frames[1]), *frames[2:]])
    edges = union(lineage) if lineage else cur.select(F.lit(0).alias("pass"), "id", F.col("id").alias("source_id")).limit(0)
    return union(finals), edges
