"""Synonym merging: greedy one-merge-per-id matching, rounds to a fixpoint, clusters; merging by equal descriptors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions.text import strip
from lexloom.operators import neighbors as nn
from lexloom.plans.components import connected_components
from lexloom.plans.shared import small, stored

#: Rounds of parallel matching before the few edges that are left are matched one by one within their components.
MATCH_ROUNDS = 30
#: Edges that one task scans in order, rather than rounds of all: a table of 5 MB.
SCAN_EDGES = 200_000
#: Neighbours of a row that are kept for the rounds of a merge, of each that a round looks at.
LISTED = 8


def greedy_matching(edges: DataFrame, max_rounds: int = MATCH_ROUNDS, scan: int = SCAN_EDGES) -> DataFrame:
    """Edges (a, b, score) that a scan by falling score, then a and b, takes if each id may be used once.

    An edge that comes first at both its ends is taken, edges at taken ids go, and so on: with a strict order this is
    the sequential result. Once at most ``scan`` edges are left, one task scans them. A long falling chain needs a round
    per edge; after ``max_rounds`` an ordered scan of each component of what is left ends it.
    """
    # null and NaN scores are never candidates
    left = stored(edges.where("a <> b and score is not null and not isnan(score)").groupBy("a", "b").agg(F.max("score").alias("score")), "edges")
    taken = []
    for _ in range(max_rounds):
        n = left.count()
        if n <= scan:
            if n:
                taken.append(_in_order(left.withColumn("component", F.lit(0))))
            break
        rank = F.struct((-F.col("score")).alias("s"), "a", "b")
        ends = left.select(F.col("a").alias("v"), rank.alias("r")).union(left.select(F.col("b").alias("v"), rank.alias("r")))
        first = ends.groupBy("v").agg(F.min("r").alias("r"))
        both = first.groupBy("r").agg(F.count("*").alias("n")).where("n = 2").select("r.a", "r.b", (-F.col("r.s")).alias("score"))
        won = stored(both, "matched")
        taken.append(won)
        used = stored(won.select(F.col("a").alias("v")).union(won.select(F.col("b").alias("v"))), "used")
        left = stored(left.join(used, left["a"] == used["v"], "left_anti").join(used, left["b"] == used["v"], "left_anti"), "edges")
    else:
        part = connected_components(left).withColumnRenamed("node", "a")
        taken.append(_in_order(left.join(part, "a")))
    if not taken:
        return left
    out = taken[0]
    for more in taken[1:]:
        out = out.union(more)
    return out


def _in_order(edges: DataFrame) -> DataFrame:
    """The sequential scan over each ``component`` of edges; components do not meet, so each is scanned by itself."""

    def run(table):
        import pyarrow as pa

        table = table.sort_by([("score", "descending"), ("a", "ascending"), ("b", "ascending")])
        used, keep = set(), []
        for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist()):
            free = a not in used and b not in used
            keep.append(free)
            if free:
                used.update((a, b))
        return table.filter(pa.array(keep, pa.bool_())).select(["a", "b", "score"])

    return edges.groupBy("component").applyInArrow(run, edges.select("a", "b", "score").schema)


def _lists(asked: DataFrame, rest: DataFrame, depth: int) -> DataFrame:
    """(id, neighbor, score, whole): the ``depth`` nearest of each asked row among ``rest``; whole lists hold all the others."""
    packed = nn.blocks(rest, "id", "vec")
    near = nn.top_k(packed if asked is rest else nn.blocks(asked, "id", "vec"), packed, depth, exclude_self=True)
    return stored(near.select("id", "neighbor", "score", F.lit(rest.count() <= depth + 1).alias("whole")), "near")


def _listed_again(near: DataFrame, gone: DataFrame, rest: DataFrame, k: int, depth: int) -> DataFrame:
    """The lists without the rows that are gone. A list is in order, so its first k are the k nearest as long as it has k;
    rows of which fewer are left are searched for again."""
    gone = small(stored(gone, "gone"))
    kept = stored(near.join(gone, "id", "left_anti").join(gone.withColumnRenamed("id", "neighbor"), "neighbor", "left_anti").select(near.columns), "near")
    full = kept.groupBy("id").agg(F.count("*").alias("n"), F.bool_or("whole").alias("whole")).where(F.col("whole") | (F.col("n") >= k))
    short = stored(rest.join(full, "id", "left_anti"), "short")
    if short.isEmpty():
        return kept
    return kept.join(small(stored(short.select("id"), "short-ids")), "id", "left_anti").union(_lists(short, rest, depth))


def merge_synonyms(vectors: DataFrame, decide: Callable[[DataFrame], DataFrame], id_col: str = "id", vec_col: str = "vec", k: int = 1, strategy: str = "mutual", least: float | None = None, max_iters: int = 50) -> tuple[DataFrame, DataFrame]:
    """Merge neighbours that ``decide`` calls synonyms, until nothing merges: (kept ids, lineage).

    Per round: neighbours among the rows left, candidates by ``strategy`` (mutual or unique), ``decide`` returns those
    that are synonyms with (a, b, score, keep, drop), a greedy matching uses each id once, and dropped rows leave.
    Lineage has (iteration, keep, drop, score). All rows are searched for once, for more neighbours than a round looks at;
    later rounds search only for rows whose lists have run out.
    """
    rest = stored(vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec")), "rows")
    lineage: DataFrame | None = None
    lists = _lists(rest, rest, k * LISTED)
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "neighbor"))
    for n in range(max_iters):
        near = lists.withColumn("rank", place).where(F.col("rank") <= k)
        candidates = nn.mutual_pairs(near) if strategy == "mutual" else nn.unique_candidates(near)
        kept, _ = nn.threshold_split(candidates, least)
        said = stored(decide(kept), "decided")
        won = greedy_matching(said.select("a", "b", "score"))
        merged = stored(said.join(won.select("a", "b"), ["a", "b"]).select(F.lit(n).alias("iteration"), "keep", "drop", "score"), "merges")
        if merged.isEmpty():
            break
        lineage = merged if lineage is None else lineage.union(merged)
        gone = merged.select(F.col("drop").alias("id"))
        rest = stored(rest.join(gone, "id", "left_anti"), "rows")
        lists = _listed_again(lists, gone, rest, k, k * LISTED)
    if lineage is None:
        lineage = rest.select(F.lit(0).alias("iteration"), F.col("id").alias("keep"), F.col("id").alias("drop"), F.lit(0.0).alias("score")).limit(0)
    return rest.select("id"), lineage


def merge_clusters(lineage: DataFrame, keep: str = "keep", drop: str = "drop") -> DataFrame:
    """(member, cluster): clusters of a merge lineage, named by their smallest id."""
    return connected_components(lineage.select(F.col(keep).alias("a"), F.col(drop).alias("b"))).select(F.col("node").alias("member"), F.col("component").alias("cluster"))


def force_merge(pairs: DataFrame, order: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Merge pairs whose stripped descriptors are equal, case included: (kept pairs, lineage of keep and drop).

    The chooser takes the shortest explainer, then the smallest explainer and id; ``order`` gives other sort columns.
    The first of a group is a minimum with map-side partials, and joins back to the others.
    """
    base = pairs.select("id", strip("descriptor").alias("descriptor"), "explainer")
    rank = F.struct(*(order or [F.length("explainer").alias("n"), F.col("explainer"), F.col("id")]))
    chosen = base.groupBy("descriptor").agg(F.min(F.struct(rank.alias("r"), "id", "explainer")).alias("c"), F.count("*").alias("n_members"))
    kept = chosen.select("descriptor", F.col("c.id").alias("id"), F.col("c.explainer").alias("explainer"), "n_members")
    drops = base.select("descriptor", F.col("id").alias("drop")).join(kept.where("n_members > 1").select("descriptor", F.col("id").alias("keep")), "descriptor").where("keep <> drop")
    return kept, drops.select("keep", "drop", "descriptor")


def replay(decisions: DataFrame) -> DataFrame:
    """Merges of logged decisions (iteration, ord, keep, drop, is_synonym): within an iteration each id is used once, in
    the order of the log."""
    each = decisions.where("is_synonym").select("iteration", "ord", "keep", "drop")
    # ids of different iterations do not meet: an id is scoped by its iteration
    scoped = lambda c: F.concat_ws("#", F.col("iteration").cast("string"), F.col(c).cast("string"))
    first = each.withColumn("n", F.row_number().over(Window.partitionBy("iteration", "keep", "drop").orderBy("ord"))).where("n = 1")
    won = greedy_matching(first.select(scoped("keep").alias("a"), scoped("drop").alias("b"), (-F.col("ord")).cast("double").alias("score")))
    return first.join(won.select(F.col("a").alias("_a"), F.col("b").alias("_b")), (scoped("keep") == F.col("_a")) & (scoped("drop") == F.col("_b"))).select("iteration", "ord", "keep", "drop")
