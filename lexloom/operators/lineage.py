"""Lineage: closures over merge edges, weights and contributions, the round-by-round backtrace.

Edges have (dst, src): the new id and one of its sources. All walks are semi-naive: a round only joins what was new in
the round before, and each round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.plans.shared import stored

MAX_ROUNDS = 100


def last_events(events: DataFrame, order: str = "ord") -> DataFrame:
    """(dst, src) of the last event of each new id; events have (dst, src, ord), one order for all sources of an event."""
    last = events.groupBy("dst").agg(F.max(order).alias("m"))
    return events.join(last, "dst").where(F.col(order) == F.col("m")).select("dst", "src").distinct()


def reach(starts: DataFrame, edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(start, node): all nodes that edges lead to from each start, itself included. Cycles are walked once."""
    edges = stored(edges.select("dst", "src").where("dst <> src").distinct(), "edges")
    new = stored(starts.select(F.col("start"), F.col("start").alias("node")).distinct(), "reached")
    every = new
    for _ in range(max_rounds):
        step = new.join(edges, new["node"] == edges["dst"]).select("start", F.col("src").alias("node")).distinct()
        new = stored(step.join(every, ["start", "node"], "left_anti"), "reached")
        if new.isEmpty():
            return every
        every = every.union(new)
    raise RuntimeError("the walk did not end")


def roots(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, root): the nodes without sources that each start goes back to."""
    return reach(starts, edges).join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").select("start", F.col("node").alias("root"))


def root_weights(found: DataFrame, counts: DataFrame) -> DataFrame:
    """(start, root_count, weight): the summed counts (id, n) of each start's roots; a root without a count weighs 1."""
    joined = found.join(counts.select(F.col("id").alias("root"), "n"), "root", "left")
    return joined.groupBy("start").agg(F.count("*").alias("root_count"), F.sum(F.coalesce("n", F.lit(1))).alias("weight"))


def path_weights(starts: DataFrame, edges: DataFrame, counts: DataFrame, keep_self: bool = False, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(start, root_count, weight): counts add once per path, while roots are a set.

    With ``keep_self`` a node that has a count keeps it besides what its sources bring. A cycle raises RuntimeError.
    """
    edges = stored(edges.select("dst", "src").distinct(), "edges")
    has = edges.select(F.col("dst").alias("node")).distinct()
    cur = stored(starts.select("start", F.col("start").alias("node"), F.lit(1).cast("bigint").alias("paths")), "paths")
    ended = []
    for _ in range(max_rounds):
        stop = cur.join(has, "node", "left_anti")
        if keep_self:
            stop = stop.union(cur.join(has, "node", "left_semi").join(counts.select(F.col("id").alias("node")), "node", "left_semi"))
        ended.append(stop.select("start", "node", "paths"))
        cur = stored(cur.join(edges, cur["node"] == edges["dst"]).groupBy("start", F.col("src").alias("node")).agg(F.sum("paths").alias("paths")), "paths")
        if cur.isEmpty():
            break
    else:
        raise RuntimeError("the lineage has a cycle")
    every = ended[0]
    for more in ended[1:]:
        every = every.union(more)
    joined = every.join(counts.select(F.col("id").alias("node"), "n"), "node", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    per_root = joined.groupBy("start", "node").agg(F.sum(F.col("paths") * F.col("n")).alias("w"))
    return per_root.groupBy("start").agg(F.count("*").alias("root_count"), F.sum("w").alias("weight"))


def finals_of(originals: DataFrame, edges: DataFrame, finals: DataFrame, sinks_only: bool = False) -> DataFrame:
    """(original, final): the final ids that each original (id) leads to; with ``sinks_only`` not those merged on."""
    forward = edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    ends = finals.select(F.col("id").alias("node")).distinct()
    if sinks_only:
        ends = ends.join(edges.select(F.col("src").alias("node")), "node", "left_anti")
    walked = reach(originals.select(F.col("id").alias("start")), forward)
    return walked.join(ends, "node").select(F.col("start").alias("original"), F.col("node").alias("final"))


def contributions(links: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(final, count): occurrences (id, n) of the originals that reach each final; one that reaches several adds to each."""
    return links.join(occurrences.withColumnRenamed("id", "original"), "original").groupBy("final").agg(F.sum("n").alias("count"))


def contribution_breakdown(links: DataFrame, originals: DataFrame, finals: DataFrame) -> DataFrame:
    """(original_descriptor, original_explainer, final_descriptor, final_explainer, count): how often an original pair
    (id, descriptor, explainer, n) reaches a final pair (id, descriptor, explainer)."""
    named = lambda df, kind, *more: df.select(F.col("id").alias(kind), F.col("descriptor").alias(f"{kind}_descriptor"), F.col("explainer").alias(f"{kind}_explainer"), *more)
    both = links.join(named(originals, "original", "n"), "original").join(named(finals, "final"), "final")
    return both.groupBy("original_descriptor", "original_explainer", "final_descriptor", "final_explainer").agg(F.sum("n").alias("count"))


def backtrace(finals: DataFrame, rounds: list[tuple[DataFrame, DataFrame]], counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trace finals (id) back through rounds, latest first: (contributions, dead ends).

    A round is (edges, outputs of the round before, as ids). A node with edges goes to its sources, once per edge; one
    without passes through if the round before put it out, else it is a dead end of that round. What arrives takes its
    count from ``counts`` (id, n), if it has one. Contributions have (id, contribution_count), dead ends (round, id).
    """
    cur = stored(finals.select("id", F.col("id").alias("node"), F.lit(1).cast("bigint").alias("m")), "trace")
    dead = None
    for n, (edges, outputs) in reversed(list(enumerate(rounds, 1))):
        own = edges.select("dst", "src")
        moved = cur.join(own, cur["node"] == own["dst"]).select("id", F.col("src").alias("node"), "m")
        rest = stored(cur.join(own.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").select("id", "node", "m"), "rest")
        known = outputs.select(F.col("id").alias("node")).distinct()
        lost = rest.join(known, "node", "left_anti").select(F.lit(n).alias("round"), F.col("node").alias("id")).distinct()
        dead = lost if dead is None else dead.union(lost)
        cur = stored(moved.union(rest.join(known, "node", "left_semi").select("id", "node", "m")).groupBy("id", "node").agg(F.sum("m").alias("m")), "trace")
    found = cur.join(counts.select(F.col("id").alias("node"), "n"), "node").groupBy("id").agg(F.sum(F.col("m") * F.col("n")).alias("contribution_count"))
    return found, dead
