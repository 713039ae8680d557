"""Nearest neighbours by cosine or squared distance, exact, in blocks; mutual pairs, candidates, radius search.

Vectors are packed into blocks of bounded size. A task holds a bounded number of blocks of the table and meets blocks of
queries one after the other: products in single precision, with a bound on their error, tell which pairs may be among the
best so far of a query, and these alone are scored in double precision. What is shuffled are the blocks, once for each
group of the other side, and k rows for each query and group. No vector table is broadcast or gathered. The work is the
product of both sides, by the definition of an exact search, but the memory of a task is not: it holds MEET blocks and,
for a portion of a block of queries, their best rows. A cell-partitioned index (``by``) only joins blocks of the same cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.plans.shared import stored

BLOCK_ROWS = 4096
#: Bytes of a block of vectors in double precision, however wide they are.
BLOCK_BYTES = 2 << 20
#: Blocks of either side that a task meets at most, and the tasks that a search is dealt out to where it has as many pairs of blocks.
MEET, TASKS = 16, 48
#: Queries that are compared at once, and the rows that are held as their best.
PORTION, HELD_ROWS = 1024, 2 << 20
#: Pairs that are scored in double precision at once, in numbers.
SCORED = 4 << 20
#: Scores are rounded to this many places before they are ordered, so that ties do not hang on summation order.
PLACES = 9


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of equal lengths as a matrix of doubles."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of one table differ in width")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), sizes[0] if len(sizes) else 0)


def _packed(metric: str):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        data = _numbers(table.column("vec"))
        if metric == "cosine":
            norms = np.linalg.norm(data, axis=1, keepdims=True)
            data = data / np.where(norms == 0, 1, norms)
        place = {c: pa.array([table.column(c)[0].as_py()], pa.int64()) for c in ("cell", "block")}
        return pa.table({**place, "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()), "data": pa.array([data.tobytes()], pa.binary())})

    return run


def blocks(df: DataFrame, id_col: str, vec_col: str, metric: str = "cosine", rows: int = BLOCK_ROWS, by: str | None = None) -> DataFrame:
    """(cell, block, ids, data): the vectors in blocks of about ``rows``, fewer if they are wide, of one cell each if ``by``
    names its column; rows without an id or a vector are left out."""
    cell = F.col(by) if by else F.lit(0)
    base = df.select(cell.cast("bigint").alias("cell"), F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null and vec is not null")
    needed = F.greatest(F.count("*") / rows, F.sum(F.size("vec").cast("bigint") * 8) / BLOCK_BYTES)
    sizes = base.groupBy("cell").agg(F.greatest(F.ceil(needed), F.lit(1)).alias("blocks"))
    dealt = base.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("bigint"))  # one row a cell
    return stored(dealt.groupBy("cell", "block").applyInArrow(_packed(metric), "cell bigint, block bigint, ids binary, data binary"), "blocks")


class _Best:
    """The best rows so far of a portion of queries, as flat arrays in the order of queries and ranks."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, k: int, metric: str, exclude_self: bool, least: float) -> None:
        self.q_ids, self.q, self.k, self.metric, self.exclude_self = q_ids, q, k, metric, exclude_self
        self.asked = _screened(q, metric, True)
        self.length = np.linalg.norm(self.asked, axis=1)
        self.asked = self.asked.astype(np.float32)
        self.row, self.score, self.id = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        #: What a row must reach to be among the best: the radius, or the k-th score so far.
        self.bar = np.full(len(q_ids), least)
        self.met = 0

    def meet(self, t_ids: np.ndarray, t: np.ndarray, screened: np.ndarray, longest: float) -> None:
        # a product of n single-precision numbers is off by at most n + 4 units of the lengths' product
        slack = (self.asked.shape[1] + 4) * 2.0**-23 * self.length * longest + 10.0**-PLACES
        at = 0
        while at < len(t_ids):
            # queries without k best take all that they meet: as many rows as were met so far, so that the bar is soon up
            upto = min(len(t_ids), at + max(64, self.k, self.met))
            with np.errstate(over="ignore", invalid="ignore"):
                low = (self.bar - slack).astype(np.float32)
                hits = np.flatnonzero(~((self.asked @ screened[at:upto].T) < np.nextafter(low, np.float32(-np.inf))[:, None]))
            step = max(1, SCORED // max(1, self.q.shape[1]))
            for k in range(0, len(hits), step):
                i, j = np.divmod(hits[k : k + step], upto - at)
                self.take(i, j + at, t_ids, t)
            self.met += upto - at
            at = upto

    def take(self, i: np.ndarray, j: np.ndarray, t_ids: np.ndarray, t: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            near = np.einsum("ij,ij->i", self.q[i], t[j]) if self.metric == "cosine" else -((self.q[i] - t[j]) ** 2).sum(1)
        near, ids = np.round(near, PLACES), t_ids[j]
        keep = np.isfinite(near) & (near >= self.bar[i])
        if self.exclude_self:
            keep &= self.q_ids[i] != ids
        if not keep.any():
            return
        row, score, ids = np.concatenate((self.row, i[keep])), np.concatenate((self.score, near[keep])), np.concatenate((self.id, ids[keep]))
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        first = place < self.k
        self.row, self.score, self.id = row[first], score[first], ids[first]
        last = place == self.k - 1
        self.bar[row[last]] = np.maximum(self.bar[row[last]], score[last])

    def told(self) -> pa.RecordBatch:
        score = self.score if self.metric == "cosine" else 0.0 - self.score
        return pa.RecordBatch.from_arrays([pa.array(self.q_ids[self.row]), pa.array(self.id), pa.array(score)], names=["id", "neighbor", "score"])


def _screened(data: np.ndarray, metric: str, asks: bool) -> np.ndarray:
    """Rows whose products are similarities: of vectors themselves, or less the squared distance of theirs."""
    if metric == "cosine":
        return data
    squares, ones = (data**2).sum(1)[:, None], np.ones((len(data), 1))
    return np.hstack((2 * data, -squares, -ones) if asks else (data, ones, squares))


def _best(k: int, metric: str, exclude_self: bool, radius: float | None):
    least = -np.inf if radius is None else (radius if metric == "cosine" else -radius)
    portion = max(1, min(PORTION, HELD_ROWS // max(1, k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []
        for batch in batches:
            for n in range(batch.num_rows):
                r = batch.slice(n, 1).to_pylist()[0]
                if r["task"] != task:
                    task, held = r["task"], []
                ids = np.frombuffer(r["ids"], np.int64)
                data = np.frombuffer(r["data"]).reshape(len(ids), -1)
                if not r["asks"]:
                    screened = _screened(data, metric, False)
                    held.append((ids, data, screened.astype(np.float32), np.linalg.norm(screened, axis=1).max()))
                    continue
                for at in range(0, len(ids), portion):
                    best = _Best(ids[at : at + portion], data[at : at + portion], k, metric, exclude_self, least)
                    for t in held:
                        best.meet(*t)
                    yield best.told()

    return run


def _dealt(queries: DataFrame, table: DataFrame, same_cell: bool, meet: int = MEET, tasks: int = TASKS) -> DataFrame:
    """(task, asks, ids, data): each group of blocks of queries with each group of blocks of the table, a task's together, the
    table's first. With ``same_cell`` groups are of one cell each."""
    spark = queries.sparkSession
    cell = F.col("cell") if same_cell else F.lit(0).cast("bigint")
    sizes = lambda df: {r[0]: r[1] for r in df.groupBy(cell.alias("c")).agg(F.count("*")).collect()}  # noqa: E731  one row a cell
    asked, there = sizes(queries), sizes(table)
    met = sorted(c for c in asked if c in there)
    pairs = sum(asked[c] * there[c] for c in met)
    size = max(1, min(meet, math.isqrt(pairs // tasks)))
    plan, n = [], 0
    for c in met:
        groups = [-(-x // size) for x in (asked[c], there[c])]
        plan.append((c, *groups, n))
        n += groups[0] * groups[1]
    places = F.broadcast(spark.createDataFrame(plan, "c bigint, q_groups int, t_groups int, first int"))  # one row a cell
    group = lambda n: F.pmod(F.col("cell") + F.col("block"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = queries.join(places, cell == F.col("c")).select("first", "t_groups", group("q_groups").alias("q"), each("t_groups").alias("t"), F.lit(True).alias("asks"), "cell", "block", "ids", "data")
    t = table.join(places, cell == F.col("c")).select("first", "t_groups", each("q_groups").alias("q"), group("t_groups").alias("t"), F.lit(False).alias("asks"), "cell", "block", "ids", "data")
    both = q.union(t).select((F.col("first") + F.col("q") * F.col("t_groups") + F.col("t")).alias("task"), "asks", "cell", "block", "ids", "data")
    return both.repartitionById(max(1, n), F.col("task")).sortWithinPartitions("asks", "cell", "block").select("task", "asks", "ids", "data")


def top_k(queries: DataFrame, table: DataFrame, k: int, metric: str = "cosine", exclude_self: bool = False, radius: float | None = None, same_cell: bool = False) -> DataFrame:
    """(id, neighbor, score, rank): the k best rows of ``table`` for each of ``queries`` (both from ``blocks``).

    Cosine similarity falls, squared distance rises with the rank; ties go by neighbor id; ``radius`` is the least
    similarity or the largest distance. With fewer than k rows in reach there are fewer neighbours. With ``same_cell``
    queries, which may be in several cells, only meet the rows of their cells.
    """
    found = _dealt(queries, table, same_cell).mapInArrow(_best(k, metric, exclude_self, radius), "id bigint, neighbor bigint, score double")
    best = F.desc("score") if metric == "cosine" else F.asc("score")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(best, "neighbor"))).where(F.col("rank") <= k)


def mutual_pairs(neighbors: DataFrame) -> DataFrame:
    """(a, b, score), a < b: rows that are each other's first neighbour; the score is the larger of both."""
    first = neighbors.where("rank = 1").select("id", "neighbor", "score")
    x, y = first.alias("x"), first.alias("y")
    both = (F.col("x.id") == F.col("y.neighbor")) & (F.col("x.neighbor") == F.col("y.id")) & (F.col("x.id") < F.col("y.id"))
    return x.join(y, both).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.greatest("x.score", "y.score").alias("score"))


def unique_candidates(neighbors: DataFrame) -> DataFrame:
    """(a, b, score), a < b: every pair that any row lists, once, with its larger score."""
    return neighbors.groupBy(F.least("id", "neighbor").alias("a"), F.greatest("id", "neighbor").alias("b")).agg(F.max("score").alias("score"))


def threshold_split(pairs: DataFrame, least: float | None) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): NaN and scores below ``least`` are dropped; without a threshold nothing is."""
    low = F.lit(False) if least is None else F.isnan("score") | (F.col("score") < least)
    return pairs.where(~low), pairs.where(low)


def radius_search(queries: DataFrame, table: DataFrame, k: int, radius: float, doublings: int = 9) -> DataFrame:
    """Neighbours within a squared distance, at most k * 2 ** doublings of them."""
    return top_k(queries, table, k << doublings, "l2", radius=radius)


def with_fallback(neighbors: DataFrame, least: float) -> DataFrame:
    """Neighbours with a score of at least ``least``; the first one alone where none has."""
    return neighbors.where((F.col("score") >= least) | (F.col("rank") == 1))
