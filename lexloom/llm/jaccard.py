"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of at least 85 / 100.

Exact at any size, in steps that lose no link:

1. Equal sets (by 128-bit digest) become one: only a representative goes on.
2. Sieve. Sets within the bound differ in at most H elements, H given by their size class; the hash range is cut into
   H + 1 parts and a few more, so some part that is not empty agrees as a whole. A set goes on only if one of its parts,
   hashed, equals that of another set. Common passages do not pass by themselves.
3. Order. The survivors' shingles are counted; those found once are dropped (they still count in sizes and places), the
   others are put in one global order, rare first, those that are frequent in a sample of sets last.
4. Candidates share a shingle in their prefixes, within the length and place bounds. Per shingle, the set with the
   fewest unshared shingles is the pivot, and the others are only compared with it: a group of copies around an
   original costs as many pairs as it has members. Then only shingles whose sets are still in different components
   give further pairs; of a frequent one, blocks of sets meet in tasks of their own.
5. Verification is a prefix tree join: the candidates of a set, in salted groups of bounded size, form a trie of
   globally ordered shingles; the set traverses it, a branch's partial overlap is shared by what is below, and a
   branch that cannot reach the bound with what remains is left.
6. Components of the verified links; members get their representative's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.llm.columns import id_text
from lexloom.llm.words import Hashes, mix, portions, shingle_hashes, tidy
from lexloom.plans.components import connected_components
from lexloom.plans.shared import small, stored

SHINGLE_WORDS = 4
#: The least similarity, as a ratio.
NUM, DEN = 85, 100
#: Sets with one shingle that meet each other in one task; of more, blocks of them meet in tasks of their own.
BLOCK_SETS = 256
#: Sets by whose shingles frequent ones are known, those with the smallest hash of their id, and how many of them a frequent
#: shingle is in. What is frequent only decides on the order of shingles and on how they are dealt out, not on results.
SAMPLE_SETS, HOT_SETS = 20_000, 100
#: Shingles in one verification group, besides those of the set that traverses it.
GROUP_SHINGLES = 200_000


class Classes:
    """Size classes: class c holds sizes from lows[c] to highs[c] = lows[c] * DEN // NUM; parts[c] is for pairs whose smaller set is in c."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.lows, self.highs, self.parts, self.spare = [], [], [], []

    def of(self, n: int) -> int:
        while not self.highs or self.highs[-1] < n:
            low = self.highs[-1] + 1 if self.highs else 1
            high = low * self.den // self.num
            apart = (self.den - self.num) * (high + high * self.den // self.num) // (self.den + self.num)
            spare = 1 + apart // 25
            self.lows.append(low)
            self.highs.append(high)
            self.spare.append(spare)
            self.parts.append(apart + 1 + spare)
        return int(np.searchsorted(self.highs, n))


def signatures(found: np.ndarray, classes: Classes) -> np.ndarray:
    """Hashes of the parts of a set, for its own size class and the one below.

    Any two sets within the bound share one. An empty part only counts where a set has more of them than are spare: a
    pair with fewer agrees on some part that is not empty.
    """
    own = classes.of(len(found))
    out = []
    for c in range(max(0, own - 1), own + 1):
        k = classes.parts[c]
        part = (mix(found) % np.uint64(k)).astype(np.int64)
        sums = np.zeros(k, np.uint64)
        order = np.argsort(part, kind="stable")
        filled, starts = np.unique(part[order], return_index=True)
        sums[filled] = np.add.reduceat(mix(found ^ np.uint64(0x9E3779B97F4A7C15))[order], starts)
        use = np.arange(k) if k - len(filled) > classes.spare[c] else filled
        out.append(mix(sums[use] + mix(use.astype(np.uint64) + np.uint64(c << 32))))
    return np.concatenate(out).view(np.int64)


def _sets(k: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in portions(batches):
            rows = []
            for text in batch.column("text").cast(pa.binary()):
                found = shingle_hashes(text.as_py(), k, hashes)
                rows.append((len(found), *np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=["id", "n", "d1", "d2"])

    return run


def _posts(k: int, num: int, den: int):
    """(d1, sig) of the sets' signatures. Of the sets of a portion that share one only the first hands it on; for each of
    these sets two rows with a signature of its own and different digests say that it is shared."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, hashes = Classes(num, den), Hashes()
        for batch in portions(batches):
            digests, sigs = [], []
            for text in batch.column("text").cast(pa.binary()):
                found = shingle_hashes(text.as_py(), k, hashes)
                if len(found):
                    digests.append(np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)[0])
                    sigs.append(signatures(found, classes))
            if not sigs:
                continue
            every, digest = np.concatenate(sigs), np.repeat(np.array(digests, np.int64), [len(s) for s in sigs])
            order = np.argsort(every, kind="stable")
            every, digest = every[order], digest[order]
            starts = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
            mixed = np.minimum.reduceat(digest, starts) != np.maximum.reduceat(digest, starts)
            shared = np.unique(digest[np.repeat(mixed, np.diff(np.append(starts, len(every))))])
            own = mix(shared.view(np.uint64) ^ np.uint64(0x5348415245)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([digest[starts], shared, shared ^ 1])), pa.array(np.concatenate([every[starts], own, own]))], names=["d1", "sig"])

    return run


def _shingles(k: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in portions(batches):
            rows = [shingle_hashes(t.as_py(), k, hashes).view(np.int64) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.list_(pa.int64()))], names=["id", "tokens"])

    return run


def traverse(x: np.ndarray, nx: int, rows: list[tuple[int, int, np.ndarray]], num: int = NUM, den: int = DEN) -> list[int]:
    """Ids of those (id, n, tokens) whose similarity with x is at least num / den.

    Tokens are what is shared of sets of nx and n elements, in one global order. The rows, sorted, are a trie: a row's
    first tokens in common with the row before are one path, whose overlaps are taken over. ``dead`` is the depth at
    which the current branch cannot reach the bound any more.
    """
    have = np.sort(x)
    rows = sorted(rows, key=lambda r: r[2].tobytes())
    found, before, over = [], np.empty(0, np.int64), np.zeros(1, np.int64)
    for i, n, tokens in rows:
        need = -(-num * (nx + n) // (num + den))
        common = min(len(before), len(tokens))
        differ = np.flatnonzero(before[:common] != tokens[:common])
        depth = min(int(differ[0]) if len(differ) else common, len(over) - 1)
        over = over[: depth + 1]
        at = depth
        while at < len(tokens) and over[-1] + min(len(x) - over[-1], len(tokens) - at) >= need:
            step = tokens[at : at + 256]
            place = np.searchsorted(have, step)
            hit = have[np.minimum(place, len(have) - 1)] == step if len(have) else np.zeros(len(step), bool)
            over = np.concatenate([over, over[-1] + np.cumsum(hit)])
            at += len(step)
        if at == len(tokens) and over[at] >= need:
            found.append(i)
        before = tokens
    return found


def _verified(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        ids, sizes = table.column("id").to_pylist(), table.column("n").to_pylist()
        tokens = [x.values.to_numpy() for x in table.column("tokens")]
        head = table.column("head").to_pylist().index(True)
        rows = [(ids[i], sizes[i], tokens[i]) for i in range(len(ids)) if i != head]
        found = traverse(tokens[head], sizes[head], rows, num, den)
        return pa.table({"a": pa.array([ids[head]] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return run


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of candidate pairs (a, b), those within the bound. A set with many candidates meets them in salted groups."""
    sizes = sets.select(F.col("id").alias("b"), F.size("tokens").alias("size"))
    sized = pairs.join(sizes, "b")
    salts = sized.groupBy("a").agg(F.ceil(F.sum("size") / GROUP_SHINGLES).alias("salts"))
    dealt = sized.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.greatest("salts", F.ceil(F.lit(1)))).alias("salt"))
    members = dealt.join(sets.withColumnRenamed("id", "b"), "b").select("a", "salt", F.col("b").alias("id"), "n", "tokens", F.lit(False).alias("head"))
    heads = dealt.select("a", "salt").distinct().join(sets.withColumnRenamed("id", "a"), "a").select("a", "salt", F.col("a").alias("id"), "n", "tokens", F.lit(True).alias("head"))
    return members.union(heads).groupBy("a", "salt").applyInArrow(_verified(num, den), "a bigint, b bigint")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id): components of the links den * |A n B| >= num * |A u B|.

    A set holds the distinct runs of k words, A-Z lower-cased; of a text with fewer words its whole sequence. Null and
    empty texts, and those without words, have an empty set and are linked with nothing. component_id is the smallest
    id that links reach. Repeated rows each give a row; rows without an id are left out; other columns are ignored; an
    empty table gives no rows.
    """
    base = id_text(docs, id_col, text_col).where("id is not null").select(F.col("id").cast("bigint").alias("id"), "text")
    sets = stored(base.mapInArrow(_sets(k), "id bigint, n bigint, d1 bigint, d2 bigint"), "sets")
    reps = stored(sets.where("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.max("n").alias("n")), "reps")

    # signatures and shingles are made on their way into a shuffle: as tables they would take as much disk as the texts
    w = Window.partitionBy("sig")
    met = base.mapInArrow(_posts(k, num, den), "d1 bigint, sig bigint").select("d1", F.min("d1").over(w).alias("low"), F.max("d1").over(w).alias("high")).where("low <> high").select("d1")
    close = stored(reps.join(met.distinct(), "d1", "left_semi").select(F.col("rep").alias("id"), "n"), "close")

    texts = base.join(small(close.select("id")), "id", "left_semi")
    shingled = lambda df: df.mapInArrow(_shingles(k), "id bigint, tokens array<bigint>")
    # only rows that repeat an id are shuffled to find one of each
    repeated = stored(sets.groupBy("id").count().where("count > 1").select("id"), "repeated")
    tokens = shingled(texts)
    if not repeated.isEmpty():
        once, again = (shingled(texts.join(small(repeated), "id", how)) for how in ("left_anti", "left_semi"))
        tokens = once.union(again.dropDuplicates(["id"]))
    sample = close.select("id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_SETS)
    sampled = shingled(texts.join(F.broadcast(sample), "id", "left_semi")).select(F.explode(F.array_distinct("tokens")).alias("token"))
    hot = stored(sampled.groupBy("token").count().where(F.col("count") >= HOT_SETS).select("token", F.lit(1).alias("hot")), "hot")
    # at most SAMPLE_SETS / HOT_SETS times the shingles of a set; these come last in the order, uncounted and spread
    each = tokens.select("id", F.explode("tokens").alias("token")).join(small(hot), "token", "left")
    spread = F.when(F.col("hot") == 1, F.pmod(F.xxhash64("id"), F.lit(1024))).otherwise(F.lit(0))
    counted = each.withColumn("salt", spread).withColumn("df", F.count("*").over(Window.partitionBy("token", "salt")))
    ordered = counted.where("hot = 1 or df > 1").groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.when(F.col("hot") == 1, F.lit(1 << 60)).otherwise(F.col("df")).alias("df"), "token"))).alias("t"))
    shared = stored(ordered.join(close, "id").select("id", "n", F.col("t.token").alias("tokens"), (F.col("n") - F.size("t")).alias("rare")), "shared")

    ceil_of = lambda x, d: F.floor((x + (d - 1)) / d).cast("bigint")
    length = F.greatest(F.col("n") - ceil_of(F.col("n") * num, den) + 1 - F.col("rare"), F.lit(0)).cast("int")
    prefix = stored(shared.select("id", "n", "rare", F.posexplode(F.slice("tokens", F.lit(1), length)).alias("pos", "token")).withColumn("pos", F.col("pos") + F.col("rare")), "prefix")

    def bound(a: str, b: str):
        na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
        fits = F.least(na, nb) * den >= F.greatest(na, nb) * num
        return fits & (F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos")) >= ceil_of((na + nb) * num, num + den))

    pivots = prefix.groupBy("token").agg(F.min(F.struct("rare", "id", "n", "pos")).alias("p"), F.count("*").alias("c")).where("c > 1").select("token", "p.id", "p.n", "p.pos")
    stars = prefix.alias("m").join(pivots.alias("p"), "token").where((F.col("p.id") != F.col("m.id")) & bound("p", "m"))
    pairs = stored(stars.select(F.col("p.id").alias("a"), F.col("m.id").alias("b")).distinct(), "pairs")
    links = stored(_links(pairs, shared, num, den), "links")
    part = connected_components(links).withColumnRenamed("node", "id")

    placed = stored(prefix.join(part, "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
    split = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("blocks")).where("low <> high")
    rest = placed.join(small(stored(split.select("token", "blocks"), "split")), "token")
    index = F.col("a.n") - ceil_of(F.col("a.n") * 2 * num, num + den) + 1
    smaller = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.id") < F.col("b.id")))
    block, every = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = rest.withColumn("row", block).withColumn("column", every)
    right = rest.withColumn("column", block).withColumn("row", every)
    crossing = left.alias("a").join(right.alias("b"), ["token", "row", "column"]).where(smaller & (F.col("a.component") != F.col("b.component")) & (F.col("a.pos") < index) & bound("a", "b"))
    seen = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = stored(crossing.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct().join(seen, ["a", "b"], "left_anti"), "pairs")
    late = stored(_links(more, shared, num, den), "links")
    whole = connected_components(links.union(late)) if not late.isEmpty() else part.withColumnRenamed("id", "node")

    classes = reps.join(whole.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    full = sets.where("n > 0").join(classes, ["d1", "d2"]).select("id", "n", "component")
    empty = sets.where("n = 0").select("id", "n", F.col("id").alias("component"))
    return full.union(empty).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
