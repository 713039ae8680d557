"""Benchmark decontamination: size-partitioned MinHash containment search for short items inside long documents.

A short item inside a long document has a tiny Jaccard similarity, so bands over whole documents would miss it. Each
item's sketch is its m smallest shingle hashes, m = |Q| - ceil(t |Q|) + 1: a document that holds a share t of the item
leaves out fewer than m shingles, so it meets the sketch. Items are partitioned by the shingles that a document must
hold at least; a document is only looked up in the partitions that it is large enough for. Two steps:

1. All documents' shingle hashes are joined with the sketches alone. Pairs that meet are candidates.
2. Only candidate documents are cut into shingles again and compared, as words, with all shingles of their candidates.

Items shorter than a shingle use shingles of their own length. Native: shingles are rows made by compiled code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.plans.shared import small, stored

SHINGLE_WORDS = 5
CONTAINMENT = 0.8


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(df: DataFrame, k: int) -> DataFrame:
    """(id, n, hash, w0..): one row per run of k words of the column ``words``; n is how many there are."""
    # Shifted copies of the array are zipped and exploded: no array is carried into the rows, and all is compiled code.
    names = [f"w{i}" for i in range(k)]
    zipped = F.arrays_zip(*[F.slice("words", i + 1, F.greatest(F.size("words") - (k - 1), F.lit(0))).alias(w) for i, w in enumerate(names)])
    rows = df.where(F.size("words") >= k).select("id", (F.size("words") - (k - 1)).alias("n"), F.explode(zipped).alias("z"))
    return rows.select("id", "n", F.xxhash64(*[F.col(f"z.{w}") for w in names]).alias("hash"), *[F.col(f"z.{w}") for w in names])


def _text(k: int) -> Column:
    return F.concat_ws(" ", *[f"w{i}" for i in range(k)])


def item_shingles(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = SHINGLE_WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """(item_id, k, hash, shingle, size, need, least, sketch) for each distinct shingle of each item with words.

    size is the item's number of distinct shingles, need the least number a document must hold, least its size partition
    (the power of two up to need), sketch whether the shingle is among the item's size - need + 1 of smallest hash.
    """
    items = benchmark.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("words"))
    parts = [_shingles(items, k).select("id", F.lit(k).alias("k"), "hash", _text(k).alias("shingle"))]
    parts += [_shingles(items.where(F.size("words") == n), n).select("id", F.lit(n).alias("k"), "hash", _text(n).alias("shingle")) for n in range(1, k)]
    rows = reduce(DataFrame.union, parts).distinct()
    sets = rows.groupBy("id").agg(F.count("*").alias("size"), F.array_sort(F.collect_list(F.struct("hash", "shingle", "k"))).alias("all"))
    need = F.ceil(F.round(F.col("size") * containment, 6)).cast("bigint")
    each = sets.withColumn("need", need).select(F.col("id").alias("item_id"), "size", "need", F.posexplode("all").alias("rank", "s"))
    least = F.pow(2, F.floor(F.log2("need"))).cast("bigint")
    return each.select("item_id", "s.k", "s.hash", "s.shingle", "size", "need", least.alias("least"), (F.col("rank") <= F.col("size") - F.col("need")).alias("sketch"))


def candidates(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(id, item_id) of the documents (id, words) that meet an item's sketch of shingles of k words and are large enough."""
    sketches = stored(items.where((F.col("k") == k) & F.col("sketch")).select("item_id", "hash", "least"), "sketches")
    return _shingles(docs, k).select("id", "n", "hash").join(small(sketches), "hash").where("n >= least").select("id", "item_id").distinct()


def verified(docs: DataFrame, items: DataFrame, met: DataFrame, k: int) -> DataFrame:
    """(id, item_id, n_shared, n_item) of the candidates ``met`` whose documents hold enough of the item's shingles."""
    rows = _shingles(docs.join(small(met.select("id").distinct()), "id", "left_semi"), k).select("id", _text(k).alias("shingle")).distinct()
    own = items.where(F.col("k") == k).select("item_id", "shingle", "size", "need")
    hits = rows.join(small(own), "shingle").join(small(met), ["id", "item_id"], "left_semi")
    counted = hits.groupBy("id", "item_id").agg(F.count("*").alias("n_shared"), F.max("size").alias("n_item"), F.max("need").alias("need"))
    return counted.where("n_shared >= need").select("id", "item_id", "n_shared", "n_item")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", k: int = SHINGLE_WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) for each document that holds at least ``containment`` of an item's shingles.

    Null and empty texts, and items without words, match nothing; rows that repeat an item's id count as one item made of
    all of them; rows that repeat a document's id as one document, which has the item if one of the rows is large enough
    and all together hold its shingles; a null document id matches nothing; other columns are ignored. A sketch or a set
    of candidates too large to broadcast takes a shuffle join, in which Spark splits frequent shingles.
    """
    items = stored(item_shingles(benchmark, item_id_col, item_text_col, k, containment), "items")
    lengths = sorted(r[0] for r in items.select("k").distinct().collect())  # at most k different values
    base = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("words")).where("id is not null")
    found = [verified(base, items, stored(candidates(base, items, n), "candidates"), n) for n in lengths]
    if not found:
        return docs.select(F.col(id_col).alias("doc_id")).limit(0).crossJoin(items.select("item_id", F.col("size").alias("n_shared"), F.col("size").alias("n_item")).limit(0))
    return reduce(DataFrame.union, found).select(F.col("id").alias("doc_id"), "item_id", "n_shared", "n_item")


ORACLE_SQL = r"""
with d as (select doc_id as id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents),
b as (select item_id as id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark),
i as (select id, w, least(len(w), 5) as k from b where len(w) > 0),
ds as (select distinct id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as s from d, (select distinct k from i) where len(w) >= k),
bs as (select distinct id as item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as s from i),
n as (select item_id, count(*) as n_item from bs group by item_id)
select ds.id as doc_id, bs.item_id as item_id, count(*)::bigint as n_shared, any_value(n_item)::bigint as n_item
from ds join bs using (k, s) join n using (item_id) group by ds.id, bs.item_id having count(*) >= ceil(round(any_value(n_item) * 0.8, 6))
"""
