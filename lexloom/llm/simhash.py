"""Document fingerprints: weighted term hashes vote on the 64 bits of a SimHash; permuted block tables search by radius.

Native. Votes need no per-bit rows: a term's hash, shifted by j and masked, holds bits j and j + 32 in the two halves of
a BIGINT, so 32 plain sums count the votes for all 64 bits, with map-side partials and within compiled code.

The tables: bits are cut into six blocks; for radius 3 there is a table for each choice of three blocks (20), keyed by
the bits of those blocks. Fingerprints within the radius differ in at most three blocks and so share a key in some table.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.llm.columns import id_text
from lexloom.plans.shared import small, stored

BITS = 64
RADIUS = 3
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Documents per ordering bucket: neighbours by id are found within buckets, so no task orders all of them.
BUCKET = 1024
#: Rows that may be ordered in one task when buckets themselves are put in order.
ORDERED = 10_000


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def text_key(text: Column) -> Column:
    """Tells the texts of rows that share an id apart."""
    return F.xxhash64(text)


def fingerprints(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, fp) of each different row of the keys of (keys, text), which are to tell texts apart: terms are lower-cased
    words, weighted by frequency and by length up to 16.

    Longer words are rarer, so length stands in for a corpus statistic and fingerprints do not depend on other rows.
    A bit is set if terms with more than half of the weight set it; a text without terms gives 0. Sums of 32 bits hold
    the weight of some 16 million words in one text; a heavier text fails the job.
    """
    terms = df.select(*keys, F.explode(F.split(F.lower(F.col("text")), r"[\s]+")).alias("term"))
    length = F.least(F.length("term"), F.lit(16)).cast("bigint")
    votes = terms.select(*keys, F.xxhash64("term").alias("h"), (length * length).alias("w"))
    halves = F.lit((1 << 32) | 1)
    sums = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(halves) * F.col("w")).alias(f"v{j}") for j in range(32)]
    counted = votes.groupBy(*keys).agg(F.sum("w").alias("w"), *sums)
    counted = counted.withColumn("w", F.when(F.col("w") < 1 << 32, F.col("w")).otherwise(F.raise_error(F.lit("a text is too long for its votes")).cast("bigint")))
    # one small loop per document, rather than 64 branches in compiled code
    mask = F.lit((1 << 32) - 1)
    bit = lambda votes, at: F.when(votes * 2 > F.col("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), at)).otherwise(F.lit(0).cast("bigint"))
    bits = F.transform(F.array(*[f"v{j}" for j in range(32)]), lambda v, j: bit(v.bitwiseAND(mask), j).bitwiseOR(bit(F.shiftrightunsigned(v, 32), j + 32)))
    return counted.select(*keys, F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(x)).alias("fp"))


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits, 0 to 1."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def _masks(blocks: tuple[int, ...], radius: int) -> list[int]:
    edges = [sum(blocks[:k]) for k in range(len(blocks) + 1)]
    block = [((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in range(len(blocks))]
    return [_signed(sum(block[k] for k in kept)) for kept in combinations(range(len(blocks)), len(blocks) - radius)]


def within_radius(queries: DataFrame, table: DataFrame, radius: int = RADIUS, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """(query, fp, distance) of all pairs of different fingerprints (columns ``fp``) of both sides within the radius.

    Each pair comes once, though it may meet in several tables. Copies cost nothing: both sides are made distinct.
    """
    masks = _masks(blocks, radius)
    keyed = lambda df, name: df.select(F.col("fp").alias(name)).distinct().select(
        name, F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(name).bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])).alias("k")
    ).select(name, "k.t", "k.key")
    apart = F.col("query").bitwiseXOR(F.col("fp"))
    q, d = keyed(queries, "query").alias("q"), keyed(table, "fp").alias("d")
    near = (F.col("q.t") == F.col("d.t")) & (F.col("q.key") == F.col("d.key")) & (apart != 0) & (F.bit_count(apart) <= radius)
    return q.join(d, near).select("query", "fp", F.bit_count(apart).alias("distance")).distinct()


def next_lower(keys: DataFrame) -> DataFrame:
    """(key, next): for each distinct BIGINT of ``key`` the largest smaller one; null for the smallest."""
    keys = stored(keys.select("key").distinct(), "keys")
    if keys.count() <= ORDERED:
        return keys.select("key", F.lag("key").over(Window.orderBy("key")).alias("next"))
    cut = keys.withColumn("bucket", F.floor(F.col("key") / BUCKET))
    inner = cut.select("key", "bucket", F.lag("key").over(Window.partitionBy("bucket").orderBy("key")).alias("next"))
    tops = cut.groupBy("bucket").agg(F.max("key").alias("top"))
    below = next_lower(tops.select(F.col("bucket").alias("key")))
    above = below.join(tops.select(F.col("bucket").alias("next"), "top"), "next").select(F.col("key").alias("bucket"), "top")
    return inner.join(above, "bucket", "left").select("key", F.coalesce("next", "top").alias("next"))


def with_next(df: DataFrame) -> DataFrame:
    """(id, text, next_id, next_text, bucket, at): the next row in descending id; after the last comes the first. bucket and
    at tell rows apart.

    Rows are dealt to buckets of neighbouring ids; the first row of each bucket is also sent to the bucket before it.
    """
    bucket = F.floor(F.col("id") / BUCKET)
    ends = stored(df.select("id", bucket.alias("bucket")).groupBy("bucket").agg(F.max("id").alias("top")), "tops")
    order = next_lower(ends.select(F.col("bucket").alias("key")))
    last = ends.agg(F.max("bucket")).first()[0]
    guests = order.select(F.coalesce("next", F.lit(last)).alias("bucket"), F.col("key").alias("host")).join(ends, "bucket").select(F.col("top").alias("id"), "host")
    hosted = df.join(small(stored(guests.groupBy("id").agg(F.collect_list("host").alias("hosts")), "guests")), "id", "left")
    places = F.concat(F.array(F.struct(bucket.alias("bucket"), F.lit(0).alias("guest"))), F.coalesce(F.transform("hosts", lambda h: F.struct(h.alias("bucket"), F.lit(1).alias("guest"))), F.array().cast("array<struct<bucket:bigint,guest:int>>")))
    rows = hosted.select("id", "text", F.explode(places).alias("at")).select("id", "text", "at.bucket", "at.guest")
    w = Window.partitionBy("bucket").orderBy("guest", F.desc("id"), "text")
    return rows.select("id", "text", "guest", "bucket", F.row_number().over(w).alias("at"), F.lead("id").over(w).alias("next_id"), F.lead("text").over(w).alias("next_text")).where("guest = 0").drop("guest")


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 50, radius: int = RADIUS) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, likenesses, and a search by radius.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near). The edited text
    has the last floor(n_chars / 2) code points replaced by the first ones of the next document. n_near: for each id
    divisible by ``every``, the number of other documents within ``radius`` of its fingerprint; null for other ids.

    Null texts count as empty; rows without an id are left out; ids are expected to be unique: rows that repeat one
    are each paired with one of the rows of the next id. An empty table gives no rows; other columns are ignored.
    """
    base = id_text(docs, id_col, text_col).where("id is not null").select(F.col("id").cast("bigint").alias("id"), "text")
    if base.isEmpty():
        return base.sparkSession.createDataFrame([], "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_near bigint")
    own = stored(fingerprints(base.withColumn("tid", text_key(F.col("text"))), "id", "tid"), "prints")
    half = F.floor(F.length("text") / 2).cast("int")
    both = with_next(base).select("bucket", "at", "id", text_key(F.col("text")).alias("tid"), "next_id", text_key(F.col("next_text")).alias("ntid"), F.length("text").cast("bigint").alias("n_chars"), F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next_text", F.lit(1), half)).alias("text"))
    edited = both.select("bucket", "at", "id", "tid", "next_id", "ntid", "n_chars", F.sha2("text", 256).alias("edited_sha256"), "text")
    # what is told of the edited text groups its votes, so that it is made once
    changed = fingerprints(edited, "bucket", "at", "id", "tid", "next_id", "ntid", "n_chars", "edited_sha256").withColumnRenamed("fp", "efp")
    sizes = stored(own.groupBy("fp").agg(F.count("*").alias("n")), "sizes")
    queries = own.where(F.col("id") % every == 0)
    pairs = within_radius(queries, sizes, radius).join(sizes, "fp").groupBy(F.col("query").alias("fp")).agg(F.sum("n").alias("others"))
    counts = sizes.join(queries.select("fp").distinct(), "fp", "left_semi").join(pairs, "fp", "left").select("fp", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_near"))
    searched = queries.join(counts, "fp").select("id", "tid", "n_near")
    every_one = changed.join(own, ["id", "tid"]).join(own.select(F.col("id").alias("next_id"), F.col("tid").alias("ntid"), F.col("fp").alias("nfp")), ["next_id", "ntid"]).join(searched, ["id", "tid"], "left")
    return every_one.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("nfp")).alias("near_next"), "n_near",
    )


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 50, radius: int = RADIUS) -> DataFrame:
    """(doc_id, class_id, near_class, distance): each document's class, and the classes near those of the queried ids.

    A class has the documents of one fingerprint and is named by its smallest id. That document has a row for each
    class within ``radius`` if an id of its own class is divisible by ``every``; all others have one row without a
    near class. Edge cases are those of ``fingerprint_report``.
    """
    base = id_text(docs, id_col, text_col).where("id is not null").select(F.col("id").cast("bigint").alias("id"), "text")
    own = stored(fingerprints(base.withColumn("tid", text_key(F.col("text"))), "id", "tid"), "prints")
    classes = stored(own.groupBy("fp").agg(F.min("id").alias("class_id")), "classes")
    found = within_radius(own.where(F.col("id") % every == 0), classes, radius)
    named = found.join(classes.withColumnRenamed("class_id", "near_class"), "fp").select(F.col("query").alias("fp"), "near_class", "distance").join(classes, "fp")
    pairs = named.select(F.col("class_id").alias("id"), "near_class", F.col("distance").cast("bigint").alias("distance"))
    return own.join(classes, "fp").join(pairs, "id", "left").select(F.col("id").alias("doc_id"), "class_id", "near_class", "distance")
