"""Queries over texts and annotations. Each entry: name -> (function of session and folder, SQL or null)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.operators import annotate, evaluate, grouping


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, line) of the lines of all documents that are not blank."""
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return each.where(F.trim("line") != "")


LINES = r"""lines as (select doc_id, pos, line from (select doc_id, unnest(range(len(l))) as pos, unnest(l) as line
from (select doc_id, string_split(text, chr(10)) as l from documents)) where trim(line) <> '')"""


def first_words(c: str = "line", n: int = 3):
    return F.array_join(F.slice(F.split(F.trim(c), " +"), 1, n), " ")


#: Pairs as a generator would give them; every seventh document forgets the separator.
def raw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("doc_id") % 7 == 0, " ").otherwise("; ")
    return lines(spark, sf_dir).select("doc_id", "pos", F.concat(first_words(), mark, F.col("line")).alias("pair"))


PAIRS = (
    LINES
    + r""", raw as (select doc_id, pos, case when doc_id % 7 = 0 then null else array_to_string(list_slice(regexp_split_to_array(trim(line), ' +'), 1, 3), ' ') end as d, trim(line) as e from lines),
pairs as (select doc_id, pos, regexp_replace(replace(lower(d), 'ß', 'ss'), '\s+', ' ', 'g') as descriptor, e as explainer from raw where d is not null),
ids as (select *, substr(sha1(descriptor || '␟' || explainer), 1, 12) as id from pairs)"""
)


def pairs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.first_pairs(grouping.extract_pairs(raw_pairs(spark, sf_dir)), ["doc_id", "pos"])


def q_extract_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptor groups: each pair with its place in its group, in order of appearance. A group is as many rows, whatever
    its size."""
    first = pairs_of(spark, sf_dir).withColumnRenamed("pos", "line")
    return grouping.placed_groups(first, ["doc_id", "line"])


SQL_EXTRACT = f"""with {PAIRS}, f as (select descriptor, explainer, id, min((doc_id, pos)) as first_at, count(*) as n from ids group by all)
select descriptor, (row_number() over (partition by descriptor order by first_at, id) - 1)::bigint as pos, id, explainer from f"""


def q_group_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = grouping.group_statistics(pairs_of(spark, sf_dir))
    return s.withColumn("average", F.round("average", 6))


SQL_STATS = f"""with {PAIRS}, g as (select descriptor, count(distinct explainer) as n from ids group by descriptor)
select count(*)::bigint as n_descriptors, sum(n)::bigint as n_pairs, count(*) filter (n = 1)::bigint as n_single, count(*) filter (n > 1)::bigint as n_multi, round(avg(n), 6) as average, max(n)::bigint as largest from g"""


def q_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = grouping.extract_pairs(raw_pairs(spark, sf_dir))
    return each.groupBy("ok").agg(F.count("*").alias("n"), F.countDistinct("pair").alias("n_distinct"))


SQL_MALFORMED = f"""with {LINES}, r as (select doc_id % 7 <> 0 as ok, array_to_string(list_slice(regexp_split_to_array(trim(line), ' +'), 1, 3), ' ') || case when doc_id % 7 = 0 then ' ' else '; ' end || line as pair from lines)
select ok, count(*)::bigint as n, count(distinct pair)::bigint as n_distinct from r group by ok"""


def q_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explainers of a descriptor in prompts of at most 20, by id."""
    placed = grouping.chunked(pairs_of(spark, sf_dir), ["descriptor"], "id")
    return placed.groupBy("descriptor", "chunk").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


SQL_CHUNKS = f"""with {PAIRS}, f as (select distinct descriptor, id from ids), c as (select descriptor, id, (row_number() over (partition by descriptor order by id) - 1) // 20 as chunk from f)
select descriptor, chunk::bigint as chunk, count(*)::bigint as n, min(id) as first_id from c group by descriptor, chunk"""


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with three rounds of similarities, ties among them."""
    sim = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda r: ((F.col("doc_id") * 31 + r * r * 577 * (F.col("doc_id") % 3)) % 1000) / F.lit(1000.0))
    return table(spark, sf_dir, "documents").select("doc_id", sim.alias("similarity"))


ANNOTATED = "a as (select doc_id, list_transform([0, 1, 2], lambda r: ((doc_id * 31 + r * r * 577 * (doc_id % 3)) % 1000) / 1000.0::double) as s from documents)"


def q_best_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = annotate.best_index("similarity")
    return annotated(spark, sf_dir).groupBy(best.cast("bigint").alias("best")).agg(F.count("*").alias("n"), F.round(F.sum(F.array_max("similarity")), 6).alias("total"))


SQL_BEST = f"with {ANNOTATED} select (list_position(s, list_max(s)) - 1)::bigint as best, count(*)::bigint as n, round(sum(list_max(s)), 6) as total from a group by 1"


def q_best_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = annotated(spark, sf_dir).select(annotate.best_margin("similarity").alias("m"))
    return m.agg(F.count("m").alias("n"), F.round(F.min("m"), 6).alias("low"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.max("m"), 6).alias("high"))


SQL_MARGIN = f"""with {ANNOTATED}, m as (select list_reverse_sort(s)[1] - list_reverse_sort(s)[2] as m from a where list_position(s, list_max(s)) > 1)
select count(*)::bigint as n, round(min(m), 6) as low, round(avg(m), 6) as mean, round(max(m), 6) as high from m"""


def q_round_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.round_averages(annotated(spark, sf_dir)).select(F.col("round").cast("bigint").alias("round"), "n", F.round("average", 6).alias("average"))


SQL_ROUNDS = f"with {ANNOTATED}, e as (select unnest([0, 1, 2]) as r, unnest(s) as v from a) select r::bigint as round, count(*)::bigint as n, round(avg(v), 6) as average from e group by r"


def _vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = raw_pairs(spark, sf_dir).select(F.array(F.array("pair")).alias("descriptors"))
    return annotate.vocabulary(docs)


def q_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocab(spark, sf_dir)


_SQL_VOCAB = (
    LINES
    + r""", v as (select regexp_replace(regexp_replace(string_split(array_to_string(list_slice(regexp_split_to_array(trim(line), ' +'), 1, 3), ' ') || case when doc_id % 7 = 0 then ' ' else '; ' end || line, ';')[1], '^\s+', ''), '\s+$', '') as d from lines)"""
)
SQL_VOCAB = f"with {_SQL_VOCAB} select d as descriptor, count(*)::bigint as n from v group by d"


def q_vocabulary_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocab(spark, sf_dir).orderBy(F.desc("n"), "descriptor").limit(100)


SQL_TOP = f"with {_SQL_VOCAB} select d as descriptor, count(*)::bigint as n from v group by d order by n desc, d limit 100"


def q_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select(F.floor(F.col("doc_id") / 200).alias("batch"), first_words().alias("descriptor"))
    return annotate.growth(rows)


SQL_GROWTH = f"""with {LINES}, r as (select doc_id // 200 as batch, array_to_string(list_slice(regexp_split_to_array(trim(line), ' +'), 1, 3), ' ') as d from lines),
f as (select d, min(batch) as batch from r group by d), n as (select b.batch, count(f.d) as n_new from (select distinct batch from r) b left join f using (batch) group by b.batch)
select batch::bigint as batch, n_new::bigint as n_new, sum(n_new) over (order by batch)::bigint as n_total from n"""


def q_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.singleton_ratio(_vocab(spark, sf_dir))


SQL_SINGLE = f"with {_SQL_VOCAB}, c as (select d, count(*) as n from v group by d) select count(*)::bigint as n_distinct, count(*) filter (n = 1)::bigint as n_singletons, round(count(*) filter (n = 1) / count(*), 6) as ratio from c"


def q_suffix_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as descriptors with suffix words, stripped and counted again."""
    suffix = F.element_at(F.array(*map(F.lit, (" tone", " style", " content", ""))), (F.col("p_partkey") % 4 + 1).cast("int"))
    bare = evaluate.strip_suffixes(F.concat("p_name", suffix))
    return table(spark, sf_dir, "part").groupBy(bare.alias("descriptor")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "descriptor").limit(200)


SQL_SUFFIX = "select trim(p_name) as descriptor, count(*)::bigint as n from part group by 1 order by n desc, descriptor limit 200"


def q_keyword_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("text", "[ \n]+")
    return table(spark, sf_dir, "documents").where(F.exists(words, lambda w: w.contains("tion") & ~w.contains("ntion"))).groupBy("lang").agg(F.count("*").alias("n"))


SQL_KEYWORD = r"select lang, count(*)::bigint as n from documents where len(list_filter(regexp_split_to_array(text, '[ \n]+'), lambda w: contains(w, 'tion') and not contains(w, 'ntion'))) > 0 group by lang"


def q_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers around the numbers of orders: in a fence, with single quotes, with a trailing comma, with text around,
    and without JSON."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey").cast("string")
    forms = [F.concat(F.lit('```json\n{"k": '), k, F.lit("}\n```")), F.concat(F.lit("{'k': "), k, F.lit("}")), F.concat(F.lit('{"k": '), k, F.lit(", }")), F.concat(F.lit('Here: {"x": {"y": 1}, "k": '), k, F.lit("} - done")), F.concat(F.lit("none of "), k)]
    said = F.element_at(F.array(*forms), (F.col("o_orderkey") % 5 + 1).cast("int"))
    parsed = o.select("o_orderstatus", tx.parse_model_json(said, "k bigint").alias("j"))
    return parsed.groupBy("o_orderstatus").agg(F.count("j").alias("n_ok"), F.sum("j.k").alias("total"))


SQL_JSON = "select o_orderstatus, count(*) filter (o_orderkey % 5 <> 4)::bigint as n_ok, sum(o_orderkey) filter (o_orderkey % 5 <> 4)::bigint as total from orders group by 1"


def q_normalizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three normalisers side by side on decorated descriptors."""
    d = F.concat(F.lit(" _"), F.replace(first_words(), F.lit(" "), F.lit("__ ")), F.lit("\t"))
    base = lines(spark, sf_dir).select("doc_id", "pos", d.alias("d"))
    return base.select("doc_id", F.col("pos").cast("bigint").alias("pos"), tx.normalize_strict("d").alias("n1"), tx.normalize_counter("d").alias("n2"), tx.normalize_tracer("d").alias("n3"))


SQL_NORMAL = f"""with {LINES}, b as (select doc_id, pos, '_' || replace(array_to_string(list_slice(regexp_split_to_array(trim(line), ' +'), 1, 3), ' '), ' ', '__ ') as d from lines)
select doc_id, pos::bigint as pos, replace(lower(d), 'ß', 'ss') as n1, regexp_replace(lower(d), '[_\\s]+', ' ', 'g') as n2, trim(regexp_replace(lower(d), '[_\\s]+', ' ', 'g')) as n3 from b"""


def q_stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by parse variant: descriptors kept, dropped and hashed."""
    p = raw_pairs(spark, sf_dir)
    one = F.col("s.ok")
    split = p.select(tx.split_strict("pair").alias("s"), tx.split_counter("pair").alias("c"), tx.split_tracer("pair").alias("t"), tx.split_plain("pair").alias("p"), tx.training_descriptor("pair").alias("n6"))
    return split.agg(
        F.countDistinct(F.when(one, tx.stable_id("s.descriptor", "s.explainer"))).alias("n1_ids"), F.countDistinct(F.when(F.col("c").isNotNull(), tx.stable_id("c.descriptor", "c.explainer"))).alias("n2_ids"),
        F.countDistinct(F.when(F.col("t").isNotNull(), tx.stable_id("t.descriptor", "t.explainer"))).alias("n3_ids"), F.countDistinct("p.descriptor").alias("n4_descriptors"), F.count("n6").alias("n6_rows"),
    )


SQL_IDS = f"""with {PAIRS}, x as (select descriptor, explainer, regexp_replace(lower(d), '\\s+', ' ', 'g') as d2 from ids join raw using (doc_id, pos)),
p as (select case when doc_id % 7 = 0 then array_to_string(list_slice(regexp_split_to_array(trim(line), ' +'), 1, 3), ' ') || ' ' || trim(line) else array_to_string(list_slice(regexp_split_to_array(trim(line), ' +'), 1, 3), ' ') end as d from lines)
select (select count(distinct (descriptor, explainer)) from x)::bigint as n1_ids, (select count(distinct (d2, explainer)) from x)::bigint as n2_ids, (select count(distinct (d2, explainer)) from x)::bigint as n3_ids,
(select count(distinct d) from p)::bigint as n4_descriptors, (select count(*) from x)::bigint as n6_rows"""


def q_lexical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that each conversation turn shares with the one before."""
    c = table(spark, sf_dir, "conversations")
    a, b = c.alias("a"), c.alias("b")
    both = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") == F.col("b.turn") - 1))
    return both.select(F.col("b.conv_id").alias("conv_id"), F.col("b.turn").alias("turn"), tx.lexical_overlap("a.text", "b.text").alias("overlap"))


SQL_OVERLAP = r"""with w as (select conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) as w from conversations)
select b.conv_id as conv_id, b.turn as turn, len(list_intersect(a.w, b.w))::bigint as overlap from w a join w b on a.conv_id = b.conv_id and a.turn = b.turn - 1"""


def q_disambiguate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finals of the disambiguation loop with the deterministic grouper, per number of words."""
    finals, lineage = grouping.disambiguate(pairs_of(spark, sf_dir).select("descriptor", "explainer", "id"))
    merged = lineage.select("id").distinct().withColumn("made", F.lit(1))
    return finals.join(merged, "id", "left").select("id", "descriptor", F.coalesce("made", F.lit(0)).alias("made"))


QUERIES = {
    "q_extract_groups": (q_extract_groups, SQL_EXTRACT), "q_group_statistics": (q_group_statistics, SQL_STATS), "q_malformed": (q_malformed, SQL_MALFORMED), "q_chunks": (q_chunks, SQL_CHUNKS),
    "q_best_round": (q_best_round, SQL_BEST), "q_best_margin": (q_best_margin, SQL_MARGIN), "q_round_averages": (q_round_averages, SQL_ROUNDS), "q_vocabulary": (q_vocabulary, SQL_VOCAB),
    "q_vocabulary_top": (q_vocabulary_top, SQL_TOP), "q_growth": (q_growth, SQL_GROWTH), "q_singletons": (q_singletons, SQL_SINGLE), "q_suffix_vocabulary": (q_suffix_vocabulary, SQL_SUFFIX),
    "q_keyword_any": (q_keyword_any, SQL_KEYWORD), "q_json_props": (q_json_props, SQL_JSON), "q_normalizers": (q_normalizers, SQL_NORMAL), "q_stable_ids": (q_stable_ids, SQL_IDS),
    "q_lexical_overlap": (q_lexical_overlap, SQL_OVERLAP), "q_disambiguate": (q_disambiguate, None),
}
