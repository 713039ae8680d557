"""Queries over labels, conversations, events and documents for evaluation and training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.operators import evaluate, export, search
from lexloom.plans.q_text import LINES, first_words, lines, table
from lexloom.plans.shared import scratch
from lexloom.streaming import vocabulary as sv


def q_label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.concat("quality", F.lit("/"), "toxic").alias("label"))
    return evaluate.label_distribution(labels, "label", spark.createDataFrame([("0/0",), ("0/1",), ("1/0",), ("1/1",), ("invalid",)], "label string"))


SQL_LABELS = """with l as (select unnest(['0/0', '0/1', '1/0', '1/1', 'invalid']) as label), c as (select quality || '/' || toxic as label, count(*) as n from labels group by 1)
select l.label as label, coalesce(n, 0)::bigint as n, round(100.0 * coalesce(n, 0) / sum(coalesce(n, 0)) over (), 2)::double as percent from l left join c using (label)"""


def q_label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge answers made from conversation turns, parsed back to labels."""
    c = table(spark, sf_dir, "conversations")
    said = F.element_at(F.array(F.lit("Sure.\nANSWER: **Mostly accurate**."), F.lit("answer: Accurate"), F.lit("Inaccurate, I think"), F.lit("Accuratest"), F.lit("Answer:"), F.concat(F.lit("well, "), F.substring("text", 1, 9), F.lit(" ... **Answer: YES** ")), F.lit('ANSWER: "no".')), (F.length("text") % 7 + 1))
    label = tx.answer_label(said, ["accurate", "mostly accurate", "inaccurate", "yes", "no"])
    return c.groupBy(label.alias("label"), tx.verdict_yes(said).alias("yes")).agg(F.count("*").alias("n"))


SQL_PARSE = "select list_extract(['mostly accurate', 'accurate', 'inaccurate', 'invalid', 'invalid', 'yes', 'no'], length(text) % 7 + 1) as label, length(text) % 7 = 5 as yes, count(*)::bigint as n from conversations group by all"


def q_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select("doc_id", "pos", first_words().alias("text"))
    index = search.inverted_index(rows)
    return index.groupBy("text").agg(F.count("*").alias("n_docs"), F.sum("pos").alias("positions"), F.min("doc_id").alias("first_doc"))


SQL_INVERTED = f"""with {LINES}, i as (select array_to_string(list_slice(regexp_split_to_array(trim(line), ' +'), 1, 3), ' ') as text, doc_id, min(pos) as pos from lines group by all)
select text, count(*)::bigint as n_docs, sum(pos)::bigint as positions, min(doc_id) as first_doc from i group by text"""


def q_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat examples of documents within the token budget, as role and content rows."""
    docs = table(spark, sf_dir, "documents").withColumn("descriptors", F.array("lang", "source"))
    kept = export.usable(docs, "text", "descriptors", 100, 2000)
    chats = export.chat_examples(kept, "text", "descriptors", "Describe the text.", 300)
    return chats.select("doc_id", F.explode("messages").alias("m")).select("doc_id", "m.role", "m.content")


SQL_CHAT = r"""with d as (select doc_id, case when length(text) > 900 then substr(text, 1, 900) || chr(10) || '[TRUNCATED]' else text end as t, lang, source from documents where length(text) between 300 and 6000)
select doc_id, 'system' as role, 'Describe the text.' as content from d union all select doc_id, 'user', t from d union all select doc_id, 'assistant', '{"descriptors":["' || lang || '","' || source || '"]}' from d"""


def q_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(export.length_between("n_chars", 500, 5000)).groupBy("source").agg(F.count("*").alias("n"))


SQL_LENGTH = "select source, count(*)::bigint as n from documents where n_chars > 500 and n_chars <= 5000 group by source"


def q_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.token_stats(table(spark, sf_dir, "documents").select("lang", F.size(F.split("text", "[ \n]+")).cast("bigint").alias("t")), "t", "lang")


SQL_TOKENS = r"select lang, count(*)::bigint as n, round(avg(t), 4) as average, max(t)::bigint as longest, min(t)::bigint as shortest from (select lang, len(regexp_split_to_array(text, '[ \n]+')) as t from documents) group by lang"


def q_split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.near_equal_parts(table(spark, sf_dir, "labels"), 7, ["doc_id"]).groupBy(F.col("part").cast("bigint").alias("part")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


SQL_PARTS = "select part::bigint as part, count(*)::bigint as n, min(doc_id) as first_id from (select doc_id, ntile(7) over (order by doc_id) as part from labels) group by part"


def q_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of each role in rounds of three turns."""
    c = table(spark, sf_dir, "conversations").select("role", (F.col("conv_id") * 1000 + F.col("turn")).alias("at"))
    return export.interleave(c, "role", "at", 3).groupBy("round", "role").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))


SQL_INTERLEAVE = """with c as (select role, conv_id * 1000 + turn as t from conversations), r as (select role, t, (row_number() over (partition by role order by t) - 1) // 3 as round from c)
select round::bigint as round, role, count(*)::bigint as n, min(t) as first_at from r group by round, role"""


def q_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeatable sample of half of the documents, then 100 of them."""
    return export.sample_exactly(table(spark, sf_dir, "documents"), "doc_id", 100, 0.5, 7).select("doc_id")


_U = "('0x' || substr(md5('{seed}:' || doc_id), 1, 8))::bigint / 4294967296.0::double"
SQL_SAMPLE = f"select doc_id from documents where {_U.format(seed=7)} < 0.5 order by {_U.format(seed=8)}, doc_id limit 100"


def q_train_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.split_rows(table(spark, sf_dir, "documents"), "doc_id", 0.1, 0.05).groupBy("split").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


SQL_TRAIN = f"select case when u < 0.1 then 'test' when u < 0.15 then 'validation' else 'train' end as split, count(*)::bigint as n, min(doc_id) as first_id from (select doc_id, {_U.format(seed=0)} as u from documents) group by 1"


def q_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types per user as columns; errors count as rows without a type."""
    kinds = F.when(F.col("event_type") != "error", F.array("event_type")).otherwise(F.array().cast("array<string>"))
    return evaluate.dummies(table(spark, sf_dir, "events").select("user_id", kinds.alias("kinds")), "user_id", "kinds", ["click", "view", "purchase", "signup"])


SQL_DUMMIES = "select user_id, " + ", ".join(f"count(*) filter (event_type = '{k}')::bigint as {k}" for k in ("click", "view", "purchase", "signup")) + ", count(*) filter (event_type = 'error')::bigint as empty from events group by user_id"


def q_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much shorter the first lines' descriptors are than their documents."""
    d = table(spark, sf_dir, "documents").where("n_chars > 0")
    rate = F.round((1 - F.length(first_words("text")) / F.length("text")) * 100, 2)
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.sum(rate), 1).alias("total"))


SQL_COMPRESSION = "select lang, count(*)::bigint as n, round(sum(round((1 - length(array_to_string(list_slice(regexp_split_to_array(trim(text, ' '), ' +'), 1, 3), ' ')) / length(text)) * 100, 2)), 1) as total from documents where n_chars > 0 group by lang"


def q_merge_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_type", F.lit("|M|"), "p_type")).when(F.col("p_partkey") % 3 == 1, F.concat("p_type", F.lit("|M|"), "p_name", F.lit("|M|"), "p_type")).otherwise(F.col("p_type"))
    return evaluate.merge_markers(table(spark, sf_dir, "part").select((F.col("p_size") % 4).cast("bigint").alias("iteration"), v.alias("v")), "v", "iteration")


SQL_MARKERS = """select (p_size % 4)::bigint as iteration, count(*) filter (p_partkey % 3 = 2)::bigint as unmerged, count(*) filter (p_partkey % 3 = 0)::bigint as same, count(*) filter (p_partkey % 3 = 1)::bigint as differing,
max(case p_partkey % 3 when 0 then 2 when 1 then 3 else 1 end)::bigint as largest, round(avg(case p_partkey % 3 when 0 then 2 when 1 then 3 else 1 end), 6) as mean from part group by 1"""


def q_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource logs made from orders, read back."""
    o = table(spark, sf_dir, "orders")
    line = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("TOTAL: "), F.col("o_orderkey").cast("string"), F.lit(".25 Wh"))).otherwise(F.concat(F.lit("GPU 1: 3.5 Wh, 2 W avg ("), F.col("o_custkey").cast("string"), F.lit(".5 s)")))
    return evaluate.energy(o.select(line.alias("value")))


SQL_ENERGY = "select round(sum(o_orderkey + 0.25::double) filter (o_orderkey % 2 = 0), 4) as total_wh, round(sum(o_custkey + 0.5::double) filter (o_orderkey % 2 = 1) / 3600, 6) as gpu_hours from orders"


def q_replicated_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth curves of line items per order as runs, cut to the shortest of each customer segment of orders."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("grp"), F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("batch"), "l_quantity")
    return evaluate.replicated_curves(li, "grp", "run", "batch", "l_quantity").select("grp", F.col("batch").cast("bigint").alias("batch"), "n", "mean", "std")


SQL_CURVES = """with r as (select l_suppkey % 5 as grp, l_orderkey as run, l_linenumber as batch, l_quantity as q from lineitem), l as (select grp, min(last) as last from (select grp, run, max(batch) as last from r group by all) group by grp)
select r.grp as grp, batch::bigint as batch, count(*)::bigint as n, round(avg(q), 6) as mean, round(stddev_pop(q), 6) as std from r join l using (grp) where batch <= last group by r.grp, batch"""


def q_windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sv.windowed_counts(table(spark, sf_dir, "events"), width="1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "kind", "n")


SQL_WINDOWED = "select strftime(ts, '%Y-%m-%d') as day, event_type as kind, count(*)::bigint as n from events group by all"


def q_stream_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of the documents as a stream of micro-batches; equal to the batch result."""
    docs = spark.readStream.schema("doc_id bigint, text string, lang string, source string, n_chars bigint").option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/documents.parquet*")
    rows = docs.select(F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "").select(first_words().alias("descriptor"))
    path = scratch(spark, "vocabulary")
    sv.start_vocabulary(rows, f"{path}/table", f"{path}/state").awaitTermination()
    return sv.vocabulary_so_far(spark, f"{path}/table")


SQL_STREAM = f"with {LINES} select array_to_string(list_slice(regexp_split_to_array(trim(line), ' +'), 1, 3), ' ') as descriptor, count(*)::bigint as n from lines group by 1"


QUERIES = {
    "q_label_distribution": (q_label_distribution, SQL_LABELS), "q_label_parse": (q_label_parse, SQL_PARSE), "q_inverted_index": (q_inverted_index, SQL_INVERTED), "q_chat_examples": (q_chat_examples, SQL_CHAT),
    "q_length_filter": (q_length_filter, SQL_LENGTH), "q_token_stats": (q_token_stats, SQL_TOKENS), "q_split_parts": (q_split_parts, SQL_PARTS), "q_interleave": (q_interleave, SQL_INTERLEAVE),
    "q_sample": (q_sample, SQL_SAMPLE), "q_train_split": (q_train_split, SQL_TRAIN), "q_dummies": (q_dummies, SQL_DUMMIES), "q_compression": (q_compression, SQL_COMPRESSION), "q_merge_markers": (q_merge_markers, SQL_MARKERS),
    "q_energy": (q_energy, SQL_ENERGY), "q_replicated_curves": (q_replicated_curves, SQL_CURVES), "q_windowed_events": (q_windowed_events, SQL_WINDOWED), "q_stream_vocabulary": (q_stream_vocabulary, SQL_STREAM),
}
