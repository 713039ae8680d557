"""Queries over the seam to models and what stands around it: answers, decisions, prompts, search results, splits, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions import text as tx
from lexloom.functions.vector import l2_normalize
from lexloom.operators import audit, evaluate, export, grouping, harmonize, lineage, models, prompts, search
from lexloom.operators import neighbors as nn
from lexloom.plans.q_text import LINES, PAIRS, first_words, lines, pairs_of, table
from lexloom.plans.shared import scratch


def q_repaired_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's answers with bare keys and values, single quotes, trailing commas and text around them, mended; then
    completed to all their fields."""
    o = table(spark, sf_dir, "orders")
    k, s = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    forms = [
        F.concat(F.lit('{"k": '), k, F.lit(', "s": "'), s, F.lit('"}')), F.concat(F.lit("Sure: {k: "), k, F.lit(", 's': '"), s, F.lit("',} is it")),
        F.concat(F.lit("\n{'k': "), k, F.lit(', "s": word '), s, F.lit("}\n")), F.concat(F.lit('{"descriptors": [1, "'), s, F.lit('",], general: plain '), s, F.lit("}")), F.lit("no answer at all"),
    ]
    said = F.element_at(F.array(*forms), (F.col("o_orderkey") % 5 + 1).cast("int"))
    fixed = o.select("o_orderkey", tx.repaired_json(said).alias("j"))
    whole = fixed.select("o_orderkey", "j", tx.completed(F.col("j")).alias("c"))
    return whole.select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("j").isNotNull().alias("ok"), F.get_json_object("j", "$.k").cast("bigint").alias("k"), F.get_json_object("j", "$.s").alias("s"),
        F.array_join("c.descriptors", "|").alias("descriptors"), F.size("c.specifics").cast("bigint").alias("n_specifics"), F.col("c.general").alias("general"),
    )


SQL_REPAIRED = """select o_orderkey::bigint as o_orderkey, o_orderkey % 5 <> 4 as ok, case when o_orderkey % 5 < 3 then o_orderkey end::bigint as k,
case o_orderkey % 5 when 0 then o_orderstatus when 1 then o_orderstatus when 2 then 'word ' || o_orderstatus end as s, case when o_orderkey % 5 = 3 then '1|' || o_orderstatus else '' end as descriptors,
0::bigint as n_specifics, case when o_orderkey % 5 = 3 then 'plain ' || o_orderstatus else '' end as general from orders"""


def q_clean_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small functions on answers: thinking removed, ids and indices cleaned, queries split, labels without explanations."""
    c = table(spark, sf_dir, "customer")
    k, name = F.col("c_custkey").cast("string"), F.col("c_name")
    thinking = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("so I think... AssistantFinal \n "), name)).otherwise(name)
    tagged = F.concat(F.lit("<think>a\nb</think>```json\n{"), k, F.lit("}```"))
    chosen = F.concat(F.lit(" \"id= '"), k, F.lit("'` "))
    index = F.concat(F.lit("Answer: "), (F.col("c_custkey") % 7).cast("string"))
    return c.select(
        F.col("c_custkey").cast("bigint").alias("c_custkey"), tx.remove_thinking(thinking).alias("plain"), tx.remove_think_tags(tagged).alias("untagged"), tx.clean_chosen_id(chosen).alias("chosen"),
        tx.keep_index(index, F.lit(5)).cast("bigint").alias("index"), F.array_join(tx.split_queries(F.concat(F.lit(" a ,, "), name, F.lit(" ,"))), "|").alias("queries"),
        F.array_join(tx.remove_explanations(F.array(F.concat(name, F.lit(" ; why")), F.lit("bare "))), "|").alias("bare"), tx.strip(F.concat(F.lit(" \t"), name, F.lit(" \n"))).alias("stripped"),
        tx.truncate_tokens(F.concat(F.lit("one two  three "), name), 3).alias("three"), tx.vocab_descriptor(F.concat(name, F.lit(";x"))).alias("vocab"),
    )


SQL_CLEAN = """select c_custkey::bigint as c_custkey, c_name as plain, '{' || c_custkey || '}' as untagged, c_custkey::varchar as chosen, case when c_custkey % 7 < 5 then c_custkey % 7 end::bigint as index,
'a|' || c_name as queries, c_name || '|bare' as bare, c_name as stripped, 'one two  three' as three, c_name as vocab from customer"""


def q_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every template, filled from the nations."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    fields = dict.fromkeys(("general", "descriptors", "rewrite", "answer", "descriptor", "a", "label", "query", "vocabulary"), F.col("n_name")) | dict.fromkeys(("document", "b"), F.col("r_name"))
    fields["roster"] = prompts.roster(F.array("n_name", "r_name"))
    made = F.array(*[F.struct(F.lit(t).alias("template"), prompts.render(t, **fields).alias("prompt")) for t in prompts.TEMPLATES])
    return n.select("n_name", F.explode(made).alias("p")).select("n_name", "p.*")


def _sql_prompt(template: str) -> str:
    quoted = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for f in ("document", "b"):
        quoted = quoted.replace("{" + f + "}", "' || r_name || '")
    quoted = quoted.replace("{roster}", "' || '[0] ' || n_name || chr(10) || '[1] ' || r_name || '")
    for f in ("general", "descriptors", "rewrite", "answer", "descriptor", "a", "label", "query", "vocabulary"):
        quoted = quoted.replace("{" + f + "}", "' || n_name || '")
    return quoted


SQL_PROMPTS = " union all ".join(f"select n_name, '{name}' as template, {_sql_prompt(t)} as prompt from nation join region on n_regionkey = r_regionkey" for name, t in prompts.TEMPLATES.items())


def q_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three judge tasks over customers: the stand-in model repeats a prompt's last line, which says what to parse."""
    c = table(spark, sf_dir, "customer")
    said = F.element_at(F.array(*map(F.lit, ("ANSWER: yes", "Answer: **No**.", "answer: Mostly inaccurate", "Answer: Accurate", "none"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    rounds = F.array(F.array("c_name", "c_mktsegment"), F.array("c_mktsegment"))
    rows = c.select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("document"), F.col("c_mktsegment").alias("descriptor"), rounds.alias("descriptors"), F.array(F.col("c_custkey") % 3 / 10, F.lit(0.1)).alias("similarity"), said.alias("said"))
    wanted = rows.where("doc_id % 4 = 0").select("doc_id")
    found = None
    for task in models.JUDGE_LABELS:
        base = rows.drop("descriptor") if task == "DescriptorAccuracy" else rows
        made = models.judge_examples(base, task, "find it", wanted).withColumn("prompt", F.concat("prompt", F.lit("\n"), "said"))
        judged = models.judge(made.select("doc_id", "prompt"), task, "prompt").groupBy("label").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids")).withColumn("task", F.lit(task))
        found = judged if found is None else found.unionByName(judged)
    return found


SQL_JUDGED = """with c as (select c_custkey as i, c_custkey % 5 as s from customer),
t as (select 'QueryDescriptorMatch' as task, i, s from c union all select 'QueryDocMatch', i, s from c where i % 4 = 0
union all select 'DescriptorAccuracy', i, s from c union all select 'DescriptorAccuracy', i, s from c where i % 3 <> 0),
l as (select task, i, case when task <> 'DescriptorAccuracy' then case s when 0 then 'yes' when 1 then 'no' else 'invalid' end else case s when 2 then 'mostly inaccurate' when 3 then 'accurate' else 'invalid' end end as label from t)
select task, label, count(*)::bigint as n, sum(i)::bigint as ids from l group by all"""


def q_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reranker's choice among the line items of an order, from log-probabilities of which some are missing."""
    li = table(spark, sf_dir, "lineitem")
    yes = F.when(F.col("l_linenumber") % 4 != 3, -(F.col("l_partkey") % 100) / 10.0)
    no = F.when(F.col("l_linenumber") % 3 != 2, -(F.col("l_suppkey") % 50) / 10.0)
    found = models.rerank(li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("neighbor"), yes.alias("yes"), no.alias("no")), 0.6)
    return found.select(F.col("id").cast("bigint").alias("id"), F.col("chosen").cast("bigint").alias("chosen"), F.round("score", 9).alias("score"))


SQL_RERANKED = """with p as (select l_orderkey as id, l_linenumber as neighbor, exp(coalesce(case when l_linenumber % 4 <> 3 then -(l_partkey % 100) / 10.0::double end, -10)) as y, exp(coalesce(case when l_linenumber % 3 <> 2 then -(l_suppkey % 50) / 10.0::double end, -10)) as n from lineitem),
s as (select id, neighbor, round(y / (y + n), 12) as score from p), f as (select *, row_number() over (partition by id order by score desc, neighbor) as r from s)
select id::bigint as id, case when score > 0.6 then neighbor end::bigint as chosen, round(score, 9) as score from f where r = 1"""


def q_good_and_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts called bad in one of three passes, and what is left as good."""
    passes = iter((2, 3, 5))

    def say(items: DataFrame) -> DataFrame:
        return items.withColumn("good", F.col("p_partkey") % next(passes) != 0)

    good, bad = models.classify_in_passes(table(spark, sf_dir, "part").select("p_partkey", "p_type"), say)
    both = good.withColumn("kind", F.lit("good")).unionByName(bad.withColumn("kind", F.lit("bad")))
    return both.groupBy("kind", "p_type").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("total"))


SQL_GOOD = "select case when p_partkey % 2 = 0 or p_partkey % 3 = 0 or p_partkey % 5 = 0 then 'bad' else 'good' end as kind, p_type, count(*)::bigint as n, sum(p_partkey)::bigint as total from part group by all"


def q_synonym_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of nations decided from a cache, in either order of the pair, or else by a model whose answers are not all clean."""
    n = table(spark, sf_dir, "nation")
    side = lambda x: F.struct(F.col(f"{x}.n_nationkey").cast("string").alias("id"), F.col(f"{x}.n_name").alias("descriptor"), F.lit("").alias("explainer"))
    pairs = n.alias("x").join(n.alias("y"), F.col("x.n_regionkey") == F.col("y.n_regionkey")).where("x.n_nationkey < y.n_nationkey").select(side("x").alias("a"), side("y").alias("b"))
    key = (F.col("a.id").cast("int") + F.col("b.id").cast("int")).alias("k")
    cached = pairs.where(key % 3 == 0).select(tx.decision_key(F.col("b"), F.col("a")).alias("key"), (key % 2 == 0).alias("is_synonym"), F.col("a.id").alias("keep_id"), F.lit("older").alias("reason"))

    def decide(rows: DataFrame) -> DataFrame:
        return rows.withColumn("is_synonym", key % 5 == 0).withColumn("keep_id", F.col("b.id")).withColumn("clean", key % 7 != 0)

    decided, new = models.decide_synonyms(pairs, cached, decide)
    added = new.withColumn("added", F.lit(True)).select("key", "added")
    return decided.join(added, "key", "left").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "is_synonym", "keep_id", "reason", F.coalesce("added", F.lit(False)).alias("added"))


SQL_SYNONYM_CACHE = """with p as (select x.n_nationkey as a, y.n_nationkey as b, x.n_nationkey + y.n_nationkey as k from nation x join nation y on x.n_regionkey = y.n_regionkey and x.n_nationkey < y.n_nationkey)
select a::varchar as a, b::varchar as b, case when k % 3 = 0 then k % 2 = 0 else k % 5 = 0 end as is_synonym, case when k % 3 = 0 then a else b end::varchar as keep_id,
case when k % 3 = 0 then 'older' when k % 7 <> 0 then 'LLM_decision' else 'parse_failed' end as reason, k % 3 <> 0 and k % 7 <> 0 as added from p"""


def q_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered indices among an order's line items: out of range means the first, no answer means none; decisions of a third
    of the orders come from a cache, where the others' are added."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"))
    found = li.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("neighbor"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")).alias("rank"), F.lit(0.5).alias("score"))
    texts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("t"), "o_orderkey").alias("text"))
    listed = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("neighbor").cast("string").alias("n")))).alias("c"))
    keys = listed.join(texts, "id").select("id", tx.choice_key(F.col("text"), F.col("c.n")).alias("key"))
    cache = keys.where("id % 3 = 0").select("key", F.when(F.col("id") % 2 == 0, F.col("id")).alias("chosen"))

    def decide(rows: DataFrame) -> DataFrame:
        answers = rows.select("id").distinct().select("id", F.when(F.col("id") % 4 != 0, (F.col("id") % 4).cast("int")).alias("answer"))
        return harmonize.choose_by_index(rows, answers)

    decisions, new = harmonize.decide_cached(found, texts, cache, decide)
    added = keys.join(new.select("key"), "key").select("id", F.lit(True).alias("added"))
    out = decisions.join(added, "id", "left")
    return out.select(F.col("id").cast("bigint").alias("id"), F.col("chosen").cast("bigint").alias("chosen"), F.coalesce("added", F.lit(False)).alias("added"))


SQL_CHOICES = """with d as (select l_orderkey, l_linenumber, max(l_partkey) as p from lineitem group by all), k as (select *, row_number() over (partition by l_orderkey order by l_linenumber) as r from d),
l as (select l_orderkey as id, max(p) filter (r = l_orderkey % 4) as named, max(p) filter (r = 1) as first from k group by 1)
select id::bigint as id, case when id % 3 = 0 then (case when id % 2 = 0 then id end) when id % 4 = 0 then null else coalesce(named, first) end::bigint as chosen, id % 3 <> 0 as added from l"""


def q_mock_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("neighbor"), F.col("l_linenumber").alias("rank"))
    return models.mock_choice(li).select(F.col("id").cast("bigint").alias("id"), F.col("chosen").cast("bigint").alias("chosen"))


SQL_MOCK = """with n as (select l_orderkey as id, max(l_linenumber) as n from lineitem group by 1),
d as (select id, case when ('0x' || substr(md5('0:' || id), 1, 8))::bigint / 4294967296.0::double < 0.75 then floor(('0x' || substr(md5('1:' || id), 1, 8))::bigint / 4294967296.0::double * n) + 1 end as r from n)
select d.id::bigint as id, l_partkey::bigint as chosen from d left join lineitem on l_orderkey = d.id and l_linenumber = r"""


def q_vocabulary_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of documents described one after the other, each prompt naming the most frequent labels so far."""
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 3).alias("batch"), F.concat("c_mktsegment", F.lit(" for "), "c_name").alias("text"))
    made = models.describe_with_feedback(docs, "batch", "text", 3)
    return made.groupBy("batch", "descriptor").agg(F.count("*").alias("n"))


SQL_FEEDBACK = "select (c_custkey % 3)::bigint as batch, lower(array_to_string(list_slice(string_split(c_mktsegment || ' for ' || c_name, ' '), 1, 3), ' ')) as descriptor, count(*)::bigint as n from customer group by all"


def q_generated_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of description and rewriting by the stand-in model: its first labels, and that similarities are there."""
    p = table(spark, sf_dir, "part")
    # rows of a small file are few tasks to Spark, but much work to a model
    dealt = p.repartition(-(-max(1, p.count()) // models.ROWS_A_TASK), "p_partkey")
    made = models.annotate_documents(dealt.select("p_partkey", F.concat("p_type", F.lit("\n"), "p_name", F.lit(" of a kind ")).alias("text")), "text", 2)
    return made.select("p_partkey", F.size("descriptors").cast("bigint").alias("rounds"), F.get(F.get("descriptors", F.lit(0)), F.lit(0)).alias("first"), F.get("rewrite", F.lit(1)).alias("rewrite"), F.size("similarity").cast("bigint").alias("n_scores"))


SQL_ROUNDS_MADE = "select p_partkey, 2::bigint as rounds, lower(array_to_string(list_slice(regexp_split_to_array(trim(p_name || ' of a kind'), ' +'), 1, 3), ' ')) || '; ' || p_name || ' of a kind' as first, p_name || ' of a kind' as rewrite, 2::bigint as n_scores from part"


def q_search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of a vector search: the texts found, by rank, with the documents that have them."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.concat(F.lit("label "), (F.col("vec_id") % 40).cast("string")).alias("text"))
    index = search.VectorIndex(v, "vec_id", "embedding")
    hits = index.search(v.where("vec_id % 50 = 0"), "vec_id", "embedding", 3)
    documents = search.inverted_index(v.select((F.col("vec_id") % 300).alias("doc_id"), F.col("vec_id").alias("pos"), "text"))
    rows = search.search_results(hits, v.select(F.col("vec_id").alias("id"), "text"), documents)
    listed = search.nested_index(documents).select("text", F.size("documents").cast("bigint").alias("n_listed"))
    found = rows.groupBy("query", "rank", "text").agg(F.round(F.min("distance"), 6).alias("distance"), F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).join(listed, "text")
    return found.withColumn("rank", F.col("rank").cast("bigint"))


SQL_RESULTS = """with v as (select vec_id, cast(embedding as double[]) as e, 'label ' || (vec_id % 40) as text from embeddings),
s as (select a.vec_id as query, b.text, round(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) as d, b.vec_id as n from v a join v b on a.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query order by d, n) as rank from s), i as (select text, count(distinct vec_id % 300) as n_docs, min(vec_id % 300) as first_doc from v group by text)
select query, rank::bigint as rank, text, round(d, 6) as distance, n_docs::bigint as n_docs, first_doc, n_docs::bigint as n_listed from r join i using (text) where rank <= 3"""


def q_ivf_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell-partitioned index saved, loaded and asked in all its cells: then it is exact."""
    v = table(spark, sf_dir, "embeddings")
    path = scratch(spark, "index")
    search.VectorIndex(v, "vec_id", "embedding", "IndexIVFFlat", 12).save(path)
    found = search.VectorIndex.load(spark, path).search(v.where("vec_id % 50 = 0"), "vec_id", "embedding", 5, 12)
    return found.select("id", "neighbor", F.round("score", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


SQL_ALL_CELLS = """with v as (select vec_id, cast(embedding as double[]) as e from embeddings),
s as (select a.vec_id as id, b.vec_id as neighbor, round(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) as d from v a join v b on a.vec_id % 50 = 0)
select id, neighbor, round(d, 6) as distance, rank::bigint as rank from (select *, row_number() over (partition by id order by d, neighbor) as rank from s) where rank <= 5"""


def q_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", l2_normalize("embedding").alias("v"))
    return v.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


SQL_NORMALIZED = """with v as (select vec_id, cast(embedding as double[]) as e from embeddings), n as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as l from v)
select vec_id, round(e[1] / l, 6) as first, round(list_sum(list_transform(e, lambda x: (x / l) * (x / l))), 6) as norm from n"""


def q_exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.split_exactly(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 40, 60, 80, 3).select("doc_id", "split")


_U = "('0x' || substr(md5('{seed}:' || {key}), 1, 8))::bigint / 4294967296.0::double"
SQL_EXACT = f"""with r as (select doc_id, row_number() over (order by {_U.format(seed=3, key='doc_id')}, doc_id) as n from documents)
select doc_id, case when n <= 40 then 'test' when n <= 100 then 'validation' else 'train' end as split from r where n <= 180"""


def q_shuffled_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven parts of near-equal sizes in a seeded order, and in blocks of a fixed number of lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    parts = export.shuffled_parts(docs, "doc_id", 7, 11)
    return parts.groupBy(F.col("part").cast("bigint").alias("part")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


SQL_SHUFFLED = f"select part::bigint as part, count(*)::bigint as n, sum(doc_id)::bigint as ids from (select doc_id, ntile(7) over (order by {_U.format(seed=11, key='doc_id')}, doc_id) as part from documents) group by part"


def q_length_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows within a length, where the bound may be off, by the side of a threshold they are on."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 10 / 10).alias("score"))
    found = None
    for most in (1000, 0, None):
        kept = export.threshold_parts(export.at_most(d, "n_chars", most), "score", 0.7)
        n = kept.groupBy("side").agg(F.lit(str(most)).alias("bound"), F.count("*").alias("n"))
        found = n if found is None else found.unionByName(n)
    return found


SQL_FILTERS = """select b as bound, case when doc_id % 5 = 0 then 'none' when doc_id % 10 <= 7 then 'low' else 'high' end as side, count(*)::bigint as n
from documents, (select unnest(['1000', '0', 'None']) as b) where b <> '1000' or n_chars <= 1000 group by all"""


def q_packed_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of each cohort in batches of at most four and at most 3,000 characters, shortest first."""
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 200).alias("cohort"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 37 % 1500).alias("chars"))
    return grouping.packed_prompts(o, "cohort", "chars", 4, 3000).groupBy("key").agg((F.max("batch") + 1).alias("n_batches"), F.count("*").alias("n"), F.sum(F.col("batch") * F.col("id")).alias("digest"))


SQL_PACKED = """with recursive o as (select o_orderkey % 200 as key, o_orderkey as id, o_orderkey * 37 % 1500 as chars, row_number() over (partition by o_orderkey % 200 order by o_orderkey * 37 % 1500, o_orderkey) as r from orders),
w(key, r, id, batch, n, size) as (select key, r, id, 0, 1, chars from o where r = 1
union all select o.key, o.r, o.id, case when w.n + 1 > 4 or w.size + o.chars > 3000 then w.batch + 1 else w.batch end, case when w.n + 1 > 4 or w.size + o.chars > 3000 then 1 else w.n + 1 end,
case when w.n + 1 > 4 or w.size + o.chars > 3000 then o.chars else w.size + o.chars end from w join o on o.key = w.key and o.r = w.r + 1)
select key::bigint as key, (max(batch) + 1)::bigint as n_batches, count(*)::bigint as n, sum(batch * id)::bigint as digest from w group by key"""


def q_mapped_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered indices as ids: of an order's line items two groups, with an index out of range and a repeated one; of every
    fifth order no group at all."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("id")))).alias("l"))
    group = lambda *i: F.array(*[F.lit(x) for x in i])
    answer = F.array(F.struct(group(1, 0, 99, 1).alias("indices"), F.lit("x").alias("text")), F.struct(group(-1, 50).alias("indices"), F.lit("y").alias("text")), F.struct(group(2).alias("indices"), F.lit("z").alias("text")))
    chunks = li.select("chunk", F.col("l.id").alias("ids"), F.col("l.id").alias("explainers"), F.when(F.col("chunk") % 5 != 0, answer).alias("groups"))
    made = grouping.mapped_indices(chunks)
    return made.groupBy(F.col("chunk").cast("bigint").alias("chunk"), "grp").agg(F.count("*").alias("n"), F.min("text").alias("text"), F.min(F.col("id").cast("bigint")).alias("first"))


SQL_MAPPED = """with l as (select l_orderkey as chunk, l_partkey as id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey::varchar) - 1 as i from lineitem),
f as (select chunk, id::varchar as head from l where i = 0), g as (select chunk, case when chunk % 5 = 0 then 0 when i < 2 then 0 when i = 2 then 1 end as grp, case when chunk % 5 = 0 then head when i < 2 then 'x' else 'z' end as text, id from l join f using (chunk))
select chunk::bigint as chunk, grp::bigint as grp, count(*)::bigint as n, min(text) as text, min(id)::bigint as first from g where grp is not null group by chunk, grp"""


def q_merge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of merging the parts of each type, validated, with ids that repeat."""
    p = table(spark, sf_dir, "part").groupBy("p_type").agg(F.collect_list(F.col("p_partkey").cast("string")).alias("sources"), F.min("p_name").alias("explainer"))
    made = grouping.merge_events(p.withColumnRenamed("p_type", "descriptor"))
    return made.select("new_descriptor", "new_explainer", "new_pair_id", F.size("source_pair_ids").cast("bigint").alias("n_sources"))


SQL_EVENTS = """select p_type as new_descriptor, min(p_name) as new_explainer, substr(sha256(string_agg(p_partkey::varchar, ',' order by p_partkey::varchar) || '␟' || p_type || '␟' || min(p_name)), 1, 32) as new_pair_id,
count(*)::bigint as n_sources from part group by p_type"""


def q_largest_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.largest_groups(pairs_of(spark, sf_dir))


SQL_LARGEST = f"with {PAIRS} select descriptor, count(distinct explainer)::bigint as n from ids group by descriptor order by n desc, descriptor limit 5"


def q_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of original pairs by the kind of their rows: rounds of pairs, or pairs."""
    p = table(spark, sf_dir, "part")
    rounds = p.select(F.array(F.array(F.concat(F.lit("_"), "p_type", F.lit("__; "), "p_name")), F.array(F.lit("no pair"))).alias("descriptors"), F.array(F.lit(0.5), F.col("p_partkey") % 2 * 0.9).alias("similarity"))
    plain = p.select(F.concat(F.lit(" "), F.replace("p_type", F.lit(" "), F.lit("_"))).alias("descriptor"), F.col("p_name").alias("explainer"))
    both = [grouping.pair_counts(x).withColumn("kind", F.lit(k)) for k, x in (("rounds", rounds), ("pairs", plain))]
    return both[0].unionByName(both[1]).groupBy("kind", "descriptor").agg(F.sum("n").alias("n"), F.count("*").alias("n_pairs"))


SQL_PAIR_COUNTS = """select kind, lower(p_type) as descriptor, count(*)::bigint as n, count(distinct p_name)::bigint as n_pairs from part, (select unnest(['rounds', 'pairs']) as kind) where kind = 'pairs' or p_partkey % 2 = 0 group by all"""


def q_contribution_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often pairs of market segment and nation reach the regions' final pairs, through two merges."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    originals = c.groupBy(F.concat("c_mktsegment", F.lit("/"), "n_name").alias("id"), F.col("c_mktsegment").alias("descriptor"), F.col("n_name").alias("explainer"), F.col("n_regionkey").alias("r")).agg(F.count("*").alias("n"))
    edges = originals.select(F.col("explainer").alias("dst"), F.col("id").alias("src")).union(originals.select(F.concat(F.lit("r"), "r").alias("dst"), F.col("explainer").alias("src"))).distinct()
    finals = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("descriptor"), F.lit("all").alias("explainer"))
    links = lineage.finals_of(originals, edges, finals)
    return lineage.contribution_breakdown(links, originals, finals)


SQL_BREAKDOWN = """select c_mktsegment as original_descriptor, n_name as original_explainer, r_name as final_descriptor, 'all' as final_explainer, count(*)::bigint as count
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all"""


def q_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and tokens of a pass over the documents, as metrics of the pass itself."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "[ \n]+")).cast("bigint").alias("tokens"))
    rows, metrics = evaluate.observed(docs, "documents", "tokens")
    rows.write.format("noop").mode("overwrite").save()
    rates = evaluate.throughput(metrics, 2.0)
    return spark.createDataFrame([(metrics.get["n"], metrics.get["tokens"], rates["n_per_second"] * 2)], "n bigint, tokens bigint, again double")


SQL_OBSERVED = r"select count(*)::bigint as n, sum(len(regexp_split_to_array(text, '[ \n]+')))::bigint as tokens, count(*)::double as again from documents"


def q_same_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset comparisons of line items with themselves in another order, without one row, and with one row twice."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    first = li.where("l_orderkey = 1 and l_linenumber = 1").limit(1)
    cases = {"same": li.repartition("l_partkey"), "less": li.where("not (l_orderkey = 1 and l_linenumber = 1)"), "twice": li.union(first)}
    there = not first.isEmpty()
    return spark.createDataFrame([(k, audit.same_multiset(li, v) if k == "same" or there else None) for k, v in cases.items()], "name string, same boolean")


SQL_SAME = "select n as name, case when n = 'same' then true when exists (select 1 from lineitem where l_orderkey = 1 and l_linenumber = 1) then false end as same from (select unnest(['same', 'less', 'twice']) as n)"


def q_sample_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sample will come to after a quarter of the sources was read, and whether that is enough."""
    docs = table(spark, sf_dir, "documents")
    sources = docs.select("source").distinct().count()
    few = docs.select("source").distinct().orderBy("source").limit(max(1, sources // 4))
    n = docs.join(few, "source", "left_semi").count()
    size, state = export.sample_forecast(sources, max(1, sources // 4), n, 200)
    return spark.createDataFrame([(size, state)], "size bigint, state string")


SQL_FORECAST = """with s as (select source, count(*) as n from documents group by 1), k as (select count(*) as f, greatest(1, count(*) // 4) as q from s),
t as (select f, q, (select sum(n) from (select n from s order by source limit (select q from k))) as n from k), z as (select trunc(f * (n / q))::bigint as size from t)
select size, case when size < 200 then 'too few' when size > 1000 then 'far too many' else 'ok' end as state from z"""


def q_batches_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the lines after 70 were done, in shards of 40 lines."""
    rows = export.ranked(lines(spark, sf_dir).select("doc_id", "pos", first_words().alias("descriptor")), ["doc_id", "pos"], "at").where("at >= 70")
    return rows.groupBy(F.floor((F.col("at") - 70) / 40).alias("shard")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("at").alias("last"))


SQL_LEFT = f"""with {LINES}, r as (select doc_id, row_number() over (order by doc_id, pos) - 1 as k from lines)
select ((k - 70) // 40)::bigint as shard, count(*)::bigint as n, min(doc_id) as first_doc, max(k)::bigint as last from r where k >= 70 group by 1"""

_ALL = (
    (q_repaired_answers, SQL_REPAIRED), (q_clean_answers, SQL_CLEAN), (q_prompts, SQL_PROMPTS), (q_judged, SQL_JUDGED), (q_reranked, SQL_RERANKED), (q_good_and_bad, SQL_GOOD), (q_synonym_cache, SQL_SYNONYM_CACHE),
    (q_choices, SQL_CHOICES), (q_mock_choices, SQL_MOCK), (q_vocabulary_feedback, SQL_FEEDBACK), (q_generated_rounds, SQL_ROUNDS_MADE), (q_search_results, SQL_RESULTS), (q_ivf_all_cells, SQL_ALL_CELLS),
    (q_normalized, SQL_NORMALIZED), (q_exact_split, SQL_EXACT), (q_shuffled_parts, SQL_SHUFFLED), (q_length_filters, SQL_FILTERS), (q_packed_prompts, SQL_PACKED), (q_mapped_indices, SQL_MAPPED),
    (q_merge_events, SQL_EVENTS), (q_largest_groups, SQL_LARGEST), (q_pair_counts, SQL_PAIR_COUNTS), (q_contribution_breakdown, SQL_BREAKDOWN), (q_observed, SQL_OBSERVED), (q_same_rows, SQL_SAME),
    (q_sample_forecast, SQL_FORECAST), (q_batches_left, SQL_LEFT),
)
QUERIES = {run.__name__: (run, sql) for run, sql in _ALL}
