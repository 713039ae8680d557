"""Queries over sources and sinks: tables are written in the formats that users have and read back by the readers.

Files are in a scratch folder of the shared store; what is compared is what the readers make of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.operators import evaluate
from lexloom.plans.q_text import table
from lexloom.plans.shared import scratch
from lexloom.sources import readers, sinks


def _lines(df: DataFrame, line: Column, path: str, *order: str) -> str:
    """Write a line for each row, in order over all files."""
    rows = df.orderBy(*order) if order else df
    rows.select(line.alias("value")).write.text(path)
    return path


def _json(**columns: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]))


def q_read_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated documents; every tenth line lacks a field and is passed over."""
    c = table(spark, sf_dir, "customer")
    rest = F.when(F.col("c_custkey") % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("\t  "), "c_name", F.lit("  ")))
    path = _lines(c, F.concat("c_mktsegment", F.lit("\t"), F.col("c_custkey").cast("string"), rest), f"{scratch(spark, 'core')}.tsv")
    return readers.read_documents(spark, path)


SQL_CORE = "select c_custkey::varchar as id, c_name as text from customer where c_custkey % 10 <> 0"


def q_read_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table as JSON lines, compressed ones, Parquet and a table of the catalog, each found by its name."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("text"))
    top, view = scratch(spark, "formats"), f"formats_{scratch(spark, 'x')[-8:]}"
    sinks.write_jsonl(s, f"{top}/a.jsonl")
    sinks.write_jsonl(s, f"{top}/b.jsonl.gz", compression="gzip")
    s.write.parquet(f"{top}/c.parquet")
    s.createOrReplaceTempView(view)
    found = None
    for name, source in (("json", f"{top}/a.jsonl"), ("gzip", f"{top}/b.jsonl.gz"), ("parquet", f"{top}/c.parquet"), ("table", view)):
        rows = readers.read_documents(spark, source).select(F.lit(name).alias("format"), F.col("id").cast("bigint").alias("id"), "text")
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("format").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.max("text").alias("last"))


SQL_FORMATS = "select f as format, count(*)::bigint as n, sum(s_suppkey)::bigint as ids, max(s_name) as last from supplier, (select unnest(['json', 'gzip', 'parquet', 'table']) as f) group by f"


def q_strict_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with blank ones between them, by the strict reader."""
    o = table(spark, sf_dir, "orders")
    path = _lines(o, F.concat(_json(k=F.col("o_orderkey"), s=F.col("o_orderstatus")), F.when(F.col("o_orderkey") % 9 == 0, "\n\n  ").otherwise("")), scratch(spark, "strict"))
    return readers.read_jsonl(spark, path, "k bigint, s string").groupBy("s").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


SQL_STRICT = "select o_orderstatus as s, count(*)::bigint as n, sum(o_orderkey)::bigint as total from orders group by 1"


def q_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of undecodable lines, over several files."""
    o = table(spark, sf_dir, "orders").repartitionByRange(3, "o_orderkey")
    line = F.when(F.col("o_orderkey") % 50 == 0, F.concat(F.lit("{broken "), "o_orderkey")).otherwise(_json(k=F.col("o_orderkey")))
    return readers.bad_lines(spark, _lines(o, line, scratch(spark, "bad"), "o_orderkey"))


SQL_BAD = "select line::bigint as line, '{broken ' || o_orderkey as value from (select o_orderkey, row_number() over (order by o_orderkey) as line from orders) where o_orderkey % 50 = 0"


def q_lenient_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ids of lines of which some are broken, and of a file that does not exist."""
    li = table(spark, sf_dir, "lineitem")
    path = _lines(li, F.when(F.col("l_linenumber") == 3, F.lit('{"id": ')).otherwise(_json(id=F.col("l_partkey").cast("string"))), scratch(spark, "lenient"))
    there = readers.read_ids(spark, path)
    missing = readers.read_many_jsonl(spark, [f"{path}-missing"], "id string")
    return there.unionByName(missing).agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


SQL_LENIENT = "select count(distinct l_partkey)::bigint as n, min(l_partkey::varchar) as first, max(l_partkey::varchar) as last from lineitem where l_linenumber <> 3"


def q_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with different fields as one table; what a file lacks is null, a missing file only warned of."""
    top = scratch(spark, "many")
    sinks.write_jsonl(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")), f"{top}/a")
    sinks.write_jsonl(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("supplier")), f"{top}/b")
    rows = readers.read_many_jsonl(spark, [f"{top}/a", f"{top}/b", f"{top}/c"])
    return rows.groupBy("nation").agg(F.count("*").alias("n"), F.count("balance").alias("n_balances"), F.count("supplier").alias("n_suppliers"))


SQL_MANY = "select nation::bigint as nation, count(*)::bigint as n, count(b)::bigint as n_balances, count(s)::bigint as n_suppliers from (select c_nationkey as nation, c_acctbal as b, null as s from customer union all select s_nationkey, null, s_name from supplier) group by nation"


def _pair_lines(spark: SparkSession, sf_dir: str) -> str:
    p = table(spark, sf_dir, "part")
    line = _json(id=F.col("p_partkey").cast("string"), descriptor=F.col("p_type"), explainer=F.col("p_name"))
    return _lines(p.repartitionByRange(3, "p_partkey"), line, scratch(spark, "pairs"), "p_partkey")


def q_pair_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of a file, checked; of the test mode the first 300 lines."""
    path = _pair_lines(spark, sf_dir)
    whole, first = readers.read_pairs(spark, path), readers.read_pairs(spark, path, 300)
    rows = whole.select(F.lit("all").alias("mode"), "*").unionByName(first.select(F.lit("first").alias("mode"), "*"))
    return rows.groupBy("mode").agg(F.count("*").alias("n"), F.countDistinct("descriptor").alias("n_descriptors"), F.max(F.col("id").cast("bigint")).alias("last"))


SQL_PAIR_FILE = """select mode, count(*)::bigint as n, count(distinct p_type)::bigint as n_descriptors, max(p_partkey)::bigint as last
from (select 'all' as mode, * from part union all select * from (select 'first' as mode, * from part order by p_partkey limit 300)) group by mode"""


def q_schema_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.read_schema(spark, _pair_lines(spark, sf_dir))
    return rows.select("id", tx.pair_text("descriptor", "explainer").alias("text"))


SQL_SCHEMA_FILE = "select p_partkey::varchar as id, p_type || '; ' || p_name as text from part"


def q_annotated_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with rounds of pairs: the best round, or what an empty list of similarities gives, or the harmonised pairs;
    without text nothing; then the documents of the fifty smallest ids alone."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    first, second = F.array(F.concat("c_mktsegment", F.lit(" ; "), "c_name")), F.array(F.concat("c_mktsegment", F.lit(" x;"), "c_name", F.lit(";y")), F.lit("solo"))
    sim = F.when(k % 5 == 0, F.array().cast("array<double>")).otherwise(F.array(k % 3 / 10, k % 2 / 10))
    line = _json(
        doc_id=F.lpad(k.cast("string"), 9, "0"), document=F.when(k % 7 != 0, F.col("c_name")), descriptors=F.array(first, second), similarity=sim,
        harmonized_descriptors=F.when(k % 11 == 0, F.array(F.lit("schema; pair"))),
    )
    docs = readers.read_jsonl(spark, _lines(c, line, scratch(spark, "annotated")))
    count = lambda rows, mode: rows.groupBy("descriptor").agg(F.lit(mode).alias("mode"), F.count("*").alias("n"), F.count_if(F.col("explainer") == "").alias("n_bare"), F.max("explainer").alias("last"), F.sum("pos").alias("places"))
    return count(readers.annotated(docs), "all").unionByName(count(readers.annotated(docs, "all", 50), "fifty"))


SQL_ANNOTATED = """with c as (select *, c_custkey as k, row_number() over (order by c_custkey) as r from customer where c_custkey % 7 <> 0),
m as (select *, unnest(['all', 'fifty']) as mode from c),
d as (select *, case when k % 11 = 0 then 'h' when k % 5 = 0 then (case when mode = 'all' then '1' else '12' end) when (k % 2) / 10.0 > (k % 3) / 10.0 then '2' else '1' end as b from m where mode = 'all' or r <= 50),
p as (select mode, 'schema' as descriptor, 'pair' as explainer, 0 as pos from d where b = 'h' union all select mode, c_mktsegment, c_name, 0 from d where b in ('1', '12')
union all select mode, c_mktsegment || ' x', c_name || ';y', case when b = '12' then 1 else 0 end from d where b in ('2', '12') union all select mode, 'solo', '', case when b = '12' then 2 else 1 end from d where b in ('2', '12'))
select mode, descriptor, count(*)::bigint as n, count(*) filter (explainer = '')::bigint as n_bare, max(explainer) as last, sum(pos)::bigint as places from p group by all"""


def _group_file(spark: SparkSession, sf_dir: str) -> str:
    p = table(spark, sf_dir, "part").groupBy("p_type").agg(F.array_sort(F.collect_list(F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("explainer")))).alias("explainers"))
    return _lines(p, _json(descriptor=F.concat(F.lit(" "), F.initcap("p_type"), F.lit("  ")), explainers=F.col("explainers")), scratch(spark, "groups"), "p_type")


def q_group_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped descriptors read flat, their names normalised, and the ids they hold; of the test mode the first 20 groups."""
    path = _group_file(spark, sf_dir)
    flat = readers.read_grouped(spark, path).groupBy("descriptor").agg(F.count("*").alias("n"), F.min("explainer").alias("first"))
    n_ids, few = readers.read_input_ids(spark, path).count(), readers.read_input_ids(spark, path, 20).count()
    return flat.withColumn("n_ids", F.lit(n_ids).cast("bigint")).withColumn("n_few", F.lit(few).cast("bigint"))


SQL_GROUP_FILE = """select lower(p_type) as descriptor, count(*)::bigint as n, min(p_name) as first, (select count(*) from part)::bigint as n_ids,
(select count(*) from part where p_type in (select distinct p_type from part order by p_type limit 20))::bigint as n_few from part group by p_type"""


def q_lineage_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage from the second of the names a run may use; a source may be a list or a single id."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    line = F.when(F.col("o_orderkey") % 2 == 0, _json(new_pair_id=k, source_pair_ids=F.array(c, k))).otherwise(_json(new_pair_id=k, source_pair_ids=c))
    run = scratch(spark, "run")
    _lines(o.repartitionByRange(3, "o_orderkey"), line, f"{run}/disambig_lineage.jsonl", "o_orderkey")
    return readers.read_lineage(spark, run)


SQL_LINEAGE_FILE = """with r as (select o_orderkey as k, o_custkey as c, row_number() over (order by o_orderkey) - 1 as ord from orders)
select k::varchar as dst, c::varchar as src, ord::bigint as ord from r union all select k::varchar, k::varchar, ord::bigint from r where k % 2 = 0"""


def q_final_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final pairs of two files with ids in common: the last row holds, or the first, and how many differ."""
    p = table(spark, sf_dir, "part").repartitionByRange(2, "p_partkey")
    top, key = scratch(spark, "finals"), (F.col("p_partkey") % 500).cast("string")
    a = _lines(p, _json(id=key, descriptor=F.col("p_type"), explainer=F.col("p_name")), f"{top}/a", "p_partkey")
    b = _lines(p.where("p_partkey % 500 < 100"), _json(id=key, descriptor=F.lit(""), final_descriptor=F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")), name=F.col("p_name"), group_explainer=F.col("p_type")), f"{top}/b", "p_partkey")
    last, first = readers.read_finals(spark, [a, b]), readers.read_finals(spark, [a, b], "first")
    both = last.join(first.select("id", F.col("descriptor").alias("first_descriptor")), "id").join(readers.conflicting_finals(spark, [a, b]), "id", "left")
    return both.select("id", "descriptor", "explainer", "first_descriptor", F.coalesce("n", F.lit(1)).alias("n_variants"))


SQL_FINALS = """with r as (select 0 as f, p_partkey as o, p_partkey % 500 as id, p_type as d, p_name as e from part
union all select 1, p_partkey, p_partkey % 500, case when p_partkey % 2 = 0 then p_type else p_name end, p_type from part where p_partkey % 500 < 100)
select id::varchar as id, arg_max(d, (f, o)) as descriptor, arg_max(e, (f, o)) as explainer, arg_min(d, (f, o)) as first_descriptor, count(distinct (d, e))::bigint as n_variants from r group by id"""


def q_iteration_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered files as one table with the number; files of other names are not read."""
    top = scratch(spark, "iterations")
    for n in (2, 10, 1):
        sinks.write_jsonl(table(spark, sf_dir, "nation").where(F.col("n_nationkey") % n == 0).select(F.col("n_nationkey").alias("k")), f"{top}/all/iteration_{n}_merges.jsonl")
    sinks.write_jsonl(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k")), f"{top}/all/other.jsonl")
    rows = readers.read_iterations(spark, f"{top}/all/iteration_*_merges.jsonl", "k bigint")
    return rows.groupBy(F.col("iteration").cast("bigint").alias("iteration")).agg(F.count("*").alias("n"), F.sum("k").alias("total"))


SQL_ITERATIONS = "select i::bigint as iteration, count(*)::bigint as n, sum(n_nationkey)::bigint as total from nation, (select unnest([1, 2, 10]) as i) where n_nationkey % i = 0 group by i"


def q_file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each folder of shards, found below a folder by pattern, and of all of them as one."""
    top = scratch(spark, "listing")
    for n in range(3):
        sinks.write_lines(table(spark, sf_dir, "customer").where(F.col("c_custkey") % 3 == n).coalesce(1), f"{top}/run/shard{n}", "c_name")
    folders = sorted({p.rsplit("/", 1)[0] for p in readers.list_files(spark, top, "part-*")})
    sinks.concatenate(spark, folders, f"{top}/whole")
    counts = readers.line_counts(spark, f"{top}/run", "part-*").select(F.regexp_extract("file", r"/(shard\d)/", 1).alias("name"), "n")
    return counts.unionByName(readers.line_counts(spark, f"{top}/whole", "part-*").agg(F.lit("whole").alias("name"), F.sum("n").alias("n")))


SQL_LISTING = "select 'shard' || (c_custkey % 3) as name, count(*)::bigint as n from customer group by 1 union all select 'whole', count(*)::bigint from customer"


def q_word_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct stripped lines, the first 50 of them."""
    path = _lines(table(spark, sf_dir, "part"), F.concat(F.lit(" \t"), "p_type", F.lit(" \n\n")), scratch(spark, "words"))
    return readers.read_lines(spark, path, 50)


SQL_WORDS = "select distinct p_type as value from part order by value limit 50"


def q_vocabulary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary written, followed by malformed and repeated lines, and read: counts of a descriptor add up."""
    top = scratch(spark, "vocabulary")
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("descriptor")).agg(F.count("*").alias("n"))
    sinks.write_vocabulary(counts, f"{top}/a")
    more = F.when(F.col("n") % 2 == 0, F.concat_ws("\t", "descriptor", F.lit(" 5 "))).when(F.col("n") % 3 == 0, F.col("descriptor")).otherwise(F.concat_ws("\t", "descriptor", F.lit("many")))
    _lines(counts, more, f"{top}/b")
    return readers.read_vocabulary(spark, f"{top}/*")


SQL_VOCABULARY = "select p_type as descriptor, (count(*) + case when count(*) % 2 = 0 then 5 else 0 end)::bigint as n from part group by 1"


def q_key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of keys and values, read by a prefix of the key."""
    path = scratch(spark, "kv")
    sinks.write_key_values(table(spark, sf_dir, "customer"), path, "c_name", F.to_json(F.struct("c_custkey", "c_mktsegment")))
    rows = readers.read_key_values(spark, path, "Customer#00000001")
    return rows.select("key", F.from_json("value", "c_custkey bigint, c_mktsegment string").alias("v")).select("key", "v.*")


SQL_KEY_VALUES = "select c_name as key, c_custkey::bigint as c_custkey, c_mktsegment from customer where starts_with(c_name, 'Customer#00000001')"


def q_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource use from the log folders of one kind of job; other folders below are not read."""
    top, o = scratch(spark, "logs"), table(spark, sf_dir, "orders")
    line = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("step "), F.col("o_custkey").cast("string"), F.lit(" TOTAL:  "), F.col("o_orderkey").cast("string"), F.lit(".5 Wh"))).otherwise(F.concat(F.lit("GPU 0: 1 Wh, 2 W avg ("), F.col("o_custkey").cast("string"), F.lit(".25 s)")))
    for kind, rows in (("merge_1", o.where("o_orderkey % 3 = 0")), ("merge_2", o.where("o_orderkey % 3 = 1")), ("other", o.where("o_orderkey % 3 = 2"))):
        _lines(rows, line, f"{top}/{kind}")
    logs = readers.read_logs(spark, f"{top}/merge_*", "part-", ".txt")
    return evaluate.energy(logs)


SQL_LOGS = "select round(sum(o_orderkey + 0.5::double) filter (o_orderkey % 2 = 0), 4) as total_wh, round(sum(o_custkey + 0.25::double) filter (o_orderkey % 2 = 1) / 3600, 6) as gpu_hours from orders where o_orderkey % 3 < 2"


def _as_arrow(batches):
    """Each batch as the bytes of an Arrow stream."""
    import pyarrow as pa

    for batch in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["content"])


def q_arrow_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrow streams as bytes, read back by column name."""
    c = table(spark, sf_dir, "customer").select("c_name", F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_mktsegment")
    path = scratch(spark, "arrow")
    c.mapInArrow(_as_arrow, "content binary").write.parquet(path)
    rows = readers.read_arrow(spark.read.parquet(path), "c_custkey bigint, c_mktsegment string")
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("total"))


SQL_ARROW = "select c_mktsegment, count(*)::bigint as n, sum(c_custkey)::bigint as total from customer group by 1"


def q_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with surrogates and invalid bytes: surrogates go, other invalid bytes become the replacement character."""
    n = table(spark, sf_dir, "nation")
    raw = F.concat(F.col("n_name").cast("binary"), F.unhex(F.lit("EDA080")), F.encode(F.lit("é"), "UTF-8"), F.unhex(F.lit("FF")), F.unhex(F.lit("EDBFBF")), F.lit("!").cast("binary"))
    return n.select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), tx.sanitize(raw).alias("text"))


SQL_ENCODING = "select n_nationkey::bigint as n_nationkey, n_name || 'é' || chr(65533) || '!' as text from nation"


def q_resumed_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink written in batches by two runs, of which the first ends early; then what each batch holds."""
    path = scratch(spark, "resumed")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("at"), "c_name")
    done = sinks.append_batches(rows, path, "at", 400, upto=2)
    more = sinks.append_batches(rows, path, "at", 400)
    found = spark.read.schema("at bigint, c_name string, batch int").json(path)
    counts = found.groupBy(F.col("batch").cast("bigint").alias("batch")).agg(F.count("*").alias("n"), F.min("c_name").alias("first"))
    return counts.withColumn("n_lines", F.lit(readers.lines_done(spark, f"{path}/*")).cast("bigint")).withColumn("runs", F.lit(f"{done}+{more}"))


SQL_RESUMED = "select (c_custkey // 400)::bigint as batch, count(*)::bigint as n, min(c_name) as first, (select count(*) from customer)::bigint as n_lines, (select least(2, max(c_custkey) // 400 + 1) || '+' || greatest(0, max(c_custkey) // 400 - 1) from customer) as runs from customer group by 1"


def q_csv_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV sink in a total order, read back with line numbers."""
    path = scratch(spark, "csv")
    totals = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    sinks.write_csv(totals, path, F.desc("n"), "o_custkey")
    lines = readers.with_line_numbers(spark, path).where(~F.col("value").startswith("o_custkey"))
    parts = lines.select("line", F.split("value", ",").alias("p"))
    ranked = parts.withColumn("key", F.get("p", F.lit(0)).cast("bigint")).withColumn("n", F.get("p", F.lit(1)).cast("bigint"))
    # header lines of further files shift the numbers but not the order
    above = ranked.agg(F.array_sort(F.collect_list(F.struct("line", "key", "n"))).alias("l")).select(F.posexplode(F.slice("l", 1, 200)).alias("pos", "x"))
    return above.select(F.col("pos").cast("bigint").alias("pos"), "x.key", "x.n")


SQL_CSV = "select row_number() over (order by n desc, o_custkey) - 1 as pos, o_custkey::bigint as key, n::bigint as n from (select o_custkey, count(*) as n from orders group by 1) order by pos limit 200"


def q_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit markers of a rule that holds and of one that is broken, with the rows that break it."""
    top, c = scratch(spark, "marker"), table(spark, sf_dir, "customer")
    found = None
    for name, broken in (("key", c.where("c_custkey < 0")), ("balance", c.where("c_acctbal < 0").select("c_custkey"))):
        sinks.write_marker(broken, f"{top}/{name}")
        state = next(s for s in ("passed", "failed") if readers.exists(spark, f"{top}/{name}/{s}"))
        n = spark.read.schema("c_custkey bigint").json(f"{top}/{name}/violations").agg(F.lit(name).alias("rule"), F.lit(state).alias("state"), F.count("*").alias("n"))
        found = n if found is None else found.unionByName(n)
    return found


SQL_MARKER = "select 'key' as rule, 'passed' as state, 0::bigint as n union all select 'balance', case when count(*) > 0 then 'failed' else 'passed' end, count(*)::bigint from customer where c_acctbal < 0"


def q_embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored embedding table is used for the same model, ids and texts, and for no others."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.concat(F.lit("t"), "vec_id").alias("text"))
    path = scratch(spark, "cache")
    sinks.write_embeddings(v, path, "model-a", text_col="text")
    same = sinks.read_embeddings(spark, path, "model-a", v.select("id", "text"))
    others = [sinks.read_embeddings(spark, path, m, x) for m, x in (("model-b", v.select("id", "text")), ("model-a", v.select("id", "text").where("id > 0")), ("model-a", v.select("id", F.lit("x").alias("text"))))]
    return same.agg(F.count("*").alias("n"), F.max(F.size("vec")).cast("bigint").alias("width"), F.lit(sum(x is not None for x in others)).cast("bigint").alias("n_wrong"))


SQL_CACHE = "select count(*)::bigint as n, max(len(embedding))::bigint as width, 0::bigint as n_wrong from embeddings"


def q_parquet_to_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Parquet table as JSON lines: nulls are written out and non-ASCII characters stay."""
    top = scratch(spark, "p2j")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("text"), "lang")
    docs.write.parquet(f"{top}/a.parquet")
    sinks.parquet_to_jsonl(spark, f"{top}/a.parquet", f"{top}/b")
    lines = spark.read.text(f"{top}/b")
    named = lines.select(F.json_object_keys("value").alias("k"), F.from_json("value", "doc_id bigint, text string, lang string").alias("j"))
    return named.groupBy("j.lang").agg(F.count_if(F.size("k") == 3).alias("n_whole"), F.count("j.text").alias("n_texts"), F.sum(F.length("j.text")).alias("n_chars"))


SQL_P2J = "select lang, count(*)::bigint as n_whole, count(text) filter (doc_id % 2 = 0)::bigint as n_texts, sum(length(text)) filter (doc_id % 2 = 0)::bigint as n_chars from documents group by lang"


def q_group_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with their sorted members as JSON lines."""
    path = scratch(spark, "clusters")
    sinks.write_groups(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("cluster"), F.col("s_suppkey").alias("member")), path)
    rows = readers.read_jsonl(spark, path, "cluster bigint, members array<bigint>")
    return rows.select("cluster", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


SQL_GROUP_SINK = "select s_nationkey::bigint as cluster, string_agg(s_suppkey::varchar, ',' order by s_suppkey) as members from supplier group by 1"

_ALL = (
    (q_read_core, SQL_CORE), (q_read_formats, SQL_FORMATS), (q_strict_lines, SQL_STRICT), (q_bad_lines, SQL_BAD), (q_lenient_lines, SQL_LENIENT), (q_many_files, SQL_MANY), (q_pair_file, SQL_PAIR_FILE),
    (q_schema_file, SQL_SCHEMA_FILE), (q_annotated_file, SQL_ANNOTATED), (q_group_file, SQL_GROUP_FILE), (q_lineage_file, SQL_LINEAGE_FILE), (q_final_files, SQL_FINALS), (q_iteration_files, SQL_ITERATIONS),
    (q_file_listing, SQL_LISTING), (q_word_list, SQL_WORDS), (q_vocabulary_file, SQL_VOCABULARY), (q_key_values, SQL_KEY_VALUES), (q_log_files, SQL_LOGS), (q_arrow_tables, SQL_ARROW), (q_encoding, SQL_ENCODING),
    (q_resumed_sink, SQL_RESUMED), (q_csv_order, SQL_CSV), (q_marker, SQL_MARKER), (q_embedding_cache, SQL_CACHE), (q_parquet_to_jsonl, SQL_P2J), (q_group_sink, SQL_GROUP_SINK),
)
QUERIES = {run.__name__: (run, sql) for run, sql in _ALL}
