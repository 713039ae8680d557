"""Queries over lineages: closures, weights, contributions, the backtrace, audits, replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import audit, grouping, lineage, merging
from lexloom.plans.q_text import table

#: A lineage from part keys: p{key} -> q{key div 4} -> r{key div 16} -> s{key div 64}; every fifth key also goes to the
#: next q, so that there are diamonds, and each p{key} occurs p_size times.
EDGES = """k as (select p_partkey as n, p_size as size from part),
edges as (select 'q' || (n // 4) as dst, 'p' || n as src, 0 as ord from k union all select 'q' || (n // 4 + 1), 'p' || n, 0 from k where n % 5 = 0
union all select distinct 'r' || (n // 16), 'q' || (n // 4), 1 from k union all select distinct 's' || (n // 64), 'r' || (n // 16), 2 from k
union all select distinct 's' || (n // 64), 'r' || (n // 16 + 1), 2 from k where n // 16 % 3 = 0)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"))
    name = lambda letter, x: F.concat(F.lit(letter), F.floor(x).cast("string"))
    n = F.col("n")
    row = lambda df, d, s, o: df.select(d.alias("dst"), s.alias("src"), F.lit(o).alias("ord"))
    return (
        row(part, name("q", n / 4), name("p", n), 0).union(row(part.where(n % 5 == 0), name("q", F.floor(n / 4) + 1), name("p", n), 0))
        .union(row(part, name("r", n / 16), name("q", n / 4), 1).distinct()).union(row(part, name("s", n / 64), name("r", n / 16), 2).distinct())
        .union(row(part.where(F.floor(n / 16) % 3 == 0), name("s", n / 64), name("r", F.floor(n / 16) + 1), 2).distinct())
    )


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_size").cast("bigint").alias("n"))


def _finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.lit("s"), F.floor(F.col("p_partkey") / 64).cast("string")).alias("id")).distinct()


_WALK = f"""with recursive {EDGES}, f as (select distinct 's' || (n // 64) as id from k), w(start, node) as (select id, id from f union select w.start, e.src from w join edges e on e.dst = w.node)"""


def q_closure_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of each final as a set, with their summed counts."""
    starts = _finals(spark, sf_dir).withColumnRenamed("id", "start")
    return lineage.root_weights(lineage.roots(starts, _edges(spark, sf_dir)), _counts(spark, sf_dir))


SQL_CLOSURE = f"""{_WALK} select start, count(*)::bigint as root_count, sum(coalesce(k.size, 1))::bigint as weight from w left join k on 'p' || k.n = w.node
where w.node not in (select dst from edges) group by start"""


def q_path_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same roots, with counts added once per path."""
    starts = _finals(spark, sf_dir).withColumnRenamed("id", "start")
    return lineage.path_weights(starts, _edges(spark, sf_dir), _counts(spark, sf_dir))


SQL_PATHS = f"""with recursive {EDGES}, f as (select distinct 's' || (n // 64) as id from k), w(start, node) as (select id, id from f union all select w.start, e.src from w join (select distinct dst, src from edges) e on e.dst = w.node)
select start, count(distinct node)::bigint as root_count, sum(coalesce(k.size, 1))::bigint as weight from w left join k on 'p' || k.n = w.node where w.node not in (select dst from edges) group by start"""


def q_last_event_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots by the last event of each id alone: a repeated event gives q-ids with an even number new sources."""
    extra = _edges(spark, sf_dir).where("ord = 0 and substring(dst, 2) % 2 = 0 and substring(src, 2) % 4 = 1").withColumn("ord", F.lit(9))
    events = lineage.last_events(_edges(spark, sf_dir).union(extra))
    found = lineage.roots(_finals(spark, sf_dir).withColumnRenamed("id", "start"), events)
    return found.groupBy("start").agg(F.count("*").alias("root_count"), F.min("root").alias("first_root"))


SQL_LAST = f"""with recursive {EDGES}, ev as (select * from edges union all select dst, src, 9 from edges where ord = 0 and substr(dst, 2)::bigint % 2 = 0 and substr(src, 2)::bigint % 4 = 1),
l as (select distinct dst, src from (select *, max(ord) over (partition by dst) as m from ev) where ord = m), f as (select distinct 's' || (n // 64) as id from k),
w(start, node) as (select id, id from f union select w.start, e.src from w join l e on e.dst = w.node)
select start, count(*)::bigint as root_count, min(node) as first_root from w where node not in (select dst from l) group by start"""


def q_reachable_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences that reach each final; an original under two finals counts for both."""
    counts = _counts(spark, sf_dir)
    return lineage.contributions(lineage.finals_of(counts, _edges(spark, sf_dir), _finals(spark, sf_dir)), counts)


SQL_REACH = f"{_WALK} select start as final, sum(k.size)::bigint as count from w join k on 'p' || k.n = w.node group by start"


def q_backtrace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions by three rounds, latest first, with some finals that the last round passed through."""
    e = _edges(spark, sf_dir)
    rounds, out = [], _counts(spark, sf_dir).select("id")
    for n in range(3):
        own = e.where(F.col("ord") == n)
        rounds.append((own, out))
        out = own.select(F.col("dst").alias("id")).distinct()
    finals = _finals(spark, sf_dir).union(out.sparkSession.createDataFrame([("r0",), ("x1",)], "id string"))
    found, _ = lineage.backtrace(finals, rounds, _counts(spark, sf_dir))
    return found


SQL_BACK = f"""with recursive {EDGES}, f as (select distinct 's' || (n // 64) as id from k union all select 'r0'), w(start, node) as (select id, id from f union all select w.start, e.src from w join edges e on e.dst = w.node)
select start as id, sum(k.size)::bigint as contribution_count from w join k on 'p' || k.n = w.node group by start"""


def q_dead_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)
    outputs = [_counts(spark, sf_dir).select("id"), e.where("ord = 0").select(F.col("dst").alias("id")).distinct()]
    broken = e.where("ord = 1 and substring(src, 2) % 3 <> 0")
    finals = e.where("ord = 1").select(F.col("dst").alias("id")).distinct()
    _, dead = lineage.backtrace(finals, [(e.where("ord = 0 and substring(dst, 2) % 5 <> 0"), outputs[0]), (broken, outputs[1])], _counts(spark, sf_dir))
    return dead.groupBy("round").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).select(F.col("round").cast("bigint").alias("round"), "n", "first_id")


SQL_DEAD = f"""with {EDGES}, b as (select * from edges where ord = 1 and substr(src, 2)::bigint % 3 <> 0), f as (select distinct dst as id from edges where ord = 1),
d2 as (select id from f where id not in (select dst from b) and id not in (select dst from edges where ord = 0)), at1 as (select distinct src as id from b join f on f.id = b.dst),
e0 as (select * from edges where ord = 0 and substr(dst, 2)::bigint % 5 <> 0), d1 as (select id from at1 where id not in (select dst from e0) and id not in (select 'p' || n from k)),
d as (select 2 as round, id from d2 union select 1, id from d1) select round::bigint as round, count(*)::bigint as n, min(id) as first_id from d group by round"""


def _audited(spark: SparkSession, sf_dir: str, broken: bool) -> DataFrame:
    originals = _counts(spark, sf_dir).select("id")
    events = _edges(spark, sf_dir)
    finals = _finals(spark, sf_dir)
    if broken:
        events = events.where("not (ord = 0 and substring(src, 2) % 97 = 3)").union(events.limit(0).sparkSession.createDataFrame([("q0", "zz", 0)], "dst string, src string, ord int"))
        finals = finals.where("substring(id, 2) % 4 <> 1").union(finals.sparkSession.createDataFrame([("nowhere",), ("s0",)], "id string"))
    found = audit.lineage_audit(originals, events, finals)
    return found.groupBy("rule").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def q_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir, False)


def q_audit_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir, True)


_RULES = """ids as (select distinct id from o), made as (select distinct dst as id from ev), used as (select distinct src as id from ev), ends as (select distinct id from fin),
rules as (select 'missing' as rule, id from ids where id not in (select id from used) and id not in (select id from ends)
union all select 'unknown_source', id from used where id not in (select id from ids) and id not in (select id from made)
union all select 'untraceable', id from ends where id not in (select id from ids) and id not in (select id from made)
union all select 'repeated_final', id from fin group by id having count(*) > 1
union all select 'reused_id', id from made where id in (select id from ids)
union all select 'dropped', id from made where id not in (select id from used) and id not in (select id from ends)
union all select 'several_targets', src from ev group by src having count(distinct dst) > 1
union all select 'same_sources', min(dst) from (select dst, string_agg(distinct src, ',' order by src) as s from ev group by dst) group by s having count(*) > 1)
select rule, count(*)::bigint as n, min(id) as first_id from rules group by rule"""
SQL_AUDIT = f"with {EDGES}, o as (select 'p' || n as id from k), ev as (select dst, src from edges), fin as (select distinct 's' || (n // 64) as id from k), {_RULES}"
SQL_AUDIT_BROKEN = f"""with {EDGES}, o as (select 'p' || n as id from k), ev as (select dst, src from edges where not (ord = 0 and substr(src, 2)::bigint % 97 = 3) union all select 'q0', 'zz'),
fin as (select distinct 's' || (n // 64) as id from k where n // 64 % 4 <> 1 union all select 'nowhere' union all select 's0'), {_RULES}"""


def q_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents against all documents."""
    docs, labels = (table(spark, sf_dir, t).select(F.col("doc_id").alias("id")) for t in ("documents", "labels"))
    return audit.coverage(docs, labels)


SQL_COVERAGE = """with a as (select distinct doc_id as id from documents), b as (select distinct doc_id as id from labels)
select (select count(*) from a)::bigint as n_left, (select count(*) from b)::bigint as n_right, (select count(*) from a join b using (id))::bigint as n_both,
(select count(*) from a where id not in (select id from b))::bigint as only_left, (select count(*) from b where id not in (select id from a))::bigint as only_right"""


def q_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after one round in which every source has one target."""
    one = _edges(spark, sf_dir).where("ord = 0").groupBy("src").agg(F.min("dst").alias("dst"))
    counts = _counts(spark, sf_dir)
    finals = one.select(F.col("dst").alias("id")).distinct()
    found, _ = lineage.backtrace(finals, [(one.select("dst", "src"), counts.select("id"))], counts)
    return audit.conservation(counts, found)


SQL_CONSERVATION = "select sum(p_size)::bigint as original_total, sum(p_size)::bigint as traced_total, true as conserved from part"


def q_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged decisions replayed: within an iteration each id is used once, in the order of the log."""
    p = table(spark, sf_dir, "part")
    log = p.select((F.col("p_partkey") % 4).alias("iteration"), F.col("p_partkey").alias("ord"), F.floor(F.col("p_partkey") / 7).alias("keep"), (F.floor(F.col("p_partkey") * 13 % 400) + 1_000_000).alias("drop"), (F.col("p_size") > 5).alias("is_synonym"))
    return merging.replay(log).select("iteration", "keep", "drop")


SQL_REPLAY = """with recursive l as (select p_partkey % 4 as iteration, p_partkey // 7 as keep, p_partkey * 13 % 400 + 1000000 as drop, row_number() over (partition by p_partkey % 4 order by p_partkey) as k from part where p_size > 5),
w(iteration, k, used, keep, drop, won) as (select i, 0::bigint, []::bigint[], 0::bigint, 0::bigint, false from (select distinct iteration as i from l)
union all select w.iteration, l.k, case when list_contains(used, l.keep) or list_contains(used, l.drop) then used else list_concat(used, [l.keep::bigint, l.drop::bigint]) end, l.keep, l.drop, not (list_contains(used, l.keep) or list_contains(used, l.drop))
from w join l on l.iteration = w.iteration and l.k = w.k + 1) select iteration, keep, drop from w where won"""


def q_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faulty groupings of parts of a type, repaired to partitions: every sixth id is unnamed, some are named twice."""
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("chunk"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("explainer"))
    named = p.where("id % 6 <> 0").select("chunk", (F.col("id") % 4).alias("grp"), "pos", "id", F.lit("").alias("text"))
    twice = p.where("id % 6 <> 0 and id % 10 = 1").select("chunk", F.lit(3).cast("bigint").alias("grp"), "pos", "id", F.lit("").alias("text"))
    texts = p.groupBy("chunk", (F.col("id") % 4).alias("grp")).agg(F.min("explainer").alias("t"))
    answers = named.union(twice).drop("text").join(texts, ["chunk", "grp"]).select("chunk", "grp", "pos", "id", F.col("t").alias("text"))
    return grouping.repair(p, answers).select("chunk", "grp", "id")


SQL_REPAIR = """with p as (select p_type as chunk, p_partkey as id, p_name as e from part), t as (select chunk, id % 4 as grp, min(e) as text from p group by all),
held as (select chunk, id, min(grp) as grp from (select chunk, id, id % 4 as grp from p where id % 6 <> 0 union all select chunk, id, 3 from p where id % 6 <> 0 and id % 10 = 1) group by all),
g as (select distinct chunk, grp from held), lost as (select * from p where id % 6 = 0),
s as (select l.chunk, l.id, g.grp, len(list_intersect(list_distinct(string_split(lower(l.e), ' ')), list_distinct(string_split(lower(t.text), ' ')))) as o from lost l join g using (chunk) join t using (chunk, grp)),
b as (select chunk, grp, id from (select *, row_number() over (partition by chunk, id order by o desc, grp) as n from s) where n = 1)
select chunk, grp::bigint as grp, id from held union all select chunk, grp::bigint, id from b"""


QUERIES = {
    "q_closure_weights": (q_closure_weights, SQL_CLOSURE), "q_path_weights": (q_path_weights, SQL_PATHS), "q_last_event_roots": (q_last_event_roots, SQL_LAST), "q_reachable_counts": (q_reachable_counts, SQL_REACH),
    "q_backtrace": (q_backtrace, SQL_BACK), "q_dead_ends": (q_dead_ends, SQL_DEAD), "q_audit": (q_audit, SQL_AUDIT), "q_audit_broken": (q_audit_broken, SQL_AUDIT_BROKEN),
    "q_coverage": (q_coverage, SQL_COVERAGE), "q_conservation": (q_conservation, SQL_CONSERVATION), "q_replay": (q_replay, SQL_REPLAY), "q_repair": (q_repair, SQL_REPAIR),
}
