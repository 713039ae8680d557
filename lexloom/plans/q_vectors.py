"""Queries over vectors: neighbours, pairs, merging, harmonising, search, score statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.vector import cosine
from lexloom.operators import evaluate, harmonize, merging, search
from lexloom.operators import neighbors as nn
from lexloom.plans.components import connected_components
from lexloom.plans.q_text import table
from lexloom.plans.shared import stored

#: Of so many vectors one belongs to the schema, by its id: the schema is a share of the table.
SCHEMA_SHARE = 10


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def _near(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    packed = nn.blocks(_vectors(spark, sf_dir), "vec_id", "embedding")
    return nn.top_k(packed, packed, k, exclude_self=True)


def _sql_near(k: int) -> str:
    return f"""v as (select vec_id, cast(embedding as double[]) as e, label from embeddings),
s as (select a.vec_id as id, b.vec_id as neighbor, round(list_cosine_similarity(a.e, b.e), 9) as score from v a join v b on a.vec_id <> b.vec_id),
nn as (select * from (select *, row_number() over (partition by id order by score desc, neighbor) as rank from s) where rank <= {k})"""


def q_knn_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, 3).select("id", "neighbor", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


SQL_KNN = f"with {_sql_near(3)} select id, neighbor, round(score, 6) as score, rank::bigint as rank from nn"


def q_mutual_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn.mutual_pairs(_near(spark, sf_dir, 1)).withColumn("score", F.round("score", 6))


_MUTUAL = "mu as (select x.id as a, y.id as b, greatest(x.score, y.score) as score from nn x join nn y on x.id = y.neighbor and x.neighbor = y.id and x.id < y.id where x.rank = 1 and y.rank = 1)"
SQL_MUTUAL = f"with {_sql_near(1)}, {_MUTUAL} select a, b, round(score, 6) as score from mu"


def q_unique_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = nn.threshold_split(nn.unique_candidates(_near(spark, sf_dir, 3)), 0.5)
    return kept.withColumn("score", F.round("score", 6))


SQL_UNIQUE = f"with {_sql_near(3)} select least(id, neighbor) as a, greatest(id, neighbor) as b, round(max(score), 6) as score from nn group by 1, 2 having max(score) >= 0.5"


def q_dropped_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates below the threshold, and those whose score is no number, here every seventh."""
    found = nn.unique_candidates(_near(spark, sf_dir, 3)).withColumn("score", F.when(F.col("a") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("score")))
    _, dropped = nn.threshold_split(found, 0.5)
    return dropped.withColumn("score", F.round(F.nanvl("score", F.lit(-2.0)), 6))


SQL_DROPPED = f"with {_sql_near(3)}, c as (select least(id, neighbor) as a, greatest(id, neighbor) as b, max(score) as s from nn group by 1, 2) select a, b, case when a % 7 = 0 then -2.0::double else round(s, 6) end as score from c where a % 7 = 0 or s < 0.5"


def _schema(v: DataFrame) -> DataFrame:
    return v.where(F.col("vec_id") % SCHEMA_SHARE == 0)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return harmonize.candidates(nn.blocks(v.where(F.col("vec_id") % SCHEMA_SHARE != 0), "vec_id", "embedding"), nn.blocks(_schema(v), "vec_id", "embedding"), 10, 0.5)


_SQL_SCHEMA = f"""v as (select vec_id, cast(embedding as double[]) as e from embeddings),
s as (select a.vec_id as id, b.vec_id as neighbor, round(list_cosine_similarity(a.e, b.e), 9) as score from v a join v b on a.vec_id % {SCHEMA_SHARE} <> 0 and b.vec_id % {SCHEMA_SHARE} = 0),
nn as (select * from (select *, row_number() over (partition by id order by score desc, neighbor) as rank from s) where rank <= 10 and (score >= 0.5 or rank = 1))"""


def q_knn_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema candidates of each vector: the ten nearest above the threshold, or the nearest."""
    return _candidates(spark, sf_dir).select("id", "neighbor", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


SQL_SCHEMA = f"with {_SQL_SCHEMA} select id, neighbor, round(score, 6) as score, rank::bigint as rank from nn"


def q_harmonized_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as descriptors of documents of five: each takes the schema name of its choice above a threshold, in order."""
    chosen = harmonize.choose_by_score(_candidates(spark, sf_dir), 0.2)
    v = _vectors(spark, sf_dir)
    owners = v.where(F.col("vec_id") % SCHEMA_SHARE != 0).select(F.floor(F.col("vec_id") / 5).alias("doc_id"), (F.col("vec_id") % 5).alias("pos"), F.col("vec_id").alias("id"))
    names = _schema(v).select(F.col("vec_id").alias("id"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("descriptor"), F.lit("").alias("explainer"))
    docs = harmonize.harmonized_documents(owners, chosen, names)
    return docs.select("doc_id", F.array_join("harmonized", "|").alias("harmonized"), F.size("harmonized").cast("bigint").alias("n"))


SQL_HARMONIZED = f"""with {_SQL_SCHEMA}, c as (select id, neighbor from nn where rank = 1 and score > 0.2),
n as (select v.vec_id as id, v.vec_id // 5 as doc_id, v.vec_id % 5 as pos, 'label ' || e.label as t from v join c on c.id = v.vec_id join embeddings e on e.vec_id = c.neighbor),
f as (select doc_id, t, min(pos) as pos from n group by doc_id, t), d as (select distinct vec_id // 5 as doc_id from v where vec_id % {SCHEMA_SHARE} <> 0)
select d.doc_id as doc_id, coalesce(string_agg(t, '|' order by pos), '') as harmonized, count(t)::bigint as n from d left join f using (doc_id) group by d.doc_id"""


def q_decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(_candidates(spark, sf_dir), "found")  # two plans read it
    log = harmonize.decision_log(found, harmonize.choose_by_score(found, 0.2))
    return log.select("id", "is_synonym", "chosen_id", F.round("embed_sim", 6).alias("embed_sim"), F.coalesce(F.size("candidates"), F.lit(0)).cast("bigint").alias("n_candidates"))


SQL_LOG = f"""with {_SQL_SCHEMA}, b as (select id, max(neighbor) filter (rank = 1) as n1, max(score) as s1, count(*) as n from nn group by id)
select id, s1 > 0.2 as is_synonym, case when s1 > 0.2 then n1 end as chosen_id, case when s1 > 0.2 then round(s1, 6) end as embed_sim, (case when s1 > 0.2 then 0 else n end)::bigint as n_candidates from b"""


def q_radius_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours within a squared distance, as a vector search returns them; every id divisible by 50 asks."""
    v = _vectors(spark, sf_dir)
    found = nn.radius_search(nn.blocks(v.where("vec_id % 50 = 0"), "vec_id", "embedding", "l2"), nn.blocks(v, "vec_id", "embedding", "l2"), 10, 1.0)
    return found.select("id", "neighbor", F.round("score", 6).alias("distance"))


SQL_RADIUS = f"""with v as (select vec_id, cast(embedding as double[]) as e from embeddings),
s as (select a.vec_id as id, b.vec_id as neighbor, round(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) as d from v a join v b on a.vec_id % 50 = 0),
r as (select *, row_number() over (partition by id order by d, neighbor) as rank from s) select id, neighbor, round(d, 6) as distance from r where d <= 1.0 and rank <= 5120"""


def q_synonym_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of mutual candidates; equal labels are synonyms, the smaller id is kept."""
    pairs = nn.mutual_pairs(_near(spark, sf_dir, 1))
    labels = _vectors(spark, sf_dir).select("vec_id", "label")
    said = pairs.join(labels.select(F.col("vec_id").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("vec_id").alias("b"), F.col("label").alias("lb")), "b")
    won = merging.greedy_matching(said.where("la = lb").select("a", "b", "score"))
    return won.select(F.col("a").alias("keep"), F.col("b").alias("drop"), F.round("score", 6).alias("score"))


SQL_SYNONYM = f"with {_sql_near(1)}, {_MUTUAL} select a as keep, b as drop, round(mu.score, 6) as score from mu join embeddings x on x.vec_id = a join embeddings y on y.vec_id = b where x.label = y.label"


def _same_label(v: DataFrame):
    labels = v.select("vec_id", "label")

    def decide(pairs: DataFrame) -> DataFrame:
        both = pairs.join(labels.select(F.col("vec_id").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("vec_id").alias("b"), F.col("label").alias("lb")), "b")
        return both.where("la = lb").select("a", "b", "score", F.col("a").alias("keep"), F.col("b").alias("drop"))

    return decide


def q_synonym_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge rounds to the fixpoint under unique candidates, as clusters."""
    v = _vectors(spark, sf_dir)
    _, lineage = merging.merge_synonyms(v, _same_label(v), "vec_id", "embedding", k=3, strategy="unique", least=0.35, max_iters=20)
    return merging.merge_clusters(lineage)


def q_greedy_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each id in one merge, by falling score, over the unique candidates of three neighbours."""
    return merging.greedy_matching(nn.unique_candidates(_near(spark, sf_dir, 3))).withColumn("score", F.round("score", 6))


SQL_GREEDY = f"""with recursive {_sql_near(3)}, c as (select least(id, neighbor) as a, greatest(id, neighbor) as b, max(score) as score from nn group by 1, 2),
e as (select row_number() over (order by score desc, a, b) as k, a, b, score from c), w(k, used, a, b, score, won) as (select 0::bigint, []::bigint[], 0::bigint, 0::bigint, 0::double, false
union all select e.k, case when list_contains(used, e.a) or list_contains(used, e.b) then used else list_concat(used, [e.a, e.b]) end, e.a, e.b, e.score, not (list_contains(used, e.a) or list_contains(used, e.b)) from w join e on e.k = w.k + 1)
select a, b, round(score, 6) as score from w where won"""


def q_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = nn.unique_candidates(_near(spark, sf_dir, 1)).where("score >= 0.3")
    return connected_components(pairs)


SQL_COMPONENTS = f"""with recursive {_sql_near(1)}, p as (select id as a, neighbor as b from nn where score >= 0.3), e as (select a, b from p union select b, a from p),
r(node, other) as (select a, a from e union select r.node, e.b from r join e on e.a = r.other)
select node, min(other) as component from r group by node"""


def q_force_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as descriptors, names as explainers: one pair of each type stays."""
    pairs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("descriptor"), F.col("p_name").alias("explainer"))
    kept, _ = merging.force_merge(pairs)
    return kept


SQL_FORCE = """select descriptor, id, explainer, n_members from (select trim(p_type) as descriptor, p_partkey as id, p_name as explainer, count(*) over (partition by trim(p_type))::bigint as n_members,
row_number() over (partition by trim(p_type) order by length(p_name), p_name, p_partkey) as k from part) where k = 1"""


def q_force_merge_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("descriptor"), F.col("p_name").alias("explainer"))
    _, lineage = merging.force_merge(pairs)
    return lineage.groupBy("keep").agg(F.count("*").alias("n"), F.min("drop").alias("first_drop"))


SQL_FORCE_LINEAGE = """with r as (select p_partkey as id, first_value(p_partkey) over (partition by trim(p_type) order by length(p_name), p_name, p_partkey) as keep from part)
select keep, count(*)::bigint as n, min(id) as first_drop from r where id <> keep group by keep"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cosine similarity of each vector to an alternating one."""
    fixed = F.array(*[F.lit(1.0 if k % 2 == 0 else -1.0) for k in range(64)])
    return _vectors(spark, sf_dir).select("vec_id", "label", F.round(cosine("embedding", fixed), 9).alias("s"))


_SQL_SCORES = "sc as (select vec_id, label, round(list_cosine_similarity(cast(embedding as double[]), cast(list_transform(range(64), lambda k: case when k % 2 = 0 then 1.0 else -1.0 end) as double[])), 9) as s from embeddings)"


def q_score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.score_stats(_scores(spark, sf_dir), "s", "label")


SQL_SCORES = f"with {_SQL_SCORES} select label, count(*)::bigint as n, round(avg(s), 3) as mean, round(stddev_pop(s), 3) as std, round(min(s), 3) as low, round(max(s), 3) as high from sc group by label"


def q_similarity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.histogram_right(_scores(spark, sf_dir), "s", "label")


SQL_HIST = f"with {_SQL_SCORES} select label, (case when s = 0 then 0 else ceil(round(s / 0.05, 9)) - 1 end)::bigint as bin, count(*)::bigint as n from sc where s between 0 and 1 group by all"


def q_difference_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores less those of the next row, in bins of a tenth."""
    s = _scores(spark, sf_dir)
    both = s.alias("a").join(s.alias("b"), F.col("a.vec_id") == F.col("b.vec_id") - 1).select((F.col("b.s") - F.col("a.s")).alias("d"))
    return evaluate.histogram_left(both, "d")


SQL_DIFF = f"""with {_SQL_SCORES}, d as (select b.s - a.s as d from sc a join sc b on a.vec_id = b.vec_id - 1), e as (select round(min(d), 1) as f, round(max(d), 1) as l from d),
p as (select least(floor(round((d - f) / 0.1, 9)), greatest(round((l - f) / 0.1, 0) - 1, 0)) as bin, f from d, e where d >= f and d <= l)
select bin::bigint as bin, round(min(f + bin * 0.1), 6) as low, count(*)::bigint as n from p group by bin"""


def q_decile_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of good and of toxic labels by tenths of the labelled documents in id order."""
    labels = table(spark, sf_dir, "labels")
    binned = evaluate.equal_bins(labels, [F.col("doc_id")])
    return binned.groupBy(F.col("bin").cast("bigint").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("accepted"), F.round(F.avg("toxic"), 6).alias("toxic"))


SQL_DECILE = """with r as (select *, row_number() over (order by doc_id) as k, count(*) over () as n from labels)
select least((k - 1) // (n // 10), 9)::bigint as bin, count(*)::bigint as n, round(avg(quality), 6) as accepted, round(avg(toxic), 6) as toxic from r group by 1"""


def q_pairwise_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities within lists of five vectors, as in calibrating an embedder."""
    v = _vectors(spark, sf_dir).withColumn("grp", F.floor(F.col("vec_id") / 5))
    return evaluate.pairwise_cosine(v, "grp", "vec_id", "embedding")


SQL_PAIRWISE = """with v as (select vec_id, vec_id // 5 as grp, cast(embedding as double[]) as e from embeddings), s as (select a.grp, list_cosine_similarity(a.e, b.e) as s from v a join v b on a.grp = b.grp and a.vec_id < b.vec_id)
select grp, count(*)::bigint as n_pairs, round(min(s), 6) as low, round(avg(s), 6) as mean, round(max(s), 6) as high from s group by grp"""


def q_ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell-partitioned index against every query whose id is divisible by 50: 12 of 16 cells, for a recall of 0.9."""
    v = _vectors(spark, sf_dir)
    index = search.VectorIndex(v, "vec_id", "embedding", "IndexIVFFlat", 16)
    return index.search(v.where("vec_id % 50 = 0"), "vec_id", "embedding", 10, 12).select("id", "neighbor", F.round("score", 6).alias("distance"))


QUERIES = {
    "q_knn_self": (q_knn_self, SQL_KNN), "q_mutual_pairs": (q_mutual_pairs, SQL_MUTUAL), "q_unique_candidates": (q_unique_candidates, SQL_UNIQUE), "q_dropped_candidates": (q_dropped_candidates, SQL_DROPPED),
    "q_knn_schema": (q_knn_schema, SQL_SCHEMA), "q_harmonized_docs": (q_harmonized_docs, SQL_HARMONIZED), "q_decision_log": (q_decision_log, SQL_LOG), "q_radius_search": (q_radius_search, SQL_RADIUS),
    "q_synonym_round": (q_synonym_round, SQL_SYNONYM), "q_synonym_fixpoint": (q_synonym_fixpoint, None), "q_greedy_matching": (q_greedy_matching, SQL_GREEDY), "q_components": (q_components, SQL_COMPONENTS),
    "q_force_merge": (q_force_merge, SQL_FORCE), "q_force_merge_lineage": (q_force_merge_lineage, SQL_FORCE_LINEAGE), "q_score_stats": (q_score_stats, SQL_SCORES), "q_similarity_histogram": (q_similarity_histogram, SQL_HIST),
    "q_difference_histogram": (q_difference_histogram, SQL_DIFF), "q_decile_acceptance": (q_decile_acceptance, SQL_DECILE), "q_pairwise_cosine": (q_pairwise_cosine, SQL_PAIRWISE), "q_ivf_search": (q_ivf_search, None),
}
