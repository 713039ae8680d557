"""Operators against plain Python on small and random inputs, with their edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.functions import vector
from lexloom.operators import annotate, audit, evaluate, export, grouping, harmonize, lineage, merging, models, search
from lexloom.operators import neighbors as nn
from lexloom.plans.components import connected_components


def test_best_round(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, [["a"], ["b"]], [0.5, 0.5]), (1, [["a"], ["b"]], [0.1, nan]), (2, [["a"], ["b"]], []), (3, [], [])], "i int, d array<array<string>>, s array<double>")
    got = {r.i: (r.b, r.f, r.a) for r in df.select("i", annotate.best_index("s").alias("b"), annotate.best_round("d", "s").alias("f"), annotate.best_round("d", "s", "all").alias("a")).collect()}
    assert got == {0: (0, ["a"], ["a"]), 1: (1, ["b"], ["b"]), 2: (None, ["a"], ["a", "b"]), 3: (None, None, [])}
    with pytest.raises(Exception, match="no similarities"):
        df.select(annotate.best_round("d", "s", "error")).collect()


def test_growth_keeps_batches_without_news(spark):
    df = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (2, "c")], "batch long, descriptor string")
    assert sorted(map(tuple, annotate.growth(df).collect())) == [(0, 2, 2), (1, 0, 2), (2, 1, 3)]


def components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(28)] + [(99, 99)] + [(200 + k, 201 + k) for k in range(30)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges + edges[:3], "a long, b long")).collect()))
    assert got == components(edges)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def greedy(edges):
    used, out = set(), []
    for a, b, s in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if a not in used and b not in used:
            used |= {a, b}
            out.append((a, b, s))
    return sorted(out)


@pytest.mark.parametrize("rounds", [30, 1])
def test_greedy_matching(spark, rounds):
    rng = random.Random(5)
    edges = list({(a, b): (a, b, rng.randrange(5) / 4) for a, b in ((rng.randrange(20), 20 + rng.randrange(20)) for _ in range(60))}.values())
    df = spark.createDataFrame(edges + [(1, 1, 9.0), (50, 51, float("nan")), (52, 53, None)], "a long, b long, score double")
    assert sorted(map(tuple, merging.greedy_matching(df, rounds).collect())) == greedy(edges)


def test_neighbors(spark):
    rng = np.random.default_rng(1)
    data = rng.standard_normal((60, 5))
    data[7] = data[3]
    data[9] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)] + [(99, None)], "id long, vec array<double>")
    unit = data / np.where(np.linalg.norm(data, axis=1, keepdims=True) == 0, 1, np.linalg.norm(data, axis=1, keepdims=True))
    sims = np.round(unit @ unit.T, 9)
    np.fill_diagonal(sims, -np.inf)
    want = {(i, int(j)) for i in range(60) for j in sorted(range(60), key=lambda j: (-sims[i, j], j))[:4]}
    packed = nn.blocks(df, "id", "vec", rows=16)
    near = nn.top_k(packed, packed, 4, exclude_self=True)
    assert {(r.id, r.neighbor) for r in near.collect()} == want
    far = ((data[:, None] - data[None]) ** 2).sum(-1)
    two = nn.blocks(df, "id", "vec", "l2", rows=16)
    got = {(r.id, r.neighbor) for r in nn.radius_search(two, two, 60, 2.0, 0).collect()}
    assert got == {(i, j) for i in range(60) for j in range(60) if far[i, j] <= 2.0}


def test_index_recall_and_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    data = rng.standard_normal((400, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, vec array<double>")
    queries = df.where("id % 50 = 0")
    flat = search.VectorIndex(df, "id", "vec")
    exact = {(r.id, r.neighbor) for r in flat.search(queries, "id", "vec", 10).collect()}
    index = search.VectorIndex(df, "id", "vec", "IndexIVFFlat", 8)
    found = {(r.id, r.neighbor) for r in index.search(queries, "id", "vec", 10, 6).collect()}
    assert len(found & exact) / len(exact) >= 0.9
    index.save(str(tmp_path / "index"))
    again = search.VectorIndex.load(spark, str(tmp_path / "index"))
    assert {(r.id, r.neighbor) for r in again.search(queries, "id", "vec", 10, 6).collect()} == found
    with pytest.raises(ValueError):
        search.VectorIndex(df, "id", "vec", "Other")


def test_disambiguate_settles(spark):
    rows = [("a", "x one", "1"), ("a", "x two", "2"), ("a", "y one", "3"), ("b", "z", "4"), ("c", "q 1", "5"), ("c", "q 2", "6")]
    finals, edges = grouping.disambiguate(spark.createDataFrame(rows, "descriptor string, explainer string, id string"))
    made = finals.collect()
    assert sorted(r.descriptor for r in made) == ["a / x", "a / y", "b", "c"]
    starts = finals.select(F.col("id").alias("start"))
    found = lineage.roots(starts, edges.select(F.col("id").alias("dst"), F.col("source_id").alias("src")))
    assert sorted(r.root for r in found.collect()) == ["1", "2", "3", "4", "5", "6"]


def test_repair(spark):
    members = spark.createDataFrame([("c", i, i, t) for i, t in enumerate(["red fox", "red dog", "blue sea", "blue sky fox"])] + [("d", 9, 0, "only")], "chunk string, id long, pos long, explainer string")
    answers = spark.createDataFrame([("c", 0, 0, 0, "red animal"), ("c", 0, 1, 7, "red animal"), ("c", 1, 0, 2, "blue thing"), ("c", 1, 1, 0, "blue thing"), ("c", 2, 0, 8, "nothing")], "chunk string, grp long, pos long, id long, text string")
    got = {(r.chunk, r.id): (r.grp, r.text) for r in grouping.repair(members, answers).collect()}
    assert got == {("c", 0): (0, "red animal"), ("c", 1): (0, "red animal"), ("c", 2): (1, "blue thing"), ("c", 3): (1, "blue thing"), ("d", 9): (0, "only")}


def test_lineage_on_a_diamond(spark):
    edges = spark.createDataFrame([("f", "a"), ("f", "b"), ("a", "r"), ("b", "r"), ("b", "s")], "dst string, src string")
    starts, counts = spark.createDataFrame([("f",)], "start string"), spark.createDataFrame([("r", 5), ("s", 2)], "id string, n long")
    assert tuple(lineage.root_weights(lineage.roots(starts, edges), counts).first()) == ("f", 2, 7)
    assert tuple(lineage.path_weights(starts, edges, counts).first()) == ("f", 2, 12)
    loop = edges.union(spark.createDataFrame([("r", "f")], "dst string, src string"))
    assert lineage.reach(starts, loop).count() == 5
    with pytest.raises(RuntimeError):
        lineage.path_weights(starts, loop, counts, max_rounds=6)


def test_path_weights_keep_a_merged_original(spark):
    edges = spark.createDataFrame([("k", "d")], "dst string, src string")
    starts, counts = spark.createDataFrame([("k",)], "start string"), spark.createDataFrame([("k", 3), ("d", 4)], "id string, n long")
    assert tuple(lineage.path_weights(starts, edges, counts, keep_self=True).first()) == ("k", 2, 7)
    assert tuple(lineage.path_weights(starts, edges, counts).first()) == ("k", 1, 4)


def test_audit_rules(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    events = spark.createDataFrame([("x", "a"), ("x", "b")], "dst string, src string")
    assert audit.lineage_audit(ids, events, spark.createDataFrame([("x",)], "id string")).count() == 0
    broken = events.union(spark.createDataFrame([("y", "a"), ("z", "q"), ("w", "q")], "dst string, src string"))
    found = audit.lineage_audit(ids.union(spark.createDataFrame([("c",)], "id string")), broken, spark.createDataFrame([("x",), ("x",), ("n",)], "id string"))
    assert {r.rule for r in found.collect()} == {"missing", "unknown_source", "untraceable", "repeated_final", "dropped", "several_targets", "same_sources"}


def test_synonyms_to_the_fixpoint(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [1.0, 0.02]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    decide = lambda p: p.where("a <> 3 and b <> 3").select("a", "b", "score", F.col("a").alias("keep"), F.col("b").alias("drop"))
    kept, log = merging.merge_synonyms(df, decide, strategy="unique", k=2)
    assert len(kept.collect()) == 2 and log.count() == 2
    assert len({r.cluster for r in merging.merge_clusters(log).collect()}) == 1


def test_force_merge(spark):
    df = spark.createDataFrame([("1", "a ", "long one"), ("2", "a", "short"), ("3", "A", "x")], "id string, descriptor string, explainer string")
    kept, log = merging.force_merge(df)
    assert sorted((r.descriptor, r.id, r.n_members) for r in kept.collect()) == [("A", "3", 1), ("a", "2", 2)]
    assert [tuple(r) for r in log.collect()] == [("2", "1", "a")]


def test_harmonize(spark):
    found = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2), (2, 10, 0.1, 1)], "id long, neighbor long, score double, rank int")
    assert dict(map(tuple, harmonize.choose_by_score(found, 0.5).collect())) == {1: 10, 2: None}
    answers = spark.createDataFrame([(1, 7), (2, None)], "id long, answer int")
    assert dict(map(tuple, harmonize.choose_by_index(found, answers).collect())) == {1: 10, 2: None}
    texts = spark.createDataFrame([(1, "q"), (2, "r")], "id long, text string")
    empty = spark.createDataFrame([], "key string, chosen long")
    first, cache = harmonize.decide_cached(found, texts, empty, lambda f: harmonize.choose_by_score(f, 0.5))
    second, more = harmonize.decide_cached(found, texts, cache, lambda f: harmonize.choose_by_score(f.limit(0), 0.5))
    assert sorted(map(tuple, first.collect()), key=str) == sorted(map(tuple, second.collect()), key=str) and more.count() == 0
    owners = spark.createDataFrame([("d", 0, 1), ("d", 1, 1), ("e", 0, 2)], "doc_id string, pos int, id long")
    schema = spark.createDataFrame([(10, "x", "y")], "id long, descriptor string, explainer string")
    docs = dict(map(tuple, harmonize.harmonized_documents(owners, first, schema).collect()))
    assert docs == {"d": ["x; y"], "e": []}


def test_histograms_and_bins(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.05, 0.050001, 1.0, -0.1)], "v double")
    assert sorted(map(tuple, evaluate.histogram_right(df, "v").collect())) == [(0, 2), (1, 1), (19, 1)]
    left = spark.createDataFrame([(x / 10,) for x in range(6)], "v double")
    assert sorted((r.bin, r.n) for r in evaluate.histogram_left(left, "v").collect()) == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 2)]
    rows = spark.createDataFrame([(i,) for i in range(25)], "i int")
    sizes = dict(map(tuple, evaluate.equal_bins(rows, [F.col("i")]).groupBy("bin").count().collect()))
    assert [sizes[b] for b in range(10)] == [2] * 9 + [7]


def test_export(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    assert export.sample_exactly(df, "k", 10, 0.5, 3).collect() == export.sample_exactly(df, "k", 10, 0.5, 3).collect()
    assert export.sample_exactly(df, "k", 5000).count() == 1000
    shares = dict(map(tuple, export.split_rows(df, "k", 0.2, 0.1).groupBy("split").count().collect()))
    assert abs(shares["test"] - 200) < 50 and abs(shares["validation"] - 100) < 40
    assert export.sample_forecast(10, 5, 50, 100) == (100, "ok") and export.sample_forecast(10, 5, 5, 100)[1] == "too few"


def test_models_repeat(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id long, text string")
    rows = {r.id: r.vec for r in models.embed_texts(df, "id", "text").collect()}
    assert rows[1] == rows[2] != rows[3] and abs(np.linalg.norm(rows[1]) - 1) < 1e-5
    made = models.annotate_documents(df, "text", 2).collect()
    assert all(len(r.descriptors) == len(r.similarity) == 2 for r in made)
    assert all(r.similarity == [] for r in models.annotate_documents(df, "text", 0).collect())


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    row = df.select(vector.cosine("a", "a").alias("c"), vector.cosine("a", "b").alias("z"), vector.squared_l2("a", "b").alias("d"), vector.l2_normalize("a").alias("n")).first()
    assert row.c == pytest.approx(1) and row.z is None and row.d == 25 and row.n == pytest.approx([0.6, 0.8])


def test_threshold_groups(spark):
    from lexloom.operators import clusters

    rng = random.Random(8)
    pairs = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)}
    linked = {(a, b) for a, b in pairs} | {(b, a) for a, b in pairs}
    want, grouped = {}, set()
    for i in range(30):
        if i not in grouped:
            members = {j for j in range(30) if j not in grouped and (j == i or (i, j) in linked)}
            want |= dict.fromkeys(members, i)
            grouped |= members
    ids = spark.createDataFrame([(i,) for i in range(30)], "id long")
    got = clusters.threshold_groups(ids, spark.createDataFrame(list(pairs), "a long, b long"))
    assert dict(map(tuple, got.collect())) == want
    none = spark.createDataFrame([], "a long, b long")
    assert dict(map(tuple, clusters.threshold_groups(ids.limit(2), none).collect())) == {0: 0, 1: 1}
