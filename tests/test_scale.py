"""What the findings of round 3 ask for: results that stay, beside memory and work that no longer grow faster than the input."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.operators import audit, grouping, merging, models
from lexloom.operators import neighbors as nn
from lexloom.plans import catalog
from lexloom.sources import sinks


def told(found):
    return {(r["id"], r["neighbor"], round(r["score"], 8)) for batch in found for r in batch.to_pylist()}


def met(q_ids, q, tables):
    rows = [{"task": 0, "asks": asks, "ids": ids.astype(np.int64).tobytes(), "data": np.ascontiguousarray(data).tobytes()} for asks, ids, data in [*((False, *t) for t in tables), (True, q_ids, q)]]
    return [pa.RecordBatch.from_pylist(rows)]


@pytest.mark.parametrize("seed", range(12))
def test_screened_search_is_exact(seed):
    """Ties, copies, vectors of zeros, lengths of all kinds: what single precision screens out is never among the best."""
    rng = np.random.default_rng(seed)
    metric, k, radius, alone = ("cosine", "l2")[seed % 2], (1, 3, 200, 5120)[seed % 4], (None, 0.5)[seed // 2 % 2], bool(seed // 4 % 2)
    t = rng.standard_normal((500, (1, 2, 64)[seed % 3])) * (0.01, 1, 30)[seed // 3 % 3] + (0, 100)[seed % 5 == 0]
    t[250:] = t[rng.integers(0, 60, 250)]
    t[:20] = 0
    if metric == "cosine":
        t = t / np.where((n := np.linalg.norm(t, axis=1, keepdims=True)) == 0, 1, n)
    ids, asked = rng.permutation(500), rng.permutation(500)[:40]
    want = set()
    for i in asked:
        near = np.round(t @ t[i] if metric == "cosine" else -((t - t[i]) ** 2).sum(1), 9)
        keep = [x for x in np.lexsort((ids, -near)) if not (alone and x == i) and (radius is None or (near[x] >= radius if metric == "cosine" else -near[x] <= radius))]
        want |= {(int(ids[i]), int(ids[x]), round(float(near[x] if metric == "cosine" else 0.0 - near[x]), 8)) for x in keep[:k]}
    assert told(nn._best(k, metric, alone, radius)(met(ids[asked], t[asked], [(ids[:200], t[:200]), (ids[200:], t[200:])]))) == want


def test_search_is_bounded_in_memory():
    """A block of queries that may have 5,120 rows each against three blocks: only what is in reach is held."""
    rng = np.random.default_rng(1)
    t = rng.standard_normal((3 * 4096, 64))
    tables = [(np.arange(x, x + 4096), t[x : x + 4096]) for x in range(0, len(t), 4096)]
    batches = met(np.arange(4096), t[:4096], tables)
    tracemalloc.start()
    found = told(nn._best(5120, "l2", False, 1.0)(batches))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == {(i, i, 0.0) for i in range(4096)} and peak < 150e6


def test_groups_of_blocks_meet_once(spark):
    """Every pair of blocks in one task, which holds a bounded number of them; the search is dealt out to many tasks."""
    v = spark.range(300).selectExpr("id", "array(cast(id as double), 1.0D) as vec")
    packed = nn.blocks(v, "id", "vec", rows=10)
    n = packed.count()
    rows = [tuple(r) for r in nn._dealt(packed, packed, False, meet=4, tasks=12).select("task", "asks", "ids").collect()]
    pairs = [(q[2], t[2]) for q in rows for t in rows if q[1] and not t[1] and q[0] == t[0]]
    assert len(pairs) == len(set(pairs)) == n * n
    sizes = [sum(r[0] == task and not r[1] for r in rows) for task in {r[0] for r in rows}]
    assert max(sizes) <= 4 and len(sizes) >= 12


def test_wide_vectors_make_small_blocks(spark):
    """A block's bytes, not only its rows, are bounded; texts come back under their ids, in more than one portion."""
    texts = spark.range(1200).selectExpr("id", "concat('t', id % 700) as text")
    made = models.embed_texts(texts.coalesce(1), "id", "text")
    sizes = [len(r.data) for r in nn.blocks(made, "id", "vec").collect()]
    assert sum(sizes) == 1200 * 1024 * 8 and max(sizes) < 1.5 * nn.BLOCK_BYTES
    rows = {r.id: r.vec for r in made.collect()}
    assert rows[0] == rows[700] and rows[1] == pytest.approx(models.RandomEmbedder().embed(["t1"])[0].tolist()) and len(rows) == 1200


def test_lists_run_out(spark, monkeypatch):
    """Merge rounds from kept lists of neighbours, short ones that run out, equal those that search for all rows again; and
    all rows are searched for once."""
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((120, 6)))]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    decide = lambda p: p.where("(a + b) % 3 <> 0").select("a", "b", "score", F.col("a").alias("keep"), F.col("b").alias("drop"))
    monkeypatch.setattr(merging, "LISTED", 2)
    asked, search = [], nn.top_k
    monkeypatch.setattr(nn, "top_k", lambda q, *a, **b: asked.append(sum(len(r.ids) // 8 for r in q.collect())) or search(q, *a, **b))
    kept, log = merging.merge_synonyms(df, decide, k=2, strategy="unique", least=0.2, max_iters=12)
    data = np.array([v for _, v in rows])
    sims = data / np.linalg.norm(data, axis=1, keepdims=True)
    sims, left, want = np.round(sims @ sims.T, 9), list(range(120)), []
    np.fill_diagonal(sims, -np.inf)
    for n in range(12):
        pairs = {(min(i, j), max(i, j)): sims[i, j] for i in left for j in sorted(set(left) - {i}, key=lambda j: (-sims[i, j], j))[:2]}
        used, gone = set(), []
        for s, a, b in sorted((-s, a, b) for (a, b), s in pairs.items() if s >= 0.2 and (a + b) % 3):
            if not {a, b} & used:
                used |= {a, b}
                gone.append((n, a, b))
        want += gone
        if not gone:
            break
        left = [i for i in left if i not in {b for _, _, b in gone}]
    assert sorted((r.iteration, r.keep, r["drop"]) for r in log.collect()) == sorted(want)
    assert sorted(r.id for r in kept.collect()) == left and len(left) < 60
    assert asked[0] == 120 and len(asked) > 1 and max(asked[1:]) < 90


@pytest.mark.parametrize("rounds, scan", [(30, 0), (1, 0), (30, 20), (30, 10_000)])
def test_matching_in_rounds_and_in_one_scan(spark, rounds, scan):
    rng = np.random.default_rng(5)
    edges = sorted({(int(a), int(b)): float(s) for a, b, s in zip(rng.integers(0, 30, 90), rng.integers(30, 60, 90), rng.integers(0, 9, 90) / 8)}.items(), key=lambda e: (-e[1], e[0]))
    used, want = set(), []
    for (a, b), s in edges:
        if not {a, b} & used:
            used |= {a, b}
            want.append((a, b, s))
    df = spark.createDataFrame([(a, b, s) for (a, b), s in edges], "a long, b long, score double")
    assert sorted(map(tuple, merging.greedy_matching(df, rounds, scan).collect())) == sorted(want)


def test_batches_in_few_jobs(spark, tmp_path):
    """As many batches as there are keys in a few jobs; those that are there stay, ended, absent and empty ones are written once."""
    path, df = str(tmp_path / "out"), spark.range(600).where("id not between 330 and 334").selectExpr("id", "if(id = 7, null, concat('t', id)) as t")
    ran = lambda: spark._jsc.sc().dagScheduler().nextJobId()
    assert sinks.append_batches(df, path, "id", 3, upto=2) == 2
    (tmp_path / "out/batch=0/part-x.json").write_text('{"id":-1,"t":"kept"}\n')
    (tmp_path / "out/batch=5/_temporary").mkdir(parents=True)
    (tmp_path / "out/batch=5/part-half.json").write_text('{"id":15,"t":"t15"}\n')
    before = ran()
    assert sinks.append_batches(df, path, "id", 3) == 198 and ran() - before < 30
    assert sinks.append_batches(df, path, "id", 3) == 0
    got = spark.read.schema("id bigint, t string, batch int").json(path)
    assert got.where("id < 0").count() == 1 and sorted(map(tuple, got.where("id >= 0").collect())) == [(i, None if i == 7 else f"t{i}", i // 3) for i in range(600) if not 330 <= i <= 334]
    assert all(len(list(tmp_path.glob(f"out/batch={b}/part-*.json"))) == 1 for b in (1, 5, 99))


def test_rows_are_compared_in_bounded_tasks(spark, monkeypatch):
    """However few the tasks of a side are, its rows are dealt out before they are counted; nulls, NaN and zeros are values."""
    monkeypatch.setattr(audit, "COUNTED_ROWS", 1000)
    a = spark.range(6000).selectExpr("id % 2500 as k", "if(id % 7 = 0, null, id % 3) as v", "if(id % 5 = 0, double('NaN'), if(id % 2 = 0, 0D, -0D)) as `x.y`")
    seen, deal = [], type(a).repartition
    monkeypatch.setattr(type(a), "repartition", lambda self, n, *cols: seen.append(n) or deal(self, n, *cols))
    assert audit.same_multiset(a, a.orderBy("v").coalesce(1)) and seen == [12]
    assert not audit.same_multiset(a, a.union(a.limit(1))) and not audit.same_multiset(a.where("k = 1 or v = 1"), a.where("k = 1 or v = 2"))
    twice = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert not audit.same_multiset(twice, spark.createDataFrame([(1,), (2,), (2,)], "k int")) and audit.same_multiset(twice.limit(0), twice.limit(0))


def test_texts_are_embedded_once_in_portions(monkeypatch):
    calls = []

    class Counted(models.RandomEmbedder):
        def embed(self, texts):
            calls.append(len(texts))
            return super().embed(texts)

    monkeypatch.setattr(models, "KEPT_TEXTS", 40)
    kept, plain = models._Embedded(Counted(16)), models.RandomEmbedder(16)
    for texts in (["a", "b", "a"], [f"t{i % 30}" for i in range(300)], ["b", "a", "a"], [f"u{i}" for i in range(100)], ["a"]):
        assert (kept.embed(texts) == plain.embed(texts)).all()
    assert calls == [2, 30, 100, 1] and len(kept.kept) == 1


def test_settled_groups_stay_where_they_are(spark, monkeypatch):
    """Of a frontier only the rows of groups that go on are written again."""
    rows = [(f"d{i}", f"e {i}", f"s{i}") for i in range(2000)] + [(f"g{i % 10}", f"{'xyz'[i % 3]} {i}", f"m{i}") for i in range(60)]
    written, store = {}, grouping.stored
    monkeypatch.setattr(grouping, "stored", lambda df, label, *a: [found := store(df, label, *a), written.setdefault(label, []).append(found.count())][0])
    finals, _ = grouping.disambiguate(spark.createDataFrame(rows, "descriptor string, explainer string, id string"))
    got = finals.collect()
    assert sorted(r.descriptor for r in got) == sorted([f"d{i}" for i in range(2000)] + [f"g{i} / {c}" for i in range(10) for c in "xyz"])
    assert written["frontier"][0] == 2060 and sum(n for label, counts in written.items() for n in counts) - 2060 < 300


def test_a_decision_log_searches_once(spark):
    plan = catalog.queries()["q_decision_log"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
