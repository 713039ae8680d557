"""Readers, ranks, splits, searches and the queries that SQL cannot express, against plain Python."""

import math
import warnings

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.operators import export, grouping, models, prompts, search
from lexloom.plans import catalog, shared
from lexloom.plans.ranks import ranked, ranked_within
from lexloom.sources import readers, sinks

SF = "/root/testdata/sf0.001"


def lines(path, *rows):
    path.write_text("\n".join(rows) + "\n")
    return str(path)


def test_documents_by_name(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.read_documents(spark, str(tmp_path / "missing.jsonl"))
    with pytest.raises(ValueError):
        readers.read_documents(spark, "no_such_table")
    spark.range(3).createOrReplaceTempView("some_documents")
    assert readers.read_documents(spark, "some_documents").count() == 3


def test_lines_are_numbered_over_files(spark, tmp_path):
    spark.range(1000).repartitionByRange(5, "id").sortWithinPartitions("id").selectExpr("cast(id as string) as value").write.text(str(tmp_path / "t"))
    got = dict((int(r.value), r.line) for r in readers.with_line_numbers(spark, str(tmp_path / "t")).collect())
    assert got == {i: i for i in range(1000)}
    whole = lines(tmp_path / "one", "a", "", "b")
    assert sorted((r.line, r.value) for r in readers.with_line_numbers(spark, whole).collect()) == [(0, "a"), (1, ""), (2, "b")]


def test_strict_readers(spark, tmp_path):
    bad = lines(tmp_path / "bad.jsonl", '{"id": "1", "descriptor": "a", "explainer": "b"}', "", "{oops", '{"id": "2", "descriptor": " ", "explainer": "b"}')
    assert [tuple(r) for r in readers.bad_lines(spark, bad).collect()] == [(3, "{oops")]
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_pairs(spark, bad).collect()
    assert readers.read_pairs(spark, bad, 1).count() == 1
    empty = lines(tmp_path / "empty.jsonl", '{"id": "2", "descriptor": " ", "explainer": "b"}')
    with pytest.raises(Exception, match="empty field"):
        readers.read_pairs(spark, empty).collect()
    twice = lines(tmp_path / "twice.jsonl", '{"descriptor": "A", "explainers": [{"id": "1", "explainer": "x"}, {"id": "1", "explainer": "y"}]}')
    with pytest.raises(ValueError):
        readers.read_grouped(spark, twice)
    with warnings.catch_warnings(record=True) as found:
        warnings.simplefilter("always")
        assert readers.read_many_jsonl(spark, [empty, str(tmp_path / "none")]).count() == 1
    assert any("does not exist" in str(w.message) for w in found)
    with pytest.raises(FileNotFoundError):
        readers.read_lineage(spark, str(tmp_path))


def test_arrow_folder(spark, tmp_path):
    table = pa.table({"b": ["x", "y", "z"], "a": pa.array([1, 2, None], pa.int64()), "c": [1.0, 2.0, 3.0]})
    (tmp_path / "d").mkdir()
    with pa.OSFile(str(tmp_path / "d" / "one.arrow"), "wb") as f, pa.ipc.new_file(f, table.schema) as out:
        out.write_table(table, max_chunksize=2)
    with pa.OSFile(str(tmp_path / "d" / "two.arrow"), "wb") as f, pa.ipc.new_stream(f, table.schema) as out:
        out.write_table(table)
    got = [tuple(r) for r in readers.read_arrow_folder(spark, str(tmp_path), "a bigint, b string").collect()]
    assert sorted(got, key=str) == sorted([(1, "x"), (2, "y"), (None, "z")] * 2, key=str)
    assert [p.rsplit("/", 1)[1] for p in readers.list_files(spark, str(tmp_path), "*.arrow")] == ["one.arrow", "two.arrow"]


def test_resumed_sink_keeps_what_is_there(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(25)
    assert sinks.append_batches(df, path, "id", 10, upto=1) == 1
    assert sinks.append_batches(df, path, "id", 10) == 2 and sinks.append_batches(df, path, "id", 10) == 0
    assert readers.lines_done(spark, f"{path}/*") == 25 and readers.lines_done(spark, str(tmp_path / "none")) == 0
    assert sinks.append_batches(df.limit(0), str(tmp_path / "empty"), "id", 10) == 0


def test_ranks(spark):
    rows = [(None if i % 13 == 0 else "hot" if i % 3 else str(i % 5), (i * 37) % 101, i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v int, id int").repartition(7)
    key = lambda r: (r[0] is not None, r[0] or "", r[1], r[2])
    every = sorted(rows, key=key)
    got = {r.id: r.place for r in ranked(df, ["k", "v", "id"], "place").collect()}
    assert got == {r[2]: n for n, r in enumerate(every)}
    want, seen = {}, {}
    for r in every:
        want[r[2]] = seen.setdefault(r[0], 0)
        seen[r[0]] += 1
    assert {r.id: r.place for r in ranked_within(df, ["k"], ["v", "id"], "place").collect()} == want
    assert ranked(df.limit(0), ["id"], "place").count() == 0


def test_parts_of_near_equal_size(spark):
    for n, parts in ((10, 4), (3, 5), (0, 2)):
        got = sorted(r["count"] for r in export.near_equal_parts(spark.range(n), parts, ["id"]).groupBy("part").count().collect())
        assert got == sorted(x for x in (n // parts + (k < n % parts) for k in range(parts)) if x)


def test_exact_splits_check_their_sizes(spark):
    with pytest.raises(ValueError):
        export.split_exactly(spark.range(10), "id", 5, 5)
    got = {r.split: r["count"] for r in export.split_exactly(spark.range(100), "id", 10, 20).groupBy("split").count().collect()}
    assert got == {"test": 10, "validation": 20, "train": 70}
    assert export.at_most(spark.range(5), "missing", 3).count() == 5


def test_prompts_need_their_fields(spark):
    with pytest.raises(KeyError):
        prompts.render("synonym", a=F.lit("x"))
    made = spark.range(1).select(prompts.render("keep", descriptor=F.lit(None), roster=prompts.roster(F.array(F.lit("x"), F.lit("y")))).alias("p")).first().p
    assert "[0] x\n[1] y" in made
    with pytest.raises(ValueError):
        models.judge_examples(spark.range(1), "other")


def test_events_are_validated(spark):
    df = spark.createDataFrame([("d", "e", ["b", "a", "b"])], "descriptor string, explainer string, sources array<string>")
    assert grouping.merge_events(df).first().source_pair_ids == ["a", "b"]
    for row in ((" ", "e", ["a"]), ("d", "e", []), ("d", "e", [None])):
        with pytest.raises(Exception, match="lacks"):
            grouping.merge_events(spark.createDataFrame([row], df.schema)).collect()


def test_index_is_kept_or_made_anew(spark, tmp_path):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    path = str(tmp_path / "index")
    made = search.VectorIndex.ensure(v, "vec_id", "embedding", path, "IndexIVFFlat", 6)
    kept = search.VectorIndex.ensure(v.limit(0), "vec_id", "embedding", path, "IndexIVFFlat", 6)
    assert kept.cells.count() == made.cells.count() == v.count() and np.allclose(kept.centers, made.centers)
    assert search.VectorIndex.ensure(v.where("vec_id < 9"), "vec_id", "embedding", path, "FlatL2").vectors.count() == 9
    assert search.VectorIndex.ensure(v, "vec_id", "embedding", path, "FlatL2", rebuild=True).vectors.count() == v.count()


def test_shared_folder_and_sizes(spark):
    df = shared.stored(spark.range(1000).withColumn("s", F.lit("x" * 92)), "probe")
    assert shared.bytes_of(df) == 1000 * 108
    assert "broadcast" in shared.small(df)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in shared.small(df, 1000)._jdf.queryExecution().logical().toString().lower()
    assert shared.bytes_of(df.limit(0)) == 0


# queries that SQL cannot express


def test_every_query_has_a_reference():
    """The others are compared with their SQL."""
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"q_disambiguate", "q_synonym_fixpoint", "q_ivf_search", "q_generated_annotations"}


def unit(rows):
    data = np.array([r.embedding for r in rows], np.float64)
    return data / np.linalg.norm(data, axis=1, keepdims=True)


def test_ivf_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    data, ids = np.array([r.embedding for r in rows], np.float64), [r.vec_id for r in rows]
    found = {}
    for r in catalog.queries()["q_ivf_search"](spark, SF).collect():
        found.setdefault(r.id, set()).add(r.neighbor)
    hits = total = 0
    for k, i in enumerate(ids):
        if i % 50 == 0:
            near = np.argsort(((data - data[k]) ** 2).sum(1).round(9), kind="stable")[:10]
            hits += len(found[i] & {ids[n] for n in near})
            total += 10
    assert total and hits / total >= 0.9


def test_synonym_fixpoint_equals_the_sequential_rounds(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    label, left, parent = {r.vec_id: r.label for r in rows}, list(rows), {r.vec_id: r.vec_id for r in rows}
    for _ in range(20):
        data, ids = unit(left), [r.vec_id for r in left]
        sims = np.round(data @ data.T, 9)
        np.fill_diagonal(sims, -math.inf)
        pairs = {}
        for k, i in enumerate(ids):
            for n in sorted(range(len(ids)), key=lambda n: (-sims[k, n], ids[n]))[:3]:
                if n != k:
                    key = (min(i, ids[n]), max(i, ids[n]))
                    pairs[key] = max(pairs.get(key, -9.0), sims[k, n])
        said = sorted(((-s, a, b) for (a, b), s in pairs.items() if s >= 0.35 and label[a] == label[b]))
        used, gone = set(), set()
        for _, a, b in said:
            if a not in used and b not in used:
                used |= {a, b}
                gone.add(b)
                parent[b] = a
        if not gone:
            break
        left = [r for r in left if r.vec_id not in gone]

    def root(x):
        return x if parent[x] == x else root(parent[x])

    sets = {}
    for x in parent:
        sets.setdefault(root(x), set()).add(x)
    want = {m: min(s) for s in sets.values() if len(s) > 1 for m in s}
    assert {r.member: r.cluster for r in catalog.queries()["q_synonym_fixpoint"](spark, SF).collect()} == want


def test_generated_annotations_equal_the_models(spark):
    echo, embedder = models.EchoModel(), models.RandomEmbedder()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.rounds, r.best) for r in catalog.queries()["q_generated_annotations"](spark, SF).collect()}
    for i, text in texts.items():
        own, cur, said, sims = embedder.embed([text or ""])[0], text or "", [], []
        for _ in range(2):
            said.append(echo.generate([cur])[0])
            cur = said[-1].split(";", 1)[-1].strip()
            sims.append(round(float((embedder.embed([cur])[0] * own).sum()), 4))
        assert got[i] == (2, said[int(np.argmax(sims))])


def test_disambiguation_accounts_for_every_pair(spark):
    """Finals have distinct descriptors within what one descriptor was taken apart into, and lineage leads back to all pairs."""
    from lexloom.plans.q_text import pairs_of

    pairs = {r.id: r for r in pairs_of(spark, SF).collect()}
    finals, events = grouping.disambiguate(pairs_of(spark, SF).select("descriptor", "explainer", "id"))
    finals, sources = finals.collect(), {}
    for e in events.collect():
        sources.setdefault(e.id, set()).add(e.source_id)

    def roots(x):
        return set().union(*(roots(s) for s in sources[x])) if x in sources else {x}

    ends = {f.id: roots(f.id) for f in finals}
    every = [r for s in ends.values() for r in s]
    assert sorted(every) == sorted(pairs) and len(ends) == len(finals)
    parents = {}
    for f in finals:
        (parent,) = {pairs[r].descriptor for r in ends[f.id]}
        parents.setdefault(parent, []).append(f.descriptor)
    assert all(len(set(d)) == len(d) for d in parents.values())
    assert {r.id for r in catalog.queries()["q_disambiguate"](spark, SF).collect()} == set(ends)
