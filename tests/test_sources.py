"""Readers, sinks and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from lexloom.sources import readers, sinks
from lexloom.streaming import vocabulary


def put(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(path)


def test_documents_by_suffix(spark, tmp_path):
    tsv = put(tmp_path / "a.tsv", ["l\t1\t text ", "bad line", "l\t2\tb"])
    assert sorted(map(tuple, readers.read_documents(spark, tsv).collect())) == [("1", "text"), ("2", "b")]
    jsonl = put(tmp_path / "a.jsonl", [{"id": "1", "text": "x"}, "", {"id": "2", "text": "y"}])
    assert readers.read_documents(spark, jsonl).count() == 2
    sinks.parquet_to_jsonl(spark, "/root/testdata/sf0.001/labels.parquet", str(tmp_path / "out.jsonl"))
    assert readers.read_documents(spark, str(tmp_path / "out.jsonl")).count() == 87
    with pytest.raises(ValueError):
        readers.read_documents(spark, "x.bin")


def test_strict_and_lenient(spark, tmp_path):
    path = put(tmp_path / "b.jsonl", [{"id": "1"}, "{broken", {"id": "1"}])
    assert readers.read_ids(spark, path).count() == 1
    with pytest.raises(Exception):
        readers.read_jsonl(spark, path, "id string").collect()
    with pytest.raises(ValueError):
        readers.read_jsonl(spark, put(tmp_path / "c.jsonl", [{"id": "1"}, "", {"id": "2"}]), "id string", blank_lines=False)
    assert readers.read_many_jsonl(spark, [str(tmp_path / "none"), put(tmp_path / "d.jsonl", [{"id": "1"}])], "id string").count() == 1


def test_pairs_and_groups(spark, tmp_path):
    good = {"id": "1", "descriptor": "d", "explainer": "e"}
    assert readers.read_pairs(spark, put(tmp_path / "p.jsonl", [good])).count() == 1
    with pytest.raises(Exception, match="empty field"):
        readers.read_pairs(spark, put(tmp_path / "q.jsonl", [good, good | {"explainer": " "}])).collect()
    group = {"descriptor": "d", "explainers": [{"id": "1", "explainer": "a"}]}
    assert readers.read_grouped(spark, put(tmp_path / "g.jsonl", [group])).count() == 1
    with pytest.raises(ValueError):
        readers.read_grouped(spark, put(tmp_path / "h.jsonl", [group, group]))


def test_lineage_and_finals(spark, tmp_path):
    put(tmp_path / "full_lineage.jsonl", [{"new_pair_id": "x", "source_pair_ids": ["a", "b"]}, "", {"new_pair_id": "y", "source_pair_ids": "x"}])
    assert sorted(map(tuple, readers.read_lineage(spark, str(tmp_path)).collect())) == [("x", "a", 0), ("x", "b", 0), ("y", "x", 2)]
    path = put(tmp_path / "f.jsonl", [{"id": "1", "descriptor": "a", "explainer": "e"}, {"id": "1", "final_descriptor": "b", "group_explainer": "g"}])
    assert tuple(readers.read_finals(spark, [path]).first()) == ("1", "b", "g")
    assert tuple(readers.read_finals(spark, [path], "first").first()) == ("1", "a", "e")


def test_annotated_reader(spark):
    rows = [("1", "t", [["a; b", "c"]], [0.1], None), ("2", "u", [["x"]], [0.1], ["h; i"]), ("3", "", [["x"]], [0.1], None), ("4", "v", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string, descriptors array<array<string>>, similarity array<double>, harmonized_descriptors array<string>")
    got = sorted((r.doc_id, r.pos, r.descriptor, r.explainer) for r in readers.annotated(df).collect())
    assert got == [("1", 0, "a", "b"), ("1", 1, "c", ""), ("2", 0, "h", "i")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("é", None)], "descriptor string, n long")
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert any('"n":null' in r[0] and "é" in r[0] for r in spark.read.text(str(tmp_path / "j")).collect())
    sinks.write_vocabulary(df.where("n is not null"), str(tmp_path / "v"))
    assert sorted(map(tuple, readers.read_vocabulary(spark, str(tmp_path / "v")).collect())) == [("a", 2), ("b", 2)]
    assert sinks.write_marker(df.limit(0), str(tmp_path / "ok")) and not sinks.write_marker(df, str(tmp_path / "bad"))
    assert readers.exists(spark, str(tmp_path / "ok/passed")) and readers.exists(spark, str(tmp_path / "bad/failed"))
    vec = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id long, vec array<double>")
    sinks.write_embeddings(vec, str(tmp_path / "e"), "m")
    assert sinks.read_embeddings(spark, str(tmp_path / "e"), "m", vec.select("id")).count() == 2
    assert sinks.read_embeddings(spark, str(tmp_path / "e"), "other", vec.select("id")) is None
    assert readers.line_counts(spark, str(tmp_path / "v")).agg(F.sum("n")).first()[0] == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a; x",), ("b",), ("a",), ("c",)]
    for k in range(2):
        spark.createDataFrame(rows[2 * k : 2 * k + 2], "descriptor string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: vocabulary.document_stream(spark, str(tmp_path / "in"), "descriptor string")
    vocabulary.start_vocabulary(stream(), str(tmp_path / "v"), str(tmp_path / "c1")).awaitTermination()
    assert dict(map(tuple, vocabulary.vocabulary_so_far(spark, str(tmp_path / "v")).collect())) == {"a": 2, "b": 1, "c": 1}
    vocabulary.start_growth(stream(), str(tmp_path / "g"), str(tmp_path / "c2")).awaitTermination()
    assert sorted(r.descriptor for r in spark.read.parquet(str(tmp_path / "g")).collect()) == ["a", "b", "c"]
