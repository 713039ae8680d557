"""The seam to models: small interfaces with deterministic stand-ins, so that results repeat without a GPU or network.

A model is called in Arrow batches; it is loaded once per worker, by its factory, and never travels with the plan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import answer_label, decision_key, vocab_descriptor
from lexloom.operators import prompts
from lexloom.operators.annotate import best_round
from lexloom.operators.export import hash_unit
from lexloom.plans.shared import stored


class Embedder(Protocol):
    width: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class TextModel(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class RandomEmbedder:
    """A normal vector per text, seeded by its SHA-256, of length 1; equal texts have equal vectors."""

    def __init__(self, width: int = 1024) -> None:
        self.width = width

    def embed(self, texts: list[str]) -> np.ndarray:
        rows = [np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "little")).standard_normal(self.width) for t in texts]
        data = np.array(rows, np.float32).reshape(len(texts), self.width)
        return data / (np.linalg.norm(data, axis=1, keepdims=True) + 1e-12)


class EchoModel:
    """A stand-in generator: the first words of a prompt's last line as a descriptor, with that line."""

    def generate(self, prompts: list[str]) -> list[str]:
        last = [p.rstrip().rsplit("\n", 1)[-1].strip() for p in prompts]
        return [f"{' '.join(x.split()[:3]).lower()}; {x}" for x in last]


#: Texts whose vectors are made at once.
EMBEDDED_ROWS = 512
#: Texts whose vectors a task keeps.
KEPT_TEXTS = 4096
#: Rows of a small table that a task should take through a model.
ROWS_A_TASK = 20_000


@cache
def _loaded(factory: Callable[[], object]) -> object:
    return factory()


def embed_texts(df: DataFrame, id_col: str, text_col: str, factory: Callable[[], Embedder] = RandomEmbedder) -> DataFrame:
    """(id, vec) of each row's text; null counts as empty. A text that rows share should come here once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(factory)
        for batch in batches:
            for at in range(0, batch.num_rows, EMBEDDED_ROWS):
                part = batch.slice(at, EMBEDDED_ROWS)
                data = model.embed(part.column("text").to_pylist()).astype(np.float32)
                ends = pa.array(np.arange(len(data) + 1) * data.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(ends, pa.array(data.ravel()))], names=["id", "vec"])

    base = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return base.mapInArrow(run, f"id {dict(base.dtypes)['id']}, vec array<float>")


def generate(df: DataFrame, prompt: str, factory: Callable[[], TextModel] = EchoModel, out: str = "response") -> DataFrame:
    """The rows with a model's response to each prompt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(factory)
        for batch in batches:
            answers = model.generate([p or "" for p in batch.column(prompt).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string())], names=[*batch.schema.names, out])

    schema = df.withColumn(out, F.lit("")).schema
    return df.mapInArrow(run, schema)


class _Embedded:
    """Vectors of texts, each made once while at most KEPT_TEXTS of a task are kept."""

    def __init__(self, model: Embedder) -> None:
        self.model, self.kept = model, {}

    def embed(self, texts: list[str]) -> np.ndarray:
        keys = [hashlib.sha256(t.encode()).digest() for t in texts]  # texts may be long
        new = {k: t for k, t in zip(keys, texts) if k not in self.kept}
        if len(self.kept) + len(new) > KEPT_TEXTS:
            self.kept, new = {}, dict(zip(keys, texts))
        if new:
            self.kept.update(zip(new, self.model.embed(list(new.values()))))
        return np.array([self.kept[k] for k in keys])


def annotate_documents(docs: DataFrame, text: str, rounds: int, factory: Callable[[], TextModel] = EchoModel, embedder: Callable[[], Embedder] = RandomEmbedder) -> DataFrame:
    """The rows with descriptors, rewrite and similarity: ``rounds`` of describing and rewriting, each from the last rewrite.

    With no rounds there is one description and no similarity. Rows go through in portions of EMBEDDED_ROWS.
    """

    def annotated(batch: pa.RecordBatch, model: TextModel, vectors: _Embedded) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(text).to_pylist()]
        own, cur = vectors.embed(texts) if rounds else None, texts
        descriptors, rewrites, sims = [[] for _ in texts], [[] for _ in texts], [[] for _ in texts]
        for _ in range(max(1, rounds)):
            said = model.generate(cur)
            for d, x in zip(descriptors, said):
                d.append([x])
            if not rounds:
                break
            cur = [x.split(";", 1)[-1].strip() for x in said]
            for r, s, x, v in zip(rewrites, sims, cur, (vectors.embed(cur) * own).sum(1)):
                r.append(x)
                s.append(round(float(v), 4))
        made = [pa.array(descriptors, pa.list_(pa.list_(pa.string()))), pa.array(rewrites, pa.list_(pa.string())), pa.array(sims, pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "descriptors", "rewrite", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, vectors = _loaded(factory), _Embedded(_loaded(embedder))
        for batch in batches:
            for at in range(0, batch.num_rows, EMBEDDED_ROWS):
                yield annotated(batch.slice(at, EMBEDDED_ROWS), model, vectors)

    schema = docs.withColumns({"descriptors": F.lit(None).cast("array<array<string>>"), "rewrite": F.lit(None).cast("array<string>"), "similarity": F.lit(None).cast("array<double>")}).schema
    return docs.mapInArrow(run, schema)


#: The labels of the judge's three tasks.
JUDGE_LABELS = {
    "QueryDescriptorMatch": ["yes", "no"], "QueryDocMatch": ["yes", "no"],
    "DescriptorAccuracy": ["accurate", "mostly accurate", "partially accurate", "mostly inaccurate", "inaccurate"],
}


def judge_examples(df: DataFrame, task: str, query: str = "", doc_ids: DataFrame | None = None, harmonized: bool = False, share: float = 1.0, seed: int = 0) -> DataFrame:
    """The examples of a task with their ``prompt``.

    QueryDescriptorMatch: one for each row's ``descriptor``. QueryDocMatch: one for each ``document`` whose doc_id is
    among ``doc_ids`` (doc_id). DescriptorAccuracy: one for each descriptor, harmonised or of the best round, of a share
    of the documents that is drawn by a hash of the doc_id.
    """
    if task == "QueryDescriptorMatch":
        return df.withColumn("prompt", prompts.render("judge_query_descriptor", query=F.lit(query), descriptor=F.coalesce("descriptor", F.lit(""))))
    if task == "QueryDocMatch":
        return df.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("prompt", prompts.render("judge_query_document", query=F.lit(query), document=F.col("document")))
    if task != "DescriptorAccuracy":
        raise ValueError(f"unknown task {task}")
    drawn = df if share >= 1 else df.where(hash_unit("doc_id", seed) < share)
    listed = F.col("harmonized_descriptors") if harmonized else best_round("descriptors", "similarity", "all")
    each = drawn.withColumn("descriptor", F.explode(listed))
    return each.withColumn("prompt", prompts.render("judge_accuracy", document=F.col("document"), descriptor=F.col("descriptor")))


def judge(df: DataFrame, task: str, prompt: str, factory: Callable[[], TextModel] = EchoModel) -> DataFrame:
    """The rows with the model's response and the label parsed from it."""
    return generate(df, prompt, factory).withColumn("label", answer_label("response", JUDGE_LABELS[task]))


def reranker_score(yes: Column, no: Column) -> Column:
    """P(yes) / (P(yes) + P(no)) from log-probabilities; a missing one counts as -10."""
    y, n = F.exp(F.coalesce(yes, F.lit(-10.0))), F.exp(F.coalesce(no, F.lit(-10.0)))
    return y / (y + n)


def rerank(found: DataFrame, above: float) -> DataFrame:
    """(id, chosen, score): of the candidates (id, neighbor, yes, no: log-probabilities) the best by the reranker, the
    smallest on a tie; chosen is null where its score is not above the threshold."""
    scored = found.select("id", "neighbor", reranker_score(F.col("yes"), F.col("no")).alias("score"))
    best = scored.groupBy("id").agg(F.min(F.struct((-F.round("score", 12)).alias("s"), "neighbor")).alias("b"))
    return best.select("id", F.when(-F.col("b.s") > above, F.col("b.neighbor")).alias("chosen"), (-F.col("b.s")).alias("score"))


def mock_choice(found: DataFrame, keep: float = 0.75, seed: int = 0) -> DataFrame:
    """(id, chosen): a stand-in selector. A share of the ids, drawn by hash, takes one of its candidates (id, neighbor, rank),
    also drawn by hash; the others choose none."""
    sized = found.groupBy("id").agg(F.max("rank").alias("n"))
    pick = (F.floor(hash_unit("id", seed + 1) * F.col("n")) + 1).alias("rank")
    drawn = sized.where(hash_unit("id", seed) < keep).select("id", pick)
    return sized.select("id").join(drawn.join(found.select("id", "rank", "neighbor"), ["id", "rank"]), "id", "left").select("id", F.col("neighbor").alias("chosen"))


def decide_synonyms(pairs: DataFrame, cache: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Decisions of pairs (a, b: structs with id, descriptor, explainer) from a cache (key, is_synonym, keep_id, reason), else
    from ``decide``, which adds is_synonym, keep_id and clean: (decisions with reason, new cache rows).

    A key is the same in either order. Cached rows keep their reason; only clean answers are cached.
    """
    keyed = pairs.withColumn("key", decision_key(F.col("a"), F.col("b")))
    known = keyed.join(cache.select("key", "is_synonym", "keep_id", "reason"), "key")
    fresh = decide(keyed.join(cache.select("key"), "key", "left_anti")).withColumn("reason", F.when(F.col("clean"), "LLM_decision").otherwise("parse_failed"))
    columns = ["key", "a", "b", "is_synonym", "keep_id", "reason"]
    return known.select(columns).unionByName(fresh.select(columns)), fresh.where("clean").select("key", "is_synonym", "keep_id", "reason").distinct()


def describe_with_feedback(docs: DataFrame, batch: str, text: str, batches: int, top: int = 100, factory: Callable[[], TextModel] = EchoModel) -> DataFrame:
    """The rows with ``descriptor``: batch after batch, each prompt naming the ``top`` descriptors so far (at most that many
    travel to the driver)."""
    counts, done = None, None
    for n in range(batches):
        known = "" if counts is None else ", ".join(r[0] for r in counts.orderBy(F.desc("n"), "descriptor").limit(top).collect())
        own = docs.where(F.col(batch) == n).withColumn("prompt", prompts.render("describe_with_vocabulary", vocabulary=F.lit(known), document=F.col(text)))
        said = stored(generate(own, "prompt", factory).withColumn("descriptor", vocab_descriptor("response")).drop("prompt", "response"), "described")
        new = said.groupBy("descriptor").agg(F.count("*").alias("n"))
        counts = stored((new if counts is None else counts.unionByName(new)).groupBy("descriptor").agg(F.sum("n").alias("n")), "vocabulary")
        done = said if done is None else done.unionByName(said)
    return done


def classify_in_passes(items: DataFrame, say: Callable[[DataFrame], DataFrame], passes: int = 3) -> tuple[DataFrame, DataFrame]:
    """(good, bad): ``say`` adds ``good`` to the rows; in each pass those called bad leave and are added to the bad list."""
    good, bad = items, None
    for _ in range(passes):
        said = say(good)
        gone = said.where(~F.col("good")).drop("good")
        bad = gone if bad is None else bad.union(gone)
        good = said.where("good").drop("good")
    return good, bad
