"""Search over harmonised descriptors: an inverted index, an exact and a cell-partitioned vector index."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import neighbors as nn
from lexloom.plans.shared import stored

INDEX_TYPES = ("FlatL2", "IndexIVFFlat")


def inverted_index(rows: DataFrame, doc: str = "doc_id", pos: str = "pos", text: str = "text") -> DataFrame:
    """(text, doc_id, pos): each document once per descriptor text, with the first place it has there."""
    return rows.groupBy(F.col(text).alias("text"), F.col(doc).alias("doc_id")).agg(F.min(pos).alias("pos"))


def nested_index(index: DataFrame) -> DataFrame:
    """(text, documents): the index as lists, for a sink; a text's list is as long as its documents are many."""
    return index.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("doc_id", "pos"))).alias("documents"))


def search_results(hits: DataFrame, names: DataFrame, index: DataFrame) -> DataFrame:
    """(query, rank, distance, text, doc_id): hits (id, neighbor, score, rank) with the documents of the neighbour's text."""
    named = hits.join(names.select(F.col("id").alias("neighbor"), "text"), "neighbor")
    return named.join(index.select("text", "doc_id"), "text").select(F.col("id").alias("query"), "rank", F.col("score").alias("distance"), "text", "doc_id")


def train_cells(vectors: DataFrame, vec: str, cells: int, sample_rows: int = 20_000, rounds: int = 15) -> np.ndarray:
    """Centroids by k-means over at most ``sample_rows`` vectors, those with the smallest hash."""
    rows = vectors.select(F.col(vec).cast("array<double>").alias("v")).orderBy(F.xxhash64("v"), "v").limit(sample_rows).collect()
    data = np.array([r[0] for r in rows])
    centers = data[np.linspace(0, len(data) - 1, min(cells, len(data))).astype(int)].copy()
    for _ in range(rounds):
        near = ((data**2).sum(1)[:, None] - 2 * data @ centers.T + (centers**2).sum(1)).argmin(1)
        for c in range(len(centers)):
            if (near == c).any():
                centers[c] = data[near == c].mean(0)
    return centers


def _cells(vectors: DataFrame, id_col: str, vec: str, centers: np.ndarray, probes: int) -> DataFrame:
    """(id, vec, cell): the ``probes`` nearest cells of each vector."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data = nn._numbers(pa.chunked_array([batch.column("vec")]))
            far = (data**2).sum(1)[:, None] - 2 * data @ centers.T + (centers**2).sum(1) if batch.num_rows else np.empty((0, len(centers)))
            near = np.argsort(far, axis=1, kind="stable")[:, :probes]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(near.tolist(), pa.list_(pa.int32()))], names=["id", "vec", "cells"])

    base = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("vec")).where("id is not null and vec is not null")
    return base.mapInArrow(run, "id bigint, vec array<double>, cells array<int>").select("id", "vec", F.explode("cells").alias("cell"))


class VectorIndex:
    """FlatL2 searches exactly; IndexIVFFlat puts each vector in the nearest of ``nlist`` cells and looks in ``nprobe``."""

    def __init__(self, vectors: DataFrame, id_col: str, vec_col: str, index_type: str = "FlatL2", nlist: int = 16, centers: np.ndarray | None = None, cells: DataFrame | None = None) -> None:
        if index_type not in INDEX_TYPES:
            raise ValueError(f"unknown index type {index_type}")
        self.index_type, self.nlist = index_type, nlist
        self.vectors = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        if index_type != "FlatL2":
            self.centers = train_cells(self.vectors, "vec", nlist) if centers is None else centers
            self.cells = stored(_cells(self.vectors, "id", "vec", self.centers, 1), "cells") if cells is None else cells

    def search(self, queries: DataFrame, id_col: str, vec_col: str, k: int, nprobe: int = 4) -> DataFrame:
        """(id, neighbor, score, rank) with squared distances; a row may find itself."""
        if self.index_type == "FlatL2":
            return nn.top_k(nn.blocks(queries, id_col, vec_col, "l2"), nn.blocks(self.vectors, "id", "vec", "l2"), k, "l2")
        probes = _cells(queries, id_col, vec_col, self.centers, nprobe)
        return nn.top_k(nn.blocks(probes, "id", "vec", "l2", by="cell"), nn.blocks(self.cells, "id", "vec", "l2", by="cell"), k, "l2", same_cell=True)

    def save(self, path: str) -> None:
        """Vectors, by cell for IVF, and one metadata row."""
        table = self.vectors.withColumn("cell", F.lit(0)) if self.index_type == "FlatL2" else self.cells
        table.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
        centers = [] if self.index_type == "FlatL2" else self.centers.tolist()
        meta = json.dumps({"index_type": self.index_type, "nlist": self.nlist, "centers": centers})
        self.vectors.sparkSession.createDataFrame([(meta,)], "value string").write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> VectorIndex:
        """A saved index as it is: its vectors are in their cells' folders already."""
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        table = spark.read.parquet(f"{path}/vectors")
        centers = np.array(meta["centers"]) if meta["centers"] else None
        return VectorIndex(table, "id", "vec", meta["index_type"], meta["nlist"], centers, table.select("id", "vec", "cell") if centers is not None else None)

    @staticmethod
    def ensure(vectors: DataFrame, id_col: str, vec_col: str, path: str, index_type: str = "FlatL2", nlist: int = 16, rebuild: bool = False) -> VectorIndex:
        """The index saved at ``path`` if it is of this type; else, or if it is to be rebuilt, a new one, saved there."""
        from lexloom.sources.readers import exists

        spark = vectors.sparkSession
        if not rebuild and exists(spark, f"{path}/meta"):
            found = VectorIndex.load(spark, path)
            if (found.index_type, found.nlist) == (index_type, nlist):
                return found
        made = VectorIndex(vectors, id_col, vec_col, index_type, nlist)
        made.save(path)
        return made
