"""Sinks: JSON lines, tables with a total order, audit markers, embedding tables with their fingerprint."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import fingerprint

#: Batches that the first job of a sink in batches writes, and the tasks of a job.
FIRST_BATCHES, BATCH_TASKS = 256, 200


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "none") -> None:
    """JSON lines with nulls written out and non-ASCII characters as they are. zstd cannot be written here; gzip can."""
    df.write.mode(mode).option("ignoreNullFields", "false").option("compression", compression).json(path)


def write_csv(df: DataFrame, path: str, *order) -> None:
    df.orderBy(*order).write.mode("overwrite").option("header", "true").csv(path)


def write_vocabulary(df: DataFrame, path: str) -> None:
    """Descriptor and count by falling count, then descriptor, tab-separated."""
    df.orderBy(F.desc("n"), "descriptor").select(F.concat_ws("\t", "descriptor", F.col("n").cast("string"))).write.mode("overwrite").text(path)


def write_lines(df: DataFrame, path: str, column: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def write_groups(df: DataFrame, path: str, key: str = "cluster", member: str = "member") -> None:
    """JSON lines of a cluster and its sorted members."""
    write_jsonl(df.groupBy(key).agg(F.array_sort(F.collect_list(member)).alias("members")), path)


def write_marker(violations: DataFrame, path: str) -> bool:
    """The rows that break a rule, and a marker file named passed or failed; returns whether all passed."""
    passed = violations.isEmpty()
    violations.write.mode("overwrite").json(f"{path}/violations")
    violations.sparkSession.createDataFrame([("passed" if passed else "failed",)], "value string").write.mode("overwrite").text(f"{path}/{'passed' if passed else 'failed'}")
    return passed


def parquet_to_jsonl(spark: SparkSession, source: str, path: str) -> None:
    write_jsonl(spark.read.parquet(source), path)


def concatenate(spark: SparkSession, paths: list[str], path: str) -> None:
    """The lines of several shards as one folder, shard by shard; a last line without a line feed stays a line."""
    for k, shard in enumerate(paths):
        spark.read.text(shard).write.mode("append" if k else "overwrite").text(path)


def _batches_there(spark: SparkSession, path: str) -> set[int]:
    """Batches whose folders are there and not left by a write that was ended; names come from the JVM as one string."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def found(pattern: str) -> set[int]:
        listed = files.globStatus(jvm.org.apache.hadoop.fs.Path(top, pattern))
        text = "" if listed is None else jvm.org.apache.commons.lang3.ArrayUtils.toString(jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(listed))
        return {int(x) for x in re.findall(r"/batch=(\d+)(?=[,/}])", text)}

    return found("batch=*") - (found("batch=*/_temporary") - found("batch=*/_SUCCESS"))


def append_batches(df: DataFrame, path: str, key: str, size: int, upto: int | None = None) -> int:
    """Append rows, in batches of ``size`` keys, as JSON lines in a folder a batch; returns how many batches were written.

    ``key`` numbers the rows from 0 without gaps. Batches that are there are not written again, so a run that was ended
    takes up its work; a batch's one file is made by one task and its folder moved in whole. ``upto`` ends a run early.
    Each job writes twice as many batches as the one before, so there are few passes over the rows, and a run that ends
    keeps what its jobs before the last have written.
    """
    if "batch" in df.columns:
        raise ValueError("the column batch names the folders")
    spark = df.sparkSession
    n = df.agg(F.max(key)).first()[0]
    there = _batches_there(spark, path)
    missing = [x for x in range(0 if n is None else min(n // size + 1, upto or n + 1)) if x not in there]
    at, many = 0, FIRST_BATCHES
    while at < len(missing):
        group = missing[at : at + many]
        rows = df.where(F.col(key).between(group[0] * size, (group[-1] + 1) * size - 1)).withColumn("batch", F.floor(F.col(key) / size))
        if len(group) <= group[-1] - group[0]:
            rows = rows.where(F.col("batch").isin(group))
        dealt = rows.repartition(min(len(group), BATCH_TASKS), "batch")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy("batch").json(path)
        for empty in set(group) - _batches_there(spark, path):  # only where keys have gaps
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={empty}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
        at, many = at + len(group), many * 2
    return len(missing)


def write_key_values(df: DataFrame, path: str, key: str, value) -> None:
    """(key, value) in the order of keys, so that a scan for a prefix reads few row groups."""
    df.select(F.col(key).cast("string").alias("key"), value.alias("value")).repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(path)


def write_embeddings(df: DataFrame, path: str, model: str, id_col: str = "id", vec_col: str = "vec", text_col: str | None = None) -> None:
    """(id, vec) as floats, and one metadata row with model, rows, width and a fingerprint of the ids and, if given, texts."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("vec"), *([F.col(text_col).alias("text")] if text_col else []))
    rows.select("id", "vec").write.mode("overwrite").parquet(f"{path}/vectors")
    meta = rows.agg(fingerprint(model, F.struct("id", *(["text"] if text_col else []))).alias("fingerprint"), F.lit(model).alias("model"), F.count("*").alias("n_rows"), F.max(F.size("vec")).alias("width"), F.lit("float32").alias("dtype"))
    meta.write.mode("overwrite").json(f"{path}/meta")


def read_embeddings(spark: SparkSession, path: str, model: str, ids: DataFrame) -> DataFrame | None:
    """A stored table if its fingerprint is that of the model and these ids (id) or ids and texts (id, text), else null."""
    from lexloom.sources.readers import exists

    if not exists(spark, f"{path}/meta"):
        return None
    want = ids.agg(fingerprint(model, F.struct(*[c for c in ("id", "text") if c in ids.columns]))).first()[0]
    return spark.read.parquet(f"{path}/vectors") if spark.read.json(f"{path}/meta").first()["fingerprint"] == want else None
