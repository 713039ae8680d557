"""A stream of documents in micro-batches: running vocabulary, growth per batch, windowed event counts.

State lives in Spark's checkpointed state store or in tables of the shared folder; a restart resumes where it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import vocab_descriptor


def document_stream(spark: SparkSession, directory: str, schema: str, files_per_batch: int = 1, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(directory)


def running_vocabulary(stream: DataFrame, descriptor: str = "descriptor") -> DataFrame:
    """(descriptor, n) so far; for complete or update mode. The state is a count per descriptor."""
    return stream.select(vocab_descriptor(descriptor).alias("descriptor")).groupBy("descriptor").agg(F.count("*").alias("n"))


def start_vocabulary(stream: DataFrame, path: str, checkpoint: str, descriptor: str = "descriptor"):
    """The running vocabulary over all files that are there: per micro-batch the descriptors whose counts changed, as a table
    (descriptor, n) in a folder of its own, which a batch that is run again overwrites. Nothing is held on the driver."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return running_vocabulary(stream, descriptor).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def vocabulary_so_far(spark: SparkSession, path: str) -> DataFrame:
    """(descriptor, n): of each descriptor the count that the latest batch gave it."""
    rows = spark.read.schema("descriptor string, n bigint, batch bigint").parquet(path)
    return rows.groupBy("descriptor").agg(F.max_by("n", "batch").alias("n"))


def start_growth(stream: DataFrame, path: str, checkpoint: str, descriptor: str = "descriptor"):
    """Per micro-batch the descriptors not met before, appended to ``path`` as (descriptor, batch).

    A batch that is run again after a failure first drops what it wrote, so the table stays exact.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.select(vocab_descriptor(descriptor).alias("descriptor")).distinct()
        if batch_id:
            known = spark.read.parquet(path).where(F.col("batch") < batch_id).select("descriptor")
            new = new.join(known, "descriptor", "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window start, kind, n): tumbling windows; rows later than ``late`` are dropped by a stream's watermark."""
    base = events.withWatermark(time, late) if events.isStreaming else events
    return base.groupBy(F.window(time, width).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")
