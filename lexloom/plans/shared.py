"""Intermediate tables in the folder that driver and executors share.

Lineage is cut with Parquet tables under ``spark.checkpoint.dir``; a lost executor then costs a re-read, never a
recomputation of the whole chain, and nothing depends on a machine-local disk.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes, as estimated from rows and the lengths of their strings, up to which a table is broadcast.
BROADCAST_BYTES = 16 << 20
#: Bytes of a value of each type without a length of its own.
_WIDTHS = {"tinyint": 1, "smallint": 2, "int": 4, "float": 4, "boolean": 1}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where unset, on one machine alone, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = os.path.join(tempfile.gettempdir(), "lexloom-shared")
    os.makedirs(own, exist_ok=True)
    return "file://" + own


def _own_tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lexloom/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, label: str) -> str:
    """A folder of its own among the application's intermediate tables."""
    return f"{_own_tables(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of what was written; zstd takes less disk for texts and ids."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Delete the application's intermediate tables, once the results that read them are saved."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_own_tables(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bytes_of(df: DataFrame) -> int:
    """About how many bytes the rows of ``df`` take; arrays, maps and structs count by their JSON form."""
    width = F.lit(0).cast("bigint")
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            width += 8 + F.coalesce(F.octet_length(column), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            width += F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
        else:
            width += _WIDTHS.get(kind, 8)
    return df.agg(F.sum(width)).first()[0] or 0


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows take at most ``most`` bytes, else as it is, for a shuffle join.

    ``df`` should be a stored table, which is read once for its size.
    """
    return F.broadcast(df) if bytes_of(df) <= most else df
