"""Readers: documents from several formats, strict and tolerant JSON lines, pairs, schemas, lineage, vocabularies, logs.

Schemas are declared where the format fixes them and inferred once where it does not. Paths may be in any store that
Spark reads; existence is asked of Spark's file systems, never of the driver's disk.
"""

from __future__ import annotations

import re
import warnings
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions.text import normalize_strict, split_plain, strip
from lexloom.operators.annotate import best_round

#: Names an id column may have, in order of preference, and entity schemas.
ID_NAMES = ("doc_id", "ID", "id", "text_id", "document_id", "warc_record_id")
PAIR = "id string, descriptor string, explainer string"
GROUP = "descriptor string, explainers array<struct<id:string,explainer:string>>"
EVENT = "new_descriptor string, new_explainer string, new_pair_id string, source_pair_ids array<string>"
LINEAGE_NAMES = ("full_lineage.jsonl", "lineage.jsonl", "disambig_lineage.jsonl", "lineage_full.jsonl")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, which may hold a pattern, names any file."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_documents(spark: SparkSession, source: str) -> DataFrame:
    """Documents by suffix: .tsv (label, id, text), .jsonl and .jsonl.zst or .gz, .parquet. What has none of these, or no
    such file, is looked up as a table of the catalog; ValueError if there is none."""
    bare = source.rstrip("/")
    for suffixes, read in (((".tsv",), read_core_tsv), ((".json", ".jsonl", ".jsonl.zst", ".jsonl.gz"), read_jsonl), ((".parquet",), lambda s, p: s.read.parquet(p))):
        if bare.endswith(suffixes) and exists(spark, source):
            return read(spark, source)
    if re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)*", bare) and spark.catalog.tableExists(bare):
        return spark.table(bare)
    raise ValueError(f"{source} is neither a file of a known format nor a table")


def read_core_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of lines with exactly three tab-separated fields; the text is stripped."""
    parts = spark.read.text(path).select(F.split("value", "\t", -1).alias("p")).where(F.size("p") == 3)
    return parts.select(F.get("p", F.lit(1)).alias("id"), strip(F.get("p", F.lit(2))).alias("text"))


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | None = None, lenient: bool = False, blank_lines: bool = True) -> DataFrame:
    """JSON lines. Strict by default: an undecodable line fails the job; ``lenient`` drops it. With ``blank_lines=False``
    a blank line fails too."""
    reader = spark.read.option("mode", "DROPMALFORMED" if lenient else "FAILFAST")
    if not blank_lines:
        blank = spark.read.text(path).where(F.trim("value") == "")
        if not blank.isEmpty():
            raise ValueError("a line is blank")
    return (reader.schema(schema) if schema else reader).json(path)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of the lines, numbered from 1, that are neither blank nor JSON: what a strict reader fails on."""
    rows = with_line_numbers(spark, path).where((F.trim("value") != "") & F.try_parse_json("value").isNull())
    return rows.select((F.col("line") + 1).alias("line"), "value")


def read_many_jsonl(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """All files that exist, as one table, with a warning for each that does not; with a schema none may exist."""
    there = [p for p in paths if exists(spark, p)]
    for p in set(paths) - set(there):
        warnings.warn(f"{p} does not exist", stacklevel=2)
    if not there:
        if schema is None:
            raise FileNotFoundError("none of the files exists")
        return spark.createDataFrame([], schema)
    return read_jsonl(spark, there, schema)


def read_pairs(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Pairs; a null or blank id, descriptor or explainer fails the job."""
    rows = read_jsonl(spark, path, PAIR) if limit is None else first_rows(spark, path, PAIR, limit)
    good = (strip("id") != "") & (strip("descriptor") != "") & (strip("explainer") != "")
    checked = F.when(good, F.col("id")).otherwise(F.raise_error(F.lit("a pair has an empty field")))
    return rows.withColumn("id", checked)


def read_schema(spark: SparkSession, path: str) -> DataFrame:
    """A schema's pairs; a missing field fails the job."""
    rows = read_jsonl(spark, path, PAIR)
    whole = F.col("id").isNotNull() & F.col("descriptor").isNotNull() & F.col("explainer").isNotNull()
    return rows.withColumn("id", F.when(whole, F.col("id")).otherwise(F.raise_error(F.lit("a schema row lacks a field"))))


def with_line_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(value, line): lines of text files numbered from 0 in the order of the files, blank ones included.

    Rows are numbered within each block of a file as they are read; what is ordered to add up is one row per block.
    """
    place = {"file": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start"), "at": F.monotonically_increasing_id()}
    rows = spark.read.text(path).select("value", *[c.alias(n) for n, c in place.items()])
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    begun = blocks.select("file", "block", "first", (F.sum("n").over(Window.orderBy("file", "block")) - F.col("n")).alias("before"))
    return rows.join(begun, ["file", "block"]).select("value", (F.col("before") + F.col("at") - F.col("first")).alias("line"))


def first_rows(spark: SparkSession, path: str, schema: str, n: int) -> DataFrame:
    """The first n JSON lines of the files, by their order; blank lines do not count."""
    lines = with_line_numbers(spark, path).where(F.trim("value") != "").orderBy("line").limit(n)
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("j")).select("j.*")


def id_column(df: DataFrame) -> str | None:
    return next((c for c in ID_NAMES if c in df.columns), None)


def annotated(df: DataFrame, on_empty: str = "first", max_docs: int | None = None) -> DataFrame:
    """(doc_id, text, pos, descriptor, explainer): the best round's pairs, or the harmonised ones where there are any.

    The text is ``text`` or ``document``; rows without text or descriptors give nothing. ``max_docs`` reads the documents
    of the smallest ids alone.
    """
    column = lambda *names: F.coalesce(*[F.col(n) for n in names if n in df.columns], F.lit(None))
    raw = best_round("descriptors", "similarity", on_empty) if "descriptors" in df.columns else F.lit(None).cast("array<string>")
    own = F.coalesce(F.when(F.size("harmonized_descriptors") > 0, F.col("harmonized_descriptors")), raw) if "harmonized_descriptors" in df.columns else raw
    key = id_column(df)
    base = df.select((F.col(key) if key else F.lit(None)).cast("string").alias("doc_id"), column("text", "document").cast("string").alias("text"), own.alias("d"))
    base = base.where("text <> ''")
    base = base if max_docs is None else base.orderBy("doc_id").limit(max_docs)
    each = base.select("doc_id", "text", F.posexplode("d").alias("pos", "pair"))
    return each.select("doc_id", "text", "pos", split_plain("pair").alias("p")).select("doc_id", "text", "pos", "p.*").where("descriptor <> ''")


def read_grouped(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(descriptor, id, explainer) of grouped descriptors, normalised; an id in more than one place raises ValueError.
    ``limit`` reads the first groups alone."""
    rows = read_jsonl(spark, path, GROUP) if limit is None else first_rows(spark, path, GROUP, limit)
    flat = rows.select(normalize_strict("descriptor").alias("descriptor"), F.explode("explainers").alias("e")).select("descriptor", "e.*")
    if not flat.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("an id is repeated")
    return flat


def read_input_ids(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(id): the distinct explainer ids of grouped descriptors, checked as ``read_grouped`` does."""
    return read_grouped(spark, path, limit).select("id").distinct()


def conflicting_finals(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(id, n): ids whose final pairs differ between rows, of which ``read_finals`` takes one."""
    rows = reduce(DataFrame.union, [_final_rows(spark, p, k) for k, p in enumerate(paths)])
    return rows.groupBy("id").agg(F.countDistinct("descriptor", "explainer").alias("n")).where("n > 1")


def read_lineage(spark: SparkSession, run_dir: str, names: tuple[str, ...] = LINEAGE_NAMES) -> DataFrame:
    """(dst, src, ord) of the first lineage file that a run has; a scalar source counts as a list of one."""
    path = next((f"{run_dir}/{n}" for n in names if exists(spark, f"{run_dir}/{n}")), None)
    if path is None:
        raise FileNotFoundError(f"no lineage in {run_dir}")
    rows = with_line_numbers(spark, path).where(F.trim("value") != "")
    listed = F.from_json("value", "new_pair_id string, source_pair_ids array<string>")
    single = F.from_json("value", "source_pair_ids string")["source_pair_ids"]
    return rows.select(listed["new_pair_id"].alias("dst"), F.explode(F.coalesce(listed["source_pair_ids"], F.array(single))).alias("src"), F.col("line").alias("ord"))


def _final_rows(spark: SparkSession, path: str, file: int) -> DataFrame:
    j = F.from_json("value", "id string, descriptor string, final_descriptor string, name string, explainer string, group_explainer string")
    flat = with_line_numbers(spark, path).select(F.lit(file).alias("file"), "line", j.alias("j")).where("j.id is not null")
    empty = F.lit("")
    descriptor = F.coalesce(F.nullif("j.descriptor", empty), F.nullif("j.final_descriptor", empty), "j.name")
    return flat.select("file", "line", "j.id", descriptor.alias("descriptor"), F.coalesce(F.nullif("j.explainer", empty), "j.group_explainer", empty).alias("explainer"))


def read_finals(spark: SparkSession, paths: list[str], keep: str = "last") -> DataFrame:
    """(id, descriptor, explainer) of final pairs; of rows with the same id the last, or the first, holds."""
    rows = reduce(DataFrame.union, [_final_rows(spark, p, k) for k, p in enumerate(paths)])
    pick = F.max if keep == "last" else F.min
    return rows.groupBy("id").agg(pick(F.struct("file", "line", "descriptor", "explainer")).alias("r")).select("id", "r.descriptor", "r.explainer")


def list_files(spark: SparkSession, directory: str, pattern: str = "*") -> list[str]:
    """Paths below a folder whose names fit a pattern, sorted."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(directory)
    return sorted(r[0] for r in rows.select("path").collect())  # one row a file; contents are not read


def read_iterations(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """The rows of numbered files, or folders, with the iteration: the number at the last star of the pattern."""
    before, _, after = pattern.rsplit("/", 1)[-1].rpartition("*")
    number = re.escape(before.rpartition("*")[2]) + r"(\d+)" + re.escape(after)
    rows = spark.read.schema(schema).json(pattern)
    return rows.withColumn("iteration", F.regexp_extract(F.col("_metadata.file_path"), number + "(?:/[^/]*)?$", 1).cast("int"))


def read_ids(spark: SparkSession, path: str, field: str = "id") -> DataFrame:
    """Distinct ids of JSON lines; undecodable lines are passed over."""
    return read_jsonl(spark, path, f"`{field}` string", lenient=True).where(F.col(field).isNotNull()).select(F.col(field).alias("id")).distinct()


def read_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Distinct stripped lines that are not blank."""
    rows = spark.read.text(path).select(strip("value").alias("value")).where("value <> ''").distinct()
    return rows if limit is None else rows.orderBy("value").limit(limit)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(descriptor, n): tab-separated counts; malformed lines are passed over and repeated descriptors add up."""
    parts = spark.read.text(path).select(F.split("value", "\t", -1).alias("p")).where(F.size("p") == 2)
    rows = parts.select(F.get("p", F.lit(0)).alias("descriptor"), F.expr("try_cast(trim(p[1]) as bigint)").alias("n")).where("n is not null")
    return rows.groupBy("descriptor").agg(F.sum("n").alias("n"))


def read_tree(spark: SparkSession, directory: str, pattern: str = "*.jsonl*") -> DataFrame:
    """JSON lines of all files below a folder whose names fit a pattern."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).json(directory)


def line_counts(spark: SparkSession, directory: str, pattern: str = "*") -> DataFrame:
    """(file, n): lines of each file below a folder."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(directory)
    return rows.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n")).orderBy("file")


def read_key_values(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(key, value) of a table of keys and values whose keys begin with ``prefix``, which reaches the scan."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("key").startswith(prefix)) if prefix else rows


def read_arrow(files: DataFrame, schema: str, content: str = "content") -> DataFrame:
    """The rows of Arrow streams or files that stand as bytes in a column; columns are taken by name."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(content):
                raw = data.as_py()
                source = pa.ipc.open_file(raw) if raw[:6] == b"ARROW1" else pa.ipc.open_stream(raw)
                for k in range(source.num_record_batches) if raw[:6] == b"ARROW1" else iter(source):
                    found = source.get_batch(k) if isinstance(k, int) else k
                    yield found.select(names)

    names = files.sparkSession.createDataFrame([], schema).columns
    return files.select(content).mapInArrow(run, schema)


def read_arrow_folder(spark: SparkSession, directory: str, schema: str) -> DataFrame:
    """The rows of all .arrow files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.arrow").load(directory)
    return read_arrow(files, schema)


def read_logs(spark: SparkSession, directory: str, prefix: str, suffix: str) -> DataFrame:
    """(file, value): lines of the files below a folder whose names begin and end so."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"{prefix}*{suffix}").text(directory)
    return rows.select(F.col("_metadata.file_name").alias("file"), "value")


def lines_done(spark: SparkSession, path: str) -> int:
    """How many lines a sink already holds: where a run takes up its work again. 0 if there is no such folder."""
    return spark.read.text(path).count() if exists(spark, path) else 0
