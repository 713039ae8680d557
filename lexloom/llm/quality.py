"""Quality classifier by importance resampling: the ratio of two hashed n-gram models, sampled by Gumbel top-k.

The target model is learned from labelled documents of good quality that are not toxic, the raw model from all
documents. A feature is a word, a run of marks or a pair of neighbours; a document has it once, and once more for each
power of four that its count reaches, so one long junk text does not tilt the models. Features are hashed to a bucket
in each of two tables, and the ratio nearer to 1 is taken: features that merely share a bucket with a telling one do
not add up in long texts. A document's importance is the product of target / raw over its features. The log ratios are
smoothed and shrunk by their variance; the document itself is left out of the counts it is judged by, so labelled
documents are not favoured.

The number to keep, k, is the number of documents whose importance reaches the level that all but ``clean_loss`` of
the target documents reach. The k largest importances times Gumbel noise are then a sample of k without replacement.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.columns import id_text
from lexloom.llm.words import Hashes, mix, portions, tidy
from lexloom.plans.shared import stored

#: Buckets in each of the two tables.
BUCKETS = 1 << 18
#: Labelled target documents to learn from at most; of more, those with the smallest hash of their id.
TARGET_ROWS = 20_000
CLEAN_LOSS = 0.005
#: The sample is drawn from importances to the power 1 / TEMPERATURE: noise is small against a telling feature.
TEMPERATURE = 0.25
#: Documents added to both counts of a ratio, and the variances by which its square shrinks.
PRIOR_DOCS, SHRINKAGE = 2.0, 4.0
#: Keys are ordered in steps of 2 ** -STEP_BITS between these bounds; what is below is equal.
STEP_BITS, LOWEST, HIGHEST = 32, -4096, 4096

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_SAME = np.uint64(0x53414D45)


def features(text: str, hashes: Hashes) -> np.ndarray:
    """Hashes of a text's distinct features."""
    tokens = _TOKEN.findall(text.lower())
    if not tokens:
        return np.empty(0, np.uint64)
    single = hashes.of(tokens)
    pair = mix(single[:-1] * np.uint64(0x9E3779B97F4A7C15) + single[1:])
    pair[single[:-1] == single[1:]] = _SAME
    found, counts = np.unique(np.concatenate([single, pair]), return_counts=True)
    levels, least = [found], 4
    while len(more := found[counts >= least]):
        levels.append(mix(more + np.uint64(least)))
        least *= 4
    return mix(np.concatenate(levels))


def places(found: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of features in the first and the second table; the second follows the first in one array."""
    first = found % np.uint64(buckets)
    second = (found >> np.uint64(32)) % np.uint64(buckets) + np.uint64(buckets)
    return first.astype(np.int64), second.astype(np.int64)


def _counted(buckets: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target, hashes = np.zeros(2 * buckets + 1, np.int64), np.zeros(2 * buckets + 1, np.int64), Hashes()
        for batch in portions(batches):
            for text, own in zip(batch.column("text"), batch.column("target").to_pylist()):
                at = np.unique(np.concatenate([*places(features(text.as_py(), hashes), buckets), [2 * buckets]]))  # the last place counts documents
                raw[at] += 1
                if own:
                    target[at] += 1
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    return run


def _weighed(own: np.ndarray, others: np.ndarray):
    def weight(text: str, ratios: np.ndarray, hashes: Hashes) -> float:
        one, two = (ratios[at] for at in places(features(text, hashes), len(ratios) // 2))
        return float(np.where(np.abs(one) < np.abs(two), one, two).sum())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in portions(batches):
            found = [weight(t.as_py(), own if of else others, hashes) for t, of in zip(batch.column("text"), batch.column("target").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.float64())], names=["id", "log_weight"])

    return run


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Shrunk log ratios of target to raw by bucket, from (bucket, raw, target): for target documents and for others.

    Each is without the document that is judged: it has one less in raw and, if it is a target document, in target.
    """
    raw, target = np.zeros(2 * buckets + 1), np.zeros(2 * buckets + 1)
    found = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # at most 2 * buckets + 1 rows
    at = found.column("bucket").to_numpy()
    raw[at], target[at] = found.column("raw").to_numpy(), found.column("target").to_numpy()
    share = target[-1] / max(raw[-1], 1.0)
    expected = np.maximum(raw[:-1] - 1, 0) * share + PRIOR_DOCS

    def shrunk(having: np.ndarray) -> np.ndarray:
        ratio = np.log((having + PRIOR_DOCS) / expected)
        return (ratio * np.maximum(0.0, 1 - SHRINKAGE / expected / np.maximum(ratio**2, 1e-12))).astype(np.float32)

    return shrunk(np.maximum(target[:-1] - 1, 0)), shrunk(target[:-1])


def kth_largest(df: DataFrame, key: str, k: int) -> int | None:
    """The k-th largest of a BIGINT column, exactly, by counts of its leading bits: no task sorts or holds all rows."""
    if k <= 0:
        return None
    low, shift, left = None, 48, k
    while True:
        inside = df if low is None else df.where(F.shiftright(key, shift + 16) == low)
        found = sorted(inside.groupBy(F.shiftright(key, shift).alias("b")).count().collect(), reverse=True)  # at most 2 ** 16 rows
        for b, n in found:
            if n >= left:
                low = b
                break
            left -= n
        else:
            return None
        if shift == 0:
            return low
        shift -= 16


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_rows: int = TARGET_ROWS, clean_loss: float = CLEAN_LOSS, seed: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, log_weight, key, keep) for each input row.

    ``labels`` has doc_id, quality and toxic; an id labelled more than once takes its worst label, a null counts as bad.
    The noise depends on id and seed alone, so repeated rows are kept or rejected alike, and rows that tie with the
    k-th are kept. Null and empty texts have weight 0. Without target documents all rows are kept. Null ids count as
    one id; other columns are ignored; an empty table gives no rows.
    """
    good = labels.groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(1))).alias("t")).where("q = 1 and t = 0")
    target = stored(good.select(F.col("doc_id").cast("bigint").alias("id")).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(target_rows).withColumn("target", F.lit(True)), "target")
    base = id_text(docs, id_col, text_col).select(F.col("id").cast("bigint").alias("id"), "text")
    marked = base.join(F.broadcast(target), "id", "left").withColumn("target", F.coalesce("target", F.lit(False)))  # at most target_rows rows
    ratios = log_ratios(marked.mapInArrow(_counted(buckets), "bucket bigint, raw bigint, target bigint"), buckets)
    weights = marked.mapInArrow(_weighed(*ratios), "id bigint, log_weight double")
    noise = -F.log(-F.log((F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), F.coalesce("id", F.lit(0))), 12) + F.lit(0.5)) / F.lit(float(1 << 52))))
    keyed = weights.withColumn("key", F.col("log_weight") / TEMPERATURE + noise)
    fixed = F.floor(F.greatest(F.least(F.col("key"), F.lit(float(HIGHEST))), F.lit(float(LOWEST))) * float(1 << STEP_BITS)).cast("bigint")
    scored = stored(keyed.withColumn("step", fixed), "weights")
    level = scored.join(F.broadcast(target), "id").agg(F.percentile("log_weight", clean_loss)).first()[0]
    if level is None:
        return scored.select(F.col("id").alias("doc_id"), "log_weight", "key", F.lit(True).alias("keep"))
    least = kth_largest(scored, "step", scored.where(F.col("log_weight") >= level).count())
    return scored.select(F.col("id").alias("doc_id"), "log_weight", "key", (F.col("step") >= least).alias("keep"))
