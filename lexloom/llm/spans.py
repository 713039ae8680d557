"""Substring dedup: every run of several consecutive sentences is hashed and joined globally; sentences covered by a
run that is not its first occurrence are removed.

From each sentence on, the run is the shortest one of at least two sentences and ``least_words`` words, so a repeated
passage holds a run that lies within it wherever it begins and ends; a sentence of ``long_words`` words is a run by
itself. A run is two 64-bit hashes, a document id and a place: 28 bytes, packed, dealt out by its hash. What repeats within
a portion of texts is known there at once, so a run found in very many documents comes once from each portion, and
no table is stored. What repeats is dealt out again by document.

``drop_repeats`` is the rule of the SQL. ``drop_passages`` also removes repeated passages of fifty words wherever their
sentences begin and end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.words import Hashes, mix, portions, split_words, tidy
from lexloom.plans.shared import stored

#: Sizes of a run of two or more sentences, and of a single one. A size is words or, where words are long or there are
#: no spaces, eighths of characters.
LEAST_WORDS, LONG_WORDS, WORD_CHARS = 20, 50, 8
#: Words of a passage that counts whatever its sentences, and of the runs in it that its anchor is chosen from.
PASSAGE_WORDS, ANCHOR_WORDS = 50, 16
#: Buckets that runs and marks are dealt out to, at least; as many as shuffle partitions where these are more.
BUCKETS = 256
#: A sentence ends with marks before white space, with full-width marks, or with a line.
BOUNDARY = re.compile(r"""[.!?]+["')\]]*[ \t\n\r\f]+|[。！？]+[ \t\n\r\f]*|\n[ \t\n\r\f]*""")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_STEPS = np.array([[0x9E3779B97F4A7C15], [0xC2B2AE3D27D4EB4F]], np.uint64)
_BACK = np.array([[pow(int(s[0]), -1, 1 << 64)] for s in _STEPS], np.uint64)
#: A run; one that is known not to be the first has no hashes and the complement of its place. A sentence at which such a run begins.
_RUN, _MARK = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("id", "<i8"), ("pos", "<i4")]), np.dtype([("id", "<i8"), ("pos", "<i4")])
_PACKED = "bucket int, packed binary"


def sentence_ends(text: str) -> list[int]:
    """Where the sentences of a text end; joined again they are the text."""
    ends = [m.end() for m in BOUNDARY.finditer(text)]
    return ends if not text or ends and ends[-1] == len(text) else [*ends, len(text)]


def _plain(text: str, ends: list[int]) -> list[str]:
    return [_SPACES.sub(" ", text[a:b].lower()).strip(" ") for a, b in zip([0, *ends], ends)]


def run_ends(sizes: np.ndarray, least_words: int, long_words: int) -> np.ndarray:
    """The last sentence of the run that begins at each sentence; as many as there are sentences where it has none."""
    last, reached = np.arange(len(sizes)), np.cumsum(sizes)
    found = np.searchsorted(reached, reached - sizes + least_words)
    return np.where(found > last, found, np.where(sizes >= long_words, last, last + 1))


def _runs_of(text: str, least_words: int, long_words: int) -> tuple[list[int], list[str], np.ndarray]:
    ends = sentence_ends(text)
    plain = _plain(text, ends)
    sizes = np.array([max(s.count(" ") + 1, len(s) // WORD_CHARS) if s else 0 for s in plain], np.int64)
    return ends, plain, run_ends(sizes, least_words, long_words)


def _run_hashes(plain: list[str], last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of a document's runs, and two hashes of the sentences of each, from sums over powers of two odd numbers."""
    n = len(plain)
    each = mix(np.array([xxhash.xxh64_intdigest(s) for s in plain], np.uint64))
    power, back = (np.cumprod(np.concatenate([np.ones((2, 1), np.uint64), np.repeat(f, n, 1)], 1), axis=1, dtype=np.uint64)[:, :n] for f in (_STEPS, _BACK))
    sums = np.concatenate([np.zeros((2, 1), np.uint64), np.cumsum(each * power, axis=1, dtype=np.uint64)], 1)
    starts = np.flatnonzero(last < n)
    length = (last[starts] - starts + 1).astype(np.uint64)
    return starts, mix((sums[:, last[starts] + 1] - sums[:, starts]) * back[:, starts] + mix(length))


def _dealt(rows: np.ndarray, by: np.ndarray, buckets: int) -> pa.RecordBatch:
    """(bucket, packed): the rows of each bucket, which a number of each row gives."""
    bucket = (by % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    found, begins = np.unique(bucket[order], return_index=True)
    ends = (np.append(begins, len(rows)) * rows.itemsize).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(ends), pa.py_buffer(rows[order].tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), packed], names=["bucket", "packed"])


def _unpacked(table: pa.Table, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("packed").to_pylist()), kind)


def _firsts(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each run the first, by document and place, and all that come after a first."""
    runs = runs[np.lexsort((runs["pos"], runs["id"], runs["h2"], runs["h1"]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs["h1"][1:] != runs["h1"][:-1]) | (runs["h2"][1:] != runs["h2"][:-1])
    first = runs[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return runs[new], runs[(runs["id"] != first["id"]) | (runs["pos"] != first["pos"])]


def _hashed(least_words: int, long_words: int, buckets: int):
    def runs_of(batch: pa.RecordBatch) -> np.ndarray:
        found = [np.empty(0, _RUN)]
        for i, text in zip(batch.column("id").to_pylist(), batch.column("text")):
            _, plain, last = _runs_of(text.as_py(), least_words, long_words)
            starts, (h1, h2) = _run_hashes(plain, last)
            own = np.empty(len(starts), _RUN)
            own["h1"], own["h2"], own["id"], own["pos"] = h1, h2, i, starts
            found.append(own)
        return np.concatenate(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            firsts, after = _firsts(runs_of(batch))
            after["h1"], after["h2"], after["pos"] = 0, 0, ~after["pos"]
            yield _dealt(np.concatenate([firsts, after]), np.concatenate([firsts["h1"], mix(after["id"].view(np.uint64))]), buckets)

    return tidy(run)


def _matched(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        runs = _unpacked(table, _RUN)
        known, after = runs[runs["pos"] < 0], _firsts(runs[runs["pos"] >= 0])[1]
        marks = np.empty(len(known) + len(after), _MARK)
        marks["id"] = np.concatenate([known["id"], after["id"]])
        marks["pos"] = np.concatenate([~known["pos"], after["pos"]])
        return pa.Table.from_batches([_dealt(marks, mix(marks["id"].astype(np.uint64)), buckets)])

    return run


def _by_document(table: pa.Table) -> pa.Table:
    marks = _unpacked(table, _MARK)
    marks = marks[np.lexsort((marks["pos"], marks["id"]))]
    marks = marks[np.append(True, marks[1:] != marks[:-1])]
    ids, begins = np.unique(marks["id"], return_index=True)
    starts = pa.ListArray.from_arrays(pa.array(np.append(begins, len(marks)).astype(np.int32)), pa.array(marks["pos"].copy()))
    return pa.table([pa.array(ids), starts], names=["id", "starts"])


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _starts(runs: DataFrame, apart: int = 1) -> DataFrame:
    """(id, starts) of the rows (id, pos, h1, h2) that are not the first with their hashes; in one document only from ``apart`` places on.

    The firsts are stored, so that the join deals out both sides anew and Spark can split the rows of a frequent run.
    """
    first = runs.groupBy("h1", "h2").agg(F.min(F.struct("id", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    first = stored(first, "firsts")
    after = (F.col("id") > F.col("first.id")) | ((F.col("id") == F.col("first.id")) & (F.col("pos") >= F.col("first.pos") + apart))
    return runs.join(first, ["h1", "h2"]).where(after).groupBy("id").agg(F.collect_set("pos").alias("starts"))


def repeated_runs(docs: DataFrame, id_col: str, text_col: str, least_words: int = LEAST_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """(id, starts): the sentences at which runs begin that are not the first of their kind, of documents that have some."""
    base = _base(docs, id_col, text_col).where("id is not null")
    buckets = max(BUCKETS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    runs = base.mapInArrow(_hashed(least_words, long_words, buckets), _PACKED)
    marks = runs.groupBy("bucket").applyInArrow(_matched(buckets), _PACKED)
    return marks.groupBy("bucket").applyInArrow(_by_document, "id bigint, starts array<int>")


def _covered(text: str, starts: list[int], least_words: int, long_words: int) -> tuple[list[tuple[int, int]], int, int]:
    """Places in the text of the sentences that runs cover, the number of all sentences and of those covered."""
    ends, _, last = _runs_of(text, least_words, long_words)
    gone = sorted({k for a in starts for k in range(a, int(last[a]) + 1)})
    return [(ends[k - 1] if k else 0, ends[k]) for k in gone], len(ends), len(gone)


def _without(text: str, gone: list[tuple[int, int]]) -> str:
    out, done = [], 0
    for a, b in sorted(gone):
        out.append(text[done : max(done, a)])
        done = max(done, b)
    return "".join([*out, text[done:]])


def _removed(least_words: int, long_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            texts, counts, gone = [], [], []
            for text, starts in zip(batch.column("text"), batch.column("starts").to_pylist()):
                text = text.as_py()
                cut, n, k = _covered(text, starts, least_words, long_words) if starts else ([], len(sentence_ends(text)), 0)
                texts.append(_without(text, cut) if cut else text)
                counts.append(n)
                gone.append(k)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], names=["doc_id", "text", "n_sentences", "n_removed"])

    return tidy(run)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, text, n_sentences, n_removed) for each input row, without the sentences of repeated runs.

    The first occurrence of a run is the one of the smallest (doc_id, pos). Runs repeat within a document too. Null and
    empty texts give an empty text; ids are expected to be unique: rows that repeat one are marked alike, each as if it
    were the other; a null id has no runs removed; other columns are ignored; an empty table gives no rows.
    """
    marked = _base(docs, id_col, text_col).join(repeated_runs(docs, id_col, text_col, least_words, long_words), "id", "left")
    return marked.select("id", "text", "starts").mapInArrow(_removed(least_words, long_words), "doc_id bigint, text string, n_sentences bigint, n_removed bigint")


def _doubled(x: np.ndarray, length: int, join) -> np.ndarray:
    """What ``join`` makes of each ``length`` neighbours: of powers of two, then of two that overlap."""
    n = 1
    while 2 * n <= length:
        x, n = join(x[: max(0, len(x) - n)], x[n:]), 2 * n
    rest = length - n
    return join(x[: max(0, len(x) - rest)], x[rest:]) if rest else x


def _grams(words: np.ndarray, length: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of the runs of ``length`` words; none if there are fewer."""
    return _doubled(words, length, lambda a, b: mix(mix(a) * np.uint64(factor) + b))


def _anchors(text: str, length: int, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and for each run of ``length`` words the least hash of the ``ANCHOR_WORDS``-word runs in it."""
    words = hashes.of(split_words(text.lower().encode()))
    if len(words) < length:
        return words, np.empty(0, np.uint64)
    return words, _doubled(_grams(words, min(ANCHOR_WORDS, length)), length - min(ANCHOR_WORDS, length) + 1, np.minimum)


def _anchored(length: int):
    room = length - min(ANCHOR_WORDS, length) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in portions(batches):
            ids, found, counts = [], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                every = _anchors(text.as_py(), length, hashes)[1]
                ends = np.append(np.flatnonzero(every[1:] != every[:-1]), [len(every) - 1] * (len(every) > 0)).astype(np.int64)
                # one place gives neighbouring runs, and no more than it has room for
                anchors, of = np.unique(every[ends], return_inverse=True)
                ids += [i] * len(anchors)
                found.append(anchors)
                counts.append(np.bincount(of, -(np.diff(ends, prepend=-1) // -room), len(anchors)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(counts))], names=["id", "anchor", "n"])

    return run


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in portions(batches):
            for i, text, shared in zip(batch.column("id").to_pylist(), batch.column("text"), batch.column("anchors")):
                words, anchors = _anchors(text.as_py(), length, hashes)
                at = np.flatnonzero(np.isin(anchors, shared.values.to_numpy().view(np.uint64)))
                h1, h2 = (_grams(words, length, f)[at].view(np.int64) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int64)), pa.array(at.astype(np.int32)), pa.array(h1), pa.array(h2)], names=["id", "pos", "h1", "h2"])

    return run


def repeated_passages(docs: DataFrame, id_col: str, text_col: str, length: int = PASSAGE_WORDS) -> DataFrame:
    """(id, starts): places of the runs of ``length`` words that are not the first of their kind, wherever sentences end.

    A run's anchor follows from its words alone, so runs that are equal have equal anchors: only runs whose anchor is
    found again are hashed and joined, and none is missed. Within a document a repeat does not overlap its first.
    """
    base = _base(docs, id_col, text_col).where("id is not null")
    anchors = stored(base.mapInArrow(_anchored(length), "id bigint, anchor bigint, n bigint"), "anchors")
    again = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    shared = anchors.join(again, "anchor").groupBy("id").agg(F.collect_set("anchor").alias("anchors"))
    windows = stored(base.join(shared, "id").mapInArrow(_windows(length), "id bigint, pos int, h1 bigint, h2 bigint"), "windows")
    return _starts(windows, length)


def _cut(length: int, least_words: int, long_words: int):
    word = re.compile(r"[^\t-\r ]+[\t-\r ]*")

    def clean(text: str, runs: list[int] | None, passages: list[int] | None) -> str:
        gone = _covered(text, runs, least_words, long_words)[0] if runs else []
        if passages:
            at = [m.span() for m in word.finditer(text)]
            gone += [(at[p][0], at[p + length - 1][1]) for p in passages]
        return _without(text, gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            before = batch.column("text").to_pylist()
            after = [clean(*row) if row[1] or row[2] else row[0] for row in zip(before, batch.column("runs").to_pylist(), batch.column("passages").to_pylist())]
            n = [len(word.findall(t)) for t in before]
            gone = [0 if a is b else k - len(word.findall(b)) for a, b, k in zip(before, after, n)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(after, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=["doc_id", "text", "n_words", "n_removed"])

    return run


def drop_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = PASSAGE_WORDS, least_words: int = LEAST_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, text, n_words, n_removed) for each input row: without repeated runs of sentences or of ``length`` words.

    Both rules look at the texts as they came; n_words and n_removed count words before and those removed. What stands
    next to each other only after the removal is not compared again. Edge cases are those of ``drop_repeats``.
    """
    runs = repeated_runs(docs, id_col, text_col, least_words, long_words).withColumnRenamed("starts", "runs")
    passages = repeated_passages(docs, id_col, text_col, length).withColumnRenamed("starts", "passages")
    marked = _base(docs, id_col, text_col).join(runs, "id", "left").join(passages, "id", "left")
    return marked.select("id", "text", "runs", "passages").mapInArrow(_cut(length, least_words, long_words), "doc_id bigint, text string, n_words bigint, n_removed bigint")


ORACLE_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '(?s).*?(?:[.!?]+["'')\]]*[ \t\n\r\f]+|[。！？]+[ \t\n\r\f]*|\n[ \t\n\r\f]*)|(?s).+') as s from documents),
p as (select doc_id, list_transform(s, lambda x: trim(regexp_replace(lower(x), '[ \t\n\r\f]+', ' ', 'g'), ' ')) as s from d),
e as (select doc_id, s, unnest(range(1, len(s) + 1)) as i, unnest(s) as x from p),
z as (select doc_id, s, i, case when x = '' then 0 else greatest(length(x) - length(replace(x, ' ', '')) + 1, length(x) // 8) end as z from e),
c as (select *, sum(z) over (partition by doc_id order by i) as c from z),
r as (select a.doc_id, a.s, a.i, case when b.i > a.i then b.i when a.z >= 50 then a.i else a.i + 1 end as j
from (select *, c - z + 20 as t from c) a asof join (select doc_id, i, c from c) b on a.doc_id = b.doc_id and a.t <= b.c),
m as (select doc_id, i, j, row_number() over (partition by s[i:j] order by doc_id, i) as k from r where j <= len(s)),
g as (select distinct doc_id, unnest(range(i, j + 1)) as i from m where k > 1),
l as (select doc_id, list(i) as covered from g group by doc_id)
select d.doc_id as doc_id, array_to_string(list_filter(list_transform(range(1, len(s) + 1), lambda i: case when list_contains(coalesce(covered, []), i) then null else s[i] end), lambda x: x is not null), '') as text,
len(s)::bigint as n_sentences, len(coalesce(covered, []))::bigint as n_removed
from d left join l using (doc_id)
"""
