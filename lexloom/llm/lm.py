"""LM scoring: a weighted backoff automaton of order three, learned from the training share of the table.

States are contexts: the empty one, the start of a text, each word and each pair of words (of which the first may be the
start) that training holds. With P0(w) = (c(w) + 1) / (N + V + 1), an arc from context h exists where c(hw) > 0 and
weighs log10 of P(w | h) = (c(hw) + m P(w | h')) / (c(h) + m), h' being h without its first word; any other word takes
the failure arc to h', which weighs log10(m / (c(h) + m)). Summed over the V known words and one unknown, each state's
probabilities are 1. m, one for each order, follows from counts of counts: the mass that all failure arcs of an order
carry in training equals the number of n-grams seen once (Good-Turing). A text is read from left to right; the state is
the longest context that exists.

The automaton of the whole corpus has no size bound, so it is never gathered. Texts are read in chunks; a chunk has an
automaton of its own with just the arcs that its texts can take, and exact corpus counts on them:

1. a map stores each chunk's texts, compressed;
2. each chunk gives its sorted distinct n-grams with their training counts, in RANGES ranges of the hash;
3. per range, the counts of a group of chunks are added. Of several groups, each takes part in the next round as a chunk
   whose ranges are cut again, so a task's data and a chunk's pieces stay bounded at any size of input;
4. on the way back each chunk is sent its totals, in its own order, and meets its texts, which one traversal scores.

A frequent n-gram is one entry per chunk, so no range is hot. N-grams are 64-bit hashes: two that collide would share a
count.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.columns import id_text
from lexloom.llm.words import Hashes, give_back, mix, split_words, tidy
from lexloom.plans.shared import stored

#: Bytes of text after which a chunk is closed.
CHUNK_BYTES = 10 << 20
#: Hash ranges into which a chunk's n-grams are cut, and groups whose sums meet in the next round.
RANGES = 256
#: Bytes of text in a group of chunks; one range of a group is one task's.
GROUP_BYTES = 4 << 30
#: Tokens that are traversed at once.
STEP_TOKENS = 65_536
START, END, FACTOR = np.uint64(0x53544152), np.uint64(0x454E44), np.uint64(0x9E3779B97F4A7C15)
#: Counts from here on are told apart by their powers of two alone when counts of counts are taken.
EXACT_COUNTS = 64

UNIGRAM, BIGRAM, TRIGRAM, TEXTS, TOTALS = range(5)
_PIECE = "kind int, part bigint, chunk bigint, keys binary, counts binary, numbers array<bigint>, sums array<bigint>"
_NAMES = ["kind", "part", "chunk", "keys", "counts", "numbers", "sums"]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
_SCHEMA = pa.schema(list(zip(_NAMES, _TYPES)))


def _rows(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*[(*r, None, None)[:7] for r in rows]), _TYPES)]


def _pack(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed: small ones leave planes of zeros."""
    return zstandard.compress(np.ascontiguousarray(values, np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes(), 3)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()


def _delta(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data), dtype=np.uint64)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct values, where each comes first, and each value's index among them: np.unique in half its memory."""
    order = np.argsort(values, kind="stable").astype(np.int32)
    values = values[order]
    new = np.append(True, values[1:] != values[:-1])[: len(values)]
    keys, first = values[new], order[new]
    del values
    at = np.empty(len(order), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return keys, first, at


class Chunk:
    """Some texts as hashed tokens: each text's words and then END. ``at[k]`` has, for each token, the index of the n-gram
    of k + 1 tokens that ends there among the sorted distinct ones ``keys[k]``; -1 for the third order at a text's start.
    """

    def __init__(self, texts: Iterator[bytes]) -> None:
        hashes, rows = Hashes(), []
        for t in texts:
            rows += [hashes.of(split_words(t)), np.array([END])]
        self.lengths = np.array([len(r) + 1 for r in rows[::2]], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        tokens = np.concatenate(rows)
        del rows, hashes
        before = np.roll(tokens, 1)
        before[self.starts] = START
        pairs = mix(before * FACTOR + tokens)
        self.keys, self.first, self.at = [], [], []
        self._add(tokens)
        del tokens
        inner = np.ones(len(pairs), bool)
        inner[self.starts] = False
        triples = mix(np.roll(before, 1)[inner] * FACTOR + pairs[inner])
        del before
        self._add(pairs)
        del pairs
        self._add(triples)
        every = np.full(len(inner), -1, np.int32)
        every[inner] = self.at[2]
        self.at[2], self.first[2] = every, np.flatnonzero(inner)[self.first[2]].astype(np.int32)

    def _add(self, values: np.ndarray) -> None:
        for own, found in zip((self.keys, self.first, self.at), _distinct(values)):
            own.append(found)

    def counts(self, train: np.ndarray) -> list[np.ndarray]:
        """How often each n-gram occurs in the texts that train."""
        own = np.repeat(train, self.lengths)
        return [np.bincount(at[own & (at >= 0)], minlength=len(keys)).astype(np.uint64) for keys, at in zip(self.keys, self.at)]


def _cut(keys: np.ndarray, parts: int, low: int = 0, high: int | None = None) -> Iterator[tuple[int, int, int]]:
    """(part, begin, end) in sorted keys of those of ``parts`` equal ranges, from ``low`` to before ``high``, that hold some."""
    edges = np.arange(low, (parts if high is None else high) + 1, dtype=np.uint64)
    edge = np.searchsorted(((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32), edges)
    return ((low + p, a, b) for p, (a, b) in enumerate(zip(edge, edge[1:])) if b > a)


@tidy
def _stored_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def close() -> pa.RecordBatch:
        # what is carried on is the tokens: words in lower case, single spaces
        heads = struct.pack(f"<{2 * len(ids)}q", *[i or 0 for i in ids], *map(len, texts)) + bytes([(i is None) * 2 + t for i, t in zip(ids, train)])
        body = zstandard.compress(b"".join(texts), 9)
        # named by place too: two chunks may hold the same rows
        name = xxhash.xxh64_intdigest(struct.pack("<2q", at, count) + heads + body) >> 1
        return pa.RecordBatch.from_arrays(_rows([(TEXTS, len(ids), name, heads, body)]), schema=_SCHEMA)

    texts, ids, train, size, count, at = [], [], [], 0, 0, TaskContext.get().partitionId()
    for batch in batches:
        for i, text, own in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("train").to_pylist()):
            texts.append(b" ".join(split_words(text.as_py())))
            ids.append(i)
            train.append(own)
            size += len(texts[-1])
            if size >= CHUNK_BYTES:
                yield close()
                texts, ids, train, size, count = [], [], [], 0, count + 1
    if texts:
        yield close()


def _opened(row: dict) -> tuple[list[int | None], np.ndarray, Iterator[bytes]]:
    """Ids, which of them train, and texts of a stored chunk."""
    n, heads, body = row["part"], row["keys"], zstandard.decompress(row["counts"])
    numbers, flags = np.frombuffer(heads, np.int64, 2 * n), np.frombuffer(heads, np.uint8, n, 16 * n)
    ids = [None if f & 2 else i for i, f in zip(numbers[:n].tolist(), flags)]
    ends = np.cumsum(numbers[n:]).tolist()
    return ids, (flags & 1).astype(bool), (body[a:b] for a, b in zip([0, *ends], ends))


def _pieces(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, train, texts = _opened(row)
                chunk = Chunk(texts)
                found = []
                for kind, (keys, counts) in enumerate(zip(chunk.keys, chunk.counts(train))):
                    found += [(kind, p, row["chunk"], _delta(keys[a:b]), _pack(counts[a:b])) for p, a, b in _cut(keys, ranges)]
                del chunk, texts, keys, counts
                out = pa.RecordBatch.from_arrays(_rows(found), schema=_SCHEMA)
                del found
                yield out
                del out

    return tidy(run)


def _merged(rows: list[dict]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each row's keys; all distinct keys; their summed counts."""
    own = [_keys(r["keys"]) for r in rows]
    keys, at = np.unique(np.concatenate(own), return_inverse=True)
    return own, keys, np.bincount(at, np.concatenate([_unpack(r["counts"]) for r in rows]).astype(np.float64)).astype(np.uint64)


def _answers(rows: list[dict], own: list[np.ndarray], keys: np.ndarray, totals: np.ndarray) -> list[tuple]:
    return [(r["kind"], r["part"], r["chunk"], None, _pack(totals[np.searchsorted(keys, k)])) for r, k in zip(rows, own)]


def _answered(table: pa.Table) -> pa.Table:
    """Of one kind and range: each chunk's n-grams with their totals over all chunks, and counts of counts."""
    rows = table.to_pylist()
    own, keys, totals = _merged(rows)
    seen = totals[totals > 0]
    bucket = np.where(seen < EXACT_COUNTS, seen, EXACT_COUNTS + np.log2(seen).astype(np.uint64)).astype(np.int64)
    numbers, sums = np.bincount(bucket, minlength=EXACT_COUNTS + 64), np.bincount(bucket, seen.astype(np.float64), EXACT_COUNTS + 64)
    found = _answers(rows, own, keys, totals) + [(TOTALS, rows[0]["kind"], -1, None, None, numbers.tolist(), sums.astype(np.int64).tolist())]
    return pa.Table.from_arrays(_rows(found), schema=_SCHEMA)


def _as_chunk(parts: int, ranges: int):
    """Of one kind, range and group: the group's n-grams as those of a chunk, the range cut into ``ranges``."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        _, keys, totals = _merged(rows)
        kind, part, group = (rows[0][c] for c in ("kind", "part", "grp"))
        found = [(kind, p, group, _delta(keys[a:b]), _pack(totals[a:b])) for p, a, b in _cut(keys, parts * ranges, part * ranges, (part + 1) * ranges)]
        return pa.Table.from_arrays(_rows(found), schema=_SCHEMA)

    return run


def _handed_down(table: pa.Table) -> pa.Table:
    """Of one kind, range and group: the group's totals, handed on to its chunks."""
    rows = table.to_pylist()
    above = sorted((r for r in rows if r["above"] is not None), key=lambda r: r["above"])
    rows = [r for r in rows if r["above"] is None]
    own = [_keys(r["keys"]) for r in rows]
    totals = np.concatenate([_unpack(r["counts"]) for r in above])
    return pa.Table.from_arrays(_rows(_answers(rows, own, np.unique(np.concatenate(own)), totals)), schema=_SCHEMA)


def corpus_counts(pieces: DataFrame, groups: int, ranges: int = RANGES, parts: int | None = None) -> DataFrame:
    """Pieces with the counts of the whole corpus in place of their own, and rows of counts of counts."""
    parts = parts or ranges
    if groups <= 1:
        return pieces.groupBy("kind", "part").applyInArrow(_answered, _PIECE)
    own = stored(pieces, "pieces").withColumn("grp", F.pmod(F.xxhash64("chunk"), F.lit(groups))).withColumn("above", F.lit(None).cast("bigint"))
    sums = own.groupBy("kind", "part", "grp").applyInArrow(_as_chunk(parts, ranges), _PIECE)
    up = stored(corpus_counts(sums, -(-groups // ranges), ranges, parts * ranges), "counts")
    told = up.where(F.col("kind") < TOTALS).withColumn("grp", F.col("chunk")).withColumn("above", F.col("part")).withColumn("part", F.floor(F.col("part") / ranges))
    return own.union(told).groupBy("kind", "part", "grp").applyInArrow(_handed_down, _PIECE).union(up.where(F.col("kind") == TOTALS))


def backoff_mass(contexts: list[tuple[int, int]], once: int) -> float:
    """The m at which the sum of c m / (c + m) over all contexts is ``once``; contexts are (number, sum of counts) by size."""
    sizes = [(n, s / n) for n, s in contexts if n]
    mass = lambda m: sum(n * c * m / (c + m) for n, c in sizes)
    low, high = 1e-3, 1e9
    for _ in range(80):
        middle = (low * high) ** 0.5
        low, high = (middle, high) if mass(middle) < once else (low, middle)
    return high


class Gathered:
    """``values[at]``, made slice by slice: for all tokens of a chunk such arrays would take most of a task's memory."""

    def __init__(self, values: np.ndarray, at: np.ndarray) -> None:
        self.values, self.at = values, at

    def __getitem__(self, here: slice) -> np.ndarray:
        return self.values[self.at[here]]


def traverse(exists: list[Gathered], arcs: list[Gathered], fails: list[Gathered], starts: np.ndarray, lengths: np.ndarray) -> list[float]:
    """The log-probability of each text, read from left to right.

    For each token and order k: whether the arc of the context of k words exists, its weight, and the weight of that
    context's failure arc. A text begins in the state of its start, of order 1.
    """
    out = []
    for start, length in zip(starts.tolist(), lengths.tolist()):
        total, state = 0.0, 1
        for a in range(start, start + length, STEP_TOKENS):
            here = slice(a, min(a + STEP_TOKENS, start + length))
            for e0, e1, e2, w0, w1, w2, f1, f2 in zip(*(x[here].tolist() for x in (*exists, *arcs, *fails))):
                if state == 2:
                    if e2:
                        total += w2
                        continue  # the last two words occur together, so they are the next state
                    total += f2
                    state = 1
                if state == 1:
                    if e1:
                        total += w1
                        state = 2
                        continue
                    total += f1
                total += w0
                state = 2 if e1 else 1 if e0 else 0
        out.append(total)
    return out


_SCORES = "id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def _scored(n: int, v: int, masses: tuple[float, float]):
    def scored(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["part"]))
        ids, _, texts = _opened(rows.pop())
        chunk = Chunk(texts)
        del texts
        words, pairs, triples = (np.concatenate([np.empty(0, np.uint64), *(_unpack(r["counts"]) for r in rows if r["kind"] == k)]).astype(np.float64) for k in (UNIGRAM, BIGRAM, TRIGRAM))
        del rows
        if [len(words), len(pairs), len(triples)] != [len(k) for k in chunk.keys]:
            raise RuntimeError("a chunk's counts are incomplete")
        ends = words[np.searchsorted(chunk.keys[0], END)]
        del chunk.keys
        word_at, pair_at, triple_at = chunk.at
        # by n-gram: the lower order's probability, and the count of the context
        first = chunk.first[1]
        starts = np.isin(first, chunk.starts)
        context = np.where(starts, ends, words[word_at[first - 1]])  # as many texts end as begin
        single = (words + 1) / (n + v + 1)
        double = (pairs + masses[0] * single[word_at[first]]) / (context + masses[0])
        first = chunk.first[2]
        both = pairs[pair_at[first - 1]]
        triple = (triples + masses[1] * double[pair_at[first]]) / (both + masses[1])
        # a last entry stands for the missing third order at a text's start
        log = lambda x: np.log10(np.append(x, 1.0)).astype(np.float64)
        known = words > 0
        exists = [Gathered(known, word_at), Gathered(pairs > 0, pair_at), Gathered(np.append(triples, 0) > 0, triple_at)]
        base = np.log10(single)
        del first, starts, words, pairs, triples, single
        arcs = [Gathered(base, word_at), Gathered(np.log10(double), pair_at), Gathered(log(triple), triple_at)]
        del double, triple
        fails = [Gathered(np.log10(masses[0] / (context + masses[0])), pair_at), Gathered(log(masses[1] / (both + masses[1])), triple_at)]
        del context, both
        total = lambda x: np.add.reduceat(x, chunk.starts)
        return pa.table({
            "id": pa.array(ids, pa.int64()), "n_tokens": pa.array(chunk.lengths), "n_known": pa.array(total(known[word_at].astype(np.int64))),
            "base_score": pa.array(total(base[word_at])), "score": pa.array(traverse(exists, arcs, fails, chunk.starts, chunk.lengths)),
        })

    def run(table: pa.Table) -> pa.Table:
        try:
            return scored(table)
        finally:
            give_back()

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2, group_bytes: int = GROUP_BYTES, ranges: int = RANGES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each input row.

    Texts whose crc32(id as text) mod ``folds`` is not ``held_out`` train; a null id trains. Null and empty texts are one
    token, the end. Repeated rows count, train and are returned as often as they come; other columns are ignored. An
    empty table gives no rows.
    """
    fold = F.coalesce(F.crc32(F.col("id").cast("string")) % folds, F.lit(-1))
    base = id_text(docs, id_col, text_col).select(F.col("id").cast("bigint").alias("id"), "text").withColumn("train", fold != held_out)
    texts = stored(base.mapInArrow(_stored_texts, _PIECE), "texts")
    size = base.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    counts = stored(corpus_counts(texts.mapInArrow(_pieces(ranges), _PIECE), -(-size // group_bytes), ranges), "counts")
    cells = counts.where(F.col("kind") == TOTALS).select(F.col("part").alias("kind"), F.posexplode(F.arrays_zip("numbers", "sums")).alias("size", "x"))
    of: list[list[tuple[int, int]]] = [[(0, 0)] * (EXACT_COUNTS + 64) for _ in range(3)]
    for kind, size, numbers, sums in cells.groupBy("kind", "size").agg(F.sum("x.numbers"), F.sum("x.sums")).collect():  # at most 3 * 128 rows
        of[kind][size] = (numbers, sums)
    n, v = (sum(x[k] for x in of[UNIGRAM]) for k in (1, 0))
    masses = backoff_mass(of[UNIGRAM], of[BIGRAM][1][0]), backoff_mass(of[BIGRAM], of[TRIGRAM][1][0])
    scores = counts.where(F.col("kind") < TEXTS).union(texts).groupBy("chunk").applyInArrow(_scored(n, v, masses), _SCORES)
    return scores.select(F.col("id").alias("doc_id"), (fold == held_out).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")
