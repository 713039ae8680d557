"""SentencePiece encoding and decoding, with a max-plus parallel scan over chunks of giant documents.

The model file is a BPE model with byte fallback, whose segmentation is not a best path under piece scores. It is a
path all the same: a sequence of pieces is the BPE segmentation exactly if each adjacent pair is the segmentation of
the two joined. With arc weights 0 for such pairs and minus infinity for others, the max-plus best path is the
segmentation, and weights need one bit. From any start at most one piece ends validly at each place.

A text longer than a chunk is cut at fixed places. The state at a cut is the piece that covers the character before it
and how far it reaches beyond; a chunk's transfer matrix says which states at its left cut lead to which at its right
cut. Products of matrices combine associatively, block by block up a tree; on the way down they settle the states at all
cuts, and each chunk is then backtraced by itself. No piece crosses the start of a word (a space after another character), so within a chunk only the cut words
at its ends need the matrix, and words between are looked up in a table of words already segmented.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.columns import id_text
from lexloom.llm.words import portions, tidy
from lexloom.plans.shared import stored

TOKENIZER_DIR = "/opt/tokenizers"
MODEL = "piece_bpe_32k.model"
CHUNK_CHARS = 32_768
#: Bytes of texts or chunks that are worked on at once: their rows and ids as Python objects take many times their bytes.
CHUNK_BYTES = 1 << 20
#: Words, none longer than KEPT_CHARS, and pairs of pieces that a task keeps.
KEPT_WORDS, KEPT_CHARS = 300_000, 64
KEPT_PAIRS = 300_000
#: Neighbouring chunks, or blocks of them, whose matrices one task multiplies.
BLOCK = 16
SPACE = "▁"
#: The state before the first character of a text.
BEGIN = (1 << 30, 0)
_WORD_START = re.compile(f"(?<=[^{SPACE}]){SPACE}")


class Words(dict):
    """Ids, as 32-bit bytes, by word, whose leading space is left out; a missing word is segmented, and a full table
    begun anew."""

    def __init__(self, own: Pieces) -> None:
        self.own = own

    def __missing__(self, word: str) -> bytes:
        found = array("i", self.own.flat(self.own.whole(SPACE + word.replace(" ", SPACE)))).tobytes()
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = found
        return found


class Pieces:
    """A model's vocabulary and the rule for adjacent pieces. A character without a piece is the piece -1 - its code point.

    Made anew by each task, with its tables, so workers that Spark reuses hold on to nothing.
    """

    def __init__(self, model: bytes) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.data: list[bytes] = []
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.data.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.data.append(b"")
            else:
                self.ids[piece] = i
                self.data.append(piece.replace(SPACE, " ").encode())
        self.texts = {i: p for p, i in self.ids.items()}
        self.joined = lambda text: sp.encode("\n" + text.replace(SPACE, " "))[2:]
        self.tree: dict = {}  # characters to subtrees; under "" the piece that ends here
        for piece, i in self.ids.items():
            node = self.tree
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        self.longest = max(map(len, self.ids))
        self.pairs: dict[int, bool] = {}
        self.words = Words(self)

    def text(self, t: int) -> str:
        return self.texts[t] if t >= 0 else chr(-1 - t)

    def valid(self, a: int | None, b: int) -> bool:
        """Whether piece b may follow a, or start a text if a is None: the library segments the two, joined, as they are.

        A line feed has no piece, so what follows one is segmented by itself, without a space before it.
        """
        key = ((BEGIN[0] if a is None else a) << 32) + b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            parts = [b] if a is None else [a, b]
            found = self.pairs[key] = self.joined("".join(map(self.text, parts))) == self.flat(parts)
        return found

    def ending(self, text: str, i: int, least: int = 0) -> Iterator[tuple[int, int]]:
        """(start, piece) of the pieces that end at i and start at ``least`` or later."""
        for j in range(i - 1, max(least, i - self.longest) - 1, -1):
            t = self.ids.get(text[j:i])
            if t is not None:
                yield j, t
            elif j == i - 1:
                yield j, -1 - ord(text[j])

    def segment(self, text: str, start: int = 0, first: int | None = None, stop: int | None = None, last: tuple[int, int] | None = None) -> list[int]:
        """Pieces of text[start:stop] that follow piece ``first``; ``last`` = (start, piece) must then be the one at the end."""
        stop = len(text) if stop is None else stop
        at: dict[int, tuple[int, int | None]] = {start: (start, first)}
        for i in range(start + 1, stop + 1):
            for j, t in self.ending(text, i, start):
                if j in at and (i < stop or last is None or last == (j, t)) and self.valid(at[j][1], t):
                    at[i] = (j, t)
                    break
        out, i = [], stop
        while i > start:
            i, t = at[i]
            out.append(t)
        return out[::-1]

    def reach(self, text: str, nodes: dict[int, dict[int | None, int]], start: int, stop: int) -> dict[int, dict[int | None, int]]:
        """The bits of ``nodes`` (place: piece that ends there: bits), carried over valid arcs to all places up to ``stop``."""
        for i in range(start + 1, stop + 1):
            for j, t in self.ending(text, i, start):
                bits = 0
                for u, b in nodes.get(j, {}).items():
                    if self.valid(u, t):
                        bits |= b
                if bits:
                    own = nodes.setdefault(i, {})
                    own[t] = own.get(t, 0) | bits
        return nodes

    def flat(self, parts: list[int]) -> list[int]:
        """Ids of pieces; a character without a piece becomes its bytes."""
        if min(parts, default=0) >= 0:
            return parts
        return [i for t in parts for i in ([t] if t >= 0 else [self.bytes[b] for b in chr(-1 - t).encode()])]

    def whole(self, text: str) -> list[int]:
        """``segment`` of a text by itself, for the many short ones: there is one valid path, so the first that a search
        with the longest pieces first finds is it. A state that led nowhere is not entered again."""
        tree, pairs, n = self.tree, self.pairs.get, len(text)
        out: list[int] = []
        untried: list[tuple[int, list[tuple[int, int]]]] = []  # for each piece taken: where it starts, and shorter ones there
        dead: set[tuple[int, int]] = set()
        i, u = 0, BEGIN[0]
        while i < n:
            found: list[tuple[int, int]] = []  # pieces that start here, with their ends
            node = tree.get(text[i])
            if node is None or "" not in node:  # a character without a piece
                found.append((-1 - ord(text[i]), i + 1))
            k = i + 1
            while node is not None:
                t = node.get("")
                if t is not None:
                    found.append((t, k))
                if k == n:
                    break
                node = node.get(text[k])
                k += 1
            while True:
                if not found:
                    dead.add((u, i))
                    i, found = untried.pop()
                    out.pop()
                    u = out[-1] if out else BEGIN[0]
                    continue
                t, k = found.pop()
                ok = pairs((u << 32) + t)
                if ok is None:
                    ok = self.valid(u if i else None, t)
                if ok and (t, k) not in dead:
                    break
            untried.append((i, found))
            out.append(t)
            i, u = k, t
        return out

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        words = text.replace(SPACE, " ").split(" ")
        if "" in words:  # several spaces belong to the word after them
            joined, run = [], ""
            for k, w in enumerate(words):
                if w or k == len(words) - 1:
                    joined.append(run + w)
                    run = ""
                else:
                    run += " "
            words = joined
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.int32)

    def decode(self, ids: np.ndarray, begins: bool = True) -> str:
        """The text of ids; of those that begin a text the first space is left out."""
        return b"".join(map(self.data.__getitem__, ids.tolist())).decode(errors="replace")[1 if begins else 0 :]

    # the scan

    def covering(self, text: str, cut: int) -> list[tuple[int, int]]:
        """States at a cut: (piece, characters beyond) of the pieces that cover the character before it."""
        return [(t, i - cut) for i in range(cut, min(len(text), cut + self.longest - 1) + 1) for j, t in self.ending(text, i) if j < cut]

    def _frame(self, left: str, body: str, right: str) -> tuple[str, int, int, int | None, int]:
        """The text, its cuts, and the first and last word starts between them (none: None, and the left cut)."""
        text, low, high = left + body + right, len(left), len(left) + len(body)
        starts = [m.start() for m in _WORD_START.finditer(text, low, high)]
        return text, low, high, starts[0] if starts else None, starts[-1] if starts else low

    def transfer(self, left: str, body: str, right: str, first: bool, final: bool) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """The chunk's matrix: for each state at its right cut, the states at its left cut that lead to it."""
        text, low, high, word, tail = self._frame(left, body, right)
        entries = [BEGIN] if first else self.covering(text, low)
        nodes: dict[int, dict[int | None, int]] = {}
        for k, (t, beyond) in enumerate(entries):
            own = nodes.setdefault(low + beyond, {})
            own[None if first else t] = own.get(t, 0) | 1 << k
        if word is not None:
            at_word = self.reach(text, nodes, low, word).get(word, {})
            bits = 0
            for b in at_word.values():
                bits |= b
            nodes = {tail: {None: bits}}
        exits = [(None, 0)] if final else self.covering(text, high)
        edge = high + max(beyond for _, beyond in exits)
        nodes = self.reach(text, nodes, tail, edge)
        out = {}
        for t, beyond in exits:
            here = nodes.get(high + beyond, {})
            if final:
                bits = 0
                for b in here.values():
                    bits |= b
                out[BEGIN] = bits
            else:
                out[(t, beyond)] = here.get(t, 0)
        return {x: [e for k, e in enumerate(entries) if bits >> k & 1] for x, bits in out.items() if bits}

    def backtrace(self, left: str, body: str, right: str, entry: tuple[int, int], exit_: tuple[int, int]) -> list[int]:
        """Ids of the pieces after the entry state's, up to and with the exit state's."""
        text, low, high, word, tail = self._frame(left, body, right)
        start, before = low + entry[1], None if entry == BEGIN else entry[0]
        stop = high if exit_ == BEGIN else high + exit_[1]
        last = None if exit_ == BEGIN else (stop - len(self.text(exit_[0])), exit_[0])
        if word is None:
            return self.flat(self.segment(text, start, before, stop, last))
        head = self.flat(self.segment(text, start, before, word))
        middle = self.encode(text[word + 1 : tail].replace(SPACE, " ")).tolist() if tail > word else []
        return head + middle + self.flat(self.segment(text, tail, None, stop, last))


def settle(matrices: list[dict], begin: tuple[int, int] = BEGIN, end: tuple[int, int] = BEGIN) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """The states at both cuts of each chunk on the one path through neighbouring matrices from ``begin`` to ``end``."""
    alive = [{begin}]
    for m in matrices:
        alive.append({x for x, entries in m.items() if any(e in alive[-1] for e in entries)})
    out, state = [], end
    for k in range(len(matrices) - 1, -1, -1):
        entry = next(e for e in matrices[k][state] if e in alive[k])
        out.append((entry, state))
        state = entry
    return out[::-1]


def product(a: dict, b: dict) -> dict:
    """The matrix of two neighbouring chunks as one; associative."""
    return {x: found for x, entries in b.items() if (found := sorted({e for m in entries for e in a.get(m, [])}))}


def _encoded(model: bytes, back: bool):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pieces(model)
        for batch in portions(batches, "text", CHUNK_BYTES):
            rows = [own.encode(t.as_py()) for t in batch.column("text")]
            texts = pa.array([own.decode(r) if back else None for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.list_(pa.int32())), texts], names=["id", "ids", "decoded"])

    return run


def _cut(chunk: int, around: int):
    names = ["uid", "id", "no", "last", "left", "body", "right"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            for uid, i, text in zip(batch.column("uid").to_pylist(), batch.column("id").to_pylist(), batch.column("text")):
                text = SPACE + text.as_py().replace(" ", SPACE)
                last = (len(text) - 1) // chunk
                rows = [(uid, i, k, last, text[max(0, k * chunk - around) : k * chunk], text[k * chunk : (k + 1) * chunk], text[(k + 1) * chunk : (k + 1) * chunk + around]) for k in range(last + 1)]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


_STATE = "struct<piece:int,beyond:int>"
_MATRIX = f"uid bigint, no bigint, matrix array<struct<exit:{_STATE},entries:array<{_STATE}>>>"
_ARROW_STATE = pa.struct([("piece", pa.int32()), ("beyond", pa.int32())])
_ARROW_MATRIX = pa.list_(pa.struct([("exit", _ARROW_STATE), ("entries", pa.list_(_ARROW_STATE))]))


def _pair(s: tuple[int, int]) -> dict:
    return {"piece": s[0], "beyond": s[1]}


def _state(s: dict) -> tuple[int, int]:
    return s["piece"], s["beyond"]


def _row(matrix: dict) -> list[dict]:
    return [{"exit": _pair(x), "entries": [_pair(e) for e in es]} for x, es in matrix.items()]


def _matrix(row: list[dict]) -> dict:
    return {_state(m["exit"]): [_state(e) for e in m["entries"]] for m in row}


def _matrices(model: bytes):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pieces(model)
        for batch in portions(batches, "body", CHUNK_BYTES):
            found = [_row(own.transfer(r["left"], r["body"], r["right"], r["no"] == 0, r["no"] == r["last"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("no"), pa.array(found, _ARROW_MATRIX)], names=["uid", "no", "matrix"])

    return run


def _multiplied(table: pa.Table) -> pa.Table:
    """The matrices of one block (uid, above) as one, numbered by the block."""
    rows = sorted(table.to_pylist(), key=lambda r: r["no"])
    whole = reduce(product, [_matrix(r["matrix"]) for r in rows])
    return pa.table({"uid": pa.array([rows[0]["uid"]], pa.int64()), "no": pa.array([rows[0]["above"]], pa.int64()), "matrix": pa.array([_row(whole)], _ARROW_MATRIX)})


def _settled(table: pa.Table) -> pa.Table:
    """Of one block, whose states at its ends each row carries: the states at the ends of its parts."""
    rows = sorted(table.to_pylist(), key=lambda r: r["no"])
    path = settle([_matrix(r["matrix"]) for r in rows], _state(rows[0]["entry"]), _state(rows[0]["exit"]))
    ends = [pa.array([_pair(p[k]) for p in path], _ARROW_STATE) for k in (0, 1)]
    return pa.table({"uid": pa.array([r["uid"] for r in rows], pa.int64()), "no": pa.array([r["no"] for r in rows], pa.int64()), "entry": ends[0], "exit": ends[1]})


def _states(matrices: DataFrame, block: int) -> DataFrame:
    """(uid, no, entry, exit) of each chunk: matrices are multiplied block by block up to one block a text, whose ends are
    known, and the states are settled on the way down. No task gets more than ``block`` matrices of a text."""
    levels = [matrices]
    while (levels[-1].agg(F.max("no")).first()[0] or 0) >= block:  # one round more for each power of ``block``
        levels.append(stored(levels[-1].withColumn("above", F.floor(F.col("no") / block)).groupBy("uid", "above").applyInArrow(_multiplied, _MATRIX), "matrices"))
    ends = F.struct(F.lit(BEGIN[0]).alias("piece"), F.lit(BEGIN[1]).alias("beyond"))
    known = None
    for level in reversed(levels):
        placed = level.withColumn("above", F.floor(F.col("no") / block))
        if known is None:
            placed = placed.withColumn("entry", ends).withColumn("exit", ends)
        else:
            placed = placed.join(known.withColumnRenamed("no", "above"), ["uid", "above"])
        known = placed.groupBy("uid", "above").applyInArrow(_settled, f"uid bigint, no bigint, entry {_STATE}, exit {_STATE}")
    return known


def _traced(model: bytes, back: bool):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pieces(model)
        for batch in portions(batches, "body", CHUNK_BYTES):
            rows = [np.array(own.backtrace(r["left"], r["body"], r["right"], _state(r["entry"]), _state(r["exit"])), np.int32) for r in batch.to_pylist()]
            # a chunk's ids are whole characters, so it is decoded by itself; only the first has the space before the text
            texts = pa.array([own.decode(r, no == 0) if back else None for r, no in zip(rows, batch.column("no").to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("id"), batch.column("no"), pa.array(rows, pa.list_(pa.int32())), texts], names=["uid", "id", "no", "part", "text"])

    return run


def load_model(directory: str = TOKENIZER_DIR, name: str = MODEL) -> bytes:
    """The model file's bytes, which travel with the tasks: executors need no such file. At most a few MB."""
    with open(f"{directory}/{name}", "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, block: int = BLOCK) -> DataFrame:
    """(doc_id, ids) for each input row: the ids of its whole text, without control pieces.

    Null and empty texts give no ids; repeated rows each give a row; a null id stays null; other columns are ignored;
    an empty table gives no rows. Texts of ``chunk_chars`` and more are scanned in chunks that are tasks of their own.
    """
    return _scan(docs, model, id_col, text_col, chunk_chars, block, False).select("doc_id", "ids")


def round_trip(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, block: int = BLOCK) -> DataFrame:
    """(doc_id, ids, text): as ``encode``, with the text that the ids decode to, made in the same pass."""
    return _scan(docs, model, id_col, text_col, chunk_chars, block, True)


def _scan(docs: DataFrame, model: bytes, id_col: str, text_col: str, chunk_chars: int, block: int, back: bool) -> DataFrame:
    base = id_text(docs, id_col, text_col).select(F.col("id").cast("bigint").alias("id"), "text")
    plain = base.where(F.length("text") < chunk_chars).mapInArrow(_encoded(model, back), "id bigint, ids array<int>, decoded string")
    around = 2 * Pieces(model).longest
    giant = base.where(F.length("text") >= chunk_chars).withColumn("uid", F.monotonically_increasing_id())
    chunks = stored(giant.select("uid", "id", "text").mapInArrow(_cut(chunk_chars, around), "uid bigint, id bigint, no bigint, last bigint, left string, body string, right string"), "chunks")
    matrices = stored(chunks.mapInArrow(_matrices(model), _MATRIX), "matrices")
    states = stored(_states(matrices, block), "states")
    parts = chunks.join(states, ["uid", "no"]).mapInArrow(_traced(model, back), "uid bigint, id bigint, no bigint, part array<int>, text string")
    whole = parts.groupBy("uid").agg(F.first("id").alias("id"), F.array_sort(F.collect_list(F.struct("no", "part", "text"))).alias("p"))
    return plain.union(whole.select("id", F.flatten("p.part"), F.array_join("p.text", ""))).select(F.col("id").alias("doc_id"), "ids", F.col("decoded").alias("text"))


def decode(encoded: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, text) for each input row; null ids and empty lists give an empty text. Inverse of ``encode`` for
    every text without the character U+2581, which the model takes for a space."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pieces(model)
        for batch in batches:
            ids = batch.column("ids")
            texts = [own.decode(x.values.to_numpy()) if x.is_valid else "" for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    base = encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return base.mapInArrow(run, "doc_id bigint, ids array<int>, text string")
