"""Words and their hashes, for the operators that work on arrays of hashed words in Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are worked on at once: Spark's batches count rows, whatever their length.
PORTION_BYTES = 4 << 20

#: Words whose hashes a task keeps, and the longest of them in bytes; the table is emptied when it is full.
KEPT_WORDS, KEPT_BYTES = 150_000, 64


class Hashes(dict):
    """Hashes by word. Made anew by each task and gone with it, so workers that Spark reuses hold on to nothing."""

    def __missing__(self, word: bytes | str) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= KEPT_BYTES:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def portions(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of a text column, each of one row at least."""
    for batch in batches:
        part = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // most
        starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(a, b - a)


def give_back() -> None:
    """Hand memory that is free back to the system. The allocators keep it otherwise, and workers that Spark reuses hold on
    to the most that their tasks have needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow function over batches that gives back its memory when its task is done."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            give_back()

    return tidied


def split_words(data: bytes) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lower-cased: what lies between spaces and the characters 9 to 13."""
    return data.lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(data: bytes, k: int, hashes: Hashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; of the whole sequence if it is shorter; none without words."""
    words = hashes.of(split_words(data))
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    found = np.full(n, k, np.uint64)
    for i in range(k):
        found = mix(found * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return np.unique(found)
