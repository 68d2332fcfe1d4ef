"""Columnar word helpers used inside Arrow tasks.

A word is a run of characters other than ASCII white space
(`[^\\x20\\x09-\\x0D]+`), taken from the whole text. All helpers work on slices
of an Arrow batch so that a task holds a few megabytes of text at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 4 << 20
_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def slices(batches, column="text", limit=SLICE_BYTES):
    """Cut Arrow batches into runs of rows of about `limit` bytes of text (one row at least).

    What Arrow has set aside is given back after each batch: a worker lives on between tasks and stages, and
    what each leaves behind would add up in the executor's memory.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()


def split(texts) -> tuple[np.ndarray, pa.Array]:
    """Word offsets of every row (n + 1 numbers) and the words of all rows; null texts have none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = lists.flatten()
    counts = np.diff(lists.offsets.to_numpy())
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        row = np.repeat(np.arange(len(counts)), counts)[full]
        counts = np.bincount(row, minlength=len(counts))
        words = words.filter(pa.array(full))
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), words


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) for arrays of uint64."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def distinct(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of each word in a list of the distinct words, and that list."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; a distinct word is hashed once."""
    index, known = distinct(words)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in known.to_pylist()), np.uint64, len(known))
    return hashes[index] if len(known) else np.zeros(0, np.uint64)


def windows(hashes: np.ndarray, length: int, step: np.uint64 = _STEP) -> np.ndarray:
    """A 64-bit hash of every run of `length` consecutive word hashes, by start; another odd step gives another hash."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = out * step + hashes[k : k + n]
        out ^= out >> np.uint64(32)
    return mix(out)


def within(offsets: np.ndarray, length: int) -> np.ndarray:
    """Which starts of a run of `length` words over all rows lie, with the whole run, in one row."""
    n = int(offsets[-1]) - length + 1
    if n <= 0:
        return np.zeros(0, bool)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return row[:n] == row[length - 1 : length - 1 + n]
