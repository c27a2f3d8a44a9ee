"""Word kernels shared by the text operators.

A word is a maximal run of characters other than ``\\x20`` and ``\\x09-\\x0D``.  The kernels work on
Arrow string columns inside a task: a batch is cut into slices of a few megabytes, each slice is split
by Arrow, and whatever costs time per word (hashing, tokenising, scoring) is done once per distinct
word of the slice.  Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 8 << 20
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


_held_by: dict[str, Callable[[], None]] = {}


def take_over(owner: str, release: Callable[[], None] | None = None) -> None:
    """Gives back what another operator left in this worker, which lives on from stage to stage."""
    for other in [o for o in _held_by if o != owner]:
        _held_by.pop(other)()
    if release is not None:
        _held_by[owner] = release
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def spans(values: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal values starts and ends; none for an empty array."""
    if not len(values):
        return []
    edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def slices(batch: pa.RecordBatch | pa.Table, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.Table]:
    """Cuts a batch into tables of about ``limit`` bytes of text, one row at least.

    Workers live on from task to task, so what a slice took is given back before the next one.
    """
    table = pa.table(batch) if isinstance(batch, pa.Table) else pa.Table.from_batches([batch])
    sizes = pc.fill_null(pc.binary_length(table[text]), 0).to_numpy().astype(np.int64)
    for start, stop in spans((np.cumsum(sizes) - sizes) // limit):
        yield table.slice(start, stop - start)
        pa.default_memory_pool().release_unused()


def one_array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """A column as one array of strings without nulls."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    return pc.fill_null(array.cast(pa.large_string()), "")


def split_words(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``(bounds, codes, vocabulary)``: row ``i`` has the words ``vocabulary[codes[bounds[i]:bounds[i+1]]]``."""
    lists = pc.ascii_split_whitespace(one_array(column))
    bounds = lists.offsets.to_numpy().astype(np.int64)
    encoded = lists.flatten().dictionary_encode()
    codes, vocabulary = encoded.indices.to_numpy(), encoded.dictionary
    bounds = bounds - bounds[0]
    empty = pc.index(vocabulary, pa.scalar("", vocabulary.type)).as_py()
    if empty >= 0:
        real = codes != empty
        bounds = np.concatenate([[0], np.cumsum(real, dtype=np.int64)])[bounds]
        codes = codes[real]
    return bounds, codes, vocabulary


def whole_texts(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """As ``split_words``, with each text as its one word."""
    encoded = one_array(column).dictionary_encode()
    return np.arange(len(column) + 1), encoded.indices.to_numpy(), encoded.dictionary


def hash_words(vocabulary: pa.Array) -> np.ndarray:
    """Two independent 64-bit hashes of each distinct word, shape ``(2, n)``."""
    digest = xxhash.xxh3_128_digest
    raw = b"".join([digest(w) for w in vocabulary.cast(pa.large_binary()).to_pylist()])
    return np.ascontiguousarray(np.frombuffer(raw, "<u8").reshape(-1, 2).T)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit of ``x`` over the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def roll(hashes: np.ndarray, width: int, multiplier: np.uint64) -> np.ndarray:
    """The hash of each ``width`` consecutive elements of ``hashes``."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = hashes[:n].copy()
    for j in range(1, width):
        total *= multiplier
        total += hashes[j : n + j]
    return mix(total)


def window_starts(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window of ``width`` words lies in one row, and how many each row has."""
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    firsts = np.cumsum(counts) - counts
    return np.arange(counts.sum()) + np.repeat(bounds[:-1] - firsts, counts), counts
