"""Word and shingle hashes of whole batches of texts in numpy, without a Python loop over words."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int, start: int = 0) -> np.ndarray:
    """``n`` reproducible 64-bit words."""
    with np.errstate(over="ignore"):
        return mix((np.arange(start + 1, start + n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


BYTE_KEYS = stream(11, 256)
PLACE_KEYS = stream(12, 1 << 12) | np.uint64(1)


def place_keys(n: int) -> np.ndarray:
    return PLACE_KEYS[:n] if n <= len(PLACE_KEYS) else stream(12, n) | np.uint64(1)


def chunks(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes; a longer text is a range of its own, never cut."""
    col = batch.column(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def give_back() -> None:
    """Return a worker's free memory to the system: Spark keeps idle workers, beside the JVM that the next stage needs it for."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def joined(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, each followed by a line feed, and where each text starts."""
    parts = [x or b"" for x in col.cast(pa.binary()).to_pylist()]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in parts], out=starts[1:])
    return np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), starts


def words(data: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every run of bytes that aren't ``space``, A-Z taken as a-z."""
    inside = ~space[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.zeros(0, np.uint64), begin, end
    sizes = end - begin
    flat = np.flatnonzero(inside)
    first = np.zeros(len(begin), np.int64)
    np.cumsum(sizes[:-1], out=first[1:])
    with np.errstate(over="ignore"):
        place = place_keys(int(sizes.max()))[flat - np.repeat(begin, sizes)]
        h = np.add.reduceat(BYTE_KEYS[LOWER[data[flat]]] * place, first)
        return mix(h + sizes.astype(np.uint64)), begin, end


def shingle_sets(col: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``size``-word shingle hashes of each text, sorted, and the offsets between texts.

    A text with fewer words gives its whole sequence as one shingle; a text without words gives none.
    """
    data, starts = joined(col)
    h, begin, _ = words(data)
    bounds = np.searchsorted(begin, starts)
    out, sizes = [], np.zeros(len(col) + 1, np.int64)
    keys = stream(13, size) | np.uint64(1)
    with np.errstate(over="ignore"):
        full = len(h) - size + 1
        rolled = sum((h[i : i + full] * keys[i] for i in range(1, size)), h[:full] * keys[0]) if full > 0 else h[:0]
        rolled = mix(rolled)
        for i in range(len(col)):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= size:
                s = np.unique(rolled[a : b - size + 1])
            elif b > a:
                s = mix((h[a:b] * keys[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                s = h[:0]
            out.append(s)
            sizes[i + 1] = len(s)
    return np.concatenate(out) if out else h[:0], np.cumsum(sizes)
