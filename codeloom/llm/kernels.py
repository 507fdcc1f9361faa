"""Vectorised text kernels shared by the operators: Arrow strings in, numpy arrays out.

A "word" is a maximal run of bytes other than the six ASCII white-space characters.
Everything works on whole texts; `pieces` only bounds how many documents are held as
numpy arrays at a time.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

WHITE = np.zeros(256, dtype=bool)
WHITE[list(b" \t\n\r\f\v")] = True
#: The same class for Java and RE2 regular expressions.
WHITE_CLASS = r"[ \t\n\r\f\x0b]"

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)
_BLOCK = 1 << 19
_libc = ctypes.CDLL(None) if sys.platform == "linux" else None
_trim = getattr(_libc, "malloc_trim", None)
if hasattr(_libc, "mallopt"):  # else glibc raises both by itself, to 32 and 64 MB, and keeps freed arrays in each worker
    _libc.mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD: larger arrays are given back when they are freed
    _libc.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def bound_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Cuts the session's Arrow batches at `most` bytes, where they may be larger now: 10,000 long texts wouldn't fit in a worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark.conf.get(name).rstrip("b")
    if not have.isdigit() or int(have) > most:
        spark.conf.set(name, str(most))


def release() -> None:
    """Gives back memory that is free: workers are reused, and idle ones stay beside those at work."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows with at most `most` bytes of text, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        i = 0
        while i < n:
            before = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(i, j - i)
            i = j
    release()


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and n + 1 offsets; a null is an empty text."""
    a = pc.fill_null(texts.cast(pa.large_binary()), b"")
    n = len(a)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + n + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the number of its first word (n + 1 values)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    white = WHITE[data]
    before = np.empty_like(white)
    before[0], before[1:] = True, white[:-1]
    heads = offsets[:-1]
    before[heads[heads < len(data)]] = True
    after = np.empty_like(white)
    after[-1], after[:-1] = True, white[1:]
    tails = offsets[1:]
    after[tails[tails > 0] - 1] = True
    starts = np.flatnonzero(~white & before)
    ends = np.flatnonzero(~white & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, equal for equal bytes wherever they stand. Spans come in order; a block of bytes is looked at at a time."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _BLOCK, "right")))
        piece = data[base : ends[j - 1]]
        n = len(piece)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[piece] * _power(_STEP, n), out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[b] - sums[a]) * _power(_BACK, n + 1)[a])
        i = j
    return out


def rolling(a: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of a[i : i + width] for every i with a full window, equal for equal values wherever they stand."""
    n = len(a)
    if n < width:
        return a[:0].astype(np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(a * _power(_STEP, n), out=sums[1:])
    return mix((sums[width:] - sums[: n - width + 1]) * _power(_BACK, n + 1)[: n - width + 1])


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """min(a[i : i + width]) for every i with a full window, by doubling."""
    if len(a) < width:
        return a[:0]
    have, m = 1, a
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[: len(m) - (width - have)], m[width - have :])
    return m


def grouped(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with equal values of `keys`, whole numbers, across batches; the input is sorted by them."""
    held: list[pa.RecordBatch] = []
    held_key: tuple = ()
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(key).to_numpy(zero_copy_only=False) for key in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), k.shape[1]]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = tuple(k[:, a].tolist())
            if held and own != held_key:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = own
            held.append(batch.slice(a, b - a))
    if held:
        yield held_key, pa.Table.from_batches(held)
    release()
