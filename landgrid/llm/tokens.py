"""Words, shingles and hashes of Arrow text columns, by whole batches in numpy.

A word is a maximal run of bytes other than space and the controls 0x09-0x0D. Hashes are 64 bits, the
same in every process: polynomial prefix sums over the bytes, finished by a mixing step.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
CHUNK_BYTES = 1 << 18

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes between plain words: all of ASCII but letters and digits.
MARKS = np.ones(256, dtype=bool)
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_held: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n at least. A process keeps the most it has needed, once for all sizes."""
    size = 1 << max(int(n + 1).bit_length(), 12)
    if not _held or len(_held[0]) < size:
        up = np.full(size, BASE, dtype=U64)
        up[0] = 1
        down = np.full(size, pow(int(BASE), -1, 1 << 64), dtype=U64)
        down[0] = 1
        _held[:] = [np.cumprod(up), np.cumprod(down)]
    return _held[0], _held[1]


@dataclass
class Words:
    """Words of some documents; ``first[d]:first[d + 1]`` are those of document ``d``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; nulls are empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    offs = offs.astype(np.int64)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, np.uint8)[offs[0]:offs[-1]], offs - offs[0]


def split_words(data: np.ndarray, offs: np.ndarray, between: np.ndarray = SPACE) -> Words:
    word = ~between[data]
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    full = np.flatnonzero(np.diff(offs) > 0)
    begin[offs[full]] = word[offs[full]]
    end[offs[full + 1] - 1] = word[offs[full + 1] - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offs))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values. ``np.unique`` hashes integers, which takes many times as long as to sort them."""
    values = np.sort(values)
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    return values[fresh]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span, length included."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] ^ (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of ``n`` consecutive values from each place on; the last n - 1 places have none."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, U64)
    out = words[:size].copy()
    for k in range(1, n):
        out *= BASE
        out += words[k:size + k]
    return mix(out ^ U64(n))


def window_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Places at which ``n`` consecutive words of one document begin."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    shift = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    return np.arange(counts.sum()) + shift


def shingle_sets(texts: pa.Array, n: int, lower: bool = True) -> list[np.ndarray]:
    """Per text its sorted distinct shingles of ``n`` words; a shorter text is one shingle, an empty one none."""
    data, offs = raw(texts)
    words = split_words(LOWER[data] if lower else data, offs)
    hashed = words.hashes()
    grams = ngrams(hashed, n)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= n:
            out.append(distinct(grams[a:b - n + 1]))
        elif b > a:
            out.append(ngrams(hashed[a:b], b - a))
        else:
            out.append(np.zeros(0, U64))
    return out


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)
    trim()


def trim() -> None:
    """Give freed memory back to the system; allocators keep it otherwise, and a worker that has served many steps and waits for
    more looks as large as the largest of them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def segments(data: bytes, size: int = CHUNK_BYTES) -> Iterator[bytes]:
    """``data`` in parts of about ``size`` bytes that end at blanks, so that the words of one part are held at a time."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + size) if at + size < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


def longs(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as signed longs of the same bits."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))
