"""Cutting texts into the pieces of a tokenizer pattern, by whole batches.

Letters, numbers and white space are asked of the tokenizer library itself, whose tables follow another Unicode version than
Python's; the driver sends them to the tasks as ranges.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

#: The common pattern of byte-level vocabularies, which is cut without an engine (fixed value).
COMMON = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE, LETTER, NUMBER, OTHER = range(4)
CODE_POINTS = 0x110000


@lru_cache(maxsize=1)
def kind_ranges() -> bytes:
    """First code point of every run of one kind, times four, plus the kind: as the engine of ``tiktoken`` classes them. An
    encoding of single bytes drops what its pattern does not match, so one call per kind names all of its code points."""
    import tiktoken

    every = "".join(chr(c) for c in range(CODE_POINTS) if not 0xD800 <= c < 0xE000)
    kind = np.full(CODE_POINTS, OTHER, np.int64)
    for k, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        single = tiktoken.Encoding(f"kind{k}", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        kind[[ord(c) for c in bytes(single.encode_ordinary(every)).decode()]] = k
    first = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    return (first * 4 + kind[first]).astype(np.int32).tobytes()


@lru_cache(maxsize=1)
def kinds(ranges: bytes) -> np.ndarray:
    """Kind of each code point."""
    both = np.frombuffer(ranges, np.int32)
    return np.repeat((both % 4).astype(np.uint8), np.diff(np.append(both // 4, CODE_POINTS)))


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the places of their first bytes."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    b = padded[at].astype(np.int32)
    many = np.flatnonzero(b >= 0x80)
    if len(many):
        b0 = b[many]
        b1, b2, b3 = (padded[at[many] + k].astype(np.int32) & 63 for k in (1, 2, 3))
        b[many] = np.where(b0 < 0xE0, (b0 & 31) << 6 | b1, np.where(
            b0 < 0xF0, (b0 & 15) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3))
    return b, at


def common_starts(data: np.ndarray, offs: np.ndarray, ranges: bytes) -> np.ndarray:
    """First bytes of the pieces of texts, as ``COMMON`` cuts them."""
    code, at = code_points(data)
    n = len(code)
    if not n:
        return np.zeros(0, np.int64)
    kind = kinds(ranges)[code]
    begins = np.zeros(n + 3, bool)  # of texts, with room behind the last one
    begins[np.searchsorted(at, offs)] = True
    turn = np.ones(n, bool)
    turn[1:] = (kind[1:] != kind[:-1]) | begins[1:n]
    start = turn.copy()
    # White space before other characters gives up its last character, which joins what follows if it is a space.
    inner = np.flatnonzero(turn & (kind != SPACE) & ~begins[:n])
    after_white = inner[kind[inner - 1] == SPACE]
    start[after_white - 1] = True
    start[after_white[code[after_white - 1] == 0x20]] = False
    # An apostrophe alone takes the letters of a contraction along.
    open_ = np.concatenate([code, np.zeros(3, np.int32)])
    sign = np.flatnonzero((code == 0x27) & turn & start)
    sign = sign[~begins[sign + 1]]
    a, b = open_[sign + 1], np.where(begins[sign + 2], 0, open_[sign + 2])
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    for hit, length in ((sign[one], 2), (sign[two], 3)):
        start[hit + 1] = False
        rest = hit + length
        rest = rest[(rest < n) & ~begins[np.minimum(rest, n)]]
        start[rest] = True
    return at[start]


def cut(data: np.ndarray, offs: np.ndarray, pattern: str, ranges: bytes) -> tuple[pa.StringArray, np.ndarray]:
    """All pieces in order, and the number of each text; ``ranges`` are the ``kind_ranges`` of the driver."""
    if pattern == COMMON:
        starts = common_starts(data, offs, ranges)
    else:
        found, whole = [], data.tobytes()
        engine = regex.compile(pattern)
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
            text, place = whole[a:b].decode(), a
            for match in engine.finditer(text):
                found.append(place)
                place += len(match[0].encode())
        starts = np.array(found, np.int64)
    offsets = np.concatenate([starts, [len(data)]]).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))
    return pieces, np.diff(np.searchsorted(starts, offs))
