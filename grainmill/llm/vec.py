"""Vectorised work on the UTF-8 bytes of a whole Arrow batch of texts.

The operators that run in Python see a batch of texts as one byte buffer and an offset array, cut
into chunks of a few megabytes, and use numpy on whole chunks: no Python loop runs per word.
Memory is bounded by the chunk size, or by the longest single text where that is larger.
"""

from __future__ import annotations

import ctypes
import platform
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
BLOCK = 1 << 14  # values of 64 bits that are worked on at once where it pays to stay in the cache
U64 = np.uint64

_LIBC = ctypes.CDLL("libc.so.6") if sys.platform == "linux" and platform.libc_ver()[0] == "glibc" else None
if _LIBC is not None:
    _LIBC.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD: what is larger goes back to the system as soon as it is free
_rng = np.random.Generator(np.random.PCG64(20240229))
#: Random odd values for bytes, and odd bases, of the polynomial hashes mod 2^64.
BYTE = [_rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1) for _ in range(2)]
BASE = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
_POW: dict[int, np.ndarray] = {}
_INV: dict[int, np.ndarray] = {}


def trim() -> None:
    """Give memory that is free back to the system; a worker that is used again would keep its peak."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _table(words: bool) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    if words:
        t[:0x80] = True
        t[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
    return t


#: Bytes between words: white space only, or all ASCII but letters and digits.
SPACE, NONWORD = _table(False), _table(True)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _powers(base: int, n: int, store: dict[int, np.ndarray]) -> np.ndarray:
    have = store.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK + 4096), base, np.uint64)
        steps[0] = 1
        have = store[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def powers(n: int, which: int = 0) -> np.ndarray:
    return _powers(BASE[which], n, _POW)


def inverses(n: int, which: int = 0) -> np.ndarray:
    return _powers(pow(BASE[which], -1, 1 << 64), n, _INV)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits: nearby values become unrelated."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets into them; a null is as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def flat_bytes(column: pa.Array) -> np.ndarray:
    """The bytes of a binary column, joined."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]


def chunks(buf: np.ndarray, offs: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, their bytes, their offsets) of at most limit bytes, or of one text."""
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1)
        yield a, b, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def words(buf: np.ndarray, offs: np.ndarray, table: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for text i its words first[i] to first[i + 1]."""
    inside = ~table[buf]
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    cut = np.zeros(len(buf) + 1, bool)  # a text begins here
    cut[offs] = True
    before = np.empty(len(buf), bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(buf), bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE[which][buf] * powers(len(buf), which), out=total[1:])
    return mix((total[ends] - total[starts]) * inverses(len(buf) + 1, which)[starts] + (ends - starts).astype(np.uint64))


def sums(buf: np.ndarray, which: int = 0) -> np.ndarray:
    """The polynomial's sums over the first 0, 1, ... bytes."""
    out, power = np.zeros(len(buf) + 1, np.uint64), powers(len(buf), which)
    index, term = np.empty(BLOCK, np.intp), np.empty(BLOCK, np.uint64)
    for a in range(0, len(buf), BLOCK):
        n = min(BLOCK, len(buf) - a)
        i, x = index[:n], term[:n]
        i[:] = buf[a : a + n]
        np.take(BYTE[which], i, out=x, mode="clip")  # without buffering; no index is out of bounds
        x *= power[a : a + n]
        x[:1] += out[a : a + 1]
        np.cumsum(x, out=out[a + 1 : a + n + 1])
    return out


def window_hashes(values: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of size consecutive values."""
    if len(values) < size:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), which), out=total[1:])
    return mix((total[size:] - total[:-size]) * inverses(len(values) + 1, which)[: len(values) - size + 1])


def byte_window_hashes(buf: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    return window_hashes(BYTE[which][buf], size, which)


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """True for each word at which a window of size words of one text starts, cut to the windows' number."""
    n = int(first[-1])
    ok = np.zeros(n + 1, np.int32)
    long = np.diff(first) >= size
    np.add.at(ok, first[:-1][long], 1)
    np.add.at(ok, first[1:][long] - size + 1, -1)
    return np.cumsum(ok)[: max(0, n - size + 1)] > 0


def member(keys: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted set; a bitmap of low bits saves most searches."""
    out = np.zeros(len(keys), bool)
    if not len(sorted_set) or not len(keys):
        return out
    bits = min(24, max(10, int(len(sorted_set)).bit_length() + 4))
    mask = U64((1 << bits) - 1)
    seen = np.zeros(1 << bits, bool)
    seen[(sorted_set & mask).astype(np.int64)] = True
    maybe = np.flatnonzero(seen[(keys & mask).astype(np.int64)])
    at = np.searchsorted(sorted_set, keys[maybe])
    out[maybe] = sorted_set[np.minimum(at, len(sorted_set) - 1)] == keys[maybe]
    return out


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    s = np.sort(keys)
    return member(keys, s[1:][s[1:] == s[:-1]])


def cover(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n places lie in [start, start + size) of any start."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + size, n), -1)
    return np.cumsum(edge[:-1]) > 0


def per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offs])


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of set flags."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
