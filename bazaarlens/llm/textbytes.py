"""Vectorised work on the UTF-8 bytes of Arrow text columns inside Spark tasks.

A batch is walked in chunks of a few MB, so a task's temporary arrays stay bounded whatever the
batch holds; one text is never split. Hashes are 64-bit polynomial sums over random byte values, so
the hash of any span of bytes or words comes from two prefix sums. Modulo a power of two, certain
words of 1024 letters and more share their sum whatever the base, so long words are named by a
cryptographic hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
#: Words from this length on are hashed as a whole.
LONG_WORD = 256

_U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
#: A random value for each byte, and the odd base of the polynomial with its inverse modulo 2**64.
BYTE_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=_U64) * _U64(2) + _U64(1)
_BASE = 0x9E3779B97F4A7C17
_INVERSE = pow(_BASE, -1, 1 << 64)


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    for low, high in ranges:
        out[low : high + 1] = False
    return out


#: True for the bytes of words: `[^\x20\x09-\x0D]+`, and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing.
PLAIN_WORD = _table((0x20, 0x20), (0x09, 0x0D))
TERM_WORD = _table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Powers:
    """Powers of the base and of its inverse, grown as far as a chunk needs."""

    up = np.ones(1, dtype=_U64)
    down = np.ones(1, dtype=_U64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            size = max(n + 1, 2 * len(cls.up), CHUNK_BYTES + 4096)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, dtype=_U64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps))
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` takes the hash of any span of ``values``."""
    up, _ = Powers.upto(len(values))
    out = np.zeros(len(values) + 1, dtype=_U64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values in [start, end), the same wherever the span stands."""
    _, down = Powers.upto(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U64) * _U64(0xD6E8FEB86659FD93))


def fixed_hash(sums: np.ndarray, size: int) -> np.ndarray:
    """``span_hash`` of every span of ``size`` values."""
    n = len(sums) - 1
    if n < size:
        return np.zeros(0, dtype=_U64)
    _, down = Powers.upto(len(sums))
    out = sums[size:] - sums[: n + 1 - size]
    out *= down[: len(out)]
    out += _U64((size * 0xD6E8FEB86659FD93) % (1 << 64))
    return mix(out)


class Chunk(NamedTuple):
    """Some rows of a batch: their numbers, joined bytes, and where each text begins (one more)."""

    rows: np.ndarray
    data: np.ndarray
    first: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.first[i] : self.first[i + 1]].tobytes()


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of an Arrow string column (null: empty) in chunks of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        yield Chunk(np.arange(at, to), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


class Words(NamedTuple):
    """Words of a chunk: byte positions, and where the words of each text begin (one more)."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(chunk: Chunk, table: np.ndarray, data: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes that ``table`` marks; a run ends at the end of its text."""
    data = chunk.data if data is None else data
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, np.zeros(len(chunk.first), dtype=np.int64))
    inside = table[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    firsts = chunk.first[:-1]
    before[firsts[firsts < n]] = False
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    lasts = chunk.first[1:] - 1
    after[lasts[lasts >= 0]] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, chunk.first))


def word_hashes(data: np.ndarray, found: Words) -> np.ndarray:
    out = span_hash(prefix_sums(BYTE_VALUES[data]), found.start, found.end)
    for i in np.flatnonzero(found.end - found.start >= LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[found.start[i] : found.end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i] ... starts[i] + sizes[i] - 1 of all i, one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the position of its leftmost smallest one."""
    best, at, span = values, np.arange(len(values), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[:-step], best[step:]
        take = right < left
        best = np.where(take, right, left)
        at = np.where(take, at[step:], at[:-step])
        span += step
    return at
