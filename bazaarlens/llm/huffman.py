"""Canonical length-limited Huffman codes: lengths from counts, block encoder, lane decoder."""

from __future__ import annotations

import numpy as np


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    level, leaf = weights, [np.ones(n, dtype=bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((weights, pairs))
        place = np.argsort(both, kind="stable")
        level = both[place]
        leaf.append(place < n)
    lengths, take = np.zeros(n, dtype=np.uint8), 2 * n - 2
    for is_leaf in reversed(leaf):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


class Codebook:
    """Codes in (length, symbol) order, and the table that maps the next bits to symbol and length."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = lengths.astype(np.int64)
        self.bits = int(lengths.max()) if len(lengths) else 1
        symbols = np.flatnonzero(lengths)
        symbols = symbols[np.argsort(self.lengths[symbols], kind="stable")]
        spans = np.int64(1) << (self.bits - self.lengths[symbols])
        first = np.cumsum(spans) - spans
        self.codes = np.zeros(len(lengths), dtype=np.uint64)
        self.codes[symbols] = (first >> (self.bits - self.lengths[symbols])).astype(np.uint64)
        self.symbol = np.zeros(1 << self.bits, dtype=np.uint32)
        self.symbol[: int(spans.sum())] = np.repeat(symbols, spans)

    def encode(self, ids: np.ndarray, every: int) -> tuple[bytes, np.ndarray]:
        """The bit stream and the bit offset of each ``every``-th id."""
        size = self.lengths[ids]
        end = np.cumsum(size)
        at = end - size
        words = np.zeros(int(end[-1]) // 32 + 2 if len(ids) else 2, dtype=np.uint64)
        if len(ids):
            value = self.codes[ids] << (64 - (at & 31) - size).astype(np.uint64)
            word = at >> 5
            heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            joined = np.add.reduceat(value, heads)  # bits never overlap, so the sum is their union
            words[word[heads]] += joined >> np.uint64(32)
            words[word[heads] + 1] += joined & np.uint64(0xFFFFFFFF)
        return words.astype(">u4").tobytes(), at[::every]

    def decode(self, data: bytes, checkpoints: np.ndarray, n: int, every: int) -> np.ndarray:
        """``n`` ids; all checkpoints are decoded side by side, one id of each at a time."""
        words = np.frombuffer(data, dtype=">u4").astype(np.uint64)
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        at, last = checkpoints.astype(np.int64), len(pairs) - 1
        out = np.zeros((len(at), every), dtype=np.uint32)
        mask = np.uint64((1 << self.bits) - 1)
        for step in range(min(every, n)):
            window = pairs[np.minimum(at >> 5, last)] >> (64 - self.bits - (at & 31)).astype(np.uint64)
            ids = self.symbol[(window & mask).astype(np.int64)]
            out[:, step] = ids
            at = at + self.lengths[ids]
        return out.reshape(-1)[:n]
