"""Substring dedup: every word of a passage that stands in two places goes.

Reference shards are the distinct contexts of repeated anchors (``repeats``). Each shard is a
bounded suffix automaton whose states know how often they occur; contexts are streamed through it
for matching statistics, and spans at or above the threshold that occur twice are removed. Shards
travel to the contexts that can match them rather than to every document: sending each shard to all
documents would grow with the square of the corpus.

Null and empty texts have no words. Rows that repeat a doc_id are documents of their own, so
repeated rows remove each other's passages. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bazaarlens.llm.repeats import Kind, cut_documents, repeated_spans
from bazaarlens.llm.shared import keyed

#: Words of one automaton; a shard with more is worked off in several, anchor by anchor.
SHARD_WORDS = 200_000


class SuffixAutomaton:
    """All substrings of some sequences, with the number of places of each."""

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length, self.places = [-1], [0], [0]

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.places.append(0)
        return len(self.step) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list[int], places: int) -> None:
        last = 0
        for c in sequence:
            q = self.step[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
            else:
                new, p = self._state(self.length[last] + 1, {}, 0), last
                while p >= 0 and c not in self.step[p]:
                    self.step[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.step[p][c]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
                last = new
            self.places[last] += places

    def finish(self) -> None:
        """Places of every state, and the longest suffix of each that has two."""
        order = sorted(range(1, len(self.step)), key=self.length.__getitem__)
        for v in reversed(order):
            self.places[self.link[v]] += self.places[v]
        self.twice = [0] * len(self.step)
        for v in order:
            self.twice[v] = self.length[v] if self.places[v] > 1 else self.twice[self.link[v]]

    def statistics(self, sequence: list[int]) -> list[int]:
        """For each end the length of the longest match that has two places."""
        v, length, out = 0, 0, []
        for c in sequence:
            while v and c not in self.step[v]:
                v = self.link[v]
                length = self.length[v]
            if c in self.step[v]:
                v, length = self.step[v][c], length + 1
            out.append(length if self.places[v] > 1 and v else self.twice[v])
        return out


def _search(window: int):
    def search(table: pa.Table) -> pa.Table:
        anchor, cls, key, start, many = (table.column(c).to_numpy() for c in ("anchor", "cls", "key", "start", "many"))
        content = table.column("content").to_pylist()
        order = np.lexsort((cls, anchor))
        new = np.concatenate(([True], anchor[order][1:] != anchor[order][:-1]))
        head = new | np.concatenate(([True], cls[order][1:] != cls[order][:-1]))
        places = np.bincount(np.cumsum(head) - 1, weights=many[order])
        several = np.bincount(np.cumsum(new) - 1, weights=head)[np.cumsum(new) - 1] > 1
        out: list[list[int]] = [[], [], []]

        def work(group: list[tuple[int, int]]) -> None:
            shard, held = SuffixAutomaton(), []
            for i, n in group:
                words = np.frombuffer(content[i], dtype=np.int64).tolist()
                shard.add(words, n)
                held.append((i, n, words))
            shard.finish()
            for i, n, words in held:
                if n > 1:  # settled as a whole class
                    continue
                opened = closed = -1
                for end, length in enumerate(shard.statistics(words), 1):
                    if length >= window:
                        if end - window > closed and opened >= 0:
                            for column, value in zip(out, (key[i], start[i] + opened, start[i] + closed)):
                                column.append(int(value))
                            opened = -1
                        opened, closed = (end - window if opened < 0 else opened), end
                if opened >= 0:
                    for column, value in zip(out, (key[i], start[i] + opened, start[i] + closed)):
                        column.append(int(value))

        group: list[tuple[int, int]] = []
        size, rank = 0, -1
        for at, i in enumerate(order):
            rank += head[at]
            if new[at] and size > SHARD_WORDS:
                work(group)
                group, size = [], 0
            if head[at] and several[at]:
                group.append((int(i), int(places[rank])))
                size += len(content[i]) // 8
        work(group)
        return pa.table({"key": pa.array(out[0], pa.int64()), "start": pa.array(out[1], pa.int32()), "end": pa.array(out[2], pa.int32())})

    return search


def _cut(text: bytes, starts: np.ndarray, ends: np.ndarray) -> dict:
    words = text.split()  # bytes.split parts at \x20 and \x09-\x0D
    kept, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        kept += words[at:a]
        at = b
    kept += words[at:]
    return {"n_words": len(words), "n_removed": len(words) - len(kept), "n_spans": len(starts), "kept_sha256": hashlib.sha256(b" ".join(kept)).hexdigest()}


def _text(text: bytes, starts: np.ndarray, ends: np.ndarray) -> dict:
    words = text.split()
    at, kept = 0, []
    for a, b in zip(starts.tolist(), ends.tolist()):
        kept += words[at:a]
        at = b
    return {"kept": b" ".join(kept + words[at:]).decode()}


def substring_spans(docs: DataFrame, window: int = 35) -> tuple[DataFrame, DataFrame]:
    """The keyed documents, and (key, start, end) in words of their repeated passages."""
    rows, divisor = keyed(docs)
    kind = Kind("word", window, max(1, min(8, window // 2)), True)
    return rows, repeated_spans(rows, kind, divisor, _search(window))


def remove_substrings(docs: DataFrame, window: int = 35) -> DataFrame:
    """(doc_id, kept): each text without the words of repeated passages, joined by one space."""
    return cut_documents(*substring_spans(docs, window), "kept string", _text)


def substring_digest(docs: DataFrame, window: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, n_spans, kept_sha256) of ``remove_substrings``."""
    return cut_documents(*substring_spans(docs, window), "n_words long, n_removed long, n_spans long, kept_sha256 string", _cut)
