"""Suffix-array dedup: bytes of a passage that stands in an earlier document go.

The index is a logarithmic family: batches of documents in doc_id order get a suffix array each
(suffixes in byte order, cut at the match length), are merge-scanned against the levels built from
all earlier batches, and join them; levels of equal size merge, so n batches keep about log2(n)
levels. Suffixes are sampled at content-chosen anchors (``repeats``), which every match of the
length contains, and a shard of anchors is one family, so no array grows with the corpus.

Null and empty texts have no bytes. Documents with equal doc_id are not earlier than each other;
documents without one come last and never match each other. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bazaarlens.llm.repeats import Kind, cut_documents, repeated_spans
from bazaarlens.llm.shared import keyed
from bazaarlens.llm.textbytes import ragged

#: Suffixes of one batch.
BATCH_SUFFIXES = 1 << 14
#: Suffixes worked off at a time; the last anchor of a shard may exceed it.
SHARD_SUFFIXES = 1 << 18


class SuffixLevels:
    """Sorted suffixes of earlier batches in levels of about doubling size."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def seen(self, suffixes: np.ndarray) -> np.ndarray:
        """Which of the sorted ``suffixes`` stand in a level: one merge scan for each level."""
        out = np.zeros(len(suffixes), dtype=bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level, suffixes), len(level) - 1)
            out |= level[at] == suffixes
        return out

    def add(self, suffixes: np.ndarray) -> None:
        """A new level; as long as the one before is not larger, both become one."""
        while self.levels and len(self.levels[-1]) <= len(suffixes):
            suffixes = np.unique(np.concatenate((self.levels.pop(), suffixes)))
        self.levels.append(suffixes)


def earlier(suffixes: np.ndarray, order: np.ndarray, batch: int = BATCH_SUFFIXES) -> np.ndarray:
    """Which suffixes also stand under a smaller ``order``; ``order`` rises."""
    family, out, at = SuffixLevels(), np.zeros(len(suffixes), dtype=bool), 0
    while at < len(suffixes):
        to = int(np.searchsorted(order, order[min(at + batch, len(order)) - 1], "right"))
        own, place = suffixes[at:to], np.argsort(suffixes[at:to], kind="stable")
        own = own[place]
        head = np.concatenate(([True], own[1:] != own[:-1]))
        first = order[at:to][place][head][np.cumsum(head) - 1]
        found = family.seen(own[head])[np.cumsum(head) - 1] | (order[at:to][place] > first)
        out[at + place] = found
        family.add(own[head])
        at = to
    return out


def _search(window: int, divisor: int):
    def search(table: pa.Table) -> pa.Table:
        anchor, cls, key, start = (table.column(c).to_numpy() for c in ("anchor", "cls", "key", "start"))
        content = table.column("content").combine_chunks()
        offsets = np.frombuffer(content.buffers()[1], dtype=np.int32)[content.offset : content.offset + len(content) + 1].astype(np.int64)
        data = np.frombuffer(content.buffers()[2], dtype=np.uint8)
        document = key // divisor
        by_class = np.lexsort((document, cls, anchor))
        head = np.concatenate(([True], (anchor[by_class][1:] != anchor[by_class][:-1]) | (cls[by_class][1:] != cls[by_class][:-1])))
        first = document[by_class][head][np.cumsum(head) - 1]
        rows = by_class[document[by_class] == first]  # later members of a class are settled already
        rows = rows[np.lexsort((document[rows], anchor[rows]))]
        windows = (offsets[1:] - offsets[:-1])[rows] - window + 1
        # Equal suffixes have equal anchors, so whole anchors are worked off in shards of bounded size.
        new = np.flatnonzero(np.concatenate(([True], anchor[rows][1:] != anchor[rows][:-1])))
        shard = (np.cumsum(windows) - windows)[new] // SHARD_SUFFIXES
        cuts = np.append(new[np.concatenate(([True], shard[1:] != shard[:-1]))], len(rows))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = rows[a:b][np.argsort(document[rows[a:b]], kind="stable")]
            n = (offsets[1:] - offsets[:-1])[own] - window + 1
            places, owner = ragged(offsets[own], n), np.repeat(own, n)
            suffixes = np.lib.stride_tricks.sliding_window_view(data, window)[places].view(f"S{window}").reshape(-1)
            found = earlier(suffixes, document[owner])
            out.append((key[owner[found]], (start[owner] + places - offsets[owner])[found]))
        keys, at = (np.concatenate(x) for x in zip(*out))
        return pa.table({"key": pa.array(keys), "start": pa.array(at.astype(np.int32)), "end": pa.array((at + window).astype(np.int32))})

    return search


def _cut(text: bytes, starts: np.ndarray, ends: np.ndarray) -> dict:
    kept = hashlib.sha256()
    at = 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        kept.update(text[at:a])
        at = b
    kept.update(text[at:])
    return {"n_bytes": len(text), "n_removed": int((ends - starts).sum()), "n_spans": len(starts), "kept_sha256": kept.hexdigest()}


def _text(text: bytes, starts: np.ndarray, ends: np.ndarray) -> dict:
    at, kept = 0, []
    for a, b in zip(starts.tolist(), ends.tolist()):
        kept.append(text[at:a])
        at = b
    return {"kept": b"".join([*kept, text[at:]]).decode(errors="replace")}


def suffix_spans(docs: DataFrame, length: int = 50) -> tuple[DataFrame, DataFrame]:
    """The keyed documents, and (key, start, end) in bytes of what stands in earlier documents."""
    rows, divisor = keyed(docs)
    kind = Kind("byte", length, max(1, min(20, length // 2)), False)
    return rows, repeated_spans(rows, kind, divisor, _search(length, divisor))


def remove_earlier(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, kept): each text without such bytes; a cut character becomes the replacement sign."""
    return cut_documents(*suffix_spans(docs, length), "kept string", _text)


def suffix_digest(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of the bytes that stay."""
    return cut_documents(*suffix_spans(docs, length), "n_bytes long, n_removed long, n_spans long, kept_sha256 string", _cut)
