"""Word k-gram hashes of lower-cased texts, and the places where a set of them occurs.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z became a-z. A bitmap of fixed size lets
grams of interest through at the scan; the joins behind it compare hashes, then the words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.shared import batch, bitmap, has_bit
from bazaarlens.llm.textbytes import LOWER, TERM_WORD, Chunk, Words, chunks, fixed_hash, prefix_sums, word_hashes, words

GRAM_BITS = 1 << 23
PLACES = "key long, doc_id long, n_words int, pos int, size int, hash long, context string, context_start int"


def term_words(chunk: Chunk) -> tuple[np.ndarray, Words]:
    data = LOWER[chunk.data]
    return data, words(chunk, TERM_WORD, data)


def gram_hashes(data: np.ndarray, found: Words, sizes: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size the grams that lie in one text: (size, first words, hashes)."""
    sums = prefix_sums(word_hashes(data, found))
    text = np.repeat(np.arange(len(found.first) - 1), found.counts())
    for size in sizes:
        hashes = fixed_hash(sums, size)
        inside = np.flatnonzero(text[: len(hashes)] == text[size - 1 :][: len(hashes)])
        yield size, inside, hashes[inside]


def gram_bits(grams: DataFrame) -> np.ndarray:
    return bitmap(grams, F.pmod(F.col("hash"), F.lit(GRAM_BITS)), GRAM_BITS)


def _wanted(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return has_bit(known, (hashes & np.uint64(GRAM_BITS - 1)))


def text_grams(texts: DataFrame, size: int) -> DataFrame:
    """(id, text, n_words, pos, size, hash, gram) of small texts; one with fewer words is one gram."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for chunk in chunks(rows.column("text")):
                data, found = term_words(chunk)
                for i in range(len(chunk.rows)):
                    part = [data[a:b].tobytes().decode() for a, b in zip(found.start[found.first[i] : found.first[i + 1]], found.end[found.first[i] : found.first[i + 1]])]
                    if not part:
                        continue
                    k = min(size, len(part))
                    line = " ".join(part).encode()
                    own = Chunk(np.zeros(1, dtype=np.int64), np.frombuffer(line, dtype=np.uint8), np.array([0, len(line)]))
                    _, at, hashes = next(gram_hashes(own.data, words(own, TERM_WORD), [k]))
                    n = len(at)
                    yield batch(
                        id=pa.array([rows.column("id")[int(chunk.rows[i])].as_py()] * n, pa.string()), text=pa.array([line.decode()] * n), n_words=pa.array([len(part)] * n, pa.int32()),
                        pos=pa.array(at.astype(np.int32)), size=pa.array([k] * n, pa.int32()), hash=pa.array(hashes.view(np.int64)), gram=pa.array([" ".join(part[p : p + k]) for p in at.tolist()]))

    return texts.mapInArrow(scan, "id string, text string, n_words int, pos int, size int, hash long, gram string")


def gram_counts(docs: DataFrame, sizes: Sequence[int], known: np.ndarray) -> DataFrame:
    """(hash, n): how often the bitmap's grams stand in all documents."""
    shared, sizes = docs.sparkSession.sparkContext.broadcast(known), list(sizes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            got = [np.zeros(0, dtype=np.uint64)]
            for chunk in chunks(rows.column("text")):
                for _, _, hashes in gram_hashes(*term_words(chunk), sizes):
                    got.append(hashes[_wanted(shared.value, hashes)])
            hashes, n = np.unique(np.concatenate(got), return_counts=True)
            yield batch(hash=pa.array(hashes.view(np.int64)), n=pa.array(n.astype(np.int64)))

    return docs.select("text").mapInArrow(scan, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def gram_places(docs: DataFrame, sizes: Sequence[int], known: np.ndarray, around: int = 0) -> DataFrame:
    """Places of the bitmap's grams with up to ``around`` words on both sides, and for each document
    one row with ``pos`` -1 that has its number of words."""
    shared, sizes = docs.sparkSession.sparkContext.broadcast(known), list(sizes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for chunk in chunks(rows.column("text")):
                data, found = term_words(chunk)
                counts = found.counts()
                own = rows.slice(int(chunk.rows[0]), len(chunk.rows))
                keys, ids = own.column("key"), own.column("doc_id")
                n = len(counts)
                yield batch(
                    key=keys, doc_id=ids, n_words=pa.array(counts.astype(np.int32)), pos=pa.array(np.full(n, -1, dtype=np.int32)), size=pa.nulls(n, pa.int32()),
                    hash=pa.nulls(n, pa.int64()), context=pa.nulls(n, pa.string()), context_start=pa.nulls(n, pa.int32()))
                for size, at, hashes in gram_hashes(data, found, sizes):
                    i = np.flatnonzero(_wanted(shared.value, hashes))
                    if not len(i):
                        continue
                    at, text = at[i], np.searchsorted(found.first, at[i], "right") - 1
                    low = np.maximum(found.first[text], at - around)
                    high = np.minimum(found.first[text + 1], at + size + around)
                    context = [
                        b" ".join(data[a:b].tobytes() for a, b in zip(found.start[x:y], found.end[x:y])).decode() for x, y in zip(low.tolist(), high.tolist())]
                    m, where = len(i), pa.array(text)
                    yield batch(
                        key=keys.take(where), doc_id=ids.take(where), n_words=pa.array(counts[text].astype(np.int32)), pos=pa.array((at - found.first[text]).astype(np.int32)),
                        size=pa.array([size] * m, pa.int32()), hash=pa.array(hashes[i].view(np.int64)), context=pa.array(context), context_start=pa.array((low - found.first[text]).astype(np.int32)))

    return docs.select("key", "doc_id", "text").mapInArrow(scan, PLACES)
