"""Token ids in a compact file format: canonical length-limited Huffman blocks.

Two tables make a file. ``codes``: id and code length, from the ids' counts over all documents.
``blocks``: whole documents in ascending doc_id order; a block holds about BLOCK_IDS ids, decodes on
its own, and has the bit offset of every CHECKPOINT-th id. Both are Parquet, written and read by
Spark, so any store that Spark reaches will do. The vocabulary bounds the code table.

Null and empty texts hold the end id alone. Rows that repeat a doc_id stay documents of their own,
ordered by key (``keyed``); documents without an id come last. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarlens.llm.huffman import Codebook, code_lengths
from bazaarlens.llm.shared import batch, keyed, pack, unpack
from bazaarlens.llm.textbytes import PLAIN_WORD, chunks, ragged, word_hashes, words
from bazaarlens.session import durable

BLOCK_IDS = 1 << 19
CHECKPOINT = 256
MAX_BITS = 16


class WordIds:
    """Ids of words, remembered: one worker encodes a word once while it stays in its tables.

    Text parts at ASCII white space, which no token of the tokenizer crosses. A word of letters
    with ASCII marks behind it goes to the tokenizer's model in two parts; all others go through
    the whole tokenizer.
    """

    SLOTS = 1 << 20
    SIMPLE = re.compile(rb"([A-Za-z]+)([!\"#$%&()*+,./:;<=>?@^_`{|}~\\-]*)")

    def __init__(self, path: str, end_id: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.model = self.tokenizer.model
        self.parts: dict[bytes, bytes] = {}
        #: Whether ids need more than two bytes.
        self.wide = max(self.tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(self.SLOTS, dtype=np.uint64)
        self.entry = np.zeros(self.SLOTS, dtype=np.int32)
        self.flat, self.flat_n = np.full(1 << 16, self.end_id, dtype=np.uint32 if self.wide else np.uint16), 1
        self.start, self.size, self.n = np.zeros(1 << 16, dtype=np.int32), np.ones(1 << 16, dtype=np.int32), 1

    def part(self, raw: bytes) -> bytes:
        ids = self.parts.get(raw)
        if ids is None:
            if len(self.parts) >= self.SLOTS // 4:
                self.parts.clear()
            ids = self.parts[raw] = array("I", [t.id for t in self.model.tokenize(raw.decode())]).tobytes()
        return ids

    def encode(self, new: list[bytes]) -> list[bytes]:
        """The ids of each word, four bytes each."""
        out = []
        for w in new:
            simple = self.SIMPLE.fullmatch(w)
            if simple:
                letters, marks = simple.groups()
                out.append(self.part(letters.lower()) + self.part(marks) if marks else self.part(letters.lower()))
            else:
                out.append(array("I", self.tokenizer.encode(w.decode(), add_special_tokens=False).ids).tobytes())
        return out

    def remember(self, ids: list[bytes]) -> np.ndarray:
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        total, n = int(sizes.sum()), len(ids)
        while self.flat_n + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while self.n + n > len(self.size):
            self.start, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size))
        self.flat[self.flat_n : self.flat_n + total] = np.frombuffer(b"".join(ids), dtype=np.uint32)
        self.start[self.n : self.n + n] = self.flat_n + np.cumsum(sizes) - sizes
        self.size[self.n : self.n + n] = sizes
        self.flat_n, self.n = self.flat_n + total, self.n + n
        return np.arange(self.n - n, self.n)

    def ids(self, data: np.ndarray, found) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk's documents, each with the end id; and how many each has."""
        if self.n > 2 * self.SLOTS:
            self.clear()
        hashes = word_hashes(data, found)
        slot = (hashes & np.uint64(self.SLOTS - 1)).astype(np.int64)
        entry = np.where(self.hashes[slot] == hashes, self.entry[slot], -1)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            kinds, where, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            raw = data.tobytes()
            starts, ends = found.start[missing[where]].tolist(), found.end[missing[where]].tolist()
            fresh = self.remember(self.encode([raw[a:b] for a, b in zip(starts, ends)]))
            entry[missing] = fresh[back]
            slot = (kinds & np.uint64(self.SLOTS - 1)).astype(np.int64)
            self.hashes[slot], self.entry[slot] = kinds, fresh
        entry = np.insert(entry, found.first[1:], 0)  # entry 0 is the end id
        sizes = self.size[entry].astype(np.int64)
        places = np.cumsum(sizes)
        last = found.first[1:] + np.arange(len(found.first) - 1)
        counts = np.diff(np.concatenate(([0], places[last])))
        return self.flat[ragged(self.start[entry], sizes)], counts


def tokens(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """(key, doc_id, n, ids): ids as little-endian bytes of two or four each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _word_ids(tokenizer, end_id)
        for rows in batches:
            for chunk in chunks(rows.column("text")):
                ids, counts = known.ids(chunk.data, words(chunk, PLAIN_WORD))
                raw = ids.astype("<u4" if known.wide else "<u2")
                offsets = np.concatenate(([0], np.cumsum(counts * raw.itemsize))).astype(np.int32)
                part = rows.slice(int(chunk.rows[0]), len(chunk.rows))
                yield batch(key=part.column("key"), doc_id=part.column("doc_id"), n=pa.array(counts.astype(np.int64)),
                            ids=pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]))

    return docs.mapInArrow(scan, "key long, doc_id long, n long, ids binary")


_KNOWN: dict[tuple[str, int], WordIds] = {}


def _word_ids(path: str, end_id: int) -> WordIds:
    """One per worker process, kept for its later tasks."""
    if (path, end_id) not in _KNOWN:
        _KNOWN[path, end_id] = WordIds(path, end_id)
    return _KNOWN[path, end_id]


def _ids(column: pa.Array, total: int) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * total else "<u4")


def count_ids(encoded: DataFrame) -> DataFrame:
    """(id, n) over all documents; each batch sends one row for each id it holds."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = np.bincount(_ids(rows.column("ids"), pc.sum(rows.column("n")).as_py() or 0))
            used = np.flatnonzero(found)
            yield batch(id=pa.array(used.astype(np.int32)), n=pa.array(found[used].astype(np.int64)))

    return encoded.mapInArrow(scan, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_blocks(encoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The file's two tables (codes, blocks), written to the shared folder and read back lazily."""
    spark = encoded.sparkSession
    counts = count_ids(encoded).toArrow()
    total = np.zeros(int(pc.max(counts.column("id")).as_py() or 0) + 1, dtype=np.int64)
    total[counts.column("id").to_numpy()] = counts.column("n").to_numpy()
    used = int((total > 0).sum())
    lengths = code_lengths(total, max(MAX_BITS, (used - 1).bit_length() + 1 if used > 1 << MAX_BITS - 1 else 0))
    codes = durable(spark.createDataFrame(pa.table({"id": np.flatnonzero(lengths).astype(np.int32), "length": lengths[lengths > 0].astype(np.int32)})), "codes")
    shared = spark.sparkContext.broadcast(lengths)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(shared.value)
        held: list[pa.RecordBatch] = []
        size = start = number = 0

        def block() -> pa.RecordBatch:
            nonlocal held, size, start, number
            table = pa.Table.from_batches(held)
            n = table.column("n").to_numpy()
            payload, marks = book.encode(_ids(table.column("ids"), size), CHECKPOINT)
            ids = table.column("doc_id")
            out = batch(
                part=held[0].column("part").slice(0, 1), number=pa.array([number], pa.int32()), start=pa.array([start], pa.int64()), n_ids=pa.array([size], pa.int64()),
                doc_ids=pa.array([pack(pc.fill_null(ids, 0).to_numpy())]), nulls=pa.array([pack(ids.is_null().to_numpy().astype(np.uint8))]),
                sizes=pa.array([pack(n.astype(np.int64))]), marks=pa.array([pack(marks.astype(np.int64))]), payload=pa.array([payload]))
            held, start, size, number = [], start + size, 0, number + 1
            return out

        for rows in batches:
            sums, at = np.cumsum(rows.column("n").to_numpy()), 0
            while at < rows.num_rows:
                done = int(sums[at - 1]) if at else 0
                to = min(int(np.searchsorted(sums, done + BLOCK_IDS - size)) + 1, rows.num_rows)
                held.append(rows.slice(at, to - at))
                size += int(sums[to - 1]) - done
                at = to
                if size >= BLOCK_IDS:
                    yield block()
        if held:
            yield block()

    ordered = encoded.repartitionByRange("key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id())
    schema = "part int, number int, start long, n_ids long, doc_ids binary, nulls binary, sizes binary, marks binary, payload binary"
    return codes, durable(ordered.mapInArrow(scan, schema), "blocks")


def read_blocks(codes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): each document's ids, decoded from the file."""
    spark = blocks.sparkSession
    table = codes.toArrow()
    lengths = np.zeros(int(pc.max(table.column("id")).as_py() or 0) + 1, dtype=np.uint8)
    lengths[table.column("id").to_numpy()] = table.column("length").to_numpy()
    shared = spark.sparkContext.broadcast(lengths)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row for each written partition
    shift = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(shared.value)
        for rows in batches:
            for b in rows.to_pylist():
                sizes = unpack(b["sizes"], "i8")
                ids = book.decode(b["payload"], unpack(b["marks"], "i8"), b["n_ids"], CHECKPOINT).astype("<u4")
                ends = np.cumsum(sizes)
                offsets = np.concatenate(([0], ends * 4)).astype(np.int32)
                yield batch(
                    doc_id=pa.array(unpack(b["doc_ids"], "i8"), mask=unpack(b["nulls"], "u1").astype(bool)), start=pa.array(b["start"] + b["shift"] + ends - sizes),
                    n_tokens=pa.array(sizes), ids=pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]))

    return blocks.join(shift, "part").mapInArrow(scan, "doc_id long, start long, n_tokens long, ids binary")


def token_digest(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the files."""
    rows, _ = keyed(docs)
    read = read_blocks(*write_blocks(durable(tokens(rows, tokenizer, end_id), "tokens")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            crc = [zlib.crc32(x.as_buffer()) for x in rows.column("ids")]
            yield batch(doc_id=rows.column("doc_id"), start=rows.column("start"), n_tokens=rows.column("n_tokens"), ids_crc32=pa.array(crc, pa.int64()))

    return read.mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long")
