"""Fill-in-the-middle: a text is cut into prefix, middle and suffix, and blocks change places in its bytes.

The buffer first holds the parts in the order of the text, each behind its sentinel. Both forms are
then one exchange of neighbouring blocks, done by three reversals in the same buffer:

    psm: <P>prefix [<M>middle] [<S>suffix]  ->  <P>prefix [<S>suffix] [<M>middle]
    spm: [<P>prefix <M>middle] [<S>suffix]  ->  [<S>suffix] [<P>prefix <M>middle]

To restore a text, the same exchange runs backwards and the sentinels leave the buffer. Units are
runs of ASCII letters and single other code points; they are counted block by block, so a very long
text needs little more memory than itself.

Defined results: a null text is empty and stays plain; a row without id hashes the empty id;
repeated rows give equal rows; texts that hold a sentinel stay plain, so what stands between
sentinels is never ambiguous. Other columns are not read. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.textbytes import chunks

#: Sentinels of prefix, middle and suffix.
SENTINELS = (b"<P>", b"<M>", b"<S>")
PLAIN_PERCENT, SPM_PERCENT = 10, 20
BLOCK = 1 << 20
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def rotate(buffer: bytearray, start: int, middle: int, end: int) -> None:
    """Exchange the neighbouring blocks [start, middle) and [middle, end) in place."""
    view = np.frombuffer(buffer, dtype=np.uint8)
    for a, b in ((start, middle), (middle, end), (start, end)):
        view[a:b] = view[a:b][::-1]


def _unit_starts(data: np.ndarray, start: int) -> np.ndarray:
    """Marks the bytes of a block at ``start`` that begin a unit."""
    block = data[start : start + BLOCK]
    letter = _LETTER[block]
    out = (block & 0xC0) != 0x80
    out[1:] &= ~(letter[1:] & letter[:-1])
    if start and _LETTER[data[start - 1]] and letter[0]:
        out[0] = False
    return out


def cut_bytes(data: np.ndarray, choose) -> tuple[int, int, int]:
    """(n, first, second): the number of units, and the bytes at which the two chosen cuts stand."""
    counts = [int(np.count_nonzero(_unit_starts(data, s))) for s in range(0, len(data), BLOCK)]
    before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    n, places = int(before[-1]), []
    for units in choose(n):
        if units == n:
            places.append(len(data))
            continue
        block = int(np.searchsorted(before, units, "right")) - 1
        places.append(block * BLOCK + int(np.flatnonzero(_unit_starts(data, block * BLOCK))[units - before[block]]))
    return n, *places


def draws(doc_id: int | None) -> list[int]:
    """The four numbers that place the cuts and choose the form of a document."""
    digest = hashlib.sha256(b"1:" + (b"" if doc_id is None else b"%d" % doc_id)).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def exchange(text: bytes, first: int, second: int, form: str) -> bytearray:
    """The text with its sentinels, its blocks in the order of the form."""
    p, m, s = SENTINELS
    buffer = bytearray(text)
    buffer[second:second] = s
    buffer[first:first] = m
    buffer[0:0] = p
    at_middle, at_suffix = first + len(p), second + len(p) + len(m)
    rotate(buffer, at_middle if form == "psm" else 0, at_suffix, len(buffer))
    return buffer


def invert(output: bytes, form: str) -> bytearray:
    """The text from which ``exchange`` made the output."""
    p, m, s = SENTINELS
    buffer = bytearray(output)
    if form == "plain":
        return buffer
    head, tail = (s, m) if form == "psm" else (s, p)
    start, back = buffer.find(head), buffer.find(tail)
    rotate(buffer, start, back, len(buffer))
    for sentinel in (s, m, p):
        at = buffer.find(sentinel)
        del buffer[at : at + len(sentinel)]
    return buffer


def _chars(data: np.ndarray) -> int:
    return sum(int(np.count_nonzero((data[s : s + BLOCK] & 0xC0) != 0x80)) for s in range(0, len(data), BLOCK))


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def _rearranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for chunk in chunks(batch.column("text")):
            rows = []
            for i, row in enumerate(chunk.rows.tolist()):
                data, text, h = chunk.data[chunk.first[i] : chunk.first[i + 1]], chunk.text(i), draws(ids[row])
                n, first, second = cut_bytes(data, lambda n, h=h: sorted((h[0] % (n + 1), h[1] % (n + 1))))
                if not text or any(x in text for x in SENTINELS) or h[2] % 100 >= 100 - PLAIN_PERCENT:
                    rows.append((ids[row], n, "plain", None, None, text))
                    continue
                form = "spm" if h[3] % 100 < SPM_PERCENT else "psm"
                rows.append((ids[row], n, form, _chars(data[:first]), _chars(data[first:second]), bytes(exchange(text, first, second, form))))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()),
                 pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64()), _strings(columns[5])],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forms = batch.column("form").to_pylist()
        for chunk in chunks(batch.column("output")):
            part = batch.slice(int(chunk.rows[0]), len(chunk.rows))
            texts = [bytes(invert(chunk.text(i), forms[row])) for i, row in enumerate(chunk.rows.tolist())]
            yield pa.RecordBatch.from_arrays([*part.columns, _strings(texts)], [*part.schema.names, "restored"])


def rearrange(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): every document ready for infilling."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_rearranged, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rearranged: DataFrame) -> DataFrame:
    """Rearranged rows with ``restored``, the text rebuilt from ``output`` and ``form`` alone."""
    kept = [f for f in rearranged.schema if f.name != "restored"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rearranged.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(_restored, f"{schema}, restored string")


def infill_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    return restore(rearrange(docs)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
