"""Repeated fixed-length windows of a corpus, found through content-chosen anchors.

A window of L units (words or bytes) has one anchor: the leftmost of its grams with the smallest
hash. Equal windows have equal anchors at equal offsets, so windows only need to be compared under
their anchor's hash. Neighbouring windows share an anchor; such a run of windows is one row, about
one for each (L - gram) / 2 units, and runs with equal content fall into one class. A class whose
anchor has no other class is settled as a whole; only anchors with several classes (edges of copied
passages) need the content, which a second scan fetches for those anchors alone.

An anchor with more than HOT_ROWS rows is split into its single windows, dealt by their hash: equal
windows meet, and no group grows with the documents that hold a passage in different surroundings.

One hot passage becomes one row for each class and batch before the shuffle; nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.shared import batch, bitmap, buckets_of, has_bit, hashed_bit, pack, unpack
from bazaarlens.llm.textbytes import BYTE_VALUES, PLAIN_WORD, Chunk, chunks, fixed_hash, mix, prefix_sums, ragged, sliding_argmin, span_hash, word_hashes, words
from bazaarlens.session import durable

#: Bits of the bitmap of edge anchors: at least, and at most. Between, it has 16 for each anchor: in a full one all runs would pass for edges.
EDGE_BITS, MOST_EDGE_BITS = 1 << 25, 1 << 29
SPANS = "key long, start int, end int"
#: Rows of an anchor whose content is searched in one group; with more, each window is a row.
HOT_ROWS = 1024
CONTENT = "anchor long, cls long, key long, start int, many int, content binary, starts binary"


class Kind(NamedTuple):
    """What is compared: units, window and gram length, and whether one more place anywhere is
    enough (``anywhere``) or it must be in an earlier document."""

    unit: str
    window: int
    gram: int
    anywhere: bool


class Runs(NamedTuple):
    row: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    cls: np.ndarray


def units(chunk: Chunk, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """The chunk's unit values and where each text's units begin."""
    if kind.unit == "byte":
        return BYTE_VALUES[chunk.data], chunk.first
    found = words(chunk, PLAIN_WORD)
    return word_hashes(chunk.data, found), found.first


def runs_of(chunk: Chunk, kind: Kind) -> tuple[Runs, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor; besides, the unit values and each text's first unit."""
    values, first = units(chunk, kind)
    n, window = len(values), kind.window
    if n < window:
        none = np.zeros(0, dtype=np.int64)
        return Runs(none, none, none, none.astype(np.uint64), none.astype(np.uint64)), values, first
    sums = prefix_sums(values)
    grams = fixed_hash(sums, kind.gram)
    at = sliding_argmin(grams, window - kind.gram + 1)
    cut = np.zeros(len(at) + 1, dtype=bool)
    cut[1:-1] = at[1:] != at[:-1]
    cut[0] = True
    for edge in (first[:-1], np.maximum(first[1:] - window + 1, first[:-1])):
        cut[edge[edge <= len(at)]] = True
    start = np.flatnonzero(cut[:-1])
    stop = np.append(start[1:], len(at))
    text = np.searchsorted(first, start, "right") - 1
    whole = start + window <= first[text + 1]
    start, stop, text = start[whole], stop[whole], text[whole]
    anchor = at[start].astype(np.int64)
    cls = mix(span_hash(sums, start, stop - 1 + window) ^ (anchor - start).astype(np.uint64))
    return Runs(chunk.rows[text].astype(np.int32), (start - first[text]).astype(np.int32), (stop - start).astype(np.int32), grams[anchor], cls), values, first


def _merge(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of one length class joined where they touch or overlap inside a key."""
    if not len(key):
        return key, start, end
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    base = key.astype(np.int64)
    new = np.ones(len(key), dtype=bool)
    # Ends of a key's sorted spans rise except where a span lies inside another; a running maximum settles that.
    group = np.cumsum(np.concatenate(([True], base[1:] != base[:-1])))
    reach = np.maximum.accumulate(end.astype(np.int64) + (group << 32)) - (group << 32)
    new[1:] = (base[1:] != base[:-1]) | (start[1:] > reach[:-1])
    heads = np.flatnonzero(new)
    return key[heads], start[heads], reach[np.append(heads[1:], len(key)) - 1].astype(end.dtype)


def _first_scan(kind: Kind, divisor: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, rows in enumerate(batches):
            keys = rows.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
            parts = [runs_of(c, kind)[0] for c in chunks(rows.column("text"))]
            runs = Runs(*[np.concatenate(x) for x in zip(*parts)]) if parts else None
            del parts
            if runs is None or not len(runs.row):
                continue
            key = keys[runs.row]
            # Within the batch: one row stands for a class, and places it already settles go out as spans.
            order = np.lexsort((key, runs.cls))
            cls, sorted_key = runs.cls[order], key[order]
            head = np.concatenate(([True], cls[1:] != cls[:-1]))
            group = np.cumsum(head) - 1
            size = np.bincount(group)
            settled, many = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=np.uint8)
            if kind.anywhere:
                settled[order] = size[group] > 1
                many[order] = settled[order]
                keep = np.zeros(len(order), dtype=bool)
                keep[order[head]] = True
            else:
                settled[order] = sorted_key // divisor > (sorted_key // divisor)[head][group]
                keep = ~settled
            lone = keep & (many == 0)
            del order, cls, sorted_key, head, group, size
            spans = _merge(key[settled], runs.start[settled], (runs.start + runs.windows - 1 + kind.window)[settled])
            bucket = ((runs.anchor >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            chosen = np.flatnonzero(keep)
            chosen = chosen[np.argsort(bucket[chosen], kind="stable")]
            edges = np.searchsorted(bucket[chosen], np.arange(buckets + 1))
            out: dict[str, list] = {"bucket": [], "runs": [], "spans": []}
            for b in range(buckets):
                i = chosen[edges[b] : edges[b + 1]]
                if not len(i):
                    continue
                out["bucket"].append(b)
                place = np.where(lone[i], runs.start[i], -1).astype(np.int32)
                out["runs"].append([
                    pack(runs.anchor[i].astype(np.uint32)), pack(runs.cls[i]), pack(key[i]), pack(place), pack(runs.windows[i].astype(np.uint16))])
                out["spans"].append(None)
            if len(spans[0]):
                out["bucket"].append((n * 7919 + int(spans[0][0])) % buckets)
                out["runs"].append(None)
                out["spans"].append([pack(spans[0]), pack(spans[1].astype(np.int32)), pack(spans[2].astype(np.int32))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["bucket"], pa.int32()), pa.array(out["runs"], pa.list_(pa.binary())), pa.array(out["spans"], pa.list_(pa.binary()))],
                names=["bucket", "runs", "spans"])

    return scan


def _settle(kind: Kind, divisor: int) -> Callable[[pa.Table], pa.Table]:
    """All runs of some anchors: spans of classes that are settled, and anchors with several classes (end: 1 with many rows)."""

    def settle(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        spans: list[list[np.ndarray]] = [[], [], []]
        for runs, ready in zip(table.column("runs").to_pylist(), table.column("spans").to_pylist()):
            for into, raw, kinds in ((cols, runs, ("u4", "u8", "i8", "i4", "u2")), (spans, ready, ("i8", "i4", "i4"))):
                for column, data, dtype in zip(into, raw or (), kinds):
                    column.append(unpack(data, dtype))
        empty = [np.zeros(0, d) for d in ("i8", "i4", "i4")]
        spans_out = [np.concatenate(c) if c else e for c, e in zip(spans, empty)]
        edges = hot = np.zeros(0, dtype=np.int64)
        if cols[0]:
            anchor, cls, key, place, windows = (np.concatenate(c) for c in cols)
            order = np.lexsort((key, cls, anchor))
            anchor, cls, key, place, windows = (c[order] for c in (anchor, cls, key, place, windows))
            new_anchor = np.concatenate(([True], anchor[1:] != anchor[:-1]))
            head = new_anchor | np.concatenate(([True], cls[1:] != cls[:-1]))
            group = np.cumsum(head) - 1
            if kind.anywhere:
                # A row without a place stands for two places or more.
                settled = (np.bincount(group, weights=np.where(place < 0, 2, 1)) > 1)[group] & (place >= 0)
            else:
                settled = key // divisor > (key // divisor)[head][group]
            end = place + windows.astype(np.int32) - 1 + kind.window
            for i, x in enumerate((key[settled], place[settled], end[settled].astype(np.int32))):
                spans_out[i] = np.concatenate((spans_out[i], x))
            classes = np.bincount(np.cumsum(new_anchor) - 1, weights=head)
            edges = anchor[new_anchor][classes > 1].astype(np.int64) + (np.int64(bucket) << 32)
            hot = (np.bincount(np.cumsum(new_anchor) - 1) > HOT_ROWS)[classes > 1].astype(np.int64)
        key, start, end = _merge(*spans_out)
        return pa.table({
            "key": pa.array(np.concatenate((key, edges)), pa.int64()),
            "start": pa.array(np.concatenate((start, np.full(len(edges), -1))), pa.int32()),
            "end": pa.array(np.concatenate((end, hot)).astype(np.int32), pa.int32())})

    return settle


def _windows(kind: Kind, divisor: int, runs: Runs, keys: np.ndarray, values: np.ndarray, at: np.ndarray, source: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The windows of some runs: one row for each distinct window and text, and (no content) spans settled here."""
    place = ragged(at, runs.windows.astype(np.int64))
    owner = np.repeat(np.arange(len(at)), runs.windows)
    key, start = keys[runs.row[owner]], runs.start[owner] + (place - at[owner])
    name = span_hash(prefix_sums(values), place, place + kind.window)
    order = np.lexsort((start, key, name))
    name, key, start, place = name[order], key[order], start[order], place[order]
    head = np.concatenate(([True], name[1:] != name[:-1]))
    group = np.cumsum(head) - 1
    if kind.anywhere:
        seen = np.bincount(group)
        settled, one, many = seen[group] > 1, head, np.minimum(seen, 2)
    else:
        settled = key // divisor > (key // divisor)[head][group]
        one = ~settled & (head | np.concatenate(([True], key[1:] != key[:-1])))
        many = np.ones(int(one.sum()))
    spans = _merge(key[settled], start[settled].astype(np.int32), (start + kind.window)[settled].astype(np.int32))
    none = np.zeros(len(spans[0]), dtype=np.int64)
    yield batch(
        anchor=pa.array(mix(spans[0].astype(np.uint64)).view(np.int64)), cls=pa.array(none), key=pa.array(spans[0]), start=pa.array(spans[1]), many=pa.array(spans[2]),
        content=pa.nulls(len(none), pa.binary()), starts=pa.array([b""] * len(none), pa.binary()))
    left = np.flatnonzero(~settled | one)
    edges = np.append(np.flatnonzero(one[left]), len(left))
    chosen = left[one[left]]
    for a in range(0, len(chosen), 1 << 16):
        i = chosen[a : a + (1 << 16)]
        flat = np.ascontiguousarray(source[place[i][:, None] + np.arange(kind.window)]).view(np.uint8).reshape(len(i), -1)
        yield batch(
            anchor=pa.array(name[i].view(np.int64)), cls=pa.array(np.zeros(len(i), dtype=np.int64)), key=pa.array(key[i]), start=pa.array(start[i].astype(np.int32)),
            many=pa.array(many[a : a + len(i)].astype(np.int32)), content=pa.array([x.tobytes() for x in flat], pa.binary()),
            starts=pa.array([start[left[edges[j] : edges[j + 1]]].astype("<i4").tobytes() for j in range(a, a + len(i))], pa.binary()))


def _search_all(kind: Kind, divisor: int, search: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``search`` for whole runs; single windows are compared in full, and settled spans pass."""

    def every(table: pa.Table) -> pa.Table:
        single = pc.is_valid(table.column("starts"))
        ready, runs, windows = (table.filter(x) for x in (pc.and_(single, pc.is_null(table.column("content"))), pc.invert(single), pc.and_(single, pc.is_valid(table.column("content")))))
        parts = [search(runs.drop_columns("starts"))] if runs.num_rows else []
        parts.append(pa.table({"key": ready.column("key"), "start": ready.column("start"), "end": ready.column("many")}))
        if windows.num_rows:
            key, many = (windows.column(c).to_numpy() for c in ("key", "many"))
            _, group = np.unique(np.array(windows.column("content").to_pylist(), dtype=object), return_inverse=True)
            if kind.anywhere:
                found = (np.bincount(group, weights=many)[group] > 1) & (many == 1)
            else:
                least = np.full(group.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(least, group, key // divisor)
                found = key // divisor > least[group]
            starts = [np.frombuffer(x, dtype="<i4") for x in windows.column("starts").filter(pa.array(found)).to_pylist()]
            spans = _merge(np.repeat(key[found], [len(x) for x in starts]), *(np.concatenate([*starts, np.zeros(0, "i4")]) + x for x in (0, kind.window)))
            parts.append(pa.table({"key": pa.array(spans[0], pa.int64()), "start": pa.array(spans[1].astype(np.int32)), "end": pa.array(spans[2].astype(np.int32))}))
        return pa.concat_tables([p.cast(parts[-1].schema) for p in parts])

    return every


def _second_scan(kind: Kind, divisor: int, buckets: int, edges) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Content of the runs under anchors that have several classes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hot = edges.value
        for rows in batches:
            keys = rows.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
            for chunk in chunks(rows.column("text")):
                runs, values, first = runs_of(chunk, kind)
                bucket = (runs.anchor >> np.uint64(32)) % np.uint64(buckets)
                anchor = (bucket << np.uint64(32)) + (runs.anchor & np.uint64(0xFFFFFFFF))
                i = np.flatnonzero(has_bit(known, mix(anchor) % np.uint64(len(known) * 64)))
                if not len(i):
                    continue
                source = chunk.data if kind.unit == "byte" else values
                split = has_bit(hot, mix(anchor[i]) % np.uint64(len(hot) * 64))
                if split.any():
                    own = Runs(*[x[i[split]] for x in runs])
                    yield from _windows(kind, divisor, own, keys, values, first[own.row - chunk.rows[0]] + own.start, source)
                    i = i[~split]
                if not len(i):
                    continue
                key, cls = keys[runs.row[i]], runs.cls[i]
                order = np.lexsort((key, cls, anchor[i]))
                head = np.concatenate(([True], (cls[order][1:] != cls[order][:-1]) | (anchor[i][order][1:] != anchor[i][order][:-1])))
                group = np.cumsum(head) - 1
                seen = np.bincount(group)
                if kind.anywhere:
                    keep, many = order[head], np.minimum(seen, 2)
                else:  # every place in the class's first document of the chunk
                    early = (key // divisor)[order] == (key // divisor)[order][head][group]
                    keep, many = order[early], np.ones(int(early.sum()))
                at = first[runs.row[i[keep]] - chunk.rows[0]] + runs.start[i[keep]]
                length = runs.windows[i[keep]] - 1 + kind.window
                flat, width = source[ragged(at, length)], source.itemsize
                content = pa.Array.from_buffers(pa.binary(), len(keep), [
                    None, pa.py_buffer(np.concatenate(([0], np.cumsum(length * width))).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])
                yield batch(
                    anchor=pa.array(anchor[i[keep]].astype(np.int64)), cls=pa.array(cls[keep].view(np.int64)), key=pa.array(key[keep]),
                    start=pa.array(runs.start[i[keep]].astype(np.int32)), many=pa.array(many.astype(np.int32)), content=content, starts=pa.nulls(len(keep), pa.binary()))

    return scan


def repeated_spans(docs: DataFrame, kind: Kind, divisor: int, search: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """(key, start, end) in units: parts covered by repeated windows; they may touch or overlap.

    ``docs`` has (key, text). ``search`` gets all classes of some edge anchors with their content
    (anchor, cls, key, start, many, content) and returns spans; it is the operator's own index.
    """
    spark = docs.sparkSession
    buckets = buckets_of(spark)
    source = docs.select("key", "text")
    first = source.mapInArrow(_first_scan(kind, divisor, buckets), "bucket int, runs array<binary>, spans array<binary>")
    settled = durable(first.groupBy("bucket").applyInArrow(_settle(kind, divisor), SPANS), "settled")
    edge = settled.filter("start < 0").select(F.col("key").alias("anchor"), "end")
    bit = spark.sparkContext.broadcast((_edge_bits(edge), _edge_bits(edge.filter("end > 0"))))
    content = source.mapInArrow(_second_scan(kind, divisor, buckets, bit), CONTENT)
    # The bitmap lets some other anchors through; they have one class, and the search finds nothing new there.
    found = content.withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(4 * buckets))).groupBy("part").applyInArrow(_search_all(kind, divisor, search), SPANS)
    return settled.filter("start >= 0").unionByName(durable(found, "edges"))


DOC_BITS = 1 << 23


def cut_documents(docs: DataFrame, spans: DataFrame, schema: str, cut: Callable[[bytes, np.ndarray, np.ndarray], dict]) -> DataFrame:
    """One row per document: ``cut(text, starts, ends)`` with the document's spans joined to maximal ones.

    Texts without spans are finished where they are read; a bitmap of fixed size tells most of
    them, so only the others travel to their spans, compressed.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(bitmap(spans, hashed_bit(F.col("key"), DOC_BITS), DOC_BITS))
    names = [c.split()[0] for c in schema.split(", ")]
    none = np.zeros(0, dtype=np.int64)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            later = has_bit(known.value, rows.column("bit").to_numpy().view(np.uint64))
            done: dict[str, list] = {n: [] for n in names}
            body: list[bytes | None] = []
            for chunk in chunks(rows.column("text")):
                for i in range(len(chunk.rows)):
                    text = chunk.text(i)
                    travels = later[chunk.rows[i]]
                    body.append(zstandard.compress(text, 1) if travels else None)
                    one = {} if travels else cut(text, none, none)
                    for n in names:
                        done[n].append(one.get(n))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("key"), pa.array(body, pa.binary()), *[pa.array(done[n], t) for n, t in zip(names, types)]],
                names=["doc_id", "key", "body", *names])

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = {n: rows.column(n).to_pylist() for n in names}
            body, starts, ends = rows.column("body"), rows.column("starts"), rows.column("ends")
            for i in range(rows.num_rows):
                if body[i].is_valid:
                    a, b = (np.array(x[i].as_py() or (), dtype=np.int64) for x in (starts, ends))
                    _, a, b = _merge(np.zeros(len(a), dtype=np.int64), a, b)
                    for n, v in cut(zstandard.decompress(body[i].as_py()), a, b).items():
                        out[n][i] = v
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *[pa.array(out[n], t) for n, t in zip(names, types)]], names=["doc_id", *names])

    arrow = {"long": pa.int64(), "string": pa.string()}
    types = [arrow[c.split()[1]] for c in schema.split(", ")]
    rows = docs.select("doc_id", "key", "text", hashed_bit(F.col("key"), DOC_BITS).alias("bit")).mapInArrow(near, f"doc_id long, key long, body binary, {schema}")
    every = spans.groupBy(F.col("key").alias("other")).agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    joined = rows.join(every, F.col("key") == F.col("other"), "left")
    return joined.select("doc_id", "body", "starts", "ends", *names).mapInArrow(far, f"doc_id long, {schema}")


def _edge_bits(edge: DataFrame) -> np.ndarray:
    """A bitmap of the edge anchors, of which about one in 16 bits is set at most."""
    n, size = edge.count(), EDGE_BITS
    while size < min(16 * n, MOST_EDGE_BITS):
        size *= 2

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            anchor = rows.column("anchor").to_numpy().view(np.uint64)
            yield batch(bit=pa.array((mix(anchor) % np.uint64(size)).astype(np.int64)))

    return bitmap(edge.select("anchor").mapInArrow(bits, "bit long"), F.col("bit"), size)
