"""Language-model scores: prediction by partial matching over bytes.

The model is a trie of byte contexts up to ORDER. Training counts every (context, byte) of all
training texts, and every count stays, so the model grows with the corpus. The probability of a byte
depends on it and the ORDER bytes before it alone. Texts are read in units; each unit sends the
distinct numbers of this kind that it holds, and how often its training texts hold them, to buckets
by the three bytes before the predicted one. A bucket has all contexts of three bytes and more that
end so, and adds them to the shorter orders, whose size is bounded by the alphabet and which are
broadcast. It returns the logarithm for each number, and the units add them up per document. A byte
is coded at its longest known context; where that does not know the byte, the escape is paid (method
C: the distinct symbols over all occurrences and the distinct symbols) and the next shorter context
tried, without the symbols already excluded.

A text is its lower-cased words joined by one space and ended by a line feed, so empty and null
texts cost the end alone. Beside it stands an add-one word unigram model, whose counts travel
packed by hash bucket and return as partial sums. Documents whose crc32(doc_id) mod 7 is 2 are held
out; a null id counts as empty text. Repeated rows each train and each give a row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.shared import batch, keyed, pack, unpack
from bazaarlens.llm.textbytes import LOWER, PLAIN_WORD, Chunk, Words, chunks, ragged, word_hashes, words
from bazaarlens.session import durable

ORDER = 5
#: Orders that are broadcast; their entries are at most the strings of so many bytes.
SHORT = 3
#: Bytes of text in a unit, and of those whose codes are looked up at a time.
UNIT_BYTES = 1 << 23
LOOKUP_BYTES = 1 << 20
#: Words that are copied into a stream at a time.
LOOKUP_WORDS = 1 << 16
FOLDS, HELD_OUT = 7, 2
NEW_LINE, SPACE = 10, 32
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def held_out(ids: pa.Array) -> np.ndarray:
    return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == HELD_OUT for i in ids.to_pylist()), dtype=bool, count=len(ids))


def lower_words(chunk: Chunk) -> tuple[np.ndarray, Words]:
    data = LOWER[chunk.data]
    return data, words(chunk, PLAIN_WORD, data)


def streams(data: np.ndarray, found: Words) -> tuple[np.ndarray, np.ndarray]:
    """The texts as the model reads them, each after ORDER line feeds; and where each one begins."""
    n = found.counts()
    items = np.maximum(n, 1) + 1
    base = np.cumsum(items) - items
    start, size = np.zeros(int(items.sum()), dtype=np.int64), np.zeros(int(items.sum()), dtype=np.int64)
    at = ragged(base + 1, n)
    start[at], size[at] = found.start, found.end - found.start
    gap = np.full(len(start), 1, dtype=np.int64)
    gap[base] = ORDER
    size += gap
    end = np.cumsum(size)
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    for i in range(0, len(start) if len(data) else 0, LOOKUP_WORDS):
        source = ragged(start[i : i + LOOKUP_WORDS], size[i : i + LOOKUP_WORDS])
        out[end[i] - size[i] :][: len(source)] = data[np.minimum(source, len(data) - 1)]
    out[end - 1] = SPACE
    out[end[base + items - 1] - 1] = NEW_LINE
    for k in range(ORDER):
        out[end[base] - 1 - k] = NEW_LINE
    return out, end[base] - ORDER


def grams(stream: np.ndarray) -> np.ndarray:
    """At each byte the number formed by it and the ORDER bytes before it; the first ORDER are unused."""
    code = np.zeros(len(stream), dtype=np.uint64)
    wide = stream.astype(np.uint64)
    for k in range(ORDER + 1):
        code[ORDER:] |= wide[ORDER - k : len(stream) - k] << np.uint64(8 * k)
    return code


def coded(stream: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True at bytes that are predicted."""
    out = np.ones(len(stream), dtype=bool)
    out[(first[:, None] + np.arange(ORDER)).reshape(-1)] = False
    return out


def heads_of(values: np.ndarray) -> np.ndarray:
    """Where each distinct one of the sorted values begins."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, dtype=np.int64)


def summed(code: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts by the last ``size`` bytes of the codes."""
    code = code & np.uint64((1 << 8 * size) - 1)
    order = np.argsort(code, kind="stable")
    heads = heads_of(code[order])
    return code[order][heads], np.add.reduceat(n[order], heads) if len(heads) else n[:0]


def distinct_codes(stream: np.ndarray, use: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of the used bytes, sorted, and how often training bytes hold each.

    Numbers are formed for a slice of the text at a time, with the fold in the lowest bit, and sorted
    in place, so a unit's numbers stand in memory once.
    """
    code, at = np.empty(int(use.sum()), dtype=np.uint64), 0
    for start in range(0, len(stream), LOOKUP_BYTES):
        low, to = max(0, start - ORDER), start + LOOKUP_BYTES
        own = use[start:to]
        part = grams(stream[low:to])[start - low :][own]
        part <<= np.uint64(1)
        part |= train[start:to][own]
        code[at : at + len(part)] = part
        at += len(part)
    code.sort()
    heads = heads_of(code)
    times = np.diff(np.append(heads, len(code)))
    code = code[heads]
    times *= (code & np.uint64(1)).astype(np.int64)  # held-out bytes count as none
    code >>= np.uint64(1)
    heads = heads_of(code)
    return code[heads], np.add.reduceat(times, heads) if len(heads) else times


def units(docs: DataFrame, buckets: int) -> DataFrame:
    """For each unit one row with its texts (body) and, for each bucket, its distinct codes and their
    number in training texts. A unit is named by its first key."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = held_out(rows.column("doc_id"))
            keys = rows.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
            ids = rows.column("doc_id")
            valid, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for chunk in chunks(rows.column("text"), UNIT_BYTES):
                data, found = lower_words(chunk)
                stream, first = streams(data, found)
                size = np.diff(np.append(first, len(stream)))
                use, train = coded(stream, first), np.repeat(~out[chunk.rows], size)
                every, n = distinct_codes(stream, use, train)
                del use, train
                near = (every >> np.uint64(8)) & np.uint64((1 << 8 * SHORT) - 1)
                bucket = ((near * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
                used = [b for b in range(buckets) if edges[b] < edges[b + 1]]
                parts = [order[edges[b] : edges[b + 1]] for b in used]
                i, none = chunk.rows, [None] * len(used)
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(keys[i[0]])] * (len(used) + 1), pa.int64()), pa.array([*used, None], pa.int32()),
                    pa.array([*[pack(np.diff(every[x], prepend=np.uint64(0))) for x in parts], None], pa.binary()),
                    pa.array([*[pack(n[x]) for x in parts], None], pa.binary()),
                    pa.array([*none, zstandard.compress(stream.tobytes(), 1)], pa.binary()),
                    pa.array([*none, [pack(x) for x in (keys[i], ids[i], valid[i].astype(np.uint8), out[i].astype(np.uint8), found.counts() + 1, size)]], pa.list_(pa.binary()))],
                    names=["unit", "bucket", "codes", "trained", "body", "about"])

    return docs.select("key", "doc_id", "text").mapInArrow(scan, "unit long, bucket int, codes binary, trained binary, body binary, about array<binary>")


class Table:
    """A map from numbers to places, looked up in bulk."""

    def __init__(self, codes: np.ndarray) -> None:
        self.bits = max(4, int(4 * max(1, len(codes)) - 1).bit_length())
        self.slots = np.full(1 << self.bits, _EMPTY)
        self.place = np.zeros(1 << self.bits, dtype=np.int32)
        left, at = np.arange(len(codes)), self._start(codes)
        while len(left):
            free = self.slots[at[left]] == _EMPTY
            self.slots[at[left[free]]] = codes[left[free]]
            won = self.slots[at[left]] == codes[left]
            self.place[at[left[won]]] = left[won]
            left = left[~won]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _start(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Each number's place, -1 where it has none."""
        at = self._start(codes)
        got = self.slots[at]
        out = np.where(got == codes, self.place[at], -1)
        left = np.flatnonzero((got != codes) & (got != _EMPTY))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            got = self.slots[at[left]]
            hit = got == codes[left]
            out[left[hit]] = self.place[at[left[hit]]]
            left = left[~hit & (got != _EMPTY)]
        return out


class Model:
    """Entries and contexts of every order, with what escapes and exclusion need."""

    def __init__(self, shorter: Model | None = None) -> None:
        for name in ("entries", "counts", "contexts", "total", "kinds", "excluded"):
            setattr(self, name, list(getattr(shorter, name)) if shorter else [])

    def add(self, code: np.ndarray, n: np.ndarray) -> None:
        """The next longer order; it may lack contexts as long as those asked for are there."""
        k, context = len(self.entries), code >> np.uint64(8)
        heads = heads_of(context)
        add = lambda v: np.add.reduceat(v, heads) if len(heads) else np.zeros(0)
        below = np.zeros(len(code))
        if k and len(code):  # an entry's suffix is an entry as well
            below = self.counts[k - 1][self.entries[k - 1].find(code & np.uint64((1 << 8 * k) - 1))]
        self.entries.append(Table(code))
        self.counts.append(n.astype(np.float64))
        self.contexts.append(Table(context[heads]))
        self.total.append(add(n.astype(np.float64)))
        self.kinds.append(add(np.ones(len(code))))
        self.excluded.append(add(below))

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of each coded byte."""
        out = np.zeros(len(code))
        left = np.arange(len(code))
        gone_n, gone_kinds = np.zeros(len(code)), np.zeros(len(code))
        for k in range(len(self.entries) - 1, -1, -1):
            own = code[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            entry, context = self.entries[k].find(own), self.contexts[k].find(own >> np.uint64(8))
            known = np.flatnonzero(context >= 0)
            n, kinds = np.zeros(len(left)), np.zeros(len(left))
            n[known] = self.total[k][context[known]] - gone_n[left[known]]
            kinds[known] = self.kinds[k][context[known]] - gone_kinds[left[known]]
            hit = entry >= 0
            if hit.any():
                out[left[hit]] += np.log10(self.counts[k][entry[hit]] / (n[hit] + kinds[hit]))
            escaped = np.flatnonzero(~hit & (context >= 0) & (kinds > 0))
            out[left[escaped]] += np.log10(kinds[escaped] / (n[escaped] + kinds[escaped]))
            missed = known[~hit[known]]
            gone_n[left[missed]], gone_kinds[left[missed]] = self.excluded[k][context[missed]], self.kinds[k][context[missed]]
            left = left[~hit]
        # Beyond the shortest context all bytes that it does not know are equally likely.
        seen = self.kinds[0][0] if len(self.kinds[0]) else 0.0
        out[left] -= np.log10(max(1.0, 256 - seen))
        return out


def short_orders(sent: DataFrame) -> Model:
    """The orders below SHORT; at most the strings of SHORT bytes reach the driver."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            parts = [
                summed(np.cumsum(unpack(c.as_py(), "u8"), dtype=np.uint64), unpack(n.as_py(), "i8"), SHORT)
                for c, n in zip(rows.column("codes"), rows.column("trained"))]
            if parts:
                code, n = summed(*(np.concatenate(x) for x in zip(*parts)), SHORT)
                yield batch(code=pa.array(code[n > 0].astype(np.int64)), n=pa.array(n[n > 0]))

    counted = sent.filter("bucket is not null").select("codes", "trained").mapInArrow(scan, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    code, n = counted.column("code").to_numpy().astype(np.uint64), counted.column("n").to_numpy()
    model = Model()
    for k in range(SHORT):
        model.add(*summed(code, n, k + 1))
    return model


def code_values(sent: DataFrame) -> DataFrame:
    """(unit, codes, values): log10 probability of each code that a unit sent."""
    shared = sent.sparkSession.sparkContext.broadcast(short_orders(sent))

    def values(table: pa.Table) -> pa.Table:
        packed = table.column("codes").to_pylist()
        codes = [np.cumsum(unpack(c, "u8"), dtype=np.uint64) for c in packed]
        every, back = np.unique(np.concatenate(codes), return_inverse=True)
        n = np.bincount(back, weights=np.concatenate([unpack(t, "i8") for t in table.column("trained").to_pylist()]), minlength=len(every))
        del back
        model, seen = Model(shared.value), n > 0
        for k in range(SHORT, ORDER + 1):
            model.add(*summed(every[seen], n[seen], k + 1))
        value = model.log10(every)
        return pa.table({"unit": table.column("unit"), "codes": pa.array(packed, pa.binary()), "values": pa.array([pack(value[np.searchsorted(every, c)]) for c in codes], pa.binary())})

    asked = sent.filter("bucket is not null").select("bucket", "unit", "codes", "trained")
    return asked.groupBy("bucket").applyInArrow(values, "unit long, codes binary, values binary")


def score(docs: DataFrame, buckets: int) -> DataFrame:
    """(key, doc_id, held_out, n_tokens, score): log10 probability of each text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                stream = np.frombuffer(zstandard.decompress(rows.column("body")[i].as_py()), dtype=np.uint8)
                keys, ids, valid, out, tokens, size = (unpack(x, d) for x, d in zip(rows.column("about")[i].as_py(), ("i8", "i8", "u1", "u1", "i8", "i8")))
                found = rows.column("found")[i].as_py()
                known = Table(np.concatenate([np.cumsum(unpack(x["codes"], "u8"), dtype=np.uint64) for x in found]))
                value = np.concatenate([unpack(x["values"], "f8") for x in found])
                first = np.cumsum(size) - size
                use, each = coded(stream, first), np.zeros(len(stream))
                for at in range(0, len(stream), LOOKUP_BYTES):  # so that a unit's codes never stand side by side
                    low, to = max(0, at - ORDER), at + LOOKUP_BYTES
                    code, own = grams(stream[low:to])[at - low :], use[at:to]
                    each[at:to][own] = value[known.find(code[own])]
                yield batch(
                    key=pa.array(keys), doc_id=pa.array(ids, mask=valid == 0), held_out=pa.array(out == 1), n_tokens=pa.array(tokens),
                    score=pa.array(np.add.reduceat(each, first)))

    sent = durable(units(docs, buckets), "units")
    found = code_values(sent).groupBy(F.col("unit").alias("other")).agg(F.collect_list(F.struct("codes", "values")).alias("found"))
    joined = sent.filter("bucket is null").select("unit", "body", "about").join(found.hint("merge"), F.col("unit") == F.col("other"))
    return joined.select("body", "about", "found").mapInArrow(scan, "key long, doc_id long, held_out boolean, n_tokens long, score double")


def unigram_sums(docs: DataFrame, buckets: int) -> DataFrame:
    """(key, value, known) partial sums of log10(c + 1) and of known words; and for a bucket one row
    without key that has its distinct training words and their number."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keys = rows.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
            train = ~held_out(rows.column("doc_id"))
            found = [(word_hashes(d, w), np.repeat(c.rows, w.counts()).astype(np.int32)) for c in chunks(rows.column("text")) for d, w in (lower_words(c),)]
            if not found:
                continue
            hashes, row = (np.concatenate(x) for x in zip(*found))
            del found
            bucket = (hashes % np.uint64(buckets)).astype(np.int32)
            by_bucket = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
            for b in range(buckets):
                own = by_bucket[edges[b] : edges[b + 1]]
                if not len(own):
                    continue
                h = hashes[own]
                order = np.argsort(h, kind="stable")  # rows of a word stay in order
                h, r = h[order], row[own][order]
                pair = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1]))))
                times = np.diff(np.append(pair, len(h)))
                h, r = h[pair], r[pair]
                word = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                step = np.diff(r, prepend=np.int32(0))
                step[word] = r[word]
                used = np.unique(r)
                trained = np.add.reduceat(times * train[r], word)
                yield batch(
                    bucket=pa.array([b], pa.int32()), words=pa.array([pack(np.diff(h[word], prepend=np.uint64(0)))]), trained=pa.array([pack(trained.astype(np.uint32))]),
                    docs=pa.array([pack(np.diff(np.append(word, len(h))).astype(np.uint16))]), row=pa.array([pack(step.astype(np.int32))]),
                    times=pa.array([pack(times.astype(np.uint32))]), rows=pa.array([pack(used.astype(np.int32))]), keys=pa.array([pack(np.diff(keys[used], prepend=0))]))

    def sums(table: pa.Table) -> pa.Table:
        blobs = table.select(["words", "trained", "docs", "row", "times", "rows", "keys"]).to_pylist()
        hashes = [np.cumsum(unpack(x["words"], "u8"), dtype=np.uint64) for x in blobs]
        trained = [unpack(x["trained"], "u4").astype(np.int64) for x in blobs]
        every, back = np.unique(np.concatenate(hashes), return_inverse=True)
        count = np.bincount(back, weights=np.concatenate(trained), minlength=len(every))
        keys, values, known, at = [], [], [], 0
        for x, h in zip(blobs, hashes):
            c = count[back[at : at + len(h)]]
            at += len(h)
            docs_of = unpack(x["docs"], "u2").astype(np.int64)
            step, ends = unpack(x["row"], "i4").astype(np.int64), np.cumsum(docs_of)
            r = np.cumsum(step)
            base = np.concatenate(([0], r[ends[:-1] - 1]))  # each word's rows start anew
            r -= np.repeat(base, docs_of)
            times, c = unpack(x["times"], "u4").astype(np.float64), np.repeat(c, docs_of)
            used = unpack(x["rows"], "i4")
            slot = np.searchsorted(used, r)
            keys.append(np.cumsum(unpack(x["keys"], "i8")))
            values.append(np.bincount(slot, weights=times * np.log10(c + 1), minlength=len(used)))
            known.append(np.bincount(slot, weights=times * (c > 0), minlength=len(used)))
        key, mask = np.concatenate([*keys, [0]]), np.zeros(sum(map(len, keys)) + 1, dtype=bool)
        mask[-1] = True
        return pa.table({
            "key": pa.array(key.astype(np.int64), mask=mask), "value": pa.array(np.concatenate([*values, [float((count > 0).sum())]])),
            "known": pa.array(np.concatenate([*known, [count.sum()]]).astype(np.int64))})

    packed = docs.select("key", "doc_id", "text").mapInArrow(
        scan, "bucket int, words binary, trained binary, docs binary, row binary, times binary, rows binary, keys binary")
    return packed.groupBy("bucket").applyInArrow(sums, "key long, value double, known long")


def score_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    rows, _ = keyed(docs)
    buckets = max(16, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2)
    partial = durable(unigram_sums(rows, buckets), "unigram")
    scored = durable(score(rows, buckets), "scored")
    kinds, n = partial.filter("key is null").agg(F.coalesce(F.sum("value"), F.lit(0.0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    ends = scored.filter("not held_out").count()
    kinds, n = int(kinds) + (ends > 0), n + ends
    by_doc = partial.filter("key is not null").groupBy(F.col("key").alias("other")).agg(F.sum("value").alias("value"), F.sum("known").alias("known"))
    zero = F.lit(0)
    value = F.coalesce("value", F.lit(0.0)) + F.log10(F.lit(float(ends + 1))) - F.col("n_tokens") * F.log10(F.lit(float(n + kinds + 1)))
    return scored.join(by_doc, F.col("key") == F.col("other"), "left").select(
        "doc_id", "held_out", "n_tokens", (F.coalesce("known", zero) + F.lit(int(ends > 0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        value.alias("base_score"), "score")
