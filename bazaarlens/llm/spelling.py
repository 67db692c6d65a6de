"""Spelling variants: words one edit apart, found by a relational search of a trie.

The words of the documents form two tries, one read forwards and one backwards, kept as relations:
at each level an edge table (side, node, next) -> letters, where a node is the text up to the level.
Search states are (word, position, node, edits). A state that has made no edit stands on its word's
own path; an edit in the second half of a word is made in the forward trie, one in the first half in
the backward trie, so a word enters each trie in the middle, where nodes have few children. Level by
level the states without edits join the edge table; a letter is replaced, inserted or deleted only
where the trie goes on with the letter that the word needs next. After its edit a state has one path
left: its end is joined with the terminal nodes, the words themselves, and what arrives is a
neighbour. Words of LONG code points or more have one edge for their second half instead of one for each
letter, so the number of levels never follows the text.

Edge tables are combined before they are shuffled and hold at most the square of the alphabet per
node; a node that many words share meets them in a join whose large partitions Spark splits. A
word's neighbours are bounded by its length times the alphabet.

Defined results: a null text has no words; a row without id counts under the empty id; repeated rows
count again; ties of ``form`` go to the word first in code-point order; with no words there are no
rows. Texts of any length are walked in chunks. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.textbytes import LOWER, chunks, ragged, words
from bazaarlens.session import durable

LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR = 7, 2, 10
#: One word in so many loses a code point, to plant variants.
DROP_EVERY = 31
#: From this length on a word's second half is one edge.
LONG = 64
#: Bytes of words held before they are counted and sent on.
HELD_BYTES = 8 << 20

_ASCII = np.zeros(256, dtype=bool)
_ASCII[65:91] = _ASCII[97:123] = True
_INSIDE = np.array([False, True] + [False] * 254)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc_of_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of every span of bytes, continued from the crc32 values ``before`` them."""
    sizes = end - start
    order = np.argsort(-sizes, kind="stable")
    at, left, state = start[order], sizes[order], ~before[order].astype(np.uint32)
    short = int(np.searchsorted(-left, -256, "left"))  # longer spans go one by one
    for step in range(int(left[short]) if short < len(left) else 0):
        live = short + int(np.searchsorted(-left[short:], -step, "left"))
        s = state[short:live]
        state[short:live] = _CRC[(s ^ data[at[short:live] + step]) & np.uint32(255)] ^ (s >> np.uint32(8))
    out = np.empty(len(start), dtype=np.uint32)
    out[order] = ~state
    for i in order[:short].tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(before[i]))
    return out


def _chunk_words(chunk, ids: list, least: int) -> list[pa.Array]:
    """The words of a chunk that are long enough, after some have lost a code point."""
    data = LOWER[chunk.data]
    lead = chunk.data == 0xC3  # U+00C0 to U+00FF are C3 and one more byte
    inside = _ASCII[chunk.data] | lead
    inside[1:] |= lead[:-1]
    found = words(chunk, _INSIDE, inside.view(np.uint8))
    points = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    size = points[found.end] - points[found.start]
    enough = size >= least
    start, end, size = found.start[enough], found.end[enough], size[enough]
    row = np.repeat(chunk.rows, np.diff(np.concatenate([[0], np.cumsum(enough)])[found.first]))
    prefix = np.zeros(int(chunk.rows[-1]) + 1, dtype=np.uint32)
    for r in chunk.rows.tolist():
        prefix[r] = zlib.crc32(b":" if ids[r] is None else b"%d:" % ids[r])
    h = crc_of_spans(data, start, end, prefix[row])
    cut = h % np.uint32(DROP_EVERY) == 0
    kept = ~cut
    offsets = np.concatenate([[0], np.cumsum(end[kept] - start[kept])])
    letters = data[ragged(start[kept], end[kept] - start[kept])]
    whole = pa.StringArray.from_buffers(int(kept.sum()), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(letters))
    shorter = []
    for a, b, n, value in zip(start[cut].tolist(), end[cut].tolist(), size[cut].tolist(), h[cut].tolist()):
        if n > least:
            text = data[a:b].tobytes().decode()
            shorter.append(text[: value % n] + text[value % n + 1 :])
    return [whole, pa.array(shorter, pa.string())]


def _counted(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        size = 0

        def flush():
            counts = pc.value_counts(pa.chunked_array(held, pa.string()))
            return pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["word", "n"])

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for chunk in chunks(batch.column("text")):
                held += _chunk_words(chunk, ids, least)
                size += held[-2].nbytes
                if size > HELD_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the distinct words of at least ``least_length`` code points, counted over all documents."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = plain.mapInArrow(_counted(least_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# ---- the trie ------------------------------------------------------------------------------------

def both_sides(vocabulary: DataFrame) -> DataFrame:
    """(word, side, s, size, half): every word as read forwards (0) and backwards (1), and where its search begins."""
    n = F.length("word")
    half = F.floor(n / 2).cast("int")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("s"), half.alias("half")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("s"), (n - half).alias("half")))
    return vocabulary.select("word", n.alias("size"), F.explode(sides).alias("e")).select("word", "size", "e.side", "e.s", "e.half")


def edges(sides: DataFrame, level: int) -> DataFrame:
    """(side, node, letters): at each node of a level, which letters lead to a child that goes on with ``next`` (empty: ends there)."""
    pairs = sides.filter(F.col("size") > level).select(
        "side", F.substring("s", 1, level).alias("node"), F.substring("s", level + 1, 1).alias("letter"), F.substring("s", level + 2, 1).alias("next"))
    by_next = pairs.distinct().groupBy("side", "node", "next").agg(F.array_join(F.array_sort(F.collect_list("letter")), "").alias("letters"))
    return by_next.groupBy("side", "node").agg(F.map_from_entries(F.collect_list(F.struct("next", "letters"))).alias("letters"))


def frontier(sides: DataFrame, level: int) -> DataFrame:
    """(word, side, node, rest): the states without edits that make theirs at this level."""
    here = sides.filter((F.col("half") <= level) & (F.col("size") >= level))
    return here.select("word", "side", F.substring("s", 1, level).alias("node"), F.substring("s", level + 1, LONG).alias("rest"))


def advance(states: DataFrame, edge_table: DataFrame) -> DataFrame:
    """(word, target): for each state its edits that the trie allows, each with the end of its only path."""
    joined = states.join(edge_table, ["side", "node"], "left")
    first, second, third = (F.substring("rest", i, 1) for i in (1, 2, 3))
    none = F.lit("")

    def leading_to(following: Column) -> Column:
        return F.split(F.coalesce(F.element_at("letters", following), none), "")

    after = lambda i: F.substring("rest", i, LONG)
    replaced = F.when(first != "", F.transform(F.filter(leading_to(second), lambda c: (c != "") & (c != first)), lambda c: F.concat("node", c, after(2))))
    inserted = F.transform(F.filter(leading_to(first), lambda c: c != ""), lambda c: F.concat("node", c, "rest"))
    goes_on = (second == "") | F.contains(F.coalesce(F.element_at("letters", third), none), second)
    deleted = F.when((first != "") & goes_on, F.array(F.concat("node", after(2))))
    no = F.array().cast("array<string>")
    targets = F.concat(F.coalesce(replaced, no), inserted, F.coalesce(deleted, no))
    ends = joined.select("word", "side", F.explode(targets).alias("target"))
    return ends.select("word", F.when(F.col("side") == 1, F.reverse("target")).otherwise(F.col("target")).alias("target"))


def long_neighbours(vocabulary: DataFrame) -> DataFrame:
    """(word, target) one edit apart where one of the two has more than LONG code points.

    The states stand at the node of the first half of either side; the edge to the end of the word is compared in full.
    """
    sides = durable(both_sides(vocabulary.filter(F.length("word") >= LONG)), "long")
    states = sides.select("word", "side", F.col("s").substr(F.lit(1), F.col("half")).alias("node"), F.explode(F.array(*[F.col("size") + d for d in (-1, 0, 1)])).alias("size"))
    # A neighbour's node stands where the word's does: its own half, or one letter to either side.
    nodes = sides.select(F.col("word").alias("target"), "side", "size", F.explode(F.array(*[F.col("half") + d for d in (-1, 0, 1)])).alias("depth"), "s")
    nodes = nodes.select("target", "side", "size", F.col("s").substr(F.lit(1), F.col("depth")).alias("node"))
    met = states.join(nodes, ["side", "node", "size"]).filter((F.col("word") != F.col("target")) & (F.greatest(F.length("word"), F.length("target")) > LONG))
    return met.filter(F.levenshtein("word", "target", 1) == 1).select("word", "target")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, near, near_n): every pair of words (word, n) one inserted, deleted or replaced code point apart, both ways."""
    sides = durable(both_sides(vocabulary.filter(F.length("word") <= LONG)), "sides")
    least, most = sides.agg(F.min("half"), F.max("size")).first()
    arrived = durable(long_neighbours(vocabulary), "ends")
    for level in range(least, most + 1) if least is not None else ():
        arrived = arrived.unionByName(durable(advance(frontier(sides, level), edges(sides, level)), "ends"))
    terminal = vocabulary.select(F.col("word").alias("target"), F.col("n").alias("near_n"))
    met = arrived.filter(F.col("word") != F.col("target")).join(terminal, "target")
    return met.select("word", F.col("target").alias("near"), "near_n").distinct()


# ---- forms and roots -----------------------------------------------------------------------------

def with_forms(vocabulary: DataFrame, near: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """(word, n, n_near, form, form_n): the near word of largest n, where that is ``factor`` times the word's."""
    # min_by over (-n, word): the largest n, then the first word in the order of code points, which is that of UTF-8 bytes
    best = near.groupBy(F.col("word").alias("other")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = vocabulary.join(best, F.col("word") == F.col("other"), "left")
    has = -F.col("best.less") >= factor * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words that have a form: the last word of its chain of forms.

    Chains end because n grows along them; each round doubles the steps that a word has taken.
    """
    at = durable(forms.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = durable(at.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FORM_FACTOR) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every counted word of the documents."""
    vocabulary = durable(word_counts(docs, least_length, least_count), "words")
    forms = durable(with_forms(vocabulary, near_words(vocabulary), factor), "forms")
    chains = roots(forms).withColumnRenamed("word", "other")
    return forms.join(chains, F.col("word") == F.col("other"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
