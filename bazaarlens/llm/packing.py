"""Conflict-constrained best-fit packing of documents into fixed-length training sequences.

Pieces are placed longest first. Open bins are ordered by what is left in them and carry bitmaps of
their sources and duplicate clusters; from the tightest bin that fits, the successor search goes on
until a bin shares neither with the piece, else a new bin opens. So no sequence holds two documents
of one source or two copies of one text. Documents longer than a sequence are cut: full pieces are
sequences of their own, the rest is placed like a document.

Documents are dealt to shards by a hash of their key; a shard is packed on its own, which leaves at
most its last bins less full, and a hot source or a large cluster spreads evenly over all shards.

A document has its words and one end token. Null and empty texts take one token. A null source
conflicts with no other; repeated rows are copies of each other. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.shared import keyed

CAPACITY = 2048
#: Documents of a shard, on average.
SHARD_DOCUMENTS = 4000


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece. ``sources`` and ``clusters`` are small numbers, -1 for none."""
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    open_bins: list[tuple[int, int]] = []  # (left, bin), ordered
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        source = 1 << sources[i] if sources[i] >= 0 else 0
        cluster = 1 << clusters[i] if clusters[i] >= 0 else 0
        at = bisect_left(open_bins, (sizes[i], -1))
        while at < len(open_bins) and (source_bits[open_bins[at][1]] & source or cluster_bits[open_bins[at][1]] & cluster):
            at += 1
        if at < len(open_bins):
            left, b = open_bins.pop(at)
        else:
            left, b = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        bins[i], offsets[i] = b, capacity - left
        source_bits[b] |= source
        cluster_bits[b] |= cluster
        if left > sizes[i]:
            insort(open_bins, (left - sizes[i], b))
    return bins, offsets


def pack(docs: DataFrame, capacity: int = CAPACITY, cluster: Column | None = None) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, bin, bin_offset, source, cluster) of every piece.

    ``cluster`` names the duplicate cluster of a document; by default equal texts are one.
    """
    cluster = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) if cluster is None else cluster.cast("long")
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows, _ = keyed(docs.select("doc_id", "text", source.alias("source"), cluster.alias("cluster")), "source", "cluster")
    shards = rows.select("key").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / SHARD_DOCUMENTS)).alias("n")).first()["n"]
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    sized = rows.select("key", "doc_id", "source", "cluster", (words + 1).cast("int").alias("tokens"), F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"))

    def place(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("key").to_numpy(),))
        table = table.take(pa.array(order))
        tokens = table.column("tokens").to_numpy().astype(np.int64)
        parts = (tokens + capacity - 1) // capacity
        row = np.repeat(np.arange(len(tokens)), parts)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(capacity, tokens[row] - piece * capacity)
        number = lambda c: c.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        source, cluster = number(table.column("source"))[row], number(table.column("cluster"))[row]
        bins, offsets = best_fit(size.tolist(), source.tolist(), cluster.tolist(), capacity)
        shard = table.column("shard")[0].as_py()
        back = table.take(pa.array(row))
        return pa.table({
            "doc_id": back.column("doc_id"), "piece": pa.array(piece.astype(np.int32)), "first_token": pa.array(piece * capacity), "n_tokens": pa.array(size),
            "bin": pa.array((np.int64(shard) << 32) + np.array(bins, dtype=np.int64)), "bin_offset": pa.array(np.array(offsets, dtype=np.int64)),
            "source": back.column("source"), "cluster": back.column("cluster")})

    schema = "doc_id long, piece int, first_token long, n_tokens long, bin long, bin_offset long, source string, cluster long"
    return sized.groupBy("shard").applyInArrow(place, schema)
