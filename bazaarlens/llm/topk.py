"""Exact top-k inner products by a three-phase uniform threshold over vertically cut score lists.

The components of every vector are cut into LISTS parts. For a query each part defines a local list
of scores; a score is the sum of one entry from each list. Three phases find the best without adding
up every entry:

1. Every list gives its best entries. Their exact sums give a safe cutoff: the K-th best of them.
2. The cutoff goes out with the queries. A vector that reaches it has an entry of at least
   cutoff / LISTS in some list, so each list sends just those entries.
3. Sums that lack entries are bounded by what the missing lists can still add; those that can reach
   the cutoff get their remaining scores from the vectors.

Queries and vectors meet as matrix blocks of bounded size, dealt by hash. Equal vectors are one
object that keeps the few smallest ids it can ever contribute, and equal queries are asked once, so
a vector that a third of the rows share costs what any other costs. Components are integers and
products are computed without rounding.

Defined results: rows without id or vector, or with null or non-finite components, take no part;
vectors of unequal length count as if padded with zeros; every row with a query's id is a query of
its own and meets the other rows of that id; ties go to the smaller id, then to the row read first.
Scores beyond 64 bits raise. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarlens.operators.core import top_n
from bazaarlens.session import durable

LISTS = 2
CELL_ROWS, QUERY_ROWS = 4096, 1024
#: Stands for "no cutoff": fewer objects than asked for, so every entry is sent.
NONE = -(1 << 63)


def _pack_ints(values: np.ndarray) -> bytes:
    """Integers in the narrowest of three widths, which the first byte names."""
    most = max(int(values.max(initial=0)), -int(values.min(initial=0)))
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([width]) + values.astype(f"<i{width}").tobytes()


def _unpack_ints(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<i{data[0]}", offset=1).astype(np.int64)


def _matrix(packed: pa.Array, dims: int) -> np.ndarray:
    """Packed vectors as rows, shorter ones padded with zeros; vectors of one length and width are read at once."""
    packed = packed.combine_chunks() if isinstance(packed, pa.ChunkedArray) else packed
    out = np.zeros((len(packed), dims), dtype=np.int64)
    if not len(packed):
        return out
    _, offsets, data = packed.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[packed.offset : packed.offset + len(packed) + 1]
    size = int(at[1] - at[0])
    if (np.diff(at) == size).all():
        raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].reshape(len(packed), size)
        if (raw[:, 0] == raw[0, 0]).all():
            part = np.ascontiguousarray(raw[:, 1:]).view(f"<i{raw[0, 0]}")
            out[:, : part.shape[1]] = part
            return out
    for i, value in enumerate(packed.to_pylist()):
        part = _unpack_ints(value)
        out[i, : len(part)] = part
    return out


def _most(a: np.ndarray) -> int:
    return max(int(a.max(initial=0)), -int(a.min(initial=0)))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of two integer matrices, exact."""
    bound = _most(a) * _most(b) * a.shape[1]
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound >= 1 << 60:
        raise ValueError("inner products need more than 64 bits")
    return a @ b.T


def _scaled(scale: int):
    def run(batches):
        for batch in batches:
            vectors = batch.column("embedding")
            at = vectors.offsets.to_numpy()
            flat = np.floor(vectors.values.to_numpy(zero_copy_only=False) * float(scale))
            if len(flat) and np.abs(flat[at[0] : at[-1]]).max(initial=0) >= 2.0**60:
                raise ValueError("a component needs more than 60 bits")
            values = flat.astype(np.int64)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id"), "dims": pa.array(np.diff(at), pa.int32()),
                "v": pa.array([_pack_ints(values[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())})

    return run


def scaled_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, dims, v, row): vectors that take part, as packed integers floor(scale * x), numbered."""
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = plain.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(odd, F.lit(False)))
    return durable(sound.mapInArrow(_scaled(scale), "vec_id long, dims int, v binary").withColumn("row", F.monotonically_increasing_id()), "vectors")


def _blocks(objects: DataFrame, rows: int, n: int, dims: int, lists: int, cell: str) -> DataFrame:
    """(cell, list, ids, cuts, part): about ``rows`` objects (id, v, cut) to a cell, one row for each list."""
    edges = [round(dims * i / lists) for i in range(lists + 1)]

    def pack(table: pa.Table) -> pa.Table:
        ids, cuts = table.column("id").to_numpy(), table.column("cut").to_numpy()
        whole = _matrix(table.column("v"), dims)
        return pa.table({
            cell: pa.array([table.column(cell)[0].as_py()] * lists, pa.int64()), "list": pa.array(range(lists), pa.int32()),
            "ids": pa.array([ids.tobytes()] * lists, pa.binary()), "cuts": pa.array([cuts.tobytes()] * lists, pa.binary()),
            "part": pa.array([_pack_ints(whole[:, a:b].ravel()) for a, b in zip(edges, edges[1:])], pa.binary())})

    dealt = objects.select("id", "v", F.coalesce("cut", F.lit(NONE)).alias("cut"), F.pmod(F.xxhash64("id"), F.lit(max(1, math.ceil(n / rows)))).alias(cell))
    return dealt.groupBy(cell).applyInArrow(pack, f"{cell} long, list int, ids binary, cuts binary, part binary")


def _entries(queries: DataFrame, items: DataFrame, q_cells: int, cells: int, choose) -> DataFrame:
    """(q, item, list, s, cut): entries of the local lists that ``choose`` takes from each pair of blocks."""
    schema = "q long, item long, list int, s long, cut long"

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict = {"q": [], "item": [], "s": [], "cut": []}
        if left.num_rows and right.num_rows:
            (a_ids, a, cuts), (b_ids, b, _) = (
                ((ids := np.frombuffer(t.column("ids")[0].as_py(), np.int64)), _unpack_ints(t.column("part")[0].as_py()).reshape(len(ids), -1),
                 np.frombuffer(t.column("cuts")[0].as_py(), np.int64)) for t in (left, right))
            scores = _product(a, b)
            i, j = choose(scores, cuts)
            out = {"q": a_ids[i], "item": b_ids[j], "s": scores[i, j], "cut": cuts[i]}
        number = left.column("list")[0].as_py() if left.num_rows else 0
        columns = {k: pa.array(v, pa.int64()) for k, v in out.items()}
        return pa.table([columns["q"], columns["item"], pa.array(np.full(len(columns["q"]), number), pa.int32()), columns["s"], columns["cut"]], ["q", "item", "list", "s", "cut"])

    # Keys of both sides have one type: a cogroup hashes them as they are.
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    keys = ["q_cell", "cell", "list"]
    left = queries.withColumn("cell", every(cells)).groupBy(*keys)
    right = items.withColumn("q_cell", every(q_cells)).groupBy(*keys)
    return left.cogroup(right).applyInArrow(meet, schema)


def _best(k: int):
    def choose(scores: np.ndarray, cuts: np.ndarray):
        k_here = min(k, scores.shape[1])
        best = np.argpartition(scores, scores.shape[1] - k_here, axis=1)[:, scores.shape[1] - k_here :]
        return np.repeat(np.arange(len(scores)), k_here), best.ravel()

    return choose


def _reaching(lists: int):
    def choose(scores: np.ndarray, cuts: np.ndarray):
        # s >= cut / lists, without dividing; no cutoff takes all
        least = np.array([NONE if c == NONE else -(-c // lists) for c in cuts.tolist()], dtype=np.int64)
        return np.nonzero(scores >= least[:, None])

    return choose


def _dots(batches):
    for batch in batches:
        a, b = (batch.column(c) for c in ("qv", "iv"))
        dims = max(pc.max(pc.binary_length(c)).as_py() or 0 for c in (a, b))  # no vector has more components than bytes
        x, y = _matrix(a, dims), _matrix(b, dims)
        if _most(x) * _most(y) * max(1, dims) >= 1 << 60:
            raise ValueError("inner products need more than 64 bits")
        yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("item"), batch.column("min_id"), pa.array(np.einsum("ij,ij->i", x, y), pa.int64())], ["q", "item", "min_id", "score"])


def exact_scores(pairs: DataFrame, queries: DataFrame, objects: DataFrame) -> DataFrame:
    """(q, item, min_id, score) of the pairs (q, item), from the vectors."""
    sides = pairs.select("q", "item").join(objects.select(F.col("id").alias("item"), F.col("v").alias("iv"), "min_id"), "item").join(
        queries.select(F.col("id").alias("q"), F.col("v").alias("qv")), "q")
    return sides.select("q", "item", "min_id", "qv", "iv").mapInArrow(_dots, "q long, item long, min_id long, score long")


def nearest_objects(queries: DataFrame, objects: DataFrame, k: int, lists: int = LISTS, cell_rows: int = CELL_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(q, item, min_id, score, place): the ``k`` best objects (id, v, dims, min_id) for every query object (id, v).

    Both tables hold each id once. Ties go to the smaller ``min_id``.
    """
    n, dims = objects.agg(F.count("*"), F.coalesce(F.max("dims"), F.lit(0))).first()
    n_queries, q_dims = queries.agg(F.count("*"), F.coalesce(F.max("dims"), F.lit(0))).first()
    dims, lists = max(dims, q_dims), max(1, min(lists, max(dims, q_dims)))
    cells, q_cells = max(1, math.ceil(n / cell_rows)), max(1, math.ceil(n_queries / query_rows))
    none = F.lit(None).cast("long")
    items = durable(_blocks(objects.withColumn("cut", none), cell_rows, n, dims, lists, "cell"), "lists")
    asked = _blocks(queries.withColumn("cut", none), query_rows, n_queries, dims, lists, "q_cell")

    first = top_n(_entries(asked, items, q_cells, cells, _best(k)), ["q", "list"], [F.desc("s"), F.asc("item")], k)
    known = exact_scores(first.select("q", "item").distinct(), queries, objects)
    cutoffs = durable(top_n(known, ["q"], [F.desc("score"), F.asc("item")], k).filter(F.col("rank") == k).select(F.col("q").alias("id"), F.col("score").alias("cut")), "cutoffs")

    told = _blocks(queries.join(cutoffs, "id", "left"), query_rows, n_queries, dims, lists, "q_cell")
    sent = _entries(told, items, q_cells, cells, _reaching(lists)).groupBy("q", "item").agg(F.sum("s").alias("s"), F.count("*").alias("seen"), F.max("cut").alias("cut"))
    missing = F.lit(lists) - F.col("seen")
    may = (F.col("cut") == NONE) | (F.col("s") + missing * F.floor((F.col("cut") - 1) / F.lit(lists)) >= F.col("cut"))
    whole = F.when(missing == 0, F.col("s") >= F.col("cut")).otherwise(may)
    reached = durable(sent.filter(whole), "reached")
    complete = reached.filter(F.col("seen") == lists).join(objects.select(F.col("id").alias("item"), "min_id"), "item").select("q", "item", "min_id", F.col("s").alias("score"))
    resolved = exact_scores(reached.filter(F.col("seen") < lists), queries, objects)
    return top_n(complete.unionByName(resolved), ["q"], [F.desc("score"), F.asc("min_id"), F.asc("item")], k, "place")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, **sizes) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its ``k`` best other rows."""
    more = k + 1  # a query's own row may be among its best
    rows = scaled_vectors(vectors, scale)
    kept = top_n(rows, ["v"], [F.asc("vec_id"), F.asc("row")], more, "member")
    named = kept.withColumn("id", F.first("row").over(W.partitionBy("v").orderBy("member").rowsBetween(W.unboundedPreceding, W.currentRow)))
    members = durable(named, "members")
    objects = members.filter("member = 1").select("id", "v", "dims", F.col("vec_id").alias("min_id"))
    wanted = durable(rows.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("row").alias("own"), "v").join(objects.select("v", "id"), "v").select("query_id", "own", "id"), "wanted")
    queries = objects.join(wanted.select("id").distinct(), "id", "left_semi")
    best = durable(nearest_objects(queries, objects, more, **sizes), "best")
    expanded = best.select("q", "item", "score").join(members.select(F.col("id").alias("item"), "vec_id", "row"), "item")
    rows_of = top_n(expanded, ["q"], [F.desc("score"), F.asc("vec_id"), F.asc("row")], more, "at")
    lists = rows_of.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("at", "row", "vec_id", "score"))).alias("list"))  # at most k + 1 entries
    found = wanted.join(lists, F.col("id") == F.col("q"))
    others = F.slice(F.filter("list", lambda e: e["row"] != F.col("own")), 1, k)
    return found.select("query_id", F.posexplode(others).alias("place", "e")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))
