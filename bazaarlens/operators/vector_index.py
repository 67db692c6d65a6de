"""A two-level inverted index over vectors, with product-quantised residuals.

Coarse centers split the space, finer ones split each coarse cell; what a vector differs from its
fine center is coded in a few bytes, one code for each part of the components. Centers and codes are
fitted on a bounded sample (``sample`` vectors, chosen by hash); every vector is then indexed. The
fitted model is small: as many centers as the square root of the vectors, and 256 codes per part. It
travels with the tasks, never in the plan, and no table pairs queries with cells.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from bazaarlens.session import durable

CODES = 256


class Index(NamedTuple):
    """coarse: the coarse centers; fine: all fine centers; of: the coarse cell of each; codes: one table per part of the residuals."""

    coarse: np.ndarray
    fine: np.ndarray
    of: np.ndarray
    codes: list[np.ndarray]

    def parts(self) -> list[np.ndarray]:
        return np.array_split(np.arange(self.fine.shape[1]), len(self.codes))


class Cells(NamedTuple):
    """rows: (item_id, ivec, cell, code); radius and n: the farthest vector and the number of vectors of each cell."""

    index: Index
    rows: DataFrame
    radius: np.ndarray
    n: np.ndarray


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * a @ b.T, 0.0)


def nearest(points: np.ndarray, to: np.ndarray, rows: int = 1024) -> np.ndarray:
    """The nearest row of ``to`` for each point, a slice of points at a time."""
    return np.concatenate([squared_distances(points[i : i + rows], to).argmin(axis=1) for i in range(0, len(points), rows)])


def centers(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Lloyd's k-means on a sample; a center without points moves to a random one."""
    k = max(1, min(k, len(points)))
    out = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        home = nearest(points, out)
        counts = np.bincount(home, minlength=k)
        sums = np.zeros_like(out)
        np.add.at(sums, home, points)
        out = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], points[rng.integers(0, len(points), k)])
    return out


def fit_index(points: np.ndarray, cells: int, parts: int, seed: int) -> Index:
    rng = np.random.default_rng(seed)
    coarse = centers(points, max(1, round(math.sqrt(cells))), rng)
    home = nearest(points, coarse)
    fine, of = [], []
    for c in range(len(coarse)):
        own = points[home == c]
        if len(own):
            fine.append(centers(own, max(1, round(cells * len(own) / len(points))), rng))
            of += [c] * len(fine[-1])
    every = np.concatenate(fine)
    residuals = points - every[nearest(points, every)]
    split = np.array_split(np.arange(points.shape[1]), max(1, min(parts, points.shape[1])))
    return Index(coarse, every, np.array(of), [centers(residuals[:, p], CODES, rng) for p in split])


def vectors_of(column: pa.Array) -> np.ndarray:
    """Lists of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _assign(index: Index):
    def run(batches):
        for batch in batches:
            points = vectors_of(batch.column("ivec"))
            distances = squared_distances(points, index.fine)
            cell = distances.argmin(axis=1)
            rest = points - index.fine[cell]
            code = np.stack([squared_distances(rest[:, p], table).argmin(axis=1) for p, table in zip(index.parts(), index.codes)], axis=1).astype(np.uint8)
            # the distance itself, not its expansion: it bounds what a cell can hold
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), batch.column("ivec"), pa.array(cell.astype(np.int32)), pa.array(list(map(bytes, code)), pa.binary()), pa.array(np.sqrt((rest * rest).sum(axis=1)))],
                ["item_id", "ivec", "cell", "code", "distance"])

    return run


def build_index(items: DataFrame, cells: int | None = None, parts: int = 8, sample: int = 16384, seed: int = 7) -> Cells | None:
    """The index of (item_id, ivec); None for no items. All vectors have one length."""
    rows = items.select("item_id", F.col("ivec").cast("array<double>").alias("ivec"))
    n = rows.count()
    if not n:
        return None
    chosen = rows.orderBy(F.xxhash64("item_id"), "item_id").limit(sample).select("ivec").toArrow().column("ivec").combine_chunks()
    index = fit_index(vectors_of(chosen), cells or max(2, math.isqrt(n)), parts, seed)
    kind = items.schema["item_id"].dataType.simpleString()
    found = durable(rows.mapInArrow(_assign(index), f"item_id {kind}, ivec array<double>, cell int, code binary, distance double"), "cells")
    radius, count = np.zeros(len(index.fine)), np.zeros(len(index.fine), dtype=np.int64)
    for r in found.groupBy("cell").agg(F.max("distance").alias("r"), F.count("*").alias("n")).collect():  # one row per cell of the model
        radius[r.cell], count[r.cell] = r.r, r.n
    return Cells(index, found.drop("distance"), radius, count)


def _nearest_cells(index: Index, filled: np.ndarray, probes: int, coarse_probes: int | None):
    def run(batches):
        for batch in batches:
            points = vectors_of(batch.column("uvec"))
            distances = np.where(filled[None, :], squared_distances(points, index.fine), np.inf)
            if coarse_probes is not None:
                near = squared_distances(points, index.coarse)
                rank = near.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
                distances = np.where(rank[:, index.of] < coarse_probes, distances, np.inf)
            order = distances.argsort(axis=1, kind="stable")[:, :probes]
            found = [[int(c) for c in row if np.isfinite(d[c])] for row, d in zip(order, distances)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    return run


def nearest_cells(users: DataFrame, cells: Cells, probes: int, coarse_probes: int | None = None) -> DataFrame:
    """``users`` (with ``uvec``) and ``cells``: the ``probes`` nearest filled cells of each, looked for in the nearest coarse cells."""
    rows = users.withColumn("uvec", F.col("uvec").cast("array<double>"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_nearest_cells(cells.index, cells.n > 0, probes, coarse_probes), f"{schema}, cells array<int>")


def _lists(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def _seen_there(batch: pa.RecordBatch, user: np.ndarray, cell: np.ndarray, kind: pa.DataType) -> tuple[np.ndarray, pa.Array]:
    """For each (user, cell): how many items of the cell the user has seen, and these items one after the other."""
    if "seen" not in batch.schema.names:
        return np.zeros(len(user), dtype=np.int32), pa.array([], kind)
    of = [{p["cell"]: p["items"] for p in pairs or ()} for pairs in batch.column("seen").to_pylist()]
    own = [of[u].get(c, ()) for u, c in zip(user.tolist(), cell.tolist())]
    return np.array([len(x) for x in own], dtype=np.int32), pa.array([i for x in own for i in x], kind)


def _item_kind(cells: Cells) -> tuple[str, pa.DataType]:
    kind = cells.rows.schema["item_id"].dataType
    return kind.simpleString(), to_arrow_type(kind)


class Bundles(NamedTuple):
    """Neighbouring cells whose items are read together: pieces and the first and last bundle of each cell,
    pieces of a cell in one bundle, and in how many parts the users of each bundle are dealt."""

    pieces: np.ndarray
    first: np.ndarray
    last: np.ndarray
    per: int
    parts: np.ndarray


def _laid_out(cells: Cells, block: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Pieces, first and last bundle of each cell, and pieces of a cell in one bundle."""
    per = max(1, size // block)
    pieces = np.maximum(np.ceil(cells.n / block).astype(np.int64), 1)
    first, bundle, filled = np.zeros_like(pieces), 0, 0
    for c, n in enumerate(cells.n):
        if filled and filled + n > size:
            bundle, filled = bundle + 1, 0
        first[c], filled = bundle, filled + n
        bundle += (pieces[c] - 1) // per
    last = first + (pieces - 1) // per
    return pieces, first, last, per


def bundle_cells(probed: DataFrame, cells: Cells, block: int, size: int, dealt: int = 131072) -> Bundles:
    """Bundles of up to ``size`` items: cells in their order, which keeps those of a coarse cell together; a larger
    cell has several to itself. A bundle has one part for every ``dealt`` (user, cell) it is asked for, so copies of
    its items grow no faster than its users."""
    pieces, first, last, per = _laid_out(cells, block, size)
    wanted = np.zeros(int(last.max()) + 1)
    for r in probed.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect():  # one row per cell of the model
        wanted[first[r.cell] : last[r.cell] + 1] += r["count"]
    return Bundles(pieces, first, last, per, np.maximum(np.ceil(wanted / dealt), 1).astype(np.int64))


def whole_bundles(cells: Cells, block: int, size: int) -> Bundles:
    """Bundles of up to ``size`` items, each in one part until ``dealt_in_parts`` knows its users."""
    pieces, first, last, per = _laid_out(cells, block, size)
    return Bundles(pieces, first, last, per, np.ones(int(last.max()) + 1, dtype=np.int64))


def dealt_in_parts(bundles: Bundles, users: np.ndarray, rows: int, dealt: int = 65536, tasks: int = 32) -> Bundles:
    """The bundles in one part for every ``dealt`` of their ``users``, or in as many as make about ``tasks`` parts in
    all where that leaves each part a block of ``rows`` users: a number that does not grow with the tables."""
    few = np.minimum(np.ceil(tasks / len(bundles.parts)), np.ceil(users / rows))
    return bundles._replace(parts=np.maximum(np.maximum(np.ceil(users / dealt), few), 1).astype(np.int64))


def _home(bundles: Bundles):
    """The bundle of the nearest cell (of a cell in several, the first)."""

    def choose(batch: pa.RecordBatch, points: np.ndarray) -> np.ndarray:
        cells, wanted = batch.column("cells"), np.zeros((len(points), len(bundles.parts)), dtype=bool)
        user = np.repeat(np.arange(len(points)), cells.value_lengths().to_numpy(zero_copy_only=False))
        wanted[user, bundles.first[cells.flatten().to_numpy(zero_copy_only=False)]] = True
        return wanted

    return choose


def _reachable(cells: Cells, bundles: Bundles):
    """All other bundles with a cell that can hold something within each user's ``reach`` (null: anything)."""
    index, radius, filled, home = cells.index, cells.radius, cells.n > 0, _home(bundles)
    first, last = bundles.first, bundles.last

    def choose(batch: pa.RecordBatch, points: np.ndarray) -> np.ndarray:
        reach = batch.column("reach").to_numpy(zero_copy_only=False)
        bound = np.sqrt(squared_distances(points, index.fine)) - radius[None, :]
        near = filled[None, :] & (np.isnan(reach)[:, None] | (bound <= reach[:, None] + 1e-6))
        # first and last rise with the cells, so a bundle's cells stand side by side
        wanted = np.stack([near[:, np.searchsorted(last, b) : np.searchsorted(first, b, "right")].any(axis=1) for b in range(len(bundles.parts))], axis=1)
        return wanted & ~home(batch, points)

    return choose


def _seen_in_bundles(batch: pa.RecordBatch, bundles: Bundles, kind: pa.DataType) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(user, bundle, items): everything the users have seen in each bundle, by bundle and user; a cell in several bundles counts in all."""
    if "seen" not in batch.schema.names:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), pa.array([], kind)
    seen = batch.column("seen")
    cell, items = seen.flatten().flatten()
    cell = cell.to_numpy(zero_copy_only=False).astype(np.int64)
    user = np.repeat(np.arange(len(seen)), seen.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    pair = np.repeat(np.arange(len(cell)), items.value_lengths().to_numpy(zero_copy_only=False))
    user, cell, place = user[pair], cell[pair], np.arange(len(pair))
    times = bundles.last[cell] - bundles.first[cell] + 1
    bundle = np.repeat(bundles.first[cell], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    user, place = np.repeat(user, times), np.repeat(place, times)
    order = np.lexsort((user, bundle))
    return user[order], bundle[order], items.flatten().take(pa.array(place[order]))


def _blocks_for_whole_bundles(bundles: Bundles, choose, kind: pa.DataType, rows: int):
    def run(batches):
        number = TaskContext.get().partitionId()  # blocks go round the parts of a bundle
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                points, number = vectors_of(batch.column("uvec")), number + 1
                floors = batch.column("floor").to_numpy(zero_copy_only=False) if "floor" in batch.schema.names else np.full(len(points), np.nan)
                wanted = choose(batch, points)
                seen_user, seen_bundle, seen = _seen_in_bundles(batch, bundles, kind)
                for b in np.flatnonzero(wanted.any(axis=0)).tolist():
                    people = np.flatnonzero(wanted[:, b])
                    own = np.arange(*np.searchsorted(seen_bundle, [b, b + 1]))
                    own = own[wanted[seen_user[own], b]]
                    extras = np.bincount(seen_user[own], minlength=len(points))[people]
                    one = [batch.column("user_id").take(pa.array(people)), pa.array(points[people].ravel()), pa.array(extras.astype(np.int32)), seen.take(pa.array(own)), pa.array(floors[people])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b], pa.int32()), pa.array([number % int(bundles.parts[b])], pa.int32()), *[_lists(x, np.array([0, len(x)])) for x in one]],
                        ["bundle", "part", "user_ids", "uvecs", "extras", "seens", "floors"])

    return run


def _to_whole_bundles(users: DataFrame, cells: Cells, bundles: Bundles, choose, rows: int) -> DataFrame:
    kind, (item, arrow) = users.schema["user_id"].dataType.simpleString(), _item_kind(cells)
    return users.mapInArrow(
        _blocks_for_whole_bundles(bundles, choose, arrow, rows),
        f"bundle int, part int, user_ids array<{kind}>, uvecs array<double>, extras array<int>, seens array<{item}>, floors array<double>")


def blocks_to_home_bundles(probed: DataFrame, cells: Cells, bundles: Bundles, rows: int) -> DataFrame:
    """(bundle, part, user_ids, uvecs, extras, seens, floors): blocks of up to ``rows`` users for the bundle of their nearest cell.

    ``extras`` counts what each user has seen there and ``seens`` names it, user by user; ``floors`` holds
    their ``floor`` (NaN without one). Blocks are cut from the rows as they come, inside the task.
    """
    return _to_whole_bundles(probed, cells, bundles, _home(bundles), rows)


def blocks_to_reachable_bundles(probed: DataFrame, cells: Cells, bundles: Bundles, rows: int) -> DataFrame:
    """The same for all other bundles with a cell that can hold something within each user's ``reach`` (null: anything)."""
    return _to_whole_bundles(probed, cells, bundles, _reachable(cells, bundles), rows)


def _blocks_for_bundles(bundles: Bundles, kind: pa.DataType, rows: int = 16384):
    def run(batches):
        number = TaskContext.get().partitionId()  # blocks go round the parts of a bundle
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                points, number = vectors_of(batch.column("uvec")), number + 1
                wanted = batch.column("cells")
                cell = wanted.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                user = np.repeat(np.arange(len(wanted)), wanted.value_lengths().to_numpy(zero_copy_only=False))
                times = bundles.last[cell] - bundles.first[cell] + 1
                bundle = np.repeat(bundles.first[cell], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                cell, user = np.repeat(cell, times), np.repeat(user, times)
                order = np.lexsort((user, cell, bundle))
                cell, user, bundle = cell[order], user[order], bundle[order]
                extras, seens = _seen_there(batch, user, cell, kind)
                upto = np.concatenate([[0], np.cumsum(extras)])
                heads = np.append(np.flatnonzero(np.diff(bundle, prepend=-1)), len(bundle))
                for at, to in zip(heads[:-1], heads[1:]):
                    b = int(bundle[at])
                    people, place = np.unique(user[at:to], return_inverse=True)
                    one = [batch.column("user_id").take(pa.array(people)), pa.array(points[people].ravel()), pa.array(cell[at:to].astype(np.int32)), pa.array(place.astype(np.int32)),
                           pa.array(extras[at:to]), seens.slice(upto[at], upto[to] - upto[at])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b], pa.int32()), pa.array([number % int(bundles.parts[b])], pa.int32()), *[_lists(x, np.array([0, len(x)])) for x in one]],
                        ["bundle", "part", "user_ids", "uvecs", "wanted", "places", "extras", "seens"])

    return run


def blocks_to_bundles(probed: DataFrame, cells: Cells, bundles: Bundles) -> DataFrame:
    """(bundle, part, user_ids, uvecs, wanted, places, extras, seens): users with all their ``cells`` of one bundle.

    A user's vector goes to a bundle once, whatever number of its cells the user asks for. ``wanted``
    lists cells in ascending order, ``places`` the asking user's place in ``user_ids``; ``extras`` and
    ``seens`` tell what that user has seen in that cell.
    """
    kind, (item, arrow) = probed.schema["user_id"].dataType.simpleString(), _item_kind(cells)
    return probed.mapInArrow(
        _blocks_for_bundles(bundles, arrow),
        f"bundle int, part int, user_ids array<{kind}>, uvecs array<double>, wanted array<int>, places array<int>, extras array<int>, seens array<{item}>")


def bundled_items(cells: Cells, bundles: Bundles) -> DataFrame:
    """The rows of the index with their ``piece`` of the cell and their ``bundle``."""
    table = [(c, int(p), int(f)) for c, (p, f) in enumerate(zip(bundles.pieces, bundles.first))]
    return (
        cells.rows.join(F.broadcast(cells.rows.sparkSession.createDataFrame(table, "cell int, n_pieces long, first long")), "cell")
        .withColumn("piece", F.pmod(F.xxhash64("item_id"), F.col("n_pieces")).cast("int"))
        .withColumn("bundle", (F.col("first") + F.floor(F.col("piece") / bundles.per)).cast("int"))
    )


def items_of_bundles(rows: DataFrame, bundles: Bundles) -> DataFrame:
    """(bundle, part, item_ids, ivecs, and cells, pieces, codes where ``rows`` have them): the items of each bundle, a copy for each of its parts."""
    parts = [(b, int(p)) for b, p in enumerate(bundles.parts)]
    cut = rows.join(F.broadcast(rows.sparkSession.createDataFrame(parts, "bundle int, n_parts int")), "bundle").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    names = {"item_id": "item_ids", "cell": "cells", "piece": "pieces", "code": "codes", "ivec": "ivecs"}
    columns = {a: b for a, b in names.items() if a in rows.columns}
    packed = cut.groupBy("bundle", "part").agg(F.collect_list(F.struct(*columns)).alias("l"))
    return packed.select("bundle", "part", *[F.flatten(f"l.{a}").alias(b) if a == "ivec" else F.col(f"l.{a}").alias(b) for a, b in columns.items()])


def code_scores(index: Index, cell: int, users: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Estimated inner products of users with the coded items of a cell."""
    out = np.repeat((users @ index.fine[cell])[:, None], len(codes), axis=1)
    for j, (part, table) in enumerate(zip(index.parts(), index.codes)):
        out += (users[:, part] @ table.T)[:, codes[:, j]]
    return out
