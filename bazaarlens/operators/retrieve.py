"""Candidate retrieval and merging."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarlens.functions.columns import decay, seconds, unit, weighted
from bazaarlens.operators.core import in_slices, join_keys, running_count, top_n
from bazaarlens.operators.joins import anti_exists
from bazaarlens.operators.quality import RENT_ORDER, SALE_ORDER
from bazaarlens.operators.vector_index import (
    Index, blocks_to_bundles, blocks_to_home_bundles, blocks_to_reachable_bundles, build_index, bundle_cells, bundled_items, code_scores, dealt_in_parts, items_of_bundles, nearest_cells, whole_bundles,
)
from bazaarlens.operators.windows import gap_sessionize
from bazaarlens.session import durable, shared_folder
from bazaarlens.sources.star import global_row_number

# Intent weights of the history list and of co-visitation, and retrieval blend weights.
COVISIT_INTENT = {"view_phone": 2.0, "contact_chat": 3.0, "contact_zalo": 3.0, "contact_sms": 3.0, "other_interaction": 1.0}
INTENT = {"view_phone": 3.0, "contact_chat": 2.0, "contact_zalo": 2.0, "contact_sms": 2.0, "other_interaction": 1.0}
BLEND = {"als": 0.35, "covis": 0.25, "itemcf": 0.15, "fresh": 0.15}
REPEAT_WEIGHT = 0.10
#: Users of one matrix product with a bundle of items.
USER_BLOCK = 4096
#: The highest step of the longer price scale.
LAST_ORDINAL = max(len(SALE_ORDER), len(RENT_ORDER)) - 1


# ---- matrix factorization -----------------------------------------------------------------------

def confidence(pairs: DataFrame, as_of: str, rate: float = 0.005) -> DataFrame:
    """weight = max(1, count * exp(-rate * days))."""
    days = F.greatest(F.datediff(F.lit(as_of).cast("date"), F.to_date("last_ts")), F.lit(0))
    return pairs.select("user_id", "item_id", F.greatest(F.lit(1.0), F.col("pos_count") * decay(days, rate, "rate")).alias("weight"))


class Factors(NamedTuple):
    """ALS factors by the caller's own ids: (user_id, vector) and (item_id, vector)."""

    users: DataFrame
    items: DataFrame


def _indexed(df: DataFrame, column: str) -> DataFrame:
    """(column, n): every distinct id with a number from 1, for trainers that want small integers."""
    return durable(global_row_number(df.select(column).distinct(), [column], "n").select(column, F.col("n").cast("int").alias("n")), "index")


def fit_als(ratings: DataFrame, rank: int = 256, alpha: float = 40.0, iterations: int = 15, reg: float = 0.05, seed: int = 42) -> Factors:
    """Implicit ALS on the weights, for ids of any type; lineage is cut through the shared folder."""
    from pyspark.ml.recommendation import ALS

    spark = ratings.sparkSession
    spark.sparkContext.setCheckpointDir(shared_folder(spark))
    users, items = _indexed(ratings, "user_id"), _indexed(ratings, "item_id")
    numbered = ratings.join(users.withColumnRenamed("n", "u"), "user_id").join(items.withColumnRenamed("n", "i"), "item_id")
    als = ALS(userCol="u", itemCol="i", ratingCol="weight", implicitPrefs=True, rank=rank, alpha=alpha,
              maxIter=iterations, regParam=reg, seed=seed, checkpointInterval=5, coldStartStrategy="drop")
    model = als.fit(durable(numbered.select("u", "i", "weight"), "ratings"))
    vector = F.col("features").cast("array<double>").alias("vector")
    return Factors(
        model.userFactors.join(users, F.col("id") == F.col("n")).select("user_id", vector), model.itemFactors.join(items, F.col("id") == F.col("n")).select("item_id", vector))


def als_candidates(factors: Factors, users: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` items of largest inner product for the target ``users``.

    Items get one more coordinate that brings all of them to the length of the longest; then the
    nearest item by angle has the largest inner product, and the exact search by cells serves here too.
    """
    size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    longest = factors.items.agg(F.max(size)).first()[0] or 1.0
    own = F.transform("vector", lambda x: x / longest)
    rest = F.sqrt(F.greatest(F.lit(0.0), 1.0 - size * size / (longest * longest)))
    items = factors.items.select("item_id", F.concat(own, F.array(rest)).alias("ivec"))
    wanted = factors.users.join(users.select("user_id").distinct(), "user_id", "left_semi").withColumn("size", size).filter("size > 0")
    unit_users = wanted.select("user_id", F.concat(F.transform("vector", lambda x: x / F.col("size")), F.array(F.lit(0.0))).alias("uvec"))
    near = nearest_items(unit_users, items, None, n)
    return near.join(wanted.select("user_id", "size"), "user_id").select("user_id", "item_id", (F.col("score") * F.col("size") * longest).alias("score"), "rank")


# ---- nearest items to a user vector -------------------------------------------------------------

def user_vectors(pairs: DataFrame, vectors: DataFrame, weight: str = "pos_count") -> DataFrame:
    """Count-weighted mean of the items' unit vectors, scaled to length one."""
    from bazaarlens.operators.features import user_embedding_profile

    return user_embedding_profile(pairs, vectors, weight).select("user_id", unit("profile").alias("uvec"))


def item_embedding_cf(
    users: DataFrame, vectors: DataFrame, seen: DataFrame, k: int = 100, targets: DataFrame | None = None, **search
) -> DataFrame:
    """Top-k unseen items by cosine for every (user_id, uvec), or for the ``targets`` among them only."""
    wanted = users if targets is None else users.join(targets.select("user_id").distinct(), "user_id", "left_semi")
    return nearest_items(wanted, vectors.select("item_id", unit("embedding").alias("ivec")), seen, k, **search)


def nearest_items(
    users: DataFrame, items: DataFrame, seen: DataFrame | None, k: int, cells: int | None = None, probes: int = 4, block: int = 1024, seed: int = 7,
    exact: bool = True, keep: int | None = None, coarse_probes: int | None = None, bundle: int = 16384,
) -> DataFrame:
    """Top-k items by inner product for unit vectors ``uvec`` and ``ivec``, without pairing rows.

    Items are indexed in cells (``vector_index``), by default as many as the square root of their
    number; neighbouring cells lie together in bundles. For unit vectors cosine order is distance order,
    and by the triangle inequality a cell of radius r around c holds nothing nearer to u than d(u,c) - r.
    The ``exact`` form reads the bundle of a user's nearest cell, which gives a distance within which k
    unseen items already lie; of the others only bundles with a cell that could hold something nearer
    are read, and of those only rows that reach the k-th score of the first. It approximates nothing.
    Otherwise the codes of the ``probes`` nearest cells, looked for in the ``coarse_probes`` nearest
    coarse cells, are scored, and the ``keep`` best (5k) of each piece of a cell are ranked again by
    their vectors where they lie; nothing else is read.

    Work is dealt by (bundle, part of its users): bundles hold up to ``bundle`` items, in the exact form an
    eighth of all or at most four times as many; a user goes to a bundle once, whatever number of its
    cells is wanted, and leaves it with its best ``k``. So a user's vector is copied eight times, or once
    for every 65,536 items, and an item's once for every 65,536 users. Users and items meet as matrices of bounded size, and a hot cell
    spans several bundles. Bounds are taken inside a user's row, before it is copied. What a user has
    seen goes along and is left out where it lies.
    """
    types = {f.name: f.dataType.simpleString() for f in [*users.schema, *items.schema]}
    schema = f"user_id {types['user_id']}, item_id {types['item_id']}, score double"
    built = build_index(items, cells, seed=seed)
    if built is None:
        return users.sparkSession.createDataFrame([], f"{schema}, rank int")
    rows = users.select("user_id", "uvec")
    if seen is not None:  # what a user has seen, by the cells of the model
        per_cell = seen.join(built.rows.select("item_id", "cell"), "item_id").groupBy("user_id", "cell").agg(F.collect_set("item_id").alias("items"))
        rows = rows.join(per_cell.groupBy("user_id").agg(F.collect_list(F.struct("cell", "items")).alias("seen")), "user_id", "left")
    probed = durable(nearest_cells(rows, built, 1 if exact else probes, coarse_probes), "probed")
    order = [F.desc(F.round("score", 9)), F.asc("item_id")]
    if not exact:
        bundles = bundle_cells(probed, built, block, bundle)
        best = _best_of_bundles(built.index, keep or 5 * k, k)
        return top_n(_meet(blocks_to_bundles(probed, built, bundles), items_of_bundles(bundled_items(built, bundles), bundles), ["bundle", "part"], best, schema), ["user_id"], order, k)

    bundles, best, keys = whole_bundles(built, block, min(4 * bundle, math.ceil(built.n.sum() / 8))), _best_of_blocks(k), ["bundle", "part"]
    items = durable(bundled_items(built, bundles).select("bundle", "item_id", "ivec"), "bundled")
    home, asked = F.get("cells", 0), np.zeros(len(bundles.parts))
    for r in probed.groupBy(home.alias("cell")).count().collect():  # one row per cell of the model
        asked[bundles.first[r.cell]] += r["count"]
    near, rest = (dealt_in_parts(bundles, n, USER_BLOCK) for n in (asked, np.full(len(asked), asked.sum())))
    # A user's rows leave one task here, so its k-th score needs no order of all rows.
    first = durable(_meet(blocks_to_home_bundles(probed, built, near, USER_BLOCK), items_of_bundles(items, near), keys, best, schema), "first")
    full = F.when(F.count("*") >= k, F.min("score"))
    reach = first.groupBy("user_id").agg(full.alias("floor")).filter("floor is not null").withColumn("reach", F.sqrt(F.greatest(2.0 - 2.0 * F.col("floor"), F.lit(0.0))))
    more = blocks_to_reachable_bundles(probed.join(reach, "user_id", "left"), built, rest, USER_BLOCK)
    both = first.unionByName(_meet(more, items_of_bundles(items, rest), keys, best, schema))
    return top_n(both, ["user_id"], order, k)


def _meet(sent: DataFrame, packed: DataFrame, keys: Sequence[str], best, schema: str) -> DataFrame:
    """(user_id, item_id, score): what ``best`` takes from each pair of a user block and the items of its ``keys``.

    User blocks are far larger than the rows they are cut from, and Spark judges them by those: they
    must not be taken for a small table and sent through the driver.
    """
    return sent.hint("merge").join(packed.hint("merge"), list(keys)).mapInPandas(best, schema)


def _without_seen(scores, items, extras, seens):
    """``scores`` of a user block and an item block, and -inf for what the users have seen: ``extras`` of ``seens`` each."""
    import numpy as np

    if not len(seens):
        return scores
    known, column = np.unique(items, return_inverse=True)
    at = np.minimum(np.searchsorted(known, seens), len(known) - 1)
    here = known[at] == seens
    seen = np.zeros((len(scores), len(known)), dtype=bool)
    seen[np.repeat(np.arange(len(scores)), extras)[here], at[here]] = True
    return np.where(seen[:, column], -np.inf, scores)


def _best_places(scores, floors, k: int):
    """Rows and columns of each row's best ``k`` scores, ties included; none below the floor."""
    import numpy as np

    n = scores.shape[1]
    limit = np.fmax(np.partition(scores, n - min(k, n), axis=1)[:, n - min(k, n)], floors)
    return np.nonzero((scores >= limit[:, None] - 2e-9) & (scores > -np.inf))  # scores are compared at nine digits


def _best_above(scores, floors, k: int):
    """Rows and columns as in ``_best_places``. Where all rows have floors, few scores reach them, and only those are ordered."""
    import numpy as np

    if np.isnan(floors).any():
        return _best_places(scores, floors, k)
    u, i = np.nonzero(scores >= np.maximum(floors, -1e300)[:, None] - 2e-9)
    counts = np.bincount(u, minlength=len(scores))
    if counts.max(initial=0) <= k:
        return u, i
    order = np.lexsort((-scores[u, i], u))
    ends = np.cumsum(counts)
    limit = np.full(len(scores), -np.inf)
    many = counts > k
    limit[many] = scores[u, i][order][(ends - counts)[many] + k - 1]
    kept = scores[u, i] >= limit[u] - 2e-9
    return u[kept], i[kept]


def _best_of_blocks(k: int, size: int = 1 << 22):
    """Matrix products of a user block and a bundle, ``size`` scores at a time; keeps each user's best rows, ties included."""

    def of_block(row):
        import numpy as np
        import pandas as pd

        users, items, extras, seens, floors = (np.asarray(x) for x in (row.user_ids, row.item_ids, row.extras, row.seens, row.floors))
        points, vectors = np.asarray(row.uvecs).reshape(len(users), -1), np.asarray(row.ivecs).reshape(len(items), -1)
        who = what = np.zeros(0, dtype=np.int64)  # places of seen items, an item's copies each
        if len(seens):
            known, column = np.unique(items, return_inverse=True)
            by = np.argsort(column, kind="stable")
            starts = np.searchsorted(column[by], np.arange(len(known) + 1))
            at = np.minimum(np.searchsorted(known, seens), len(known) - 1)
            here = known[at] == seens
            at, who = at[here], np.repeat(np.arange(len(users)), extras)[here]
            copies = starts[at + 1] - starts[at]
            what = by[np.repeat(starts[at], copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)]
            who = np.repeat(who, copies)
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
        step = max(1, size // len(items))
        for a in range(0, len(users), step):
            scores = points[a : a + step] @ vectors.T
            lo, hi = np.searchsorted(who, [a, a + step])
            scores[who[lo:hi] - a, what[lo:hi]] = -np.inf
            u, i = _best_above(scores, floors[a : a + step], k)
            found.append((u + a, i, scores[u, i]))
        u, i, score = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"user_id": users[u], "item_id": items[i], "score": score})

    def run(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield of_block(row)

    return run


def _best_of_bundles(index: Index, keep: int, k: int, block: int = 1024):
    """Each user's best rows of a bundle, ties included: in every piece of a wanted cell over the ``keep`` items (and as many
    as the user has seen in the cell) whose codes score best."""

    def of_cell(cell, points, codes, vectors, items, extras, seens):
        import numpy as np

        rough = code_scores(index, cell, points, codes)
        least = np.sort(rough, axis=1)[np.arange(len(points)), len(items) - np.minimum(keep + extras, len(items))]
        scores = _without_seen(np.where(rough >= least[:, None], points @ vectors.T, -np.inf), items, extras, seens)
        u, i = _best_places(scores, np.nan, k)
        return u, i, scores[u, i]

    def of_bundle(row):
        import numpy as np
        import pandas as pd

        users, items, wanted, places, extras, seens = (np.asarray(x) for x in (row.user_ids, row.item_ids, row.wanted, row.places, row.extras, row.seens))
        points, vectors = np.asarray(row.uvecs).reshape(len(users), -1), np.asarray(row.ivecs).reshape(len(items), -1)
        codes = np.frombuffer(b"".join(row.codes), dtype=np.uint8).reshape(len(items), -1)
        cells, pieces = np.asarray(row.cells), np.asarray(row.pieces)
        order, upto = np.lexsort((pieces, cells)), np.concatenate([[0], np.cumsum(extras)])
        new = (np.diff(cells[order], prepend=-1) != 0) | (np.diff(pieces[order], prepend=-1) != 0)
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
        for own in np.split(order, np.flatnonzero(new)[1:]):
            cell = int(cells[own[0]])
            first, end = np.searchsorted(wanted, [cell, cell + 1])
            for a in range(first, end, block):
                b = min(a + block, end)
                u, i, score = of_cell(cell, points[places[a:b]], codes[own], vectors[own], items[own], extras[a:b], seens[upto[a] : upto[b]])
                found.append((places[a:b][u], own[i], score))
        u, i, score = (np.concatenate(x) for x in zip(*found))
        by = np.lexsort((-score, u))
        starts = np.searchsorted(u[by], np.arange(len(users)))
        counts = np.bincount(u, minlength=len(users))
        limit = np.full(len(users), -np.inf)
        limit[counts >= k] = score[by][starts[counts >= k] + k - 1]
        best = score >= limit[u] - 2e-9
        return pd.DataFrame({"user_id": users[u[best]], "item_id": items[i[best]], "score": score[best]})

    def run(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield of_bundle(row)

    return run


# ---- co-visitation ------------------------------------------------------------------------------

def forward_pairs(events: DataFrame, window: int = 5, gap_seconds: float = 1800, chunk: int = 4096) -> DataFrame:
    """Each event with its next ``window`` events of the same user session.

    A user's rows get running positions and are cut into chunks of fixed length; the first rows of
    a chunk are repeated at the end of the one before, so a user of any length is spread out and
    each row meets exactly its next rows.
    """
    cut = in_slices(events.select("user_id", "item_id", "event_ts", "event_id"), ["user_id"], "event_ts", "event_id")
    rows = gap_sessionize(cut, gap_seconds=gap_seconds, out="session_no")
    rows = running_count(rows, ["user_id"], "event_ts", "event_id", F.lit(1), "pos").withColumn("pos", F.col("pos") - 1).drop("__slice")
    home = F.floor(F.col("pos") / chunk)
    inside = F.col("pos") % chunk
    homes = F.when((inside < window) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    spread = rows.withColumn("home", home).withColumn("chunk", F.explode(homes))
    w = W.partitionBy("user_id", "chunk").orderBy("pos")
    nexts = F.array(*[F.lead(F.struct("item_id", "event_ts", "session_no"), i).over(w) for i in range(1, window + 1)])
    own = spread.withColumn("__n", nexts).filter(F.col("chunk") == F.col("home"))
    pairs = own.select("item_id", "event_ts", "session_no", F.explode("__n").alias("n")).filter(
        (F.col("n.session_no") == F.col("session_no")) & (F.col("n.item_id") != F.col("item_id")))
    minutes = F.greatest((seconds("n.event_ts") - seconds("event_ts")) / 60.0, F.lit(0.0))
    weight = F.lit(1.0) / (F.ln(minutes + 2.0) / F.ln(F.lit(2.0)))
    return pairs.select(F.least("item_id", "n.item_id").alias("a"), F.greatest("item_id", "n.item_id").alias("b"), weight.alias("w"))


def last_touches(events: DataFrame) -> DataFrame:
    """The newest event of every (user, item): what co-visitation pairs, so repeated clicks count once."""
    newest = F.max(F.struct("event_ts", "event_id"))
    return events.groupBy("user_id", "item_id").agg(newest.alias("t")).select("user_id", "item_id", "t.event_ts", "t.event_id")


def covisit_pairs(events: DataFrame, window: int = 5, gap_seconds: float = 1800, top: int = 20) -> DataFrame:
    """Best ``top`` co-visited neighbors of every item."""
    scored = forward_pairs(events, window, gap_seconds).groupBy("a", "b").agg(F.sum("w").alias("score"))
    both = F.array(F.struct(F.col("a").alias("item_id"), F.col("b").alias("neighbor")), F.struct(F.col("b").alias("item_id"), F.col("a").alias("neighbor")))
    sides = scored.select("score", F.explode(both).alias("s")).select("s.item_id", "s.neighbor", "score")
    return top_n(sides, ["item_id"], [F.desc(F.round("score", 9)), F.asc("neighbor")], top)


def user_intent(events: DataFrame, weights: Mapping[str, float] = COVISIT_INTENT) -> DataFrame:
    return events.groupBy("user_id", "item_id").agg(F.sum(weighted("event_type", weights)).alias("intent")).filter("intent > 0")


def covisit_candidates(history: DataFrame, neighbors: DataFrame, n: int = 100) -> DataFrame:
    """Sum of intent times pair score over the history, without the history itself."""
    pairs = neighbors.select("item_id", "neighbor", F.col("score").alias("pair"))
    scored = history.join(pairs, "item_id").groupBy("user_id", "neighbor").agg(F.sum(F.col("intent") * F.col("pair")).alias("score"))
    fresh = anti_exists(scored.withColumnRenamed("neighbor", "item_id"), history, ["user_id", "item_id"])
    return top_n(fresh, ["user_id"], [F.desc(F.round("score", 9)), F.asc("item_id")], n)


# ---- history and lists --------------------------------------------------------------------------

def history_candidates(events: DataFrame, allowed: DataFrame, n: int = 30, tau: float = 14.0, weights: Mapping[str, float] = INTENT) -> DataFrame:
    rows = events.join(allowed.select("item_id"), "item_id", "left_semi")
    # One row for each item meets the allowed ones here, not each event.
    lasts = events.groupBy("item_id").agg(F.max("event_ts").alias("last"))
    newest = lasts.join(allowed.select("item_id"), "item_id", "left_semi").agg(F.max("last")).scalar()
    age = (seconds(newest) - seconds("event_ts")) / 86400.0
    scored = rows.groupBy("user_id", "item_id").agg(F.sum(weighted("event_type", weights, 1.0) * decay(age, tau)).alias("score"))
    return top_n(scored, ["user_id"], [F.desc(F.round("score", 9)), F.asc("item_id")], n)


def ranked_lists(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, score: str, out: str, item: str = "item_id") -> DataFrame:
    """The first ``n`` items of every key as one short array of (r, item, score)."""
    cut = top_n(rows, keys, order, n, "r")
    packed = F.sort_array(F.collect_list(F.struct("r", F.col(item).alias("item"), F.col(score).cast("double").alias("score"))))
    return cut.groupBy(*keys).agg(packed.alias(out))


def _spread(df: DataFrame, lists: str, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns, F.explode(lists).alias("l")).select(
        *columns, F.col("l.item").alias("item_id"), F.col("l.score").alias("score"), F.col("l.r").alias("rank"))


def segment_popularity_candidates(users: DataFrame, items: DataFrame, snapshot: DataFrame, n: int = 50) -> DataFrame:
    """Most contacted items of the user's (category, city), else the global list.

    Users meet one short list each, so a segment holding a third of the users adds no pairs beyond
    the result itself.
    """
    contacts = snapshot.groupBy("item_id").agg(F.sum("contacts_24h").alias("contacts"))
    pop = contacts.join(items.select("item_id", "category", "city_name"), "item_id")
    order = [F.desc("contacts"), F.asc("item_id")]
    segment = ranked_lists(pop, ["category", "city_name"], order, n, "contacts", "list")
    best = pop.orderBy(*order).limit(n)
    numbered = best.select(F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order)).alias("r"), F.col("item_id").alias("item"),
                           F.col("contacts").cast("double").alias("score"))
    fallback = numbered.agg(F.sort_array(F.collect_list(F.struct("r", "item", "score")))).scalar()
    named = segment.withColumnsRenamed({"category": "top_category", "city_name": "top_city"})
    joined = join_keys(users.select("user_id", "top_category", "top_city"), named, ["top_category", "top_city"], "left")
    return _spread(joined.withColumn("list", F.coalesce("list", fallback)), "list", ["user_id"])


def cold_item_candidates(users: DataFrame, items: DataFrame, n: int = 50) -> DataFrame:
    """Newest items without events for the user's (category, district, ad type); score 1 - i/n."""
    keys = ["category", "district_name", "ad_type"]
    cold = items.filter("tier = 'C'").withColumn("zero", F.lit(0.0))
    lists = ranked_lists(cold, keys, [F.desc("posted_date"), F.asc("item_id")], n, "zero", "list")
    named = lists.withColumnsRenamed({"category": "top_category", "district_name": "top_district", "ad_type": "top_ad_type"})
    joined = users.join(named, ["top_category", "top_district", "top_ad_type"])
    spread = _spread(joined.withColumn("len", F.size("list")), "list", ["user_id", "len"])
    return spread.withColumn("score", 1.0 - (F.col("rank") - 1) / F.col("len")).drop("len")


def fresh_content_candidates(users: DataFrame, fresh: DataFrame, n: int = 50, band: int = 1, max_ordinal: int = LAST_ORDINAL) -> DataFrame:
    """Best fresh items of the user's category and district within one price step.

    A user's top n within allowed price steps lies in the top n of each step, so every step keeps
    n items and each (category, district, step) gets its finished list before users join it.
    """
    keys = ["category", "district_name"]
    order = [F.desc(F.round("score", 9)), F.asc("item_id")]
    steps = top_n(fresh, [*keys, "price_ordinal"], order, n, "__s").drop("__s")
    o = F.col("price_ordinal")
    every = F.sequence(F.lit(-1), F.lit(max_ordinal))
    serves = F.when(o < 0, every).otherwise(F.concat(F.array(F.lit(-1)), F.sequence(F.greatest(o - band, F.lit(0)), F.least(o + band, F.lit(max_ordinal)))))
    lists = ranked_lists(steps.withColumn("wanted", F.explode(serves)), [*keys, "wanted"], order, n, "score", "list")
    named = lists.withColumnsRenamed({"category": "pref_category", "district_name": "pref_district", "wanted": "pref_ordinal"})
    return _spread(users.join(named, ["pref_category", "pref_district", "pref_ordinal"]), "list", ["user_id"])


def session_item_to_item(clicks: DataFrame, items: DataFrame, contacts: DataFrame, popular: Column, k: int = 10, depth: int = 15) -> DataFrame:
    """From the first click: same category and district, then city, then category, then global.

    Each layer is one short list per key; layers are concatenated, made distinct in order and cut
    to k, so no pairs are made beyond the answer.
    """
    demand = items.select("item_id", "category", "city_name", "district_name").join(contacts.select("item_id", "contacts_24h"), "item_id", "left")
    demand = demand.withColumn("contacts_24h", F.coalesce("contacts_24h", F.lit(0.0)))
    order = [F.desc("contacts_24h"), F.asc("item_id")]
    meta = items.select("item_id", "category", "city_name", "district_name")
    out = clicks.select("user_id", "item_id").join(meta, "item_id")
    names = []
    for keys in (["category", "district_name"], ["category", "city_name"], ["category"]):
        name = f"l{len(names)}"
        out = join_keys(out, ranked_lists(demand.filter(F.col("category").isNotNull()), keys, order, depth, "contacts_24h", name), keys, "left")
        names.append(name)
    empty = f"array<struct<r:int,item:{items.schema['item_id'].dataType.simpleString()},score:double>>"
    lists = [F.transform(F.coalesce(F.col(n), F.array().cast(empty)), lambda x: x["item"]) for n in names]
    # array_except keeps the order of first appearance and drops repeats and the clicked item.
    picked = F.slice(F.array_except(F.concat(*lists, popular), F.array("item_id")), 1, k)
    return out.select("user_id", F.posexplode(picked).alias("pos", "rec")).select(
        "user_id", F.col("rec").alias("item_id"), (F.col("pos") + 1).alias("rank"))


def cold_session_lists(lists: DataFrame, cold: DataFrame, fallback: Column, k: int = 10) -> DataFrame:
    """For cold users only: the session list where it has ``k`` items, else the first ``k`` of the ``fallback`` array."""
    own = lists.join(cold.select("user_id"), "user_id", "left_semi").filter(F.col("rank") <= k).groupBy("user_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "item_id"))).alias("own"))  # at most k items
    named = cold.select("user_id").distinct().join(own, "user_id", "left")
    full = F.size("own") == k
    picked = F.when(full, F.transform("own", lambda x: x["item_id"])).otherwise(F.slice(fallback, 1, k))
    origin = F.when(full, F.lit("session")).otherwise(F.lit("cold"))
    return named.select("user_id", origin.alias("origin"), F.posexplode(picked).alias("pos", "item_id")).select(
        "user_id", "item_id", (F.col("pos") + 1).alias("rank"), "origin")


def top_array(rows: DataFrame, order: Sequence[Column], k: int, item: str = "item_id") -> Column:
    """The first k items of a table as one array, read as a scalar subquery."""
    best = rows.orderBy(*order).limit(k)
    numbered = best.select(F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order)).alias("r"), F.col(item).alias("i"))
    packed = numbered.agg(F.sort_array(F.collect_list(F.struct("r", "i"))).alias("a"))
    return packed.select(F.transform("a", lambda x: x["i"])).scalar()


# ---- merging ------------------------------------------------------------------------------------

def merge_candidates(
    sources: Mapping[str, DataFrame], repeats: DataFrame, weights: Mapping[str, float] = BLEND, repeat_weight: float = REPEAT_WEIGHT, cap: int = 500
) -> DataFrame:
    """All sources in one wide row per pair: per-user normalized scores, source count, blend, cap.

    Sources are stacked long and dealt once by user; pairs, the users' bounds and their best rows are all
    found there, so nothing is dealt again. A user's rows are the retrievers' lists, which are short, and
    the items it came back to.
    """
    columns = ["user_id", "item_id", "source", "score", "repeat_count"]
    extra = repeats.select("user_id", "item_id", F.lit("repeat").alias("source"), F.lit(None).cast("double").alias("score"), F.col("repeat_count").cast("double").alias("repeat_count"))
    stacked = extra.select(*columns)
    for name, df in sources.items():
        one = df.select("user_id", "item_id", F.lit(name).alias("source"), F.col("score").cast("double").alias("score"), F.lit(0.0).alias("repeat_count"))
        stacked = stacked.unionByName(one.select(*columns))
    is_src = {n: F.col("source") == n for n in sources}
    pairs = stacked.repartition("user_id").groupBy("user_id", "item_id").agg(
        *[F.max(F.when(c, F.col("score"))).alias(f"{n}_score") for n, c in is_src.items()],
        F.max("repeat_count").alias("repeat_count"), F.max(F.when(F.col("source") == "repeat", 1).otherwise(0)).alias("is_repeat"),
        (sum((F.max(c.cast("long")) for c in is_src.values()), F.count_if(F.col("source") == "repeat"))).alias("source_count"))
    user, wide = W.partitionBy("user_id"), pairs
    for n in sources:
        score, lo, hi = F.col(f"{n}_score"), F.min(f"{n}_score").over(user), F.max(f"{n}_score").over(user)
        wide = wide.withColumn(f"{n}_norm", F.coalesce((score - lo) / (hi - lo + 1e-10), F.lit(0.0)))
    kept = ["user_id", "item_id", *[f"{n}_score" for n in sources], *[f"{n}_norm" for n in sources], "repeat_count", "is_repeat", "source_count"]
    blend = sum((F.lit(weights.get(n, 0.0)) * F.col(f"{n}_norm") for n in sources), F.lit(repeat_weight) * F.col("is_repeat"))
    scored = wide.select(*kept, blend.alias("blend_score"))
    return top_n(scored, ["user_id"], [F.desc(F.round("blend_score", 9)), F.asc("item_id")], cap, "cand_rank")


def merge_sources_long(sources: Mapping[str, DataFrame], cap: int = 500) -> DataFrame:
    """Pivoted source scores, capped per user by their sum."""
    stacked = None
    for name, df in sources.items():
        one = df.select("user_id", "item_id", F.lit(name).alias("source"), F.col("score").cast("double").alias("score"))
        stacked = one if stacked is None else stacked.unionByName(one)
    wide = stacked.groupBy("user_id", "item_id").agg(
        *[F.max(F.when(F.col("source") == n, F.col("score"))).alias(f"src_{n}") for n in sources])
    total = sum((F.coalesce(F.col(f"src_{n}"), F.lit(0.0)) for n in sources), F.lit(0.0))
    return top_n(wide.withColumn("total", total), ["user_id"], [F.desc(F.round("total", 9)), F.asc("item_id")], cap)


def drop_purchased(candidates: DataFrame, interactions: DataFrame) -> DataFrame:
    return anti_exists(candidates, interactions.filter("purchased"), ["user_id", "item_id"])


def cold_fill(candidates: DataFrame, users: DataFrame, pool: Column) -> DataFrame:
    """Users without candidates get the bounded pool array."""
    cold = anti_exists(users.select("user_id"), candidates, ["user_id"])
    filled = cold.select("user_id", F.posexplode(pool).alias("pos", "item_id")).select(
        "user_id", "item_id", (F.col("pos") + 1).alias("rank"), F.lit("pool").alias("origin"))
    kept = candidates.select("user_id", "item_id", "rank", F.lit("retrieved").alias("origin"))
    return kept.unionByName(filled)


def modal_profile_fill(profiles: DataFrame, users: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Profiles for all users; those without one get the most frequent value of each column."""
    out = users.select("user_id").join(profiles.select("user_id", *columns), "user_id", "left")
    for c in columns:
        counts = profiles.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
        mode = counts.agg(F.min_by(c, F.struct(-F.col("n"), F.col(c)))).scalar()
        out = out.withColumn(c, F.coalesce(F.col(c), mode))
    return out
