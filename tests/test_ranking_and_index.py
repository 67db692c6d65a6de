"""The grouped ranker against brute force and the pointwise one; the vector index against the exact search."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarlens.operators import listwise, rank, retrieve, vector_index
from bazaarlens.session import bucketed


def ndcg(labels, order, k):
    gain = lambda ls: sum((2.0**x - 1) / math.log2(i + 2) for i, x in enumerate(ls[:k]))
    return gain([labels[i] for i in order]) / gain(sorted(labels, reverse=True))


def brute_gradients(labels, scores, k):
    """Each pair swapped in turn, one after the other."""
    n = len(labels)
    order = sorted(range(n), key=lambda i: -scores[i])
    g, h = [0.0] * n, [0.0] * n
    for i in range(n):
        for j in range(n):
            if labels[i] > labels[j]:
                swapped = list(order)
                a, b = swapped.index(i), swapped.index(j)
                swapped[a], swapped[b] = swapped[b], swapped[a]
                change = abs(ndcg(labels, order, k) - ndcg(labels, swapped, k))
                miss = 1 / (1 + math.exp(scores[i] - scores[j]))
                g[i] += miss * change
                g[j] -= miss * change
                h[i] += miss * (1 - miss) * change
                h[j] += miss * (1 - miss) * change
    return g, h


def test_pair_gradients_equal_swaps_one_by_one():
    r = np.random.default_rng(3)
    for k in (2, 5, 50):
        labels, scores = r.integers(0, 3, 12).astype(float), r.normal(size=12).round(1)
        g, h = listwise.pair_gradients(labels, scores, k)
        want = brute_gradients(labels.tolist(), scores.tolist(), k)
        assert g.tolist() == pytest.approx(want[0]) and h.tolist() == pytest.approx(want[1])
    assert listwise.pair_gradients(np.zeros(4), np.zeros(4), 3)[0].tolist() == [0.0] * 4


def test_tree_of_one_split_equals_brute_force(spark):
    r = np.random.default_rng(8)
    x, g, h = r.integers(0, 8, (60, 2)).astype(float), r.normal(size=60), r.uniform(0.1, 1, 60)
    rows = spark.createDataFrame([(a.tolist(), float(b), float(c)) for a, b, c in zip(x, g, h)], "x array<double>, g double, h double")
    tree = listwise.fit_tree(rows, depth=1, least_rows=1, l2=0.5, seed=1)
    spread = lambda m: float((h[m] * (g[m] / h[m] - g[m].sum() / h[m].sum()) ** 2).sum()) if m.any() else 0.0
    best = min((spread(x[:, f] <= t) + spread(x[:, f] > t), f, t) for f in (0, 1) for t in np.arange(7) + 0.5)
    left = x[:, best[1]] <= best[2]
    assert (tree.root.feature, tree.root.threshold) == (best[1], best[2])
    assert [tree.values[0], tree.values[1]] == pytest.approx([g[m].sum() / (h[m].sum() + 0.5) for m in (left, ~left)])


def shops(seed, users=90, items=24):
    """Labels follow ``taste`` inside a user's list; ``level`` says how many labels a user has and misleads a pointwise model."""
    r = np.random.default_rng(seed)
    rows = []
    for u in range(users):
        level = r.integers(1, 9)
        taste = r.normal(size=items)
        liked = set(np.argsort(-(taste + 0.3 * r.normal(size=items)))[:level].tolist())
        rows += [(u, i, int(i in liked), float(taste[i] - 0.8 * level), float(level), float(r.normal())) for i in range(items)]
    return rows


def held_out_ndcg(scored):
    lists: dict = {}
    for r in scored.collect():
        lists.setdefault(r.user_id, []).append((-r.score, r.item_id, r.label))
    values = [ndcg([x[2] for x in sorted(v)], range(len(v)), 10) for v in lists.values() if any(x[2] for x in v)]
    return sum(values) / len(values)


def test_listwise_beats_pointwise_on_held_out_users(spark):
    from bazaarlens.sources.star import hash_split

    features = ["taste", "level", "noise"]
    df = spark.createDataFrame(shops(1), "user_id long, item_id long, label int, taste double, level double, noise double")
    df = hash_split(df, "user_id")
    model = listwise.train_listwise(df.drop("is_train"), features, rounds=15, depth=3, step=0.3)
    held = df.filter("is_train = 0")
    grouped = held_out_ndcg(listwise.score_listwise(held, model))
    pointwise = held_out_ndcg(rank.score(held, rank.train_ranker(df.drop("is_train"), features, depth=3, iterations=15, step=0.3), features))
    popular = held_out_ndcg(held.withColumn("score", F.lit(0.0)))
    assert grouped > pointwise and grouped > popular + 0.2
    assert grouped == pytest.approx(max(x for _, x in model.history), abs=1e-6)
    weights = model.importance()
    assert sum(weights.values()) == pytest.approx(1) and weights["taste"] > weights["noise"]


def test_lists_are_cut_and_users_without_pairs_leave(spark):
    rows = [(1, i, int(i == 3), float("nan") if i == 2 else float(i)) for i in range(6)] + [(2, i, 0, 1.0) for i in range(3)] + [(3, i, 1, 1.0) for i in range(3)] + [(4, i, None if i else 1, 1.0) for i in range(2)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, label int, f double")
    got = sorted((r.user_id, r.place, r.label, r.x[0]) for r in listwise.training_lists(df, ["f"], cap=4).collect())
    assert got == [(1, 1, 0.0, 0.0), (1, 2, 0.0, 1.0), (1, 3, 0.0, 0.0), (1, 4, 1.0, 3.0), (4, 1, 1.0, 1.0), (4, 2, 0.0, 1.0)]
    empty = listwise.train_listwise(df.limit(0), ["f"], rounds=3)
    assert not empty.trees and listwise.score_listwise(df, empty).agg(F.sum("score")).first()[0] == 0


def test_lists_are_trained_whole_and_no_list_is_held(spark):
    r = np.random.default_rng(11)
    rows = [(u, i, int(i >= 590 or r.random() < 0.02), float(i % 7)) for u in (1, 2) for i in range(600 + u)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, label int, f double")
    lists = listwise.training_lists(df, ["f"])
    assert lists.count() == 1203 and lists.agg(F.max("place")).first()[0] == 602
    table = lists.withColumn("score", F.round(F.sin(F.col("place") * 3.0), 1)).withColumn("x", F.array(F.col("user_id").cast("double"), F.col("place").cast("double")))
    want = {}
    for u in (1, 2):
        own = table.filter(f"user_id = {u}").orderBy("place").collect()
        g, h = pairwise_gradients(np.array([x.label for x in own]), np.array([x.score for x in own]), 10)
        want |= {tuple(x.x): (a, b) for x, a, b in zip(own, g, h) if b > 0}
    for n in (10_000, 13):
        size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))
        try:
            got = {tuple(x.x): (x.g, x.h) for x in listwise.list_gradients(table, 10).collect()}
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)
        assert any(place > 500 for _, place in got)


def pairwise_gradients(labels, scores, k):
    """All pairs of a list in one matrix."""
    order = np.lexsort((np.arange(len(labels)), -scores))
    place = np.empty(len(labels))
    place[order] = np.arange(len(labels))
    discount, gain = np.where(place < k, 1 / np.log2(place + 2), 0), 2.0**labels - 1
    ideal = (np.sort(gain)[::-1][:k] / np.log2(np.arange(min(k, len(gain))) + 2)).sum()
    up = labels[:, None] > labels[None, :]
    change = np.where(up, np.abs((gain[:, None] - gain[None, :]) * (discount[:, None] - discount[None, :])) / ideal, 0)
    miss = 1 / (1 + np.exp(scores[:, None] - scores[None, :]))
    g, h = miss * change, miss * (1 - miss) * change
    return g.sum(axis=1) - g.sum(axis=0), h.sum(axis=1) + h.sum(axis=0)


def test_training_rounds_read_lists_without_an_exchange(spark):
    lists = bucketed(spark.range(100).select((F.col("id") % 9).alias("user_id"), F.col("id").cast("int").alias("place"), (F.col("id") % 2).cast("double").alias("label"), F.array(F.col("id").cast("double")).alias("x"), F.lit(0.0).alias("score")), "t", "user_id")
    plan = listwise.list_gradients(lists, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and listwise.list_gradients(lists, 5).count() > 0


def test_many_lists_reach_python_in_one_call_and_lists_may_span_batches(spark):
    r = np.random.default_rng(5)
    rows = [(u, p, float(r.integers(0, 3)), round(float(r.normal()), 1), [float(u), float(p)]) for u in range(40) for p in range(1 + u % 13)]
    df = spark.createDataFrame(rows, "user_id long, place int, label double, score double, x array<double>")
    got = listwise.list_gradients(df, 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    want = {}
    for u in range(40):
        own = [x for x in rows if x[0] == u]
        if len({x[2] for x in own}) > 1:
            g, h = brute_gradients([x[2] for x in own], [x[3] for x in own], 4)
            want |= {tuple(x[4]): (a, b) for x, a, b in zip(own, g, h) if b > 1e-15}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (size, "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            found = {tuple(x.x): (x.g, x.h) for x in got.collect()}
            assert found.keys() == want.keys() and all(found[x] == pytest.approx(want[x]) for x in want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_halving_finds_the_winner_of_the_full_grid_with_fewer_trees(spark):
    features = ["taste", "level", "noise"]
    df = spark.createDataFrame(shops(5, users=40, items=12), "user_id long, item_id long, label int, taste double, level double, noise double")
    grid = [{"depth": 1, "step": 0.02}, {"depth": 3, "step": 0.4}, {"depth": 1, "step": 0.005}, {"depth": 2, "step": 0.001}]
    trials = listwise.search_listwise(df, features, grid, rungs=(1, 4), keep=4)
    full = [listwise.train_listwise(df, features, rounds=4, patience=None, **p).history[-1][1] for p in grid]
    assert trials[0].number == int(np.argmax(full)) and trials[0].ndcg == pytest.approx(max(full))
    assert sum(len(t.model.trees) for t in trials) < len(grid) * 4 / 2 and len(trials) == 4


# ---- vectors -------------------------------------------------------------------------------------

def unit_rows(seed, n, d, clusters):
    r = np.random.default_rng(seed)
    x = r.normal(size=(clusters, d))[r.integers(0, clusters, n)] + 0.5 * r.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frames(spark, users, items):
    return (spark.createDataFrame([(f"u{i}", v.tolist()) for i, v in enumerate(users)], "user_id string, uvec array<double>"),
            spark.createDataFrame([(f"i{i:05d}", v.tolist()) for i, v in enumerate(items)], "item_id string, ivec array<double>"))


def tops(df):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r.user_id, {})[r["rank"]] = r.item_id
    return out


def test_exact_search_equals_brute_force_and_the_index_recalls_it(spark):
    users, items = unit_rows(1, 120, 24, 30), unit_rows(1, 3000, 24, 30)
    u, i = frames(spark, users, items)
    scores = users @ items.T
    seen_of = {n: set(np.argsort(-scores[n])[:7].tolist()) if n % 2 else set() for n in range(len(users))}
    seen = spark.createDataFrame([(f"u{n}", f"i{x:05d}") for n, s in seen_of.items() for x in s], "user_id string, item_id string")
    want = {f"u{n}": [f"i{x:05d}" for x in np.argsort(-scores[n], kind="stable") if x not in seen_of[n]][:20] for n in range(len(users))}
    exact = tops(retrieve.nearest_items(u, i, seen, 20, block=100))
    assert {n: [exact[n][r] for r in range(1, 21)] for n in exact} == want
    found = tops(retrieve.nearest_items(u, i, seen, 20, block=100, exact=False, probes=12, coarse_probes=4, keep=100))
    hit = sum(len(set(found[n].values()) & set(want[n])) for n in want) / (20 * len(want))
    assert hit >= 0.9 and all(not set(found[n].values()) & {f"i{x:05d}" for x in seen_of[int(n[1:])]} for n in want)


def test_a_hot_cell_is_cut_into_pieces(spark):
    """A third of the items are one vector; blocks stay small and the result whole."""
    items = unit_rows(2, 900, 8, 5)
    items[::3] = items[0]
    u, i = frames(spark, items[:3], items)
    got = tops(retrieve.nearest_items(u, i, None, 320, block=50))
    assert [got["u0"][r] for r in range(1, 301)] == [f"i{x:05d}" for x in range(0, 900, 3)] and all(len(v) == 320 for v in got.values())


def test_few_and_no_items(spark):
    u, i = frames(spark, unit_rows(3, 4, 5, 2), unit_rows(3, 3, 5, 2))
    assert all(len(v) == 3 for v in tops(retrieve.nearest_items(u, i, None, 10)).values())
    assert retrieve.nearest_items(u, i.limit(0), None, 10).count() == 0
    assert retrieve.nearest_items(u.limit(0), i, None, 10).count() == 0
    assert vector_index.build_index(i.limit(0)) is None


# ---- pointwise rankers ---------------------------------------------------------------------------

NAMES = ["taste", "level", "noise"]
OPTIONS = {"depth": 2, "iterations": 4}


@pytest.fixture(scope="module")
def lists(spark):
    return spark.createDataFrame(shops(3, users=40, items=12), "user_id long, item_id long, label int, taste double, level double, noise double").cache()


def test_importance_finds_the_feature_that_carries_the_label(spark, lists):
    models = rank.train_ranker(lists, NAMES, seeds=(1, 2), **OPTIONS)
    got = {r.feature: r.importance for r in rank.feature_importance(spark, models, NAMES).collect()}
    assert sum(got.values()) == pytest.approx(1) and got["taste"] > 0.5 > got["noise"]


def test_top_k_is_the_order_of_the_mean_score(lists):
    models = rank.train_ranker(lists, NAMES, seeds=(1, 2), **OPTIONS)
    scored = rank.score(lists, models, NAMES).collect()
    each = [{(r.user_id, r.item_id): r.score for r in rank.score(lists, [m], NAMES).collect()} for m in models]
    assert all(r.score == pytest.approx((each[0][r.user_id, r.item_id] + each[1][r.user_id, r.item_id]) / 2) for r in scored)
    want = sorted(((r.user_id, -r.score, r.item_id) for r in scored))
    got = {(r.user_id, r["rank"]): r.item_id for r in rank.score_and_top_k(lists, models, NAMES, 3).collect()}
    for u in {x[0] for x in want}:
        assert [got[u, k] for k in (1, 2, 3)] == [i for v, _, i in want if v == u][:3]


def test_each_part_of_the_market_has_its_own_model(lists, monkeypatch):
    seen = []
    train = rank.train_ranker
    monkeypatch.setattr(rank, "train_ranker", lambda rows, *a, **k: seen.append((rows.count(), train(rows, *a, **k))) or seen[-1][1])
    metro = F.col("item_id") < 5
    got = {(r.user_id, r.item_id): r.score for r in rank.geo_expert_ranker(lists, NAMES, metro, **OPTIONS).collect()}
    assert [n for n, _ in seen] == [40 * 5, 40 * 7] and len(got) == 40 * 12
    for part, (_, models) in zip((lists.filter(metro), lists.filter(~metro)), seen):
        assert all(got[r.user_id, r.item_id] == pytest.approx(r.score) for r in rank.score(part, models, NAMES).collect())


def test_cold_track_ignores_user_features_and_keeps_the_pool(spark, lists, monkeypatch):
    seen = []
    train = rank.train_ranker
    monkeypatch.setattr(rank, "train_ranker", lambda *a, **k: seen.append(train(*a, **k)) or seen[-1])
    pool = lists.groupBy("item_id").agg(F.avg("taste").alias("taste"), F.avg("level").alias("level"), F.avg("noise").alias("noise"), F.sum("label").alias("pop"))
    best = spark.range(1).select(rank.cold_track(lists, NAMES, ["taste"], pool, "pop", size=5, k=3, **OPTIONS).alias("a")).first().a
    assert seen[0][0].featureImportances[0] == 0.0 and sum(seen[0][0].featureImportances) == pytest.approx(1)
    popular = [r.item_id for r in pool.orderBy(F.desc("pop"), "item_id").limit(5).collect()]
    assert len(best) == 3 and set(best) <= set(popular)


def test_user_blocks_never_pass_through_the_driver_and_only_rows_above_the_floor_leave(spark, monkeypatch):
    users, items = unit_rows(3, 60, 8, 4), unit_rows(4, 400, 8, 4)
    u = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(users)], "user_id long, uvec array<double>")
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(items)], "item_id long, ivec array<double>")
    sent = []
    plain = retrieve._meet
    monkeypatch.setattr(retrieve, "_meet", lambda *a: sent.append(plain(*a)) or sent[-1])
    got = retrieve.nearest_items(u, v, None, 5, cells=20, probes=2)
    scores = users @ items.T
    want = {(i, int(j)) for i in range(60) for j in np.argsort(-scores[i])[:5]}
    assert {(r.user_id, r.item_id) for r in got.collect()} == want
    assert all("BroadcastHashJoin [cell" not in x._jdf.queryExecution().executedPlan().toString() for x in sent)
    found = {(r.user_id, r.item_id) for x in sent for r in x.collect()}
    assert sent[1].count() <= 60 * 5 * 2 and want <= found


def test_the_index_ranks_by_vectors_where_they_lie(spark, monkeypatch):
    users, items = unit_rows(5, 30, 8, 4), unit_rows(6, 400, 8, 4)
    u = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(users)], "user_id long, uvec array<double>")
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(items)], "item_id long, ivec array<double>")
    sent = []
    plain = retrieve._meet
    monkeypatch.setattr(retrieve, "_meet", lambda *a: sent.append(plain(*a)) or sent[-1])
    got = retrieve.nearest_items(u, v, None, 5, cells=20, probes=6, exact=False, keep=50).collect()
    assert all(r.score == pytest.approx(float(users[r.user_id] @ items[r.item_id])) for r in got)
    hits = sent[0].collect()  # at most k rows of each cell leave, not the 50 whose vectors are read
    assert len(hits) <= 30 * 6 * 5


def test_a_user_goes_to_a_bundle_of_cells_once_and_leaves_it_with_one_list(spark, monkeypatch):
    """Before, each probed cell took a copy of the user's vector and gave ``k`` rows, and seen items left by a join of all these rows."""
    users, items = unit_rows(5, 30, 8, 4), unit_rows(6, 400, 8, 4)
    u = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(users)], "user_id long, uvec array<double>")
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(items)], "item_id long, ivec array<double>")
    seen_pairs = {(n, int(x)) for n in range(0, 30, 2) for x in np.argsort(-(items @ users[n]))[:4]}
    seen = spark.createDataFrame(sorted(seen_pairs), "user_id long, item_id long")
    met = []
    plain = retrieve._meet
    monkeypatch.setattr(retrieve, "_meet", lambda *a: met.append(plain(*a)) or met[-1])
    got = retrieve.nearest_items(u, v, seen, 5, cells=20, probes=6, exact=False, keep=50).collect()
    hits = met[0].collect()
    assert len(got) == len(hits) == 30 * 5  # all cells are one bundle here
    assert not {(r.user_id, r.item_id) for r in hits} & seen_pairs
    assert "LeftAnti" not in met[0]._jdf.queryExecution().executedPlan().toString()


def test_bundles_in_pieces_and_parts_change_no_result(spark, monkeypatch):
    """A third of the items are one vector: its cell spans bundles, users of a bundle are dealt in parts; all cells probed is brute force."""
    items = unit_rows(2, 900, 8, 5)
    items[::3] = items[0]
    users = unit_rows(7, 40, 8, 5)
    u, i = frames(spark, users, items)
    scores = np.round(users @ items.T, 9)
    ranked = {n: sorted(range(900), key=lambda x: (-scores[n][x], x)) for n in range(40)}
    seen_of = {n: set(ranked[n][: n % 7]) for n in range(40)}
    seen = spark.createDataFrame([(f"u{n}", f"i{x:05d}") for n, s in seen_of.items() for x in s], "user_id string, item_id string")
    plain, parts = retrieve.bundle_cells, []

    def dealt(*a):
        parts.append(plain(*a, dealt=100))
        return parts[-1]

    monkeypatch.setattr(retrieve, "bundle_cells", dealt)
    got = tops(retrieve.nearest_items(u.repartition(3), i, seen, 20, block=50, exact=False, probes=1000, keep=900, bundle=100))
    assert parts[0].parts.max() > 1 and (parts[0].last > parts[0].first).any()
    want = {f"u{n}": [f"i{x:05d}" for x in ranked[n] if x not in seen_of[n]][:20] for n in range(40)}
    assert {n: [got[n][r] for r in range(1, 21)] for n in got} == want


def test_the_exact_search_copies_a_user_to_a_bundle_once(spark, monkeypatch):
    """Before, each cell that could hold something nearer took a copy of the user's vector, and cells are as many as the root of the items."""
    items = unit_rows(12, 900, 8, 900)
    items[::3] = items[0]
    users = unit_rows(13, 90, 8, 90)
    u, i = frames(spark, users, items)
    scores = np.round(users @ items.T, 9)
    ranked = {n: sorted(range(900), key=lambda x: (-scores[n][x], x)) for n in range(90)}
    seen_of = {n: set(ranked[n][: 30 * (n % 3)]) for n in range(90)}
    seen = spark.createDataFrame([(f"u{n}", f"i{x:05d}") for n, s in seen_of.items() for x in s], "user_id string, item_id string")
    monkeypatch.setattr(retrieve, "USER_BLOCK", 10)
    met, dealt = [], []
    plain, parts = retrieve._meet, retrieve.dealt_in_parts
    monkeypatch.setattr(retrieve, "_meet", lambda *a: met.append(a[0]) or plain(*a))
    monkeypatch.setattr(retrieve, "dealt_in_parts", lambda *a: dealt.append(parts(*a)) or dealt[-1])
    got = tops(retrieve.nearest_items(u.repartition(2), i, seen, 20, cells=60, block=20, bundle=50))
    assert {n: [got[n][r] for r in range(1, 21)] for n in got} == {f"u{n}": [f"i{x:05d}" for x in ranked[n] if x not in seen_of[n]][:20] for n in range(90)}
    copies = [[x for r in sent.collect() for x in zip([r.bundle] * len(r.user_ids), r.user_ids)] for sent in met]
    both = copies[0] + copies[1]
    assert len(both) == len(set(both)) <= 90 * len(dealt[1].parts) and len(dealt[1].parts) < 20
    assert len(copies[0]) == 90 and (dealt[1].last > dealt[1].first).any() and dealt[1].parts.max() > 1
