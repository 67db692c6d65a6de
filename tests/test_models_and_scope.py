"""Retrievers, models and samples against brute force or by property, and the scope of the features."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pytest

from bazaarlens.functions import buckets
from bazaarlens.operators import features, funnel, rank, retrieve, sets
from bazaarlens.plans.catalog import QUERIES
from bazaarlens.sources import star
from bazaarlens.sources.adapters import Star

FOLDER = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1, 12)


def events(spark, rows):
    schema = "user_id string, item_id string, event_type string, is_login string, category int, city_name string, event_ts timestamp_ntz, dwell_time_sec double"
    return spark.createDataFrame([(u, i, e, login, c, "x", T0, 40.0) for u, i, e, login, c in rows], schema)


def test_features_leave_out_other_logins_and_categories(spark):
    rows = [("u", "a", "view_phone", "login", 1010), ("g", "a", "view_phone", "non-login", 1010), ("u", "b", "view_phone", "login", 3030), ("u", "a", "pageview", "login", 1010), ("g", "a", "pageview", "non-login", 1010)]
    ev = events(spark, rows)
    pairs = lambda df: {(r.user_id, r.item_id) for r in df.collect()}
    assert pairs(features.user_item_positive(ev)) == {("u", "a")} == pairs(features.dwell_pairs(ev))
    assert {r.user_id: r["items"] for r in features.user_sequences(ev).collect()} == {"u": ["a"]}
    assert ("g", "a") in pairs(features.user_item_positive(ev, login_only=False)) and ("u", "b") in pairs(features.user_item_positive(ev, categories=None))


def test_interleave_fills_the_pool_from_one_large_group(spark):
    items = spark.createDataFrame([(i, "a", float(i)) for i in range(60)] + [(100 + i, "b", float(i)) for i in range(5)], "item_id long, g string, s double")
    slots = spark.createDataFrame([("a", 55, 1), ("b", 5, 2)], "g string, slots int, volume_order int")
    got = sets.interleave_by_category(items, slots, "g", "s", 60).collect()
    assert len(got) == 60 and sum(r.item_id < 100 for r in got) == 55


def test_label_codes_follow_the_alphabet(spark):
    df = spark.createDataFrame([("b", 2), ("a", 10), (None, 2), ("b", None)], "x string, y int")
    got = {(r.x, r.y): (r.cx, r.cy) for r in buckets.label_encode_all(df, {"x": "cx", "y": "cy"}).collect()}
    assert got == {("b", 2): (1, 1), ("a", 10): (0, 0), (None, 2): (2, 1), ("b", None): (1, 2)}


def test_als_candidates_equal_brute_force_with_text_ids(spark):
    rng = np.random.default_rng(3)
    rows = {(int(u), int(i)) for u, i in zip(rng.integers(0, 30, 400), rng.integers(0, 80, 400))}
    ratings = spark.createDataFrame([(f"user-{u}", f"item-{i}", float(1 + (u * i) % 5)) for u, i in sorted(rows)], "user_id string, item_id string, weight double")
    factors = retrieve.fit_als(ratings, rank=6, iterations=3)
    targets = spark.createDataFrame([("user-3",), ("user-7",), ("nobody",)], "user_id string")
    got: dict = {}
    for r in retrieve.als_candidates(factors, targets, 10).collect():
        got.setdefault(r.user_id, {})[r["rank"]] = (r.item_id, r.score)
    users, items = ({r[0]: np.array(r[1]) for r in df.collect()} for df in factors)
    assert set(got) == {"user-3", "user-7"}
    for u, lists in got.items():
        want = sorted(((float(users[u] @ v), i) for i, v in items.items()), reverse=True)[:10]
        assert [lists[k][1] for k in range(1, 11)] == pytest.approx([s for s, _ in want], abs=1e-6)


def test_cells_spare_most_pairs(spark, monkeypatch):
    """On clustered vectors the two passes score few of all user and item pairs."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 16)) * 4
    items = (centers[rng.integers(0, 40, 1600)] + 0.1 * rng.normal(size=(1600, 16)))
    users = items[:100] / np.linalg.norm(items[:100], axis=1, keepdims=True)
    scored = spark.sparkContext.accumulator(0)
    plain = retrieve._best_of_blocks

    def counting(k):
        run = plain(k)

        def counted(batches):
            for b in batches:
                scored.add(int(sum(len(u) * len(i) for u, i in zip(b.user_ids, b.item_ids))))
                yield from run(iter([b]))

        return counted

    monkeypatch.setattr(retrieve, "_best_of_blocks", counting)
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(items)], "item_id long, embedding array<double>")
    people = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(users)], "user_id long, uvec array<double>")
    got = retrieve.item_embedding_cf(people, vectors, spark.createDataFrame([], "user_id long, item_id long"), k=10, probes=1)
    assert got.count() == 1000 and scored.value < 0.5 * 2 * 1600 * 100


def test_samples_keep_about_their_share(spark):
    ev = Star(spark, "/root/testdata/sf0.01").ev
    n = ev.count()
    for part, share in ((star.block_sample(ev, 20), 0.2), (star.row_sample(ev, 0.2), 0.2)):
        assert abs(part.count() - share * n) < 4 * (n * share * (1 - share)) ** 0.5
        assert part.count() == part.count()
    kept = star.hash_sample(ev, "session_id", 0.3)
    assert kept.join(ev.select("event_id"), "event_id").count() == ev.join(kept.select("session_id").distinct(), "session_id", "left_semi").count()


def test_logistic_contributions_reach_the_optimum(spark):
    """At the optimum the class-balanced residuals are orthogonal to the features."""
    ev = Star(spark, "/root/testdata/sf0.01").ev
    got = {r.feature: r for r in funnel.logistic_contributions(ev, max_iter=200).collect()}
    names = ["has_ad_view", "has_adview", "has_other_surface", "has_consider"]
    rows = funnel.session_item_flags(ev).filter("has_pageview = 1").select(*names, "has_explicit").toPandas()
    x, y = rows[names].to_numpy(dtype=float), rows["has_explicit"].to_numpy(dtype=float)
    sd = x.std(axis=0, ddof=1)
    z = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    p = 1 / (1 + np.exp(-(z @ np.array([got[n].std_coef for n in names]) + got[names[0]].intercept)))
    assert np.abs(z.T @ (w * (y - p)) / len(y)).max() < 1e-3
    assert sum(r.weight for r in got.values()) == pytest.approx(1)


def test_clusters_are_stable_and_cover_every_row(spark):
    first, again = (sorted(map(tuple, QUERIES["behavioral_clusters"](spark, FOLDER).collect()), key=str) for _ in range(2))
    assert first == again and len(first) > 0


@pytest.mark.parametrize("name", ["train_ranker", "geo_expert_ranker"])
def test_rankers_give_the_same_rows_again(spark, name):
    rounded = lambda df: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)
    first = rounded(QUERIES[name](spark, FOLDER))
    assert first and first == rounded(QUERIES[name](spark, FOLDER))


def test_ranker_beats_a_constant_on_held_out_users(spark):
    """A feature that carries the label is found, and only held-out users are measured."""
    rows = [(u, i, int(i % 7 == 0), float(i % 7 == 0) + ((u * 31 + i * 17) % 10) / 25, ((u + i) % 5) / 5) for u in range(60) for i in range(21)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, label int, good double, noise double")
    got = rank.tune_ranker(df, ["good", "noise"], [{}]).collect()
    held = star.hash_split(df.select("user_id").distinct(), "user_id").filter("is_train = 0").count()
    assert got[0].users == held and got[0].ndcg > 0.9
