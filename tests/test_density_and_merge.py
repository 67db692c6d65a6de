"""Density clusters, the merge of the retrievers, cold lists and the scorecard against plain Python."""

from __future__ import annotations

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarlens.operators import evaluate, retrieve, segment
from bazaarlens.operators.components import components
from bazaarlens.plans import retrieve as retrieve_plans
from bazaarlens.plans.catalog import QUERIES
from bazaarlens.sources.adapters import Star

FOLDER = "/root/testdata/sf0.001"


def brute_density(rows, side, least):
    """rows: (id, group, x, y). The same rule, square by square."""
    ok = lambda v: v is not None and math.isfinite(v)
    home = {i: (g, math.floor(x / side), math.floor(y / side)) for i, g, x, y in rows if ok(x) and ok(y)}
    n = collections.Counter(home.values())
    around = lambda s: [(s[0], s[1] + a, s[2] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    dense = {s for s in n if sum(n[t] for t in around(s)) >= least}
    of: dict = {}
    for s in sorted(dense):
        todo = [s] if s not in of else []
        while todo:
            t = todo.pop()
            if t not in of:
                of[t] = s
                todo += [u for u in around(t) if u in dense]
    for s in n:
        near = [t for t in around(s) if t in dense]
        if s not in dense and near:
            of[s] = of[min(near, key=lambda t: (-n[t], t))]
    sizes = collections.Counter()
    for s, c in of.items():
        sizes[c] += n[s]
    number = {c: sum(1 for d in sizes if d[0] == c[0] and (-sizes[d], d) < (-sizes[c], c)) for c in sizes}
    return {i: number[of[home[i]]] if i in home and home[i] in of else -1 for i, *_ in rows}


@pytest.mark.parametrize("hot", [False, True])
def test_density_clusters_equal_brute_force(spark, hot):
    r = np.random.default_rng(4)
    rows = []
    for i in range(2000):
        c = [(0, 0), (3, 3), (3.4, -2), (-4, 1)][i % 4]
        x, y = np.array(c) + r.normal(size=2) * (0.4 if i % 5 else 2.5)
        rows.append((i, "ab"[i % 3 == 0], float(x), float(y)))
    if hot:  # one square holds a third of the rows
        rows += [(3000 + i, "a", 0.1, 0.1) for i in range(1000)]
    rows += [(9001, "a", None, 1.0), (9002, "a", float("nan"), 1.0), (9003, None, 50.0, 50.0), (9004, "b", float("inf"), 0.0)] + [(9100 + i, None, 1.0 + i / 100, 1.0) for i in range(20)]
    points = spark.createDataFrame(rows, "id long, g string, x double, y double")
    got = segment.density_clusters(points, ["g"], side=0.35, min_points=9)
    assert got.columns == ["id", "g", "x", "y", "cluster"]
    key = lambda rows: [(i, str(g), x, y) for i, g, x, y in rows]
    want = brute_density(key(rows), 0.35, 9)
    assert {r.id: r.cluster for r in got.collect()} == want
    assert len(set(want.values())) > 4 and -1 in want.values()


def test_density_clusters_of_no_rows_and_of_noise(spark):
    points = spark.createDataFrame([(1, 1, 0.0, 0.0), (2, 1, 9.0, 9.0)], "id long, category int, x double, y double")
    assert [r.cluster for r in segment.density_clusters(points).collect()] == [-1, -1]
    assert segment.density_clusters(points.limit(0)).count() == 0
    features = points.select("id", "category", F.col("x").alias("f"), F.col("y").alias("g"))
    assert segment.projected(features.limit(0), "id", ["f", "g"], [1]).count() == 0


def test_components_of_text_ids(spark):
    links = spark.createDataFrame([("b", "c"), ("c", "d"), ("x", "y"), ("d", "a"), ("q", "q")], "a string, b string")
    assert {r.id: r.component for r in components(links).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


def test_merge_of_the_retrievers_equals_brute_force(spark):
    s = Star(spark, FOLDER)
    sources = retrieve_plans.retrieved(s, 30)
    lists = {n: [tuple(r) for r in df.collect()] for n, df in sources.items()}
    assert all(lists.values())
    norm: dict = collections.defaultdict(dict)
    for name, rows in lists.items():
        by_user = collections.defaultdict(list)
        for u, i, x in rows:
            by_user[u].append(x)
        for u, i, x in rows:
            lo, hi = min(by_user[u]), max(by_user[u])
            norm[u, i][name] = (x - lo) / (hi - lo + 1e-10)
    got = retrieve_plans.merged_for_test_users(s, sources, cap=100_000).collect()
    seen = {(r.user_id, r.item_id): r for r in got}
    repeats = {k for k, r in seen.items() if r.is_repeat}
    assert set(norm) | repeats == set(seen)
    for k, r in seen.items():
        assert r.blend_score == pytest.approx(sum(retrieve.BLEND[n] * x for n, x in norm[k].items()) + 0.1 * r.is_repeat, abs=1e-9)
        assert r.source_count == len(norm[k]) + r.is_repeat
    only_factors = [k for k in seen if set(norm[k]) == {"als"}]
    only_vectors = [k for k in seen if set(norm[k]) == {"itemcf"}]
    assert only_factors and only_vectors


def test_cold_lists_are_whole_or_replaced(spark):
    lists = spark.createDataFrame([(1, 10 + r, r) for r in range(1, 4)] + [(2, 20, 1)] + [(9, 30 + r, r) for r in range(1, 4)], "user_id long, item_id long, rank int")
    cold = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    got = retrieve.cold_session_lists(lists, cold, F.array(*[F.lit(x).cast("long") for x in (7, 8, 9, 6)]), k=3).collect()
    of = lambda u: [(r.item_id, r.origin) for r in sorted(got, key=lambda r: r["rank"]) if r.user_id == u]
    assert of(1) == [(11, "session"), (12, "session"), (13, "session")] and of(2) == of(3) == [(7, "cold"), (8, "cold"), (9, "cold")] and not of(9)


def test_scorecard_counts_items_outside_the_pool_and_sellers_without_name(spark):
    dim = spark.createDataFrame([(1, "a", 5, 3), (2, "a", 5, 30), (3, "b", 6, 2), (4, None, 6, 1)], "item_id long, seller_id string, category int, age int")
    ranked = spark.createDataFrame([(u, i, r) for u, i, r in [(1, 1, 1), (1, 3, 2), (2, 1, 1), (2, 99, 2), (3, 4, 11)]], "user_id long, item_id long, rank int")
    got = {r.metric: r.value for r in evaluate.health_scorecard(ranked, dim).collect()}
    assert got["freshness_at_10"] == pytest.approx(75.0) and got["item_coverage"] == pytest.approx(75.0) and got["seller_coverage"] == pytest.approx(100.0)
    assert got["item_hhi"] == pytest.approx(10000 * (4 + 1 + 1 + 1) / 25)


@pytest.mark.parametrize("name", ["density_clusters", "segment_bridge_clusters", "user_positive_rate_clusters", "session_funnel_clusters"])
def test_cluster_reports_cover_their_rows(spark, name):
    rows = QUERIES[name](spark, FOLDER).collect()
    assert rows and all(r.cluster >= -1 for r in rows)
    if name == "density_clusters":
        s = Star(spark, FOLDER)
        assert sum(r["size"] for r in rows) == segment.user_intent_features(s.ev, s.dim).filter(F.col("category").isin([1010, 1020, 1030, 1040, 1050])).count()
