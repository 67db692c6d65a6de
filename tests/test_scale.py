"""The scale primitives give the plain answer on skewed, tied and null data."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarlens.operators import core, joins, post, retrieve, stats, windows
from bazaarlens.sources import star

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds two thirds of the rows; values repeat; some are NULL."""
    rnd = random.Random(5)
    rows = [("hot" if i % 3 else f"k{i % 7}", None if i % 50 == 0 else round(rnd.expovariate(0.1), 1)) for i in range(3000)]
    rows += [(None, 1.0), (None, 3.0)]
    return spark.createDataFrame(rows, "key string, x double").cache()


def test_quantiles_equal_numpy(skewed):
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    frame = skewed.toPandas()
    for bounded in (False, True):
        for row in core.quantiles(skewed, ["key"], "x", probs, bounded).collect():
            values = frame[frame.key.isna() if row.key is None else frame.key == row.key].x.dropna()
            for name, p in probs.items():
                assert row[name] == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_prefix_sums_sliced_equals_one_window(skewed):
    hist = core.histogram(skewed, ["key"], "x")
    measures = {"n": F.col("n"), "v": F.col("n") * F.col("x")}
    key = lambda r: (str(r.key), r.x)
    a = sorted(core.prefix_sums(hist, ["key"], "x", measures).collect(), key=key)
    b = sorted(core.prefix_sums(hist, ["key"], "x", measures, bounded=True).collect(), key=key)
    assert len(a) == len(b) == hist.count()
    for left, right in zip(a, b):
        for c in ("n_before", "n_total", "v_before", "v_total"):
            assert left[c] == pytest.approx(right[c])


def test_global_prefix_sums_have_no_lost_rows(skewed):
    hist = core.histogram(skewed, [], "x")
    out = core.prefix_sums(hist, [], "x", {"n": F.col("n")})
    row = out.orderBy(F.desc("x")).first()
    assert row.n_before + row.n == row.n_total == skewed.filter("x is not null").count()


def test_gini_of_equal_and_single(spark):
    df = spark.createDataFrame([("a", 2), ("a", 2), ("a", 2), ("b", 9), ("z", 0)], "k string, x long")
    got = {r.k: r.gini for r in stats.gini(df, ["k"], "x").collect()}
    assert got == {"a": 0.0, "b": 0.0}


def test_spearman_with_ties_equals_rank_correlation(skewed, spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 9), rnd.randint(0, 4)) for _ in range(400)]
    df = spark.createDataFrame(rows, "x int, y int")
    frame = df.toPandas().rank()
    assert stats.spearman(df, [], "x", "y").first().spearman == pytest.approx(np.corrcoef(frame.x, frame.y)[0, 1])


@pytest.fixture(scope="module")
def clicks(spark):
    rnd = random.Random(9)
    rows, t = [], START
    for i in range(1500):
        t += timedelta(minutes=rnd.choice([1, 2, 5, 40, 400]))
        rows.append((0 if i % 4 else 1 + i % 3, rnd.randint(1, 25), t, i))
    return spark.createDataFrame(rows, "user_id long, item_id long, event_ts timestamp_ntz, event_id long").cache()


def test_lag_in_slices_equals_window(clicks):
    got = core.lag_in_slices(clicks, ["user_id"], "event_ts", "event_id", ["item_id"])
    plain = clicks.withColumn("p", F.lag("item_id").over(W.partitionBy("user_id").orderBy("event_ts", "event_id")))
    assert got.select("event_id", F.col("prev_item_id").alias("p")).exceptAll(plain.select("event_id", "p")).count() == 0


def test_gap_sessions_equal_window(clicks):
    w = W.partitionBy("user_id").orderBy("event_ts", "event_id")
    gap = F.unix_micros(F.col("event_ts").cast("timestamp")) - F.unix_micros(F.lag("event_ts").over(w).cast("timestamp"))
    plain = clicks.withColumn("new", F.when(gap.isNull() | (gap > 1800 * 1000000), 1).otherwise(0))
    plain = plain.withColumn("session_no", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    got = windows.gap_sessionize(clicks)
    assert got.select("event_id", "session_no").exceptAll(plain.select("event_id", "session_no")).count() == 0


@pytest.mark.parametrize("chunk", [7, 4096])
def test_forward_pairs_do_not_depend_on_chunks(clicks, chunk):
    rows = sorted(windows.gap_sessionize(clicks).collect(), key=lambda r: (r.user_id, r.event_ts, r.event_id))
    want: dict = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1:i + 6]:
            if (b.user_id, b.session_no) != (a.user_id, a.session_no) or a.item_id == b.item_id:
                continue
            minutes = (b.event_ts - a.event_ts).total_seconds() / 60
            key = (min(a.item_id, b.item_id), max(a.item_id, b.item_id))
            want[key] = want.get(key, 0.0) + 1 / math.log2(minutes + 2)
    got = {(r.a, r.b): r.s for r in retrieve.forward_pairs(clicks, chunk=chunk).groupBy("a", "b").agg(F.sum("w").alias("s")).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_global_row_number_is_dense_and_ordered(spark, skewed):
    df = spark.range(0, 997).select((F.col("id") * 7919 % 997).alias("user_id"), F.lit(1).alias("rank"))
    got = star.global_row_number(df, ["user_id", "rank"], "ID").orderBy("ID").collect()
    assert [r.ID for r in got] == list(range(1, 998))
    assert [r.user_id for r in got] == sorted(r.user_id for r in got)


def test_embedding_neighbors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    items, users = rng.normal(size=(300, 8)), rng.normal(size=(40, 8))
    items[:150] = items[0] + 0.05 * rng.normal(size=(150, 8))  # one hot cell
    items /= np.linalg.norm(items, axis=1, keepdims=True)
    users /= np.linalg.norm(users, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(items)], "item_id long, embedding array<double>")
    people = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(users)], "user_id long, uvec array<double>")
    seen_pairs = [(u, int(i)) for u in range(40) for i in np.argsort(-(items @ users[u]))[:3]]
    seen = spark.createDataFrame(seen_pairs, "user_id long, item_id long")
    got: dict = {}
    for r in retrieve.item_embedding_cf(people, vectors, seen, k=10, cells=6, probes=1, block=16).collect():
        got.setdefault(r.user_id, {})[r["rank"]] = r.item_id
    for u in range(40):
        ranked = [int(i) for i in np.argsort(-(items @ users[u])) if (u, int(i)) not in set(seen_pairs)]
        assert [got[u][k] for k in range(1, 11)] == ranked[:10]


def test_band_join_equals_filtered_join(spark):
    left = spark.createDataFrame([("a", o) for o in (-1, 0, 3, 5)], "k string, u int")
    right = spark.createDataFrame([("a", o, i) for i, o in enumerate((-1, 0, 1, 2, 4, 6, 9))], "k string, i int, item int")
    got = {(r.u, r.item) for r in joins.ordinal_band_join(left, right, ["k"], "u", "i").collect()}
    want = {(a.u, b.item) for a in left.collect() for b in right.collect() if a.u < 0 or b.i < 0 or abs(a.u - b.i) <= 1}
    assert got == want


def test_diversity_cap_is_greedy_and_keeps_k(spark):
    rows = [(1, i, 1.0 - i / 100) for i in range(12)]
    dim = spark.createDataFrame([(i, None if i == 3 else i % 2, i % 3, 99) for i in range(12)], "item_id long, seller_id int, district_name int, age int")
    ranked = spark.createDataFrame(rows, "user_id long, item_id long, score double")
    got = [r.item_id for r in post.diversity_cap(ranked, dim, k=6, max_seller=2, max_district=2).orderBy("rank").collect()]
    # 0,1,2 pass; 3 has no seller; 4 is the second of seller 0's... then caps bite and the rest is back-filled.
    picked, sellers, places = [], {}, {}
    for i in range(12):
        s, d = (None if i == 3 else i % 2), i % 3
        if len(picked) < 6 and (s is None or sellers.get(s, 0) < 2) and places.get(d, 0) < 2:
            picked.append(i)
            sellers[s] = sellers.get(s, 0) + 1
            places[d] = places.get(d, 0) + 1
    picked += [i for i in range(12) if i not in picked]
    assert got == picked[:6]


@pytest.fixture(scope="module")
def busy_day(spark):
    """One user holds two thirds of the rows, all within a few seconds of one day."""
    rnd = random.Random(1)
    rows = [(7, rnd.randint(1, 9), START + timedelta(microseconds=rnd.randint(0, 5_000_000)), i) for i in range(4000)]
    rows += [(rnd.randint(100, 160), 1, START + timedelta(minutes=rnd.randint(0, 90_000)), 10_000 + i) for i in range(2000)]
    return spark.createDataFrame(rows, "user_id long, item_id long, event_ts timestamp_ntz, event_id long").cache()


def test_a_busy_day_is_spread_over_slices(spark, busy_day):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one partition
    try:
        cut = core.in_slices(busy_day, ["user_id"], "event_ts", "event_id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in cut.groupBy("__slice").count().collect()]
    assert max(sizes) < 2 * 6000 / len(sizes) and cut.filter("user_id = 7").select("__slice").distinct().count() >= 4
    w = W.partitionBy("user_id").orderBy("event_ts", "event_id")
    plain = busy_day.withColumns({"p": F.lag("item_id").over(w), "n": F.row_number().over(w).cast("long")})
    lagged = core.lag_in_slices(cut, ["user_id"], "event_ts", "event_id", ["item_id"])
    counted = core.running_count(lagged, ["user_id"], "event_ts", "event_id", F.lit(1), "n").drop("__slice")
    assert counted.columns == [*busy_day.columns, "prev_item_id", "n"]
    assert counted.select("event_id", F.col("prev_item_id").alias("p"), "n").exceptAll(plain.select("event_id", "p", "n")).count() == 0


def test_band_counts_equal_the_pairs_and_make_none(spark):
    rnd = random.Random(6)
    left = spark.createDataFrame([(rnd.randint(1, 12), rnd.choice("abc"), rnd.choice([None, "x", "y"]), rnd.randint(-1, 6)) for _ in range(200)], "who int, k string, j string, u int")
    right = spark.createDataFrame([(i, rnd.choice("abd"), rnd.choice(["x", "y", None]), rnd.choice([-1, *range(8)])) for i in range(400)], "item int, k string, j string, i int")
    pairs = joins.ordinal_band_join(left, right, ["k", "j"], "u", "i").groupBy("who").agg(F.count("*").alias("n"), F.countDistinct("item").alias("items"))
    counts = joins.ordinal_band_counts(left, right, "who", ["k", "j"], "u", "i")
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, pairs.collect()))


def test_lists_beyond_their_bound_raise_instead_of_growing(spark):
    rows = spark.createDataFrame([(u, r, 100 + r) for u in (1, 2) for r in range(1, 4 + u)], "user_id int, rank int, item_id int")
    assert {r.user_id: r["items"] for r in stats.ordered_list_agg(rows, ["user_id"], "rank", "item_id", "items", most=5).collect()} == {1: [101, 102, 103, 104], 2: [101, 102, 103, 104, 105]}
    with pytest.raises(Exception, match="more than 4 rows for 2"):
        stats.ordered_list_agg(rows, ["user_id"], "rank", "item_id", "items", most=4).collect()
    with pytest.raises(Exception, match="more than 3 rows"):
        stats.string_list_agg(rows.withColumn("t", F.col("rank").cast("string")), ["user_id"], "t", "all", most=3).collect()
    scored = rows.select("user_id", "item_id", F.col("rank").cast("double").alias("score"))
    dim = rows.select("item_id", F.lit("s").alias("seller_id"), F.lit("d").alias("district_name"), F.lit(3).alias("age")).distinct()
    assert post.diversity_cap(scored, dim, k=2, most=5).count() == 4
    with pytest.raises(Exception, match="more than 4 rows"):
        post.diversity_cap(scored, dim, k=2, most=4).collect()
