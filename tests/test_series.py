"""Robust decomposition against plain Python."""

from __future__ import annotations

import datetime
import math

import numpy as np
import pytest

from bazaarlens.operators import lifecycle

DAY = datetime.date(2024, 1, 1)


def plain_loess(y, w, span):
    n, out = len(y), []
    take = min(span, n)
    for i in range(n):
        low = max(0, min(i - take // 2, n - take))
        reach = max(i - low, low + take - 1 - i) + 1
        x = np.arange(low, low + take) - i
        v = np.array(w[low : low + take]) * (1 - np.abs(x / reach) ** 3) ** 3
        z = np.array(y[low : low + take])
        det = v.sum() * (v * x * x).sum() - (v * x).sum() ** 2
        out.append(((v * x * x).sum() * (v * z).sum() - (v * x).sum() * (v * x * z).sum()) / det if det > 1e-9 else (v * z).sum() / v.sum() if v.sum() > 1e-9 else y[i])
    return np.array(out)


def plain(dates, y, span, rounds):
    y = np.array(y, dtype=float)
    dow = np.array([d.weekday() for d in dates])
    w, seasonal = np.ones(len(y)), np.zeros(len(y))
    for number in range(rounds + 1):
        trend = plain_loess(y - seasonal, w, span)
        if number == rounds:
            break
        means = {d: (w * (y - trend))[dow == d].sum() / w[dow == d].sum() for d in set(dow) if w[dow == d].sum() > 1e-9}
        center = sum(means.values()) / len(means)
        seasonal = np.array([means[d] - center if d in means else 0.0 for d in dow])
        off = np.abs(y - trend - seasonal)
        limit = 6 * np.median(off)
        w = np.ones(len(y)) if limit <= 1e-12 else np.where(off >= limit, 0.0, (1 - (off / limit) ** 2) ** 2)
    return trend, seasonal, w


def series(seed, n, outlier=None):
    r = np.random.default_rng(seed)
    dates = [DAY + datetime.timedelta(days=i) for i in range(n)]
    y = [100 + 0.5 * i + 10 * math.sin(2 * math.pi * d.weekday() / 7) + float(r.normal()) for i, d in enumerate(dates)]
    if outlier is not None:
        for i in range(*outlier):
            y[i] += 300
    return dates, y


def test_robust_decomposition_equals_plain_python(spark):
    made = {"plain": series(1, 60), "holiday": series(1, 60, (30, 33)), "short": series(2, 5), "one": series(3, 1), "flat": ([DAY + datetime.timedelta(days=i) for i in range(9)], [4.0] * 9)}
    rows = [(k, d, y) for k, (ds, ys) in made.items() for d, y in zip(ds, ys)] + [("plain", DAY + datetime.timedelta(days=99), None)]
    frame = spark.createDataFrame(rows, "k string, date date, y double")
    got = {(r.k, r.date): r for r in lifecycle.robust_decomposition(frame, ["k"], span=15, rounds=3).collect()}
    assert len(got) == len(rows) - 1
    for k, (ds, ys) in made.items():
        trend, seasonal, w = plain(ds, ys, 15, 3)
        for i, d in enumerate(ds):
            r = got[k, d]
            assert (r.trend, r.seasonal, r.weight) == pytest.approx((trend[i], seasonal[i], w[i]), abs=1e-6)
            assert r.residual == pytest.approx(ys[i] - trend[i] - seasonal[i], abs=1e-6)


def test_a_holiday_does_not_move_the_trend(spark):
    (dates, calm), (_, loud) = series(1, 60), series(1, 60, (30, 33))
    rows = [("calm", d, y) for d, y in zip(dates, calm)] + [("loud", d, y) for d, y in zip(dates, loud)]
    frame = spark.createDataFrame(rows, "k string, date date, y double")
    got = {(r.k, r.date): r for r in lifecycle.robust_decomposition(frame, ["k"]).collect()}
    assert max(abs(got["calm", d].trend - got["loud", d].trend) for d in dates) < 1.5
    assert all(got["loud", dates[i]].weight == 0 for i in range(30, 33))
    assert lifecycle.robust_decomposition(frame.limit(0), ["k"]).count() == 0


def test_sketches_of_days_count_windows_within_three_percent(spark):
    from pyspark.sql import functions as F

    from bazaarlens.operators import sketches

    rows = spark.range(200_000).select(
        (F.col("id") % 3).alias("k"), F.pmod(F.xxhash64("id"), F.lit(40_000)).alias("user_id"), F.date_sub(F.lit("2024-02-01").cast("date"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(40))).cast("int")).alias("date"))
    days = (1, 7, 14, 28)
    exact = {r.k: r for r in sketches.exact_window_uniques(rows, ["k"], "2024-01-31", days).collect()}
    about = {r.k: r for r in sketches.window_uniques(sketches.daily_sketches(rows, ["k"]), ["k"], "2024-01-31", days).collect()}
    assert exact.keys() == about.keys() and len(exact) == 3
    for k in exact:
        for d in days:
            plain = rows.filter((F.col("k") == k) & (F.col("date") <= "2024-01-31") & (F.datediff(F.lit("2024-01-31"), "date") < d)).select("user_id").distinct().count()
            assert exact[k][f"users_{d}d"] == plain > 0
            assert abs(about[k][f"users_{d}d"] - plain) <= 0.03 * plain
