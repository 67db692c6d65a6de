"""Demand journey: how users reach their first contact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarlens.functions.columns import bucketize, flag, is_explicit, is_login, is_pageview, is_positive, pct, ratio, seconds
from bazaarlens.operators.core import join_keys, quantiles, share_of_all, share_within
from bazaarlens.operators.joins import before_first_contact, event_snapshot_join
from bazaarlens.operators.windows import query_refinement_lag


def time_to_first_contact(events: DataFrame, keys: Sequence[str] = ("category",)) -> DataFrame:
    """Days from a user's first pageview to the first explicit contact at or after it."""
    users = events.groupBy(*keys, "user_id").agg(
        F.min(F.when(is_pageview(), F.col("event_ts"))).alias("v"), F.min(F.when(is_explicit(), F.col("event_ts"))).alias("c"))
    lags = users.filter(F.col("c") >= F.col("v")).select(*keys, F.datediff(F.to_date("c"), F.to_date("v")).alias("days"))
    d = F.col("days")
    base = lags.groupBy(*keys).agg(
        F.count("*").alias("users"), F.avg("days").alias("mean_days"), (F.avg(flag(d == 0)) * 100).alias("same_day_pct"),
        (F.avg(flag(d >= 2)) * 100).alias("ge2_pct"), (F.avg(flag(d >= 3)) * 100).alias("ge3_pct"))
    return join_keys(base, quantiles(lags, keys, "days", {"p50": 0.5, "p75": 0.75, "p90": 0.9}, bounded=True), keys)


def listing_age_at_first_contact(events: DataFrame, snapshot: DataFrame) -> DataFrame:
    first = events.filter(is_explicit() & F.col("item_id").isNotNull()).groupBy("user_id", "item_id").agg(F.min("date").alias("date"))
    joined = event_snapshot_join(first, snapshot, "left")
    bucket = bucketize("listing_age_days", [3, 14, 30], ["0-3d fresh", "4-14d", "15-30d", "31d+"], "right", "unknown")
    return share_of_all(joined.groupBy(bucket.alias("age_bucket")).agg(F.count("*").alias("contacts")), "contacts", "pct", bounded=True)


def repeat_views_before_contact(events: DataFrame) -> DataFrame:
    """Pageviews of the very listing before its first contact, over pairs that have any."""
    pair = ["user_id", "item_id"]
    counts = before_first_contact(events.filter(is_pageview() | is_explicit()), pair).filter(is_pageview()).groupBy(*pair).agg(
        F.count("*").alias("n_pv"))
    n = F.col("n_pv")
    return counts.agg(
        F.count("*").alias("pairs"), F.percentile("n_pv", F.lit(0.5)).alias("median_pv"), F.percentile("n_pv", F.lit(0.75)).alias("p75_pv"),
        (F.avg(flag(n >= 2)) * 100).alias("ge2_pct"), (F.avg(flag(n >= 3)) * 100).alias("ge3_pct"))


def pre_contact_effort(events: DataFrame, key: str = "category") -> DataFrame:
    """Medians of contacted listings, sessions, viewing days and refinements before the first contact."""
    keys = [key, "user_id"]
    contacted = events.filter(is_explicit() & F.col("item_id").isNotNull()).groupBy(*keys).agg(
        F.min("event_ts").alias("t0"), F.countDistinct("item_id").alias("contacted"))
    starts = events.groupBy(*keys, "session_id").agg(F.min("event_ts").alias("st"))
    t0 = contacted.select(*keys, "t0")
    sessions = join_keys(starts, t0, keys).groupBy(*keys).agg(F.sum(flag(F.col("st") < F.col("t0"))).alias("sessions_before"))
    views = join_keys(events.filter(is_pageview()), t0, keys).filter(F.col("event_ts") < F.col("t0"))
    days = views.groupBy(*keys).agg(F.countDistinct("date").alias("pv_days"))
    searches = query_refinement_lag(events, (*keys, "session_id"))
    refined = join_keys(searches, t0, keys).filter(F.col("event_ts") < F.col("t0")).groupBy(*keys).agg(
        F.sum("is_refinement").alias("refinements"))
    users = contacted.drop("t0")
    for part in (sessions, days, refined):
        users = join_keys(users, part, keys, "left")
    return users.groupBy(key).agg(
        F.count("*").alias("users"), F.percentile("contacted", F.lit(0.5)).alias("median_contacted"),
        F.avg("contacted").alias("mean_contacted"), F.percentile("sessions_before", F.lit(0.5)).alias("median_sessions_before"),
        (F.avg(flag(F.col("pv_days") >= 2)) * 100).alias("ge2_pv_days_pct"),
        F.percentile("refinements", F.lit(0.5)).alias("median_refinements"))


def lead_profiles(interactions: DataFrame) -> DataFrame:
    prof = interactions.groupBy("category", "user_id").agg(
        F.sum("adview_count").alias("views"), F.sum("lead_count").alias("leads"), F.sum("chat_message_count").alias("messages"),
        F.avg("chat_turn_count").alias("turns"), F.countDistinct("item_id").alias("items")).filter("views > 0")
    v, lead, m, t = (F.col(c) for c in ("views", "leads", "messages", "turns"))
    segment = (
        F.when((F.col("items") >= 15) & (m > 0) & (t <= 1.5), "C_spam_broker")
        .when((v > 50) & (lead == 0) & (m == 0), "B_window_shopper")
        .when((v <= 10) & ((lead >= 2) | (t > 5)), "A_high_intent").otherwise("D_other"))
    return prof.withColumn("segment", segment)


def lead_segments(interactions: DataFrame) -> DataFrame:
    counts = lead_profiles(interactions).groupBy("category", "segment").agg(F.count("*").alias("users"))
    return share_within(counts, ["category"], "users", "pct")


def listing_age_distribution(events: DataFrame, snapshot: DataFrame, cap: float = 60) -> DataFrame:
    """Histogram of listing age at contact, capped at min(60, p99), and the share within two days."""
    joined = event_snapshot_join(events.filter(is_explicit()), snapshot).filter("listing_age_days IS NOT NULL")
    p99 = quantiles(joined, [], "listing_age_days", {"p": 0.99}, bounded=True).scalar()
    bins = joined.groupBy(F.least("listing_age_days", F.lit(float(cap)), p99).alias("age")).agg(
        F.count("*").alias("n"), F.count_if(F.col("listing_age_days") <= 2).alias("n_fresh"))
    every = W.partitionBy(F.lit(1))
    fresh = pct(F.sum("n_fresh").over(every), F.sum("n").over(every))
    return share_of_all(bins, "n", "pct", bounded=True).withColumn("fresh_pct", fresh).drop("n_fresh")


def quality_time_to_contact(events: DataFrame, dim: DataFrame, score: str = "quality_score", max_days: int | None = None) -> DataFrame:
    """Fast / Mid / Slow / NoContact shares and median hours from posting to first contact, by quality.

    Contacts dated before the posting are a class of their own; ``max_days`` leaves out what is
    negative or later, and is off by default.
    """
    first = events.filter(is_explicit()).groupBy("item_id").agg(F.min("event_ts").alias("t0"))
    joined = dim.select("item_id", score, "posted_date").join(first, "item_id", "left")
    hours = (seconds("t0") - seconds("posted_date")) / 3600.0
    rows = joined.withColumn("hours", hours)
    if max_days is not None:
        rows = rows.filter(F.col("hours").isNull() | F.col("hours").between(0, max_days * 24))
    bucket = F.when(F.col("hours").isNull(), "NoContact").when(F.col("hours") < 0, "BeforePosting").when(F.col("hours") < 24, "Fast").when(F.col("hours") <= 168, "Mid").otherwise("Slow")
    counts = share_within(rows.groupBy(score, bucket.alias("speed")).agg(F.count("*").alias("n")), [score], "n", "pct")
    return join_keys(counts, quantiles(rows, [score], "hours", {"median_hours": 0.5}), [score], "left")


def origin_destination_migration(events: DataFrame, dim: DataFrame, place: str = "district_name") -> DataFrame:
    """First viewed place to first contacted place per login user, where they differ."""
    rows = events.filter(is_login()).join(dim.select("item_id", place), "item_id").filter(F.col(place).isNotNull())
    at = F.struct("event_ts", "event_id")
    users = rows.groupBy("user_id").agg(
        F.min_by(place, F.when(is_pageview(), at)).alias("origin"), F.min_by(place, F.when(is_explicit(), at)).alias("destination"))
    moved = users.filter("origin IS NOT NULL AND destination IS NOT NULL AND origin <> destination")
    return share_within(moved.groupBy("origin", "destination").agg(F.count("*").alias("users")), ["origin"], "users", "pct_of_origin")


def positives_per_user(events: DataFrame, keys: Sequence[str] = ("category",)) -> DataFrame:
    users = events.filter(is_positive()).groupBy(*keys, "user_id").agg(F.count("*").alias("n"))
    base = users.groupBy(*keys).agg(F.count("*").alias("users"), F.avg("n").alias("mean"), F.max("n").alias("max"))
    return join_keys(base, quantiles(users.withColumnRenamed("n", "x"), keys, "x", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, bounded=True), keys)


def interaction_summary(interactions: DataFrame, events: DataFrame) -> DataFrame:
    logged = events.filter(is_login()).select("user_id").distinct()
    rows = interactions.join(logged, "user_id", "left_semi")
    return rows.groupBy("category").agg(
        F.sum("adview_count").alias("adviews"), F.sum("lead_count").alias("leads"), F.sum("chat_message_count").alias("messages"),
        F.avg("chat_turn_count").alias("avg_turns"), F.countDistinct("user_id").alias("users"), F.countDistinct("item_id").alias("items"))


def lead_distribution(interactions: DataFrame) -> DataFrame:
    items = interactions.groupBy("item_id").agg(F.sum("lead_count").alias("leads"))
    bins = bucketize("leads", [0, 1, 5, 10, 20], ["0", "1", "2-5", "6-10", "11-20", ">20"], "right")
    return share_of_all(items.groupBy(bins.alias("lead_bin")).agg(F.count("*").alias("items"), F.sum("leads").alias("leads")), "leads", "lead_share_pct", bounded=True)


def top_items_by_lead_share(interactions: DataFrame, n: int = 20) -> DataFrame:
    items = interactions.groupBy("item_id").agg(F.sum("lead_count").alias("leads"), F.sum("adview_count").alias("adviews"))
    shared = share_of_all(items, "leads", "lead_share_pct", bounded=False).withColumn("leads_per_view", ratio("leads", "adviews"))
    return shared.orderBy(F.desc("leads"), F.asc("item_id")).limit(n)


