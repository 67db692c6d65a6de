"""Recommender feature tables. Everything used for labels takes a ``cutoff`` and an excluded window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.buckets import AREA_EDGES, exclude_window, label_encode_all
from bazaarlens.functions.columns import (
    argmax_label, bucketize, cosine, decay, flag, is_explicit, is_login, is_pageview, is_positive, ratio, seconds, unit, weighted,
)
from bazaarlens.operators.core import join_keys, lag_in_slices, quantiles, top_n
from bazaarlens.operators.quality import price_log
from bazaarlens.operators.stats import entropy, mode_value
from bazaarlens.operators.windows import segment_zscore
from bazaarlens.schemas import CATEGORIES
from bazaarlens.session import bucketed, durable

# Event weights in use, renewal days and age multipliers by category.
DECAY_WEIGHTS = {"view_phone": 10.0, "contact_chat": 9.0, "contact_zalo": 9.0, "contact_sms": 8.0, "other_interaction": 2.5}
RENEWAL_DAYS = [15, 16, 30, 31]
ROOM_CATEGORY = 1050
ROOM_AGE = ([15, 30, 60], [1.00, 1.05, 1.08, 1.10])
OTHER_AGE = ([2, 7, 14, 29], [1.20, 1.10, 1.03, 1.00, 0.92])
CHANNELS = {"view_phone": "view_phone", "chat": "contact_chat", "zalo": "contact_zalo", "sms": "contact_sms"}


def before(df: DataFrame, cutoff: str | None, ts: str = "event_ts", holiday: tuple[str, str] | None = None) -> DataFrame:
    """Rows strictly before the cutoff with the holiday removed: the leak-free twin of a table."""
    out = df if cutoff is None else df.filter(F.col(ts) < F.lit(cutoff).cast("timestamp_ntz"))
    return out if holiday is None else exclude_window(out, ts, *holiday)


def in_scope(events: DataFrame, login_only: bool = True, categories: Sequence[int] | None = CATEGORIES) -> DataFrame:
    """Events of login users in the modelled categories: other ids change with every session."""
    out = events.filter(is_login()) if login_only else events
    return out if categories is None else out.filter(F.col("category").isin(list(categories)))


def user_item_positive(
    events: DataFrame, cutoff: str | None = None, holiday: tuple[str, str] | None = None, login_only: bool = True, categories: Sequence[int] | None = CATEGORIES
) -> DataFrame:
    rows = before(in_scope(events, login_only, categories).filter(is_positive()), cutoff, holiday=holiday)
    t = F.col("event_type")
    return rows.groupBy("user_id", "item_id").agg(
        F.count("*").alias("pos_count"), *[F.count_if(t == e).alias(f"n_{n}") for n, e in CHANNELS.items()],
        F.count_if(t == "other_interaction").alias("n_other"), F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts"),
        F.max("category").alias("category"), F.max("city_name").alias("city_name"))


def user_item_weighted(events: DataFrame, weights: Mapping[str, float], default: float = 0.0) -> DataFrame:
    """All login events of a pair with a weighted score."""
    return events.filter(is_login()).groupBy("user_id", "item_id").agg(
        F.sum(weighted("event_type", weights, default)).alias("weight"), F.count("*").alias("events"), F.max("event_ts").alias("last_ts"))


def user_sequences(events: DataFrame, n: int = 50, login_only: bool = True, categories: Sequence[int] | None = CATEGORIES) -> DataFrame:
    """Newest ``n`` items of each user as one array, oldest first."""
    last = in_scope(events, login_only, categories).groupBy("user_id", "item_id").agg(F.max("event_ts").alias("last_ts"))
    kept = top_n(last, ["user_id"], [F.desc("last_ts"), F.asc("item_id")], n)
    packed = F.sort_array(F.collect_list(F.struct((-F.col("rank")).alias("r"), "item_id")))
    return kept.groupBy("user_id").agg(F.transform(packed, lambda p: p["item_id"]).alias("items"), F.count("*").alias("length"))


def user_item_interactions(interactions: DataFrame, cutoff: str | None = None) -> DataFrame:
    rows = interactions if cutoff is None else interactions.filter(F.col("date") < F.lit(cutoff).cast("date"))
    return rows.groupBy("user_id", "item_id").agg(
        F.sum("adview_count").alias("adviews"), F.sum("lead_count").alias("leads"), F.sum("chat_message_count").alias("messages"),
        F.sum("chat_turn_count").alias("turns"), F.max(flag(F.col("purchased"))).alias("ever_purchased"), F.countDistinct("date").alias("active_days"))


def item_quality_stats(events: DataFrame, rsd: float | None = 0.01) -> DataFrame:
    """Per item events, positives, pageviews, users, sessions, dwell, CVR; users approximate unless
    ``rsd`` is None."""
    users = (lambda c: F.countDistinct(c)) if rsd is None else (lambda c: F.approx_count_distinct(c, rsd))
    return events.groupBy("item_id").agg(
        F.count("*").alias("total_events"), F.count_if(is_positive()).alias("pos_events"), F.count_if(is_pageview()).alias("pageviews"),
        users("user_id").alias("unique_users"), users("session_id").alias("unique_sessions"), F.avg("dwell_time_sec").alias("avg_dwell"),
        ratio(F.count_if(is_positive()), F.count("*")).alias("item_cvr"))


def popularity_windows(events: DataFrame, as_of: str, days: Sequence[int] = (1, 7, 14, 28)) -> DataFrame:
    """Events and positives of every window in one scan; both ends of a window are included."""
    end = F.lit(as_of).cast("date")
    longest = max(days)
    rows = events.filter((F.col("date") <= end) & (F.col("date") >= F.date_sub(end, longest)))
    aggs = []
    for d in days:
        inside = F.col("date") >= F.date_sub(end, d)
        aggs += [F.count_if(inside).alias(f"events_{d}d"), F.count_if(inside & is_positive()).alias(f"pos_{d}d")]
    return rows.groupBy("item_id", "category").agg(*aggs)


def user_profile(pairs: DataFrame, as_of: str) -> DataFrame:
    """Preferred category and city by positive events, totals, recency and span."""
    end = F.lit(as_of).cast("date")
    base = pairs.groupBy("user_id").agg(
        F.sum("pos_count").alias("total_pos"), F.count("*").alias("unique_items"),
        F.greatest(F.datediff(end, F.to_date(F.max("last_ts"))), F.lit(0)).alias("days_since_last"),
        (F.datediff(F.to_date(F.max("last_ts")), F.to_date(F.min("first_ts"))) + 1).alias("active_span_days"))
    out = base
    for column, name in (("category", "pref_category"), ("city_name", "pref_city")):
        sums = pairs.filter(F.col(column).isNotNull()).groupBy("user_id", column).agg(F.sum("pos_count").alias("c"))
        out = join_keys(out, sums.groupBy("user_id").agg(F.min_by(column, F.struct(-F.col("c"), F.col(column))).alias(name)), ["user_id"], "left")
    return out


def user_preferences_ext(pairs: DataFrame, dim: DataFrame) -> DataFrame:
    """Modal price, ad type, district and seller type, median size, channel mix."""
    cats = ["price_bucket", "ad_type", "district_name", "seller_type"]
    joined = pairs.select("user_id", "item_id").join(dim.select("item_id", *cats, "bedrooms", "area_sqm"), "item_id", "left")
    sums = pairs.groupBy("user_id").agg(*[F.sum(f"n_{c}").alias(f"s_{c}") for c in CHANNELS])
    total = F.greatest(sum((F.col(f"s_{c}") for c in CHANNELS), F.lit(0)), F.lit(1))
    out = sums.select("user_id", argmax_label([(c, F.col(f"s_{c}")) for c in CHANNELS], next(iter(CHANNELS))).alias("pref_channel"),
                      *[ratio(f"s_{c}", total).alias(f"{c}_ratio") for c in CHANNELS])
    for c in cats:
        out = join_keys(out, mode_value(joined, ["user_id"], c, f"pref_{c}", "__n").drop("__n"), ["user_id"], "left")
    for c in ("bedrooms", "area_sqm"):
        out = join_keys(out, quantiles(joined, ["user_id"], c, {f"pref_{c}": 0.5}, bounded=True), ["user_id"], "left")
    return out


def first_click(events: DataFrame) -> DataFrame:
    row = F.struct("item_id", "category", "city_name", "event_ts")
    return events.filter(F.col("item_id").isNotNull()).groupBy("user_id").agg(
        F.min_by(row, F.struct("event_ts", "event_id")).alias("f")).select("user_id", "f.*")


def user_behavior(events: DataFrame, dim: DataFrame) -> DataFrame:
    joined = events.filter(is_login()).join(dim.select("item_id", "district_name"), "item_id")
    hour = F.hour("event_ts")
    base = joined.groupBy("user_id").agg(
        F.countDistinct("session_id").alias("n_sessions"), F.countDistinct("district_name").alias("n_districts"),
        F.avg(flag((hour >= 22) | (hour < 6))).alias("pct_night"),
        F.avg(F.when(is_pageview() & F.col("dwell_time_sec").between(1, 3600), F.col("dwell_time_sec"))).alias("avg_dwell"))
    places = joined.filter("district_name IS NOT NULL").groupBy("user_id", "district_name").agg(F.count("*").alias("c"))
    spread = entropy(places, ["user_id"], "c").select("user_id", F.col("entropy").alias("district_entropy"))
    return base.join(spread, "user_id", "left").fillna(0.0, ["district_entropy"])


def dwell_pairs(
    events: DataFrame, cutoff: str | None = None, consider: float = 30, login_only: bool = True, categories: Sequence[int] | None = CATEGORIES
) -> DataFrame:
    rows = before(in_scope(events, login_only, categories).filter(is_pageview()), cutoff)
    return rows.groupBy("user_id", "item_id").agg(
        F.count("*").alias("pageviews"), F.max("dwell_time_sec").alias("max_dwell"), F.avg("dwell_time_sec").alias("avg_dwell"),
        F.max(flag(F.col("dwell_time_sec") > consider)).alias("considered"))


def snapshot_features(snapshot: DataFrame, as_of: str) -> DataFrame:
    """Latest non-null values up to the day, their logs and rate, share of days with a contact."""
    rows = snapshot.filter(F.col("date") <= F.lit(as_of).cast("date"))
    at = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date")))
    latest = rows.groupBy("item_id").agg(
        F.coalesce(at("views_24h"), F.lit(0.0)).alias("views_24h"), F.coalesce(at("contacts_24h"), F.lit(0.0)).alias("contacts_24h"),
        at("listing_age_days").alias("listing_age"), F.avg(flag(F.col("contacts_24h") > 0)).alias("pct_days_contact"))
    return latest.withColumns({
        "views_log": F.log1p("views_24h"), "contacts_log": F.log1p("contacts_24h"), "contact_rate": F.col("contacts_24h") / (F.col("views_24h") + 1.0)})


def age_boost(age: str = "days_since_posted", category: str = "category") -> Column:
    room = bucketize(age, *ROOM_AGE, closed="left")
    other = bucketize(age, *OTHER_AGE, closed="right")
    return F.when(F.col(category) == ROOM_CATEGORY, room).otherwise(other)


def item_features(dim: DataFrame, quality: DataFrame, popularity: DataFrame, snap: DataFrame, as_of: str) -> DataFrame:
    """Listing attributes, encodings, popularity, velocities and snapshot signal; one row per item."""
    age = F.greatest(F.datediff(F.lit(as_of).cast("date"), "posted_date"), F.lit(0))
    base = dim.withColumns({
        "days_since_posted": age, "has_project": flag(F.col("project_id").isNotNull()),
        "area_bucket": F.coalesce(bucketize(F.greatest("area_sqm", F.lit(0.0)), AREA_EDGES, list(range(len(AREA_EDGES) + 1))), F.lit(0)),
        "area_log": F.log1p(F.coalesce("area_sqm", F.lit(0.0))), "images_log": F.log1p(F.coalesce("images_count", F.lit(0.0))),
        "bedrooms_filled": F.coalesce("bedrooms", F.lit(-1.0))})
    base = base.withColumns({"is_renewal_week": flag(F.col("days_since_posted").isin(RENEWAL_DAYS)), "age_boost": age_boost()})
    base = label_encode_all(base, {
        "category": "cat_enc", "ad_type": "adtype_enc", "seller_type": "seller_enc", "price_bucket": "price_enc", "city_name": "city_enc", "district_name": "district_enc"})
    pop = popularity.groupBy("item_id").agg(*[F.sum(c).alias(c) for c in popularity.columns if c.startswith(("events_", "pos_"))])
    joined = base.join(quality, "item_id", "left").join(pop, "item_id", "left").join(
        snap.select("item_id", "views_log", "contacts_log", "contact_rate"), "item_id", "left")
    joined = joined.fillna(0, ["total_events", "pos_events", "pageviews", "unique_users", "avg_dwell", "item_cvr", "views_log", "contacts_log",
                               "contact_rate", *[c for c in pop.columns if c != "item_id"]])
    c = F.col
    joined = joined.withColumns({
        "total_events_log": F.log1p("total_events"), "unique_users_log": F.log1p("unique_users"),
        "item_contact_rate": c("pos_events") / F.greatest(c("pageviews"), F.lit(1)),
        "item_repeat_share": F.greatest(F.lit(0.0), 1.0 - c("unique_users") / F.greatest(c("total_events"), F.lit(1))),
        "trend_pos_log": F.log1p("pos_28d"), "trend_cvr": c("pos_28d") / F.greatest(c("events_28d"), F.lit(1)),
        "item_velocity_log": F.log1p(c("pos_28d") / (c("total_events") + 1)),
        "velocity_7d": c("pos_7d") / (c("pos_28d") + 1), "velocity_14d": c("pos_14d") / (c("pos_28d") + 1)})
    return joined.withColumn("velocity_accel", c("velocity_7d") - c("velocity_14d"))


def user_features(profile: DataFrame, pairs: DataFrame, behavior: DataFrame) -> DataFrame:
    explicit = sum((F.col(f"n_{c}") for c in CHANNELS), F.lit(0))
    rates = pairs.groupBy("user_id").agg(ratio(F.sum(explicit), F.greatest(F.sum("pos_count"), F.lit(1))).alias("explicit_cvr"))
    joined = profile.join(rates, "user_id", "left").join(behavior, "user_id", "left")
    joined = joined.fillna(0, ["explicit_cvr", "n_sessions", "n_districts", "pct_night", "avg_dwell", "district_entropy"])
    return joined.fillna(999, ["days_since_last"]).fillna(1, ["active_span_days"]).withColumns({
        "total_pos_log": F.log1p("total_pos"), "unique_items_log": F.log1p("unique_items"),
        "avg_pos_per_item": ratio("total_pos", F.greatest("unique_items", F.lit(1))), "n_sessions_log": F.log1p("n_sessions")})


def pair_positive_features(pairs: DataFrame, as_of: str) -> DataFrame:
    c = F.col
    direct = c("n_chat") + c("n_zalo") + c("n_sms")
    intent = 3 * direct + 2 * c("n_view_phone") + c("n_other")
    explicit = direct + c("n_view_phone")
    age = F.greatest(F.floor((seconds(F.lit(as_of).cast("timestamp_ntz")) - seconds("last_ts")) / 86400.0), F.lit(0))
    return pairs.select(
        "user_id", "item_id", age.alias("days_since_ui"), F.log1p("pos_count").alias("pos_count_log"), "n_view_phone", "n_chat", "n_zalo",
        "n_sms", "n_other", F.log1p(intent).alias("intent_score_log"), F.log1p(explicit).alias("explicit_contact_log"),
        ratio(intent, F.greatest("pos_count", F.lit(1))).alias("intent_ratio"), flag(F.weekday("last_ts") >= 5).alias("is_weekend"))


def history_decay(
    events: DataFrame, as_of: str, weights: Mapping[str, float] = DECAY_WEIGHTS, tau: float = 21.0, kind: str = "exp", only_before: bool = True
) -> DataFrame:
    """Decayed and plain weight sums per pair."""
    rows = before(events, as_of if only_before else None)
    age = F.greatest(F.datediff(F.lit(as_of).cast("date"), F.to_date("event_ts")), F.lit(0))
    w = weighted("event_type", weights, 1.0)
    return rows.groupBy("user_id", "item_id").agg(F.sum(w * decay(age, tau, kind)).alias("decay_score"), F.sum(w).alias("decay_total"))


def district_transitions(events: DataFrame, dim: DataFrame, gap_hours: float = 24.0, place: str = "district_name") -> DataFrame:
    """P(next | previous) over consecutive events in different districts at most 24 hours apart."""
    last = events.groupBy("user_id", "item_id").agg(F.max("event_ts").alias("event_ts"))
    rows = last.join(dim.select("item_id", place), "item_id").filter(F.col(place).isNotNull())
    lagged = lag_in_slices(rows, ["user_id"], "event_ts", "item_id", [place, "event_ts"])
    gap = (seconds("event_ts") - seconds("prev_event_ts")) / 3600.0
    moved = lagged.filter((gap <= gap_hours) & (F.col(place) != F.col(f"prev_{place}")))
    counts = moved.groupBy(F.col(f"prev_{place}").alias("source"), F.col(place).alias("target")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("source").agg(F.sum("n").alias("t"))
    return counts.join(totals, "source").select("source", "target", "n", ratio("n", "t").alias("prob"))


def match_features(candidates: DataFrame, prefs: DataFrame, items: DataFrame, transitions: DataFrame) -> DataFrame:
    """Equality flags between user preferences and listing attributes, and the district adjacency."""
    pairs = {"category": "pref_category", "city_name": "pref_city", "price_bucket": "pref_price_bucket", "ad_type": "pref_ad_type",
             "district_name": "pref_district_name", "seller_type": "pref_seller_type"}
    names = {"category": "category_match", "city_name": "city_match", "price_bucket": "price_match", "ad_type": "adtype_match",
             "district_name": "district_match", "seller_type": "seller_match"}
    joined = candidates.join(prefs.select("user_id", *pairs.values()), "user_id", "left").join(items.select("item_id", *pairs), "item_id", "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    joined = joined.withColumns({names[i]: flag(text(i) == text(p)) for i, p in pairs.items()})
    probs = transitions.select(F.col("source").alias("pref_district_name"), F.col("target").alias("district_name"), "prob")
    joined = joined.join(probs, ["pref_district_name", "district_name"], "left")
    score = F.when(F.col("district_match") == 1, 1.0).otherwise(F.coalesce("prob", F.lit(0.0)))
    return joined.withColumn("district_transition_score", score).select(*candidates.columns, *names.values(), "district_transition_score")


class FeatureStages(NamedTuple):
    """Feature tables of one cutoff; tables of pairs have (user_id, item_id)."""

    items: DataFrame
    users: DataFrame
    pairs: DataFrame
    decayed: DataFrame
    inter: DataFrame


def stage_features(stages: FeatureStages) -> FeatureStages:
    """The tables written once in buckets of their own keys, for any number of candidate sets.

    Lists for training and for testing are assembled from the same stages; whoever joins them reads
    them without an exchange.
    """
    keys = {"items": ["item_id"], "users": ["user_id"]}
    return FeatureStages(*[bucketed(df, name, *keys.get(name, ["user_id", "item_id"])) for name, df in stages._asdict().items()])


def assemble_features(candidates: DataFrame, stages: FeatureStages, truth: DataFrame | None = None) -> DataFrame:
    """Candidates left-joined to every feature table with fixed fills, and the label from later pairs.

    Tables of pairs come first, so candidates are dealt once by pair, once by user and once by item.
    """
    keys = ["user_id", "item_id"]
    out = candidates
    if truth is not None:
        out = out.join(truth.select(*keys).distinct().withColumn("label", F.lit(1)), keys, "left")
    for table in (stages.pairs, stages.decayed, stages.inter):
        out = out.join(table, keys, "left")
    out = out.join(stages.users, "user_id", "left").join(stages.items, "item_id", "left")
    numeric = [f.name for f in out.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "float") and f.name not in keys]
    special = {"days_since_ui": 999, "days_since_last": 999, "active_span_days": 1, "source_count": 1}
    return out.fillna({c: special.get(c, 0) for c in numeric})


def user_features_v2(events: DataFrame, dim: DataFrame, cutoff: str) -> DataFrame:
    end = F.lit(cutoff).cast("timestamp_ntz")
    rows = before(events, cutoff).withColumn("age", (seconds(end) - seconds("event_ts")) / 86400.0)
    pos = rows.filter(is_positive())
    recent = F.col("age") <= 30
    base = pos.groupBy("user_id").agg(
        F.count("*").alias("n_pos"), F.count_if(F.col("age") <= 7).alias("n_pos_7d"), F.count_if(recent).alias("n_pos_30d"),
        F.count_if(recent & is_explicit()).alias("n_high_30d"), F.min("age").alias("recency_days"), F.countDistinct("item_id").alias("n_items"),
        F.countDistinct("session_id").alias("n_sessions"), flag(F.avg(flag(is_login())) > 0.5).alias("login_majority"))
    out = base.withColumn("high_intent_ratio", ratio("n_high_30d", F.greatest("n_pos_30d", F.lit(1))))
    for column, name in (("category", "top_category"), ("city_name", "top_city"), ("surface", "main_surface"), ("device", "main_device")):
        out = join_keys(out, mode_value(pos, ["user_id"], column, name, "__n").drop("__n"), ["user_id"], "left")
    views = rows.filter(is_pageview() & recent).groupBy("user_id").agg(F.count("*").alias("n_pageviews_30d"), F.avg("dwell_time_sec").alias("avg_dwell"))
    prices = pos.select("user_id", "item_id").join(priced(dim).select("item_id", "price_log"), "item_id")
    median = quantiles(prices, ["user_id"], "price_log", {"price_pref_log": 0.5}, bounded=True)
    return join_keys(join_keys(out, views, ["user_id"], "left"), median, ["user_id"], "left")


def priced(dim: DataFrame) -> DataFrame:
    """``dim`` with ``price_log``, read once for each distinct price text instead of once for each listing."""
    logs = dim.select("price_bucket").distinct().withColumn("price_log", price_log("price_bucket"))
    return join_keys(dim, logs, ["price_bucket"], "left")


def user_tastes(events: DataFrame, prices: DataFrame, cutoff: str) -> DataFrame:
    """``top_category``, ``top_city`` and ``price_pref_log`` of ``user_features_v2`` alone, from the items' ``prices`` (``price_log``).

    All three are modes or medians over the positive events, so these are counted once by user and item.
    """
    pos = before(events.filter(is_positive()), cutoff)
    counts = durable(pos.groupBy("user_id", "item_id", "category", "city_name").agg(F.count("*").alias("c")), "positives")
    out = counts.select("user_id").distinct()
    for column, name in (("category", "top_category"), ("city_name", "top_city")):
        sums = counts.filter(F.col(column).isNotNull()).groupBy("user_id", column).agg(F.sum("c").alias("c"))
        out = join_keys(out, sums.groupBy("user_id").agg(F.min_by(column, F.struct(-F.col("c"), F.col(column))).alias(name)), ["user_id"], "left")
    paid = counts.join(prices.select("item_id", "price_log"), "item_id").filter("price_log IS NOT NULL")
    hist = paid.groupBy("user_id", "price_log").agg(F.sum("c").alias("c"))
    return join_keys(out, hist.groupBy("user_id").agg(F.percentile("price_log", F.lit(0.5), F.col("c")).alias("price_pref_log")), ["user_id"], "left")


def item_features_v2(events: DataFrame, snapshot: DataFrame, dim: DataFrame, cutoff: str) -> DataFrame:
    end = F.lit(cutoff).cast("timestamp_ntz")
    pos = before(events.filter(is_positive()), cutoff).withColumn("age", (seconds(end) - seconds("event_ts")) / 86400.0)
    agg = pos.groupBy("item_id").agg(
        F.count_if(F.col("age") <= 7).alias("n_pos_7d"), F.count_if(F.col("age") <= 30).alias("n_pos_30d"),
        F.countDistinct("user_id").alias("n_users"), F.count("*").alias("n_pos"))
    days = F.datediff(F.lit(cutoff).cast("date"), "date")
    snaps = snapshot.filter(F.col("date") < F.lit(cutoff).cast("date")).withColumn("age", days)

    def mean(c: str, d: int) -> Column:
        return F.avg(F.when(F.col("age") <= d, F.col(c)))

    means = snaps.groupBy("item_id").agg(
        mean("views_24h", 7).alias("v7"), mean("contacts_24h", 7).alias("c7"), mean("views_24h", 30).alias("v30"), mean("contacts_24h", 30).alias("c30"),
        F.count("*").alias("n_days"))
    floor = F.lit(0.01)
    joined = priced(dim).select("item_id", "category", "city_name", "price_log").join(agg, "item_id", "left").join(means, "item_id", "left")
    out = joined.fillna(0, ["n_pos", "n_pos_7d", "n_pos_30d", "n_users", "n_days"]).withColumns({
        "cr_30d": F.col("c30") / F.greatest("v30", floor), "velocity_contacts": (F.col("c7") - F.col("c30")) / F.greatest("c30", floor),
        "velocity_views": (F.col("v7") - F.col("v30")) / F.greatest("v30", floor),
        "event_density": ratio("n_pos", F.greatest("n_days", F.lit(1)))})
    return segment_zscore(out, ["category", "city_name"], "price_log", "price_deviation")


def cross_features(candidates: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    joined = candidates.join(users.select("user_id", "top_category", "top_city", "price_pref_log"), "user_id", "left").join(
        items.select("item_id", "category", "city_name", "price_log"), "item_id", "left")
    return joined.withColumns({
        "same_category": flag(F.col("top_category") == F.col("category")), "same_city": flag(F.col("top_city") == F.col("city_name")),
        "price_affinity": -F.abs(F.col("price_log") - F.col("price_pref_log"))})


def item_quality_score(trusted: Sequence[str], legal: Sequence[str]) -> Column:
    many = flag(F.coalesce("images_count", F.lit(0.0)) > 3)
    return (0.20 * many + 0.20 * flag(F.col("seller_type").isin(list(trusted))) + 0.30 * flag(F.col("legal_status").isin(list(legal)))
            + 0.15 * flag(F.col("house_type").isNotNull()) + 0.15 * flag(F.col("direction").isNotNull()))


def user_embedding_profile(pairs: DataFrame, vectors: DataFrame, weight: str | None = None) -> DataFrame:
    """Weighted mean of the unit vectors of a user's items: one summing buffer for each user and task."""
    units = vectors.select("item_id", array_to_vector(unit("embedding")).alias("u"))
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    means = pairs.join(units.hint("merge"), "item_id").groupBy("user_id").agg(Summarizer.mean(F.col("u"), w).alias("m"))
    return means.select("user_id", vector_to_array("m").alias("profile"))


def title_similarity(candidates: DataFrame, profiles: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine of the user's profile and the item's vector. One of the two travels with every pair: the
    item's, as it is stored, which takes half the bytes of a profile of doubles. Vectors are far larger
    than Spark takes them for, so neither side is left to a broadcast."""
    joined = candidates.join(vectors.select("item_id", "embedding").hint("merge"), "item_id").join(profiles.hint("merge"), "user_id")
    return joined.select(*candidates.columns, cosine("profile", "embedding").alias("similarity"))
