"""Clickstream, funnel and contact-rate operators.

Most reports start from flags per (session, item) or per session: one combining aggregation whose
key spreads evenly, after which everything is small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.buckets import dwell_band, position_bucket
from bazaarlens.functions.columns import (
    bucketize, flag, has_query, is_explicit, is_login, is_other, is_pageview, is_positive, pct, ratio, seconds,
)
from bazaarlens.operators.core import join_keys, quantiles, share_of_all, share_within, top_n, unpivot_row
from bazaarlens.operators.joins import flag_left_join, verified_chat_join
from bazaarlens.operators.stats import spearman
from bazaarlens.schemas import EXPLICIT


def event_cvr_by_category(events: DataFrame, keys: Sequence[str] = ("category",)) -> DataFrame:
    return events.groupBy(*keys).agg(
        F.count("*").alias("events"), F.count_if(is_pageview()).alias("pageviews"), F.count_if(is_other()).alias("other"),
        *[F.count_if(F.col("event_type") == t).alias(t) for t in EXPLICIT],
        F.count_if(is_positive()).alias("positives"),
        pct(F.count_if(is_positive()), F.count("*")).alias("cvr_pct"))


def stage_funnel(events: DataFrame, keys: Sequence[str] = ("category",)) -> DataFrame:
    """pageview, other, phone, direct contact and the drop from one stage to the next."""
    counts = events.groupBy(*keys).agg(
        F.count_if(is_pageview()).alias("pageview"), F.count_if(is_other()).alias("other"),
        F.count_if(F.col("event_type") == "view_phone").alias("phone"),
        F.count_if(F.col("event_type").isin("contact_chat", "contact_zalo", "contact_sms")).alias("direct"))
    return counts.withColumns({
        "drop_pageview_other_pct": 100 - pct("other", "pageview"), "drop_other_phone_pct": 100 - pct("phone", "other"),
        "drop_phone_direct_pct": 100 - pct("direct", "phone")})


def listing_cvr_by_dims(dim: DataFrame, events: DataFrame, dims: Sequence[Column | str], min_n: int) -> DataFrame:
    """Percent of listings with at least one positive event, per combination of dims."""
    flagged = flag_left_join(dim, events.filter(is_positive()), ["item_id"], "has_positive")
    return flagged.groupBy(*dims).agg(
        F.count("*").alias("listings"), F.sum("has_positive").alias("with_positive"),
        pct(F.sum("has_positive"), F.count("*")).alias("cvr_pct")).filter(F.col("listings") >= min_n)


def session_item_flags(events: DataFrame, consider_seconds: float = 30) -> DataFrame:
    surface = F.lower(F.coalesce("surface", F.lit("")))
    other = is_other()
    return events.filter(F.col("item_id").isNotNull()).groupBy("category", "session_id", "item_id").agg(
        F.max("user_id").alias("user_id"),
        F.max(flag(is_pageview())).alias("has_pageview"), F.max(flag(other)).alias("has_other"),
        F.max(flag(other & (surface == "ad_view"))).alias("has_ad_view"),
        F.max(flag(other & (surface == "adview"))).alias("has_adview"),
        F.max(flag(other & ~surface.isin("ad_view", "adview"))).alias("has_other_surface"),
        F.max(flag(is_pageview() & (F.col("dwell_time_sec") > consider_seconds))).alias("has_consider"),
        F.max(flag(is_explicit())).alias("has_explicit"))


def contact_rate_three_grains(events: DataFrame) -> DataFrame:
    """Contact rate per session-item, session and user, each with its own definition."""
    si = session_item_flags(events)
    view, contact = F.col("has_pageview") == 1, F.col("has_explicit") == 1
    both = F.count_if(view & contact)

    def row(df: DataFrame, grain: str, hit: Column, base: Column) -> DataFrame:
        return df.groupBy("category").agg(
            F.count("*").alias("n"), F.count_if(view).alias("n_with_pageview"), hit.alias("n_contact"),
            pct(hit, base).alias("contact_rate_pct")).withColumn("grain", F.lit(grain))

    sessions = si.groupBy("category", "session_id").agg(
        F.max("has_pageview").alias("has_pageview"), F.max("has_explicit").alias("has_explicit"))
    users = events.filter("item_id IS NOT NULL").groupBy("category", "user_id").agg(
        F.max(flag(is_pageview())).alias("has_pageview"), F.max(flag(is_explicit())).alias("has_explicit")).filter(view)
    return row(si, "session_item", both, F.count_if(view)).unionByName(
        row(sessions, "session", F.count_if(contact), F.count("*"))).unionByName(row(users, "user", both, F.count("*")))


PATHS = {
    "A_pageview_only": "has_ad_view = 0 AND has_adview = 0 AND has_other_surface = 0",
    "B_plus_ad_view": "has_ad_view = 1", "C_plus_adview": "has_adview = 1",
    "D_plus_other_surface": "has_other_surface = 1", "Z_all_pageview": "true",
}


def path_conditional_rates(events: DataFrame) -> DataFrame:
    """Explicit rate of session-items with a pageview along each path; one pass, then unpivoted."""
    base = session_item_flags(events).filter("has_pageview = 1")
    marks = [
        F.when(F.expr(cond), F.struct(F.lit(name).alias("path"), F.col("has_explicit").alias("x"))) for name, cond in PATHS.items()
    ]
    long = base.select("category", F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())).alias("m"))
    return long.groupBy("category", F.col("m.path").alias("path")).agg(
        F.count("*").alias("n_items"), F.sum("m.x").alias("n_explicit"), pct(F.sum("m.x"), F.count("*")).alias("explicit_rate_pct"))


def path_incremental_weights(events: DataFrame) -> DataFrame:
    """Lift of each path over the plain pageview path; positive lifts normalized to one."""
    rates = path_conditional_rates(events).filter("path <> 'Z_all_pageview'")
    base = rates.groupBy("category").agg(F.max(F.when(F.col("path") == "A_pageview_only", F.col("explicit_rate_pct"))).alias("base"))
    lifted = join_keys(rates, base, ["category"]).withColumn("lift_pp", F.col("explicit_rate_pct") - F.col("base"))
    total = lifted.groupBy("category").agg(F.sum(F.greatest("lift_pp", F.lit(0.0))).alias("total"))
    weight = ratio(F.greatest("lift_pp", F.lit(0.0)), F.when(F.col("total") > 0, F.col("total")))
    shown = F.when(F.col("path") != "A_pageview_only", F.coalesce(weight, F.lit(0.0)))
    return join_keys(lifted, total, ["category"]).select(
        "category", "path", "explicit_rate_pct", "lift_pp", shown.alias("path_weight"))


def logistic_contributions(events: DataFrame, max_iter: int = 50) -> DataFrame:
    """Class-balanced logistic regression of explicit contact on standardized path flags."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    features = ["has_ad_view", "has_adview", "has_other_surface", "has_consider"]
    base = session_item_flags(events).filter("has_pageview = 1")
    n = base.agg(F.struct(F.count("*").alias("n"), F.sum("has_explicit").alias("p")).alias("s")).scalar()
    size = F.when(F.col("has_explicit") == 1, n["p"]).otherwise(n["n"] - n["p"])
    rows = base.select(*features, F.col("has_explicit").cast("double").alias("label"), ratio(n["n"], 2 * size).alias("weight"))
    assembled = VectorAssembler(inputCols=features, outputCol="raw").transform(rows)
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(assembled).transform(assembled)
    model = LogisticRegression(maxIter=max_iter, weightCol="weight", standardization=False).fit(scaled)
    coefs = [float(c) for c in model.coefficients]
    total = sum(abs(c) for c in coefs) or 1.0
    return events.sparkSession.createDataFrame(
        [(f, c, abs(c), abs(c) / total, float(model.intercept)) for f, c in zip(features, coefs)],
        "feature string, std_coef double, abs_std_coef double, weight double, intercept double")


def verified_sessions(events: DataFrame, interactions: DataFrame) -> DataFrame:
    return verified_chat_join(events.filter(is_login()), interactions).select("category", "session_id").distinct()


def session_channel_flags(events: DataFrame, interactions: DataFrame) -> DataFrame:
    """Per session: search, pageview, other, channels, verified chat and any explicit contact."""
    t = F.col("event_type")
    flags = events.groupBy("category", "session_id").agg(
        F.max(flag(is_pageview() & has_query())).alias("search"), F.max(flag(is_pageview())).alias("pageview"),
        F.max(flag(is_other())).alias("other"), F.max(flag(t == "view_phone")).alias("phone"),
        F.max(flag(t == "contact_zalo")).alias("zalo"), F.max(flag(t == "contact_sms")).alias("sms"),
        F.max(flag(t == "contact_chat")).alias("chat_raw"))
    flagged = flag_left_join(flags, verified_sessions(events, interactions), ["category", "session_id"], "chat_verified")
    return flagged.withColumn("explicit_any", F.greatest("phone", "zalo", "sms", "chat_verified"))


def session_ab_lift(events: DataFrame, interactions: DataFrame) -> DataFrame:
    """Contact rates of pageview sessions with and without other_interaction, and the lift in points."""
    base = session_channel_flags(events, interactions).filter("pageview = 1")
    measures = ["phone", "chat_raw", "chat_verified", "zalo", "sms", "explicit_any"]
    groups = base.groupBy("category").agg(
        F.count_if(F.col("other") == 1).alias("sessions_with"), F.count_if(F.col("other") == 0).alias("sessions_without"),
        *[(F.avg(F.when(F.col("other") == 1, F.col(m))) * 100).alias(f"{m}_with_pct") for m in measures],
        *[(F.avg(F.when(F.col("other") == 0, F.col(m))) * 100).alias(f"{m}_without_pct") for m in measures])
    return groups.withColumn("lift_pp", F.col("explicit_any_with_pct") - F.col("explicit_any_without_pct"))


def session_funnel_steps(events: DataFrame, interactions: DataFrame) -> DataFrame:
    steps = ["search", "pageview", "other", "phone", "zalo", "sms", "chat_verified", "explicit_any"]
    wide = session_channel_flags(events, interactions).groupBy("category").agg(
        F.count("*").alias("sessions"), *[F.sum(c).alias(c) for c in steps])
    long = unpivot_row(wide, ["category", "sessions"], {c: c for c in steps}, "step", "n_sessions")
    return long.withColumn("pct_of_sessions", pct("n_sessions", "sessions"))


def session_path_transitions(events: DataFrame, interactions: DataFrame) -> DataFrame:
    base = session_channel_flags(events, interactions).filter("pageview = 1")
    other, hit = F.col("other") == 1, F.col("explicit_any") == 1
    label = (
        F.when(other & hit, "pv_other_explicit").when(other, "pv_other_no_explicit")
        .when(hit, "pv_explicit_skip_other").otherwise("pv_only_no_explicit"))
    counts = base.groupBy("category", label.alias("path")).agg(F.count("*").alias("n_sessions"))
    return share_within(counts, ["category"], "n_sessions", "pct_of_pv_sessions")


def session_funnel_by_device(events: DataFrame, consider_seconds: float = 30) -> DataFrame:
    sessions = events.groupBy("device", "session_id").agg(
        F.max(flag(is_pageview() & has_query())).alias("search"), F.max(flag(is_pageview())).alias("view"),
        F.max(flag(is_pageview() & (F.col("dwell_time_sec") > consider_seconds))).alias("consider"),
        F.max(flag(is_explicit())).alias("contact"))
    return sessions.groupBy("device").agg(
        F.count("*").alias("sessions"), *[F.sum(c).alias(c) for c in ("search", "view", "consider", "contact")],
        pct(F.count_if((F.col("view") == 1) & (F.col("contact") == 1)), F.sum("view")).alias("view_to_contact_pct"))


def item_funnel(events: DataFrame) -> DataFrame:
    items = events.groupBy("category", "item_id").agg(
        F.max(flag(is_pageview())).alias("viewed"), F.max(flag(is_other())).alias("other"),
        F.max(flag(is_explicit())).alias("contacted"))
    return items.groupBy("category").agg(
        F.count("*").alias("items"), *[pct(F.sum(c), F.count("*")).alias(f"{c}_pct") for c in ("viewed", "other", "contacted")])


def unmet_search_sessions(events: DataFrame) -> DataFrame:
    """Sessions that searched and never opened a listing without a query."""
    sessions = events.groupBy("category", "session_id").agg(
        F.max(flag(is_pageview() & has_query())).alias("search"), F.max(flag(is_pageview() & ~has_query())).alias("view"))
    searched = sessions.filter("search = 1")
    return searched.groupBy("category").agg(
        F.count("*").alias("search_sessions"), F.count_if(F.col("view") == 0).alias("unmet"),
        pct(F.count_if(F.col("view") == 0), F.count("*")).alias("unmet_pct"))


def demand_users_by_login(events: DataFrame) -> DataFrame:
    users = events.filter(is_positive()).groupBy("category", "is_login").agg(F.countDistinct("user_id").alias("users"))
    return share_within(users, ["category"], "users", "pct")


def demand_by_category_device(events: DataFrame, devices: Sequence[str], rsd: float = 0.01) -> DataFrame:
    """Approximate distinct positive users by device with row percent; sketches merge in two phases."""
    wide = events.filter(is_positive()).groupBy("category").agg(
        *[F.approx_count_distinct(F.when(F.col("device") == d, F.col("user_id")), rsd).alias(f"u_{d}") for d in devices])
    total = sum((F.col(f"u_{d}") for d in devices), F.lit(0))
    return wide.withColumns({f"pct_{d}": pct(f"u_{d}", total) for d in devices})


def event_mix(events: DataFrame, key: str) -> DataFrame:
    counts = events.groupBy(key, "event_type").agg(F.count("*").alias("n"))
    return share_within(counts, [key], "n", "pct")


def other_interaction_composition(events: DataFrame) -> DataFrame:
    other = events.filter(is_other())
    keys = ["surface", "device"]
    base = other.groupBy(*keys).agg(
        F.count("*").alias("n"), (F.avg(flag(F.col("position").isNull())) * 100).alias("null_position_pct"),
        (F.avg(flag(F.col("query").isNull())) * 100).alias("null_query_pct"))
    spread = quantiles(other, keys, "dwell_time_sec", {"dwell_p50": 0.5, "dwell_p90": 0.9})
    places = quantiles(other, keys, "position", {"position_p50": 0.5}, bounded=True)
    joined = join_keys(join_keys(base, spread, keys, "left"), places, keys, "left")
    return share_of_all(joined, "n", "pct", bounded=True)


def high_intent_cooccurrence(events: DataFrame) -> DataFrame:
    """Sessions with other_interaction by which contact channels also occur in them."""
    t = F.col("event_type")
    sessions = events.groupBy("session_id").agg(
        F.max(flag(is_other())).alias("other"), F.max(flag(t == "view_phone")).alias("phone"),
        F.max(flag(t == "contact_chat")).alias("chat"), F.max(flag(t == "contact_zalo")).alias("zalo"))
    counts = sessions.filter("other = 1").groupBy("phone", "chat", "zalo").agg(F.count("*").alias("sessions"))
    return share_of_all(counts, "sessions", "pct", bounded=True)


def dwell_by_event(events: DataFrame, limit_seconds: float = 600) -> DataFrame:
    rows = events.filter((is_pageview() | is_other()) & (F.col("dwell_time_sec") > 0) & (F.col("dwell_time_sec") <= limit_seconds))
    keys = ["category", "event_type"]
    base = rows.groupBy(*keys).agg(F.avg("dwell_time_sec").alias("avg_dwell"), F.count("*").alias("n"))
    return join_keys(base, quantiles(rows, keys, "dwell_time_sec", {"p50": 0.5, "p90": 0.9}), keys)


def dwell_by_group(events: DataFrame, limit_seconds: float = 600) -> DataFrame:
    """Longest pageview dwell per session-item, with and without other_interaction."""
    si = events.filter("item_id IS NOT NULL").groupBy("category", "session_id", "item_id").agg(
        F.max(flag(is_other())).alias("has_other"), F.max(F.when(is_pageview(), F.col("dwell_time_sec"))).alias("dwell"))
    rows = si.filter((F.col("dwell") > 0) & (F.col("dwell") <= limit_seconds))
    keys = ["category", "has_other"]
    base = rows.groupBy(*keys).agg(F.avg("dwell").alias("avg_dwell"), F.count("*").alias("n"))
    return join_keys(base, quantiles(rows, keys, "dwell", {"p50": 0.5}), keys)


def repeated_other_dwell(events: DataFrame) -> DataFrame:
    si = events.filter(is_other() & F.col("item_id").isNotNull()).groupBy("category", "session_id", "item_id").agg(
        F.count("*").alias("n_other"), F.max("dwell_time_sec").alias("dwell")).filter("n_other >= 2")
    band = bucketize("dwell", [5, 15], ["fast_swipe_lt5s", "short_5-15s", "long_15s+"], "left", "long_15s+")
    return si.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg("n_other").alias("avg_other"))


def hour_dow_matrix(events: DataFrame) -> DataFrame:
    counts = events.groupBy(F.weekday("event_ts").alias("dow"), F.hour("event_ts").alias("hour")).agg(F.count("*").alias("n"))
    return share_of_all(counts, "n", "pct", bounded=True)


def peak_hours_share(events: DataFrame, peak: Sequence[int]) -> DataFrame:
    """Share of events in the peak hours: over everything and as the mean of the daily shares."""
    in_peak = F.hour("event_ts").isin(list(peak))
    daily = events.groupBy("category", "date").agg(F.count("*").alias("n"), F.count_if(in_peak).alias("p"))
    return daily.groupBy("category").agg(
        pct(F.sum("p"), F.sum("n")).alias("peak_pct"), F.avg(pct("p", "n")).alias("mean_daily_peak_pct"))


def position_ctr_proxy(events: DataFrame) -> DataFrame:
    rows = events.filter(is_pageview() & F.col("position").isNotNull())
    counts = rows.groupBy("category", position_bucket().alias("position_bucket")).agg(F.count("*").alias("clicks"))
    return share_within(counts, ["category"], "clicks", "pct_of_clicks")


def stars_and_blackholes(events: DataFrame, snapshot: DataFrame, min_views: int = 5, n: int = 50) -> DataFrame:
    """Stars: shown far down yet much viewed. Black holes: shown on top, seen often, rarely opened."""
    views = events.filter(is_pageview() & F.col("position").isNotNull() & F.col("item_id").isNotNull())
    base = views.groupBy("category", "item_id").agg(F.count("*").alias("pageviews")).filter(F.col("pageviews") >= min_views)
    medians = quantiles(views, ["category", "item_id"], "position", {"med_position": 0.5}, bounded=True)
    seen = snapshot.groupBy("item_id").agg(F.sum("views_24h").alias("exposure"))
    items = join_keys(base, medians, ["category", "item_id"]).join(seen, "item_id", "left")
    items = items.withColumn("exposure", F.coalesce("exposure", F.lit(0.0))).withColumn("ctr_proxy_pct", pct("pageviews", "exposure"))
    limits = join_keys(
        join_keys(quantiles(items, ["category"], "pageviews", {"pv90": 0.9}, bounded=True),
                  quantiles(items, ["category"], "exposure", {"ex75": 0.75}), ["category"], "left"),
        quantiles(items, ["category"], "ctr_proxy_pct", {"ctr25": 0.25}), ["category"], "left")
    judged = join_keys(items, limits, ["category"])
    cols = ["category", "item_id", "kind", "pageviews", "med_position", "exposure", "ctr_proxy_pct"]
    stars = top_n(judged.filter("med_position >= 15 AND pageviews >= pv90").withColumn("kind", F.lit("star")),
                  ["category"], [F.desc("pageviews"), F.asc("item_id")], n)
    holes = judged.filter("med_position <= 3 AND exposure >= ex75 AND coalesce(ctr_proxy_pct, 100) <= ctr25")
    holes = top_n(holes.withColumn("kind", F.lit("black_hole")), ["category"], [F.asc("ctr_proxy_pct"), F.asc("item_id")], n)
    return stars.select(*cols, "rank").unionByName(holes.select(*cols, "rank"))


def content_blackholes(
    events: DataFrame, dim: DataFrame, snapshot: DataFrame, min_views: int = 20, min_other: int = 5, max_explicit: int = 1, n: int = 100
) -> DataFrame:
    """Listings much viewed and handled but hardly contacted, with snapshot medians."""
    stats = events.filter("item_id IS NOT NULL").groupBy("category", "item_id").agg(
        F.count_if(is_pageview()).alias("pageviews"), F.count_if(is_other()).alias("other_ix"), F.count_if(is_explicit()).alias("explicit"))
    holes = stats.filter(
        (F.col("pageviews") >= min_views) & (F.col("other_ix") >= min_other) & (F.col("explicit") <= max_explicit))
    best = top_n(holes, ["category"], [F.desc("pageviews"), F.desc("other_ix"), F.asc("item_id")], n)
    snaps = snapshot.join(best.select("item_id").distinct(), "item_id", "left_semi")
    ages = quantiles(snaps, ["item_id"], "listing_age_days", {"median_age": 0.5}, bounded=True)
    contacts = snaps.groupBy("item_id").agg(F.avg("contacts_24h").alias("avg_contacts"))
    return best.join(dim.select("item_id", "title", "ad_type"), "item_id", "left").join(ages, "item_id", "left").join(contacts, "item_id", "left")


def dwell_traps(events: DataFrame, n: int = 30, prob: float = 0.95) -> DataFrame:
    views = events.filter(is_pageview()).groupBy("category", "item_id").agg(
        F.avg("dwell_time_sec").alias("avg_dwell"), F.count("*").alias("pageviews"))
    contacts = events.filter(is_positive() | (F.col("is_contact") == 1)).groupBy("category", "item_id").agg(F.count("*").alias("contacts"))
    limit = quantiles(views, ["category"], "avg_dwell", {"p95": prob})
    joined = join_keys(join_keys(views, contacts, ["category", "item_id"], "left"), limit, ["category"])
    joined = joined.withColumn("contacts", F.coalesce("contacts", F.lit(0)))
    traps = joined.filter((F.col("avg_dwell") >= F.col("p95")) & (F.col("contacts") <= 1)).drop("p95")
    return top_n(traps, ["category"], [F.desc("avg_dwell"), F.asc("item_id")], n)


def contact_burst_sessions(events: DataFrame, min_items: int = 5) -> DataFrame:
    sessions = events.filter(is_positive() & F.col("user_id").isNotNull()).groupBy("category", "user_id", "session_id").agg(
        F.countDistinct("item_id").alias("items")).filter(F.col("items") >= min_items)
    return sessions.groupBy("category").agg(F.count("*").alias("sessions"), F.countDistinct("user_id").alias("users"))


def session_stats(events: DataFrame) -> DataFrame:
    """Size, span, conversion, bounce and main device of every session."""
    devices = events.groupBy("session_id", "device").agg(F.count("*").alias("n"))
    mode = devices.groupBy("session_id").agg(F.min_by("device", F.struct(-F.col("n"), F.col("device"))).alias("device"))
    stats = events.groupBy("session_id").agg(
        F.count("*").alias("n_events"), F.countDistinct("item_id").alias("n_items"), F.max("is_contact").alias("converted"),
        (seconds(F.max("event_ts")) - seconds(F.min("event_ts"))).alias("duration_s"))
    ev_bin = bucketize("n_events", [1, 3, 5, 10, 20], ["1", "2-3", "4-5", "6-10", "11-20", ">20"], "right")
    dur_bin = bucketize("duration_s", [30, 120, 300, 900], ["<30s", "30s-2min", "2-5min", "5-15min", ">15min"])
    return stats.join(mode, "session_id").withColumns({
        "is_bounce": flag(F.col("n_events") == 1), "event_bin": ev_bin, "duration_bin": dur_bin})


def session_stats_by_bin(events: DataFrame) -> DataFrame:
    counts = session_stats(events).groupBy("event_bin", "duration_bin", "converted").agg(F.count("*").alias("sessions"))
    return share_within(counts, ["converted"], "sessions", "pct")


def bounce_by_device(events: DataFrame) -> DataFrame:
    return session_stats(events).groupBy("device").agg(
        F.count("*").alias("sessions"), (F.avg("is_bounce") * 100).alias("bounce_pct"), F.avg("n_events").alias("avg_events"))


def login_vs_nonlogin(events: DataFrame) -> DataFrame:
    by_event = events.groupBy("category", "is_login").agg(
        F.count("*").alias("events"), pct(F.count_if(is_explicit()), F.count("*")).alias("explicit_event_pct"),
        pct(F.count_if(is_positive()), F.count("*")).alias("positive_event_pct"))
    sessions = events.groupBy("category", "is_login", "session_id").agg(
        F.max(flag(is_explicit())).alias("e"), F.max(flag(is_positive())).alias("p"))
    by_session = sessions.groupBy("category", "is_login").agg(
        F.count("*").alias("sessions"), (F.avg("e") * 100).alias("explicit_session_pct"), (F.avg("p") * 100).alias("positive_session_pct"))
    return join_keys(by_event, by_session, ["category", "is_login"])


def chat_verification_buckets(events: DataFrame, interactions: DataFrame) -> DataFrame:
    """Chat events by whether an interaction row exists that day and holds messages."""
    talk = interactions.groupBy("user_id", "item_id", "date").agg(F.max(F.coalesce("chat_message_count", F.lit(0.0))).alias("messages"))
    joined = events.filter(F.col("event_type") == "contact_chat").join(talk, ["user_id", "item_id", "date"], "left")
    bucket = F.when(F.col("messages").isNull(), "no_match").when(F.col("messages") > 0, "msg_gt0").otherwise("msg_zero")
    counts = joined.groupBy("is_login", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return share_within(counts, ["is_login"], "n", "pct")


def daily_cvr_rolling(events: DataFrame) -> DataFrame:
    from bazaarlens.operators.windows import rolling_mean

    daily = events.groupBy("category", "date").agg(
        F.count("*").alias("events"), pct(F.count_if(is_positive()), F.count("*")).alias("cvr_pct"))
    return rolling_mean(daily, ["category"], "date", "cvr_pct", "cvr_7d")


def user_item_mix(events: DataFrame) -> DataFrame:
    """Explicit and other counts of every pair with a positive event."""
    return events.filter(is_positive()).groupBy("user_id", "item_id", "category").agg(
        F.count_if(is_explicit()).alias("explicit"), F.count_if(is_other()).alias("n_other"))


def interaction_buckets(events: DataFrame, key: str, clip: float, q: int = 5) -> DataFrame:
    """Entities in quantile bins of other_interaction against their explicit contacts."""
    from bazaarlens.functions.buckets import quantile_buckets

    totals = user_item_mix(events).groupBy(key).agg(F.sum("explicit").alias("explicit"), F.sum("n_other").alias("n_other"))
    binned = quantile_buckets(totals, "n_other", q, "bucket", clip)
    share = F.try_divide(F.col("explicit").cast("double"), F.greatest(F.col("explicit") + F.col("n_other"), F.lit(1)).cast("double"))
    return binned.groupBy("bucket").agg(
        F.count("*").alias("n"), (F.avg(flag(F.col("explicit") > 0)) * 100).alias("has_explicit_pct"),
        F.avg("explicit").alias("avg_explicit"), F.avg("n_other").alias("avg_other"), F.avg(share).alias("explicit_ratio"))


def interaction_weight_study(events: DataFrame, explicit_weight: float = 10.0) -> DataFrame:
    """Does other_interaction predict contact? Rank correlations, pair lift and a proposed weight."""
    pairs = user_item_mix(events)
    both = flag((F.col("n_other") > 0) & (F.col("explicit") > 0))
    lift = pairs.agg(
        F.count("*").alias("pairs"), F.count_if(F.col("n_other") > 0).alias("pairs_with_other"),
        ratio(F.sum(both), F.count_if(F.col("n_other") > 0)).alias("explicit_given_other"),
        ratio(F.count_if(F.col("explicit") > 0), F.count("*")).alias("explicit_all"))

    def rho(key: str) -> Column:
        totals = pairs.groupBy(key).agg(F.sum("explicit").alias("x"), F.sum("n_other").alias("y"))
        return spearman(totals, [], "x", "y", bounded=True).select("spearman").scalar()

    out = lift.withColumns({
        "lift": ratio("explicit_given_other", "explicit_all"), "spearman_user": rho("user_id"), "spearman_item": rho("item_id")})
    raw = F.lit(explicit_weight) * F.col("spearman_item") * F.least("lift", F.lit(2.0)) * 0.5
    return out.withColumn("proposed_weight", F.greatest(F.lit(0.5), F.round(raw, 1)))


def interaction_mix(events: DataFrame) -> DataFrame:
    return user_item_mix(events).groupBy("category").agg(
        F.sum("explicit").alias("explicit"), F.sum("n_other").alias("other"),
        pct(F.sum("n_other"), F.greatest(F.sum("explicit") + F.sum("n_other"), F.lit(1))).alias("other_pct"))


def sliced_cvr(events: DataFrame, dim: DataFrame, slices: Mapping[str, Column], min_n: int) -> DataFrame:
    """Event CVR by any number of listing attributes in one scan: attributes become long rows."""
    counts = events.groupBy("item_id").agg(
        F.count("*").alias("events"), F.count_if(is_positive()).alias("positives"), F.count_if(is_explicit()).alias("explicit"))
    joined = dim.join(counts, "item_id")
    pairs = [F.struct(F.lit(name).alias("slice"), c.cast("string").alias("value")) for name, c in slices.items()]
    long = joined.select("events", "positives", "explicit", F.explode(F.array(*pairs)).alias("p"))
    return long.groupBy("p.slice", "p.value").agg(
        F.count("*").alias("items"), F.sum("events").alias("events"),
        pct(F.sum("positives"), F.sum("events")).alias("positive_pct"), pct(F.sum("explicit"), F.sum("events")).alias("explicit_pct"),
    ).filter(F.col("events") >= min_n)


def event_cvr_by(events: DataFrame, dims: Mapping[str, Column], min_n: int = 1) -> DataFrame:
    """Contact percent by event attributes (exact position, query or none, device x login)."""
    return events.groupBy(*[c.alias(n) for n, c in dims.items()]).agg(
        F.count("*").alias("events"), F.count_if(is_explicit()).alias("contacts"),
        pct(F.count_if(is_explicit()), F.count("*")).alias("contact_pct")).filter(F.col("events") >= min_n)


def seller_channel_style(events: DataFrame, interactions: DataFrame, dim: DataFrame, min_turns: int = 5, min_contacts: int = 10) -> DataFrame:
    """Messages per turn and phone preference per seller; items are aggregated before the join."""
    owner = dim.select("item_id", "seller_id")
    chat = interactions.groupBy("item_id").agg(F.sum("chat_message_count").alias("msg"), F.sum("chat_turn_count").alias("turn"))
    style = chat.join(owner, "item_id").groupBy("seller_id").agg(
        F.sum("msg").alias("messages"), F.sum("turn").alias("turns")).filter(F.col("turns") >= min_turns)
    t = F.col("event_type")
    phones = events.groupBy("item_id").agg(F.count_if(t == "view_phone").alias("p"), F.count_if(t.isin("view_phone", "contact_chat")).alias("c"))
    pref = phones.join(owner, "item_id").groupBy("seller_id").agg(
        F.sum("p").alias("phone"), F.sum("c").alias("phone_chat")).filter(F.col("phone_chat") >= min_contacts)
    return style.join(pref, "seller_id", "full").withColumns({
        "msg_per_turn": ratio("messages", "turns"), "phone_share": ratio("phone", "phone_chat")})


def listing_rate_by_cohort(events: DataFrame, dim: DataFrame, cohort: Column, min_n: int) -> DataFrame:
    """Percent of viewed listings with an explicit contact, by posted cohort and ad type."""
    items = events.groupBy("item_id").agg(F.max(flag(is_pageview())).alias("v"), F.max(flag(is_explicit())).alias("e")).filter("v = 1")
    joined = items.join(dim.withColumn("cohort", cohort).select("item_id", "cohort", "ad_type"), "item_id", "left")
    return joined.groupBy("cohort", "ad_type").agg(
        F.count("*").alias("viewed"), pct(F.sum("e"), F.count("*")).alias("contact_pct")).filter(F.col("viewed") >= min_n)


def volume_vs_outcome(events: DataFrame) -> DataFrame:
    """Event volume share of each layer beside the session-item contact rate reached with it."""
    from bazaarlens.functions.buckets import event_layer

    volume = share_within(events.groupBy("category", event_layer().alias("layer")).agg(F.count("*").alias("events")),
                          ["category"], "events", "volume_pct")
    si = session_item_flags(events)
    marks = F.array(
        F.struct(F.lit("pageview").alias("layer"), F.col("has_pageview").alias("on")),
        F.struct(F.lit("other_interaction").alias("layer"), F.col("has_other").alias("on")),
        F.struct(F.lit("explicit_contact").alias("layer"), F.col("has_explicit").alias("on")))
    reached = si.select("category", "has_explicit", F.explode(marks).alias("m")).filter("m.on = 1").groupBy("category", "m.layer").agg(
        F.count("*").alias("session_items"), (F.avg("has_explicit") * 100).alias("contact_rate_pct"))
    return join_keys(volume, reached, ["category", "layer"], "left")


def user_activity_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", "device").agg(
        F.count("*").alias("events"), F.countDistinct("item_id").alias("items"), F.countDistinct("session_id").alias("sessions"),
        F.count_if(is_explicit()).alias("contacts"), F.countDistinct("surface").alias("surfaces"),
        F.min("date").alias("first_seen"), F.max("date").alias("last_seen"))


def dwell_bands(events: DataFrame) -> DataFrame:
    counts = events.filter(is_pageview()).groupBy("category", dwell_band().alias("band")).agg(F.count("*").alias("n"))
    return share_within(counts, ["category"], "n", "pct")


def union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


