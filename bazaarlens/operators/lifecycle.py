"""Listing lifecycle: snapshots over age and calendar, states, sellers, cohorts, series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarlens.functions.buckets import age_bucket
from bazaarlens.functions.columns import (
    bucketize, flag, is_explicit, is_login, is_positive, month, pct, ratio, width_bin,
)
from bazaarlens.operators.core import join_keys, quantiles, share_of_all, top_n, unpivot_row
from bazaarlens.operators.windows import index_to_first_bucket, lag_transition


def snapshot_enriched(snapshot: DataFrame, dim: DataFrame) -> DataFrame:
    joined = snapshot.join(dim.select("item_id", "category", "ad_type", "ad_status"), "item_id")
    return joined.withColumns({
        "dow": F.weekday("date"), "month": month("date"), "age_bucket": age_bucket("listing_age_days"),
        "contact_rate": ratio("contacts_24h", "views_24h"), "violation": flag(F.col("contacts_24h") > F.col("views_24h"))})


def contact_rate_by(enriched: DataFrame, keys: Sequence[str]) -> DataFrame:
    return enriched.groupBy(*keys).agg(
        F.count("*").alias("listing_days"), F.avg("views_24h").alias("avg_views"), F.avg("contacts_24h").alias("avg_contacts"),
        pct(F.sum("contacts_24h"), F.sum("views_24h")).alias("contact_rate_pct"))


def category_ranking(enriched: DataFrame) -> DataFrame:
    base = contact_rate_by(enriched, ["category"])
    extra = enriched.groupBy("category").agg(
        F.countDistinct("item_id").alias("listings"), (F.avg(flag(F.col("contacts_24h") > 0)) * 100).alias("days_with_contact_pct"))
    age = quantiles(enriched, ["category"], "listing_age_days", {"median_age": 0.5}, bounded=True)
    return base.join(extra, "category").join(age, "category", "left")


def interaction_dow(interactions: DataFrame, events: DataFrame) -> DataFrame:
    logged = events.filter(is_login()).select("user_id").distinct()
    return interactions.join(logged, "user_id", "left_semi").groupBy("category", F.weekday("date").alias("dow")).agg(
        F.sum("lead_count").alias("leads"), F.sum("chat_message_count").alias("messages"))


def temporal_scorecard(enriched: DataFrame, events: DataFrame, min_cell: int = 100) -> DataFrame:
    """Best weekdays, best and worst month, best age bucket and busiest 3-hour block per category."""
    rate = F.col("contact_rate_pct")

    def rows(table: DataFrame, label: str, value: str, metric: str, order: Sequence[Column], n: int) -> DataFrame:
        best = top_n(table, ["category"], order, n, "place")
        return best.select("category", F.lit(label).alias("metric"), "place", F.col(value).cast("string").alias("value"),
                           F.col(metric).cast("double").alias("score"))

    dow, months = contact_rate_by(enriched, ["category", "dow"]), contact_rate_by(enriched, ["category", "month"])
    ages = contact_rate_by(enriched, ["category", "age_bucket"]).filter(F.col("listing_days") >= min_cell)
    blocks = events.filter(is_explicit()).groupBy("category", width_bin(F.hour("event_ts"), 3).alias("block")).agg(F.count("*").alias("n"))
    parts = [
        rows(dow, "top_weekday", "dow", "contact_rate_pct", [rate.desc(), F.asc("dow")], 3),
        rows(months, "peak_month", "month", "contact_rate_pct", [rate.desc(), F.asc("month")], 1),
        rows(months, "low_month", "month", "contact_rate_pct", [rate.asc(), F.asc("month")], 1),
        rows(ages, "best_age", "age_bucket", "contact_rate_pct", [rate.desc(), F.asc("age_bucket")], 1),
        rows(blocks, "peak_hour_block", "block", "n", [F.desc("n"), F.asc("block")], 1),
    ]
    return reduce(DataFrame.unionByName, parts)


def decay_curve(enriched: DataFrame, width: int = 5, maximum: int = 180) -> DataFrame:
    """Average views and contacts by age bin, averaging each item inside the bin first."""
    rows = enriched.filter(F.col("listing_age_days").between(0, maximum)).withColumn("age_bin", width_bin("listing_age_days", width))
    items = rows.groupBy("category", "item_id", "age_bin").agg(F.avg("views_24h").alias("v"), F.avg("contacts_24h").alias("c"))
    return items.groupBy("category", "age_bin").agg(
        F.count("*").alias("items"), F.avg("v").alias("avg_views"), F.avg("c").alias("avg_contacts"))


def state_expr() -> Column:
    contacted, viewed = F.sum(flag(F.col("contacts_24h") > 0)), F.sum(flag(F.col("views_24h") > 0))
    return F.when(contacted > 0, "contacted").when(viewed > 0, "viewed").otherwise("inactive")


def monthly_state(snapshot: DataFrame, dim: DataFrame) -> DataFrame:
    """State of every listing and month; aggregated before the dimension joins in."""
    states = snapshot.groupBy("item_id", month("date").alias("month")).agg(state_expr().alias("state"))
    return states.join(dim.select("item_id", "ad_status", "category"), "item_id")


def state_transitions(states: DataFrame) -> DataFrame:
    edges = lag_transition(states, ["item_id"], "month", "state").filter("prev_state IS NOT NULL")
    return edges.groupBy("prev_month", "month", "prev_state", "state").agg(F.count("*").alias("n"))


def largest_month_pair(states: DataFrame) -> DataFrame:
    pairs = state_transitions(states).groupBy("prev_month", "month").agg(F.sum("n").alias("n"))
    return pairs.orderBy(F.desc("n"), F.asc("prev_month"), F.asc("month")).limit(1)


def first_last_status(states: DataFrame) -> DataFrame:
    items = states.groupBy("item_id", "ad_status").agg(
        F.min_by("state", "month").alias("first_state"), F.max_by("state", "month").alias("last_state"))
    return items.groupBy("first_state", "last_state", "ad_status").agg(F.count("*").alias("n"))


def age_band_paths(snapshot: DataFrame, dim: DataFrame) -> DataFrame:
    """Edges band -> next band -> status of listings seen in their first week, missing bands skipped."""
    band = bucketize("listing_age_days", [7, 30], ["a", "b", "c"], "right", "c")
    states = snapshot.groupBy("item_id", band.alias("band")).agg(state_expr().alias("state"))
    wide = states.groupBy("item_id").agg(
        *[F.max(F.when(F.col("band") == b, F.concat(F.lit(n), F.lit(":"), F.col("state")))).alias(b)
          for b, n in (("a", "0-7d"), ("b", "8-30d"), ("c", "31d+"))])
    paths = wide.filter("a IS NOT NULL").join(dim.select("item_id", "ad_status"), "item_id").groupBy("a", "b", "c", "ad_status").agg(
        F.count("*").alias("n"))

    def edge(src: Column, dst: Column) -> Column:
        return F.when(src.isNotNull() & dst.isNotNull(), F.struct(src.alias("source"), dst.alias("target")))

    a, b, c, status = F.col("a"), F.col("b"), F.col("c"), F.col("ad_status")
    edges = F.array(edge(a, b), edge(b, c), edge(F.coalesce(c, b, a), status))
    return paths.select("n", F.explode(F.filter(edges, lambda e: e.isNotNull())).alias("e")).groupBy("e.source", "e.target").agg(
        F.sum("n").alias("n"))


def item_snapshot_kpi(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy("item_id").agg(
        F.count("*").alias("days"), F.count_if(F.col("views_24h") > 0).alias("days_viewed"),
        F.count_if(F.col("contacts_24h") > 0).alias("days_contacted"), F.max("views_24h").alias("max_views"),
        F.max("contacts_24h").alias("max_contacts"))


def kpi_by_status(snapshot: DataFrame, dim: DataFrame) -> DataFrame:
    joined = item_snapshot_kpi(snapshot).join(dim.select("item_id", "ad_status", "category"), "item_id")
    return joined.groupBy("ad_status", "category").agg(
        F.count("*").alias("items"), F.avg("days").alias("avg_days"), pct(F.sum("days_viewed"), F.sum("days")).alias("viewed_pct"),
        pct(F.sum("days_contacted"), F.sum("days")).alias("contacted_pct"), F.max("max_views").alias("max_views"))


def status_positive_coverage(dim: DataFrame, events: DataFrame) -> DataFrame:
    t = F.col("event_type")
    seen = events.groupBy("item_id").agg(
        F.max(flag(is_positive())).alias("pos"), F.max(flag(t == "view_phone")).alias("phone"),
        F.max(flag(t == "contact_chat")).alias("chat"), F.max(flag(t == "contact_zalo")).alias("zalo"), F.max(flag(t == "contact_sms")).alias("sms"))
    joined = dim.select("item_id", "ad_status", "category").join(seen, "item_id", "left")
    cols = ["pos", "phone", "chat", "zalo", "sms"]
    return joined.groupBy("ad_status", "category").agg(
        F.count("*").alias("items"), *[(F.avg(F.coalesce(c, F.lit(0))) * 100).alias(f"{c}_pct") for c in cols])


def seller_groups(dim: DataFrame) -> DataFrame:
    s = F.col("ad_status")
    flags = dim.filter("seller_id IS NOT NULL").groupBy("seller_id").agg(
        F.count_if(s == "shop_accepted").alias("n_shop"), F.count_if(s == "accepted").alias("n_acc"), F.count_if(s == "hidden").alias("n_hid"))
    group = (
        F.when(F.col("n_acc") > 0, "shop_and_accepted").when(F.col("n_hid") > 0, "shop_and_hidden").otherwise("shop_only"))
    return flags.filter("n_shop > 0").withColumn("seller_group", group)


def seller_status_groups(dim: DataFrame) -> DataFrame:
    counts = seller_groups(dim).groupBy("seller_group").agg(F.count("*").alias("sellers"), F.sum("n_shop").alias("shop_listings"))
    return share_of_all(counts, "shop_listings", "pct_listings", bounded=True)


def city_status_share(dim: DataFrame, min_n: int) -> DataFrame:
    s = F.col("ad_status")
    cities = dim.groupBy("city_name").agg(F.count_if(s == "shop_accepted").alias("shop"), F.count_if(s == "accepted").alias("accepted"))
    total = F.col("shop") + F.col("accepted")
    return cities.filter(total >= min_n).withColumn("shop_pct", pct("shop", total))


def first_days_contact(snapshot: DataFrame, days: int) -> DataFrame:
    """Per listing: did it get a contact within its first ``days`` days?"""
    capped = F.least("contacts_24h", "views_24h")
    return snapshot.filter(F.col("listing_age_days") <= days).groupBy("item_id").agg(flag(F.max(capped) > 0).alias("contacted"))


def first_week_match_rate(snapshot: DataFrame, dim: DataFrame, key: str = "district_name") -> DataFrame:
    return first_days_contact(snapshot, 7).join(dim.select("item_id", key), "item_id").groupBy(key).agg(
        F.count("*").alias("items"), (F.avg("contacted") * 100).alias("match_pct"))


def dead_listing_profile(snapshot: DataFrame, dim: DataFrame, columns: Sequence[str]) -> DataFrame:
    dead = first_days_contact(snapshot, 14).filter("contacted = 0").select("item_id", F.lit(1).alias("dead"))
    joined = dim.join(dead, "item_id", "left").withColumn("dead", F.coalesce("dead", F.lit(0)))
    pairs = [F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in columns]
    return joined.select("dead", F.explode(F.array(*pairs)).alias("p")).groupBy("p.variable", "p.value").agg(
        F.count("*").alias("items"), (F.avg("dead") * 100).alias("dead_pct"))


def survival_by_age(enriched: DataFrame, width: int = 7) -> DataFrame:
    rows = enriched.filter("listing_age_days IS NOT NULL")
    bins = rows.groupBy("category", width_bin("listing_age_days", width).alias("age_bin")).agg(
        F.count("*").alias("listing_days"), (F.avg(flag(F.col("contacts_24h") > 0)) * 100).alias("alive_pct"),
        F.avg("views_24h").alias("avg_views"), F.avg("contacts_24h").alias("avg_contacts"))
    indexed = index_to_first_bucket(bins, ["category"], "age_bin", "avg_views", "views_index")
    return index_to_first_bucket(indexed, ["category"], "age_bin", "avg_contacts", "contacts_index")


def posting_cohort(dim: DataFrame, interactions: DataFrame) -> DataFrame:
    leads = interactions.groupBy("item_id").agg(F.sum("lead_count").alias("leads"))
    joined = dim.join(leads, "item_id", "left").withColumn("leads", F.coalesce("leads", F.lit(0.0)))
    return joined.groupBy(month("posted_date").alias("posted_month")).agg(
        F.count("*").alias("listings"), F.avg("leads").alias("avg_leads"), (F.avg(flag(F.col("leads") > 0)) * 100).alias("with_lead_pct"))


def monthly_supply_demand(dim: DataFrame, interactions: DataFrame) -> DataFrame:
    supply = dim.groupBy(month("posted_date").alias("month")).agg(F.count("*").alias("supply"))
    demand = interactions.groupBy(month("date").alias("month")).agg(F.sum("lead_count").alias("demand"))
    joined = supply.join(demand, "month", "full").fillna(0, ["supply", "demand"])
    return share_of_all(share_of_all(joined, "supply", "supply_pct"), "demand", "demand_pct")


def listing_survival_halves(events: DataFrame, dim: DataFrame, keys: Sequence[str], mid: Column, unstable: float = 0.30) -> DataFrame:
    """Listings contacted in the first half, and how many of them again in the second."""
    hit = is_explicit()
    items = events.groupBy("item_id").agg(
        F.count_if(hit & (F.col("date") < mid)).alias("e1"), F.count_if(hit & (F.col("date") >= mid)).alias("e2"))
    e1, e2 = F.col("e1") > 0, F.col("e2") > 0
    cells = items.join(dim.select("item_id", *keys), "item_id").groupBy(*keys).agg(
        F.count_if(e1).alias("items_h1"), F.count_if(e1 & e2).alias("items_both"), F.count_if(e1 & ~e2).alias("items_h1_only"),
        F.count_if(~e1 & e2).alias("items_h2_only"))
    return cells.withColumns({
        "survival_rate": ratio("items_both", "items_h1"), "churn_pct": pct("items_h1_only", "items_h1"),
        "growth_quality": F.when(ratio("items_both", "items_h1") < unstable, "unstable_growth").otherwise("stable")})


def market_share(enriched: DataFrame) -> DataFrame:
    totals = enriched.groupBy("category").agg(F.count("*").alias("listing_days"), F.sum("contacts_24h").alias("contacts"))
    return share_of_all(share_of_all(totals, "listing_days", "listing_days_pct"), "contacts", "contacts_pct")


def item_performance(dim: DataFrame, snapshot: DataFrame, interactions: DataFrame) -> DataFrame:
    """One row per listing; both facts are aggregated to items before they are joined."""
    views = snapshot.groupBy("item_id").agg(F.sum("views_24h").alias("total_views"), F.sum("contacts_24h").alias("total_contacts"))
    leads = interactions.groupBy("item_id").agg(
        F.sum("lead_count").alias("n_leads"), F.count("*").alias("n_contacts"), F.countDistinct("user_id").alias("n_users"),
        F.min("date").alias("first_contact"))
    joined = dim.join(views, "item_id", "left").join(leads, "item_id", "left")
    zeros = {c: 0 for c in ("total_views", "total_contacts", "n_leads", "n_contacts", "n_users")}
    return joined.fillna(zeros).withColumns({
        "has_lead": flag(F.col("n_leads") > 0), "lead_per_view": ratio("n_leads", "total_views"),
        "days_to_first": F.datediff("first_contact", "posted_date")})


def performance_by(performance: DataFrame, dims: Mapping[str, Column]) -> DataFrame:
    return performance.groupBy(*[c.alias(n) for n, c in dims.items()]).agg(
        F.count("*").alias("items"), F.avg("total_views").alias("avg_views"), F.avg("n_leads").alias("avg_leads"),
        (F.avg("has_lead") * 100).alias("with_lead_pct"))


def contact_velocity(performance: DataFrame, days: Sequence[int] = (1, 3, 7, 14, 30)) -> DataFrame:
    wide = performance.agg(*[(F.avg(flag(F.col("days_to_first") <= d)) * 100).alias(str(d)) for d in days])
    return unpivot_row(wide, [], {str(d): str(d) for d in days}, "within_days", "pct_items")


def relisting_groups(dim: DataFrame, max_days: int = 30) -> DataFrame:
    groups = dim.filter("seller_id IS NOT NULL AND ward_name IS NOT NULL AND price_bucket IS NOT NULL").groupBy(
        "seller_id", "ward_name", "price_bucket").agg(
        F.count("*").alias("n_list"), F.datediff(F.max("posted_date"), F.min("posted_date")).alias("date_range"))
    return groups.filter((F.col("n_list") > 1) & (F.col("date_range") <= max_days))


def relisting_detection(dim: DataFrame, max_days: int = 30, cap: int = 20) -> DataFrame:
    sellers = relisting_groups(dim, max_days).groupBy("seller_id").agg(F.least(F.sum("n_list"), F.lit(cap)).alias("relisted"))
    return sellers.groupBy("relisted").agg(F.count("*").alias("sellers"))


def seller_scorecard(performance: DataFrame) -> DataFrame:
    sellers = performance.groupBy("seller_id").agg(
        F.avg("images_count").alias("avg_images"), F.count("*").alias("listings"), F.sum("n_leads").alias("leads"),
        F.avg(flag(F.col("furnishing") == "full")).alias("full_rate"))
    peak = sellers.agg(F.greatest(F.max("avg_images"), F.lit(1.0))).scalar()
    return sellers.withColumn("quality_score", (F.col("avg_images") / peak + F.col("full_rate")) / 2)


def top_sellers(scorecard: DataFrame, n: int = 20) -> DataFrame:
    return scorecard.orderBy(F.desc("leads"), F.asc("seller_id")).limit(n)


def monthly_posting_of_top_sellers(dim: DataFrame, scorecard: DataFrame, n: int = 20) -> DataFrame:
    best = top_sellers(scorecard, n).select("seller_id")
    return dim.join(F.broadcast(best), "seller_id").groupBy("seller_id", month("posted_date").alias("month")).agg(F.count("*").alias("listings"))


def posting_frequency_bins(dim: DataFrame) -> DataFrame:
    sellers = dim.filter("seller_id IS NOT NULL").groupBy("seller_id").agg(F.count("*").alias("n"))
    bins = bucketize("n", [1, 5, 20, 50], ["1", "2-5", "6-20", "21-50", ">50"], "right")
    counts = sellers.groupBy(bins.alias("bin")).agg(F.count("*").alias("sellers"), F.sum("n").alias("listings"))
    return share_of_all(counts, "listings", "listings_pct", bounded=True)


def issue_scorecard(performance: DataFrame, max_area: float = 200) -> DataFrame:
    issues = {
        "no_image": F.col("images_count") == 0, "no_furnishing": F.col("furnishing").isNull(), "no_area": F.col("area_sqm").isNull(),
        "no_price": F.col("price_bucket").isNull(), "zero_views": F.col("total_views") == 0, "zero_leads": F.col("n_leads") == 0,
        "deleted": F.col("ad_status") == "deleted", "area_outlier": F.col("area_sqm") > max_area,
        "no_image_with_leads": (F.col("images_count") == 0) & (F.col("n_leads") > 0)}
    wide = performance.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in issues.items()])
    long = unpivot_row(wide, ["total"], {n: n for n in issues}, "issue", "n")
    return long.select("issue", F.col("n").cast("long").alias("n"), pct("n", "total").alias("pct"))


def top_vs_bottom_decile(performance: DataFrame, prob: float = 0.9) -> DataFrame:
    """Profile of the listings at or above the lead p90 beside those without leads."""
    cut = quantiles(performance, [], "n_leads", {"q": prob}, bounded=True).scalar()
    tagged = performance.withColumn(
        "grp", F.when(F.col("n_leads") == 0, "bottom").when(F.col("n_leads") >= cut, "top")).filter("grp IS NOT NULL")
    life = F.datediff("expected_expired_date", "posted_date")
    tagged = tagged.withColumn("duration", life)
    base = tagged.groupBy("grp").agg(
        F.count("*").alias("items"), F.avg("images_count").alias("avg_images"), F.avg("area_sqm").alias("avg_area"),
        (F.avg(flag(F.col("furnishing") == "full")) * 100).alias("full_pct"), (F.avg(flag(F.col("seller_type") == "agent")) * 100).alias("agent_pct"))
    return base.join(quantiles(tagged, ["grp"], "duration", {"median_duration": 0.5}, bounded=True), "grp")


# ---- series -------------------------------------------------------------------------------------

def daily_series_fill(counts: DataFrame, keys: Sequence[str], date: str = "date", value: str = "y") -> DataFrame:
    """Complete calendar per key with linear interpolation of missing days (one row per day)."""
    keys = list(keys)
    span = counts.groupBy(*keys).agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    calendar = span.select(*keys, F.explode(F.sequence("lo", "hi")).alias(date))
    joined = join_keys(calendar, counts, [*keys, date], "left")
    back = W.partitionBy(*keys).orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*keys).orderBy(date).rowsBetween(0, W.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(date).alias("d"), F.col(value).cast("double").alias("v")))
    p, n = F.last(known, ignorenulls=True).over(back), F.first(known, ignorenulls=True).over(ahead)
    marked = joined.withColumns({"__p": p, "__n": n})
    part = F.try_divide(F.datediff(date, "__p.d").cast("double"), F.datediff("__n.d", "__p.d").cast("double"))
    filled = F.coalesce(F.col(value).cast("double"), F.col("__p.v") + (F.col("__n.v") - F.col("__p.v")) * part)
    return marked.select(*keys, date, filled.alias(value), flag(F.col(value).isNull()).alias("interpolated"))


def weekly_decomposition(series: DataFrame, keys: Sequence[str], date: str = "date", value: str = "y",
                         holiday: tuple[str, str] | None = None) -> DataFrame:
    """Moving-average trend and period-7 seasonal part of a daily series.

    Trend is the centered 7-day mean where all seven days exist; the seasonal part is the mean
    detrended value per weekday outside the holiday, centered to zero.
    """
    keys = list(keys)
    w = W.partitionBy(*keys).orderBy(date).rowsBetween(-3, 3)
    trend = F.when(F.count(value).over(w) == 7, F.avg(value).over(w))
    base = series.withColumns({"trend": trend, "dow": F.weekday(date)}).withColumn("detrended", F.col(value) - F.col("trend"))
    used = base
    if holiday:
        used = base.filter(~F.col(date).between(F.lit(holiday[0]).cast("date"), F.lit(holiday[1]).cast("date")))
    profile = used.groupBy(*keys, "dow").agg(F.avg("detrended").alias("raw"))
    seasonal = profile.select(*keys, "dow", (F.col("raw") - F.avg("raw").over(W.partitionBy(*keys))).alias("seasonal"))
    return join_keys(base, seasonal, [*keys, "dow"], "left").withColumn(
        "residual", F.col("detrended") - F.col("seasonal")).drop("detrended")


def _loess(span: int) -> Column:
    """Local lines through ``z`` (structs of place, value, weight), one value per place.

    The nearest ``span`` places get tricube weights by distance, times their own weight. Where the
    weights leave no line (one place, or none), the weighted mean or the place's own value stands.
    """
    n = F.size("z")
    take = F.least(F.lit(span), n)
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("w", "x", "xx", "y", "xy")])

    def fit(p):
        i = p["j"]
        low = F.greatest(F.lit(0), F.least(i - F.floor(take / 2).cast("int"), n - take))
        reach = F.greatest(i - low, low + take - 1 - i).cast("double") + 1.0

        def add(s, q):
            x = (q["j"] - i).cast("double")
            w = q["w"] * F.pow(1.0 - F.pow(F.abs(x) / reach, F.lit(3.0)), F.lit(3.0))
            return F.struct((s["w"] + w).alias("w"), (s["x"] + w * x).alias("x"), (s["xx"] + w * x * x).alias("xx"), (s["y"] + w * q["y"]).alias("y"), (s["xy"] + w * x * q["y"]).alias("xy"))

        def line(s):
            spread = s["w"] * s["xx"] - s["x"] * s["x"]
            return F.when(spread > 1e-9, (s["xx"] * s["y"] - s["x"] * s["xy"]) / spread).when(s["w"] > 1e-9, s["y"] / s["w"]).otherwise(p["y"])

        return F.aggregate(F.slice("z", low + 1, take), zero, add, line)

    return F.transform("z", fit)


def _weekday_means() -> Column:
    """Weighted mean of (value - trend) per weekday, centered over the weekdays that occur."""
    def mean(d):
        def add(s, q):
            w = F.when(q["dow"] == d, q["w"]).otherwise(0.0)
            return F.struct((s["w"] + w).alias("w"), (s["y"] + w * (q["y"] - q["t"])).alias("y"))

        zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("y"))
        return F.aggregate("z", zero, add, lambda s: F.when(s["w"] > 1e-9, s["y"] / s["w"]))

    return F.transform(F.sequence(F.lit(0), F.lit(6)), mean)


def robust_decomposition(series: DataFrame, keys: Sequence[str], date: str = "date", value: str = "y", span: int = 21, rounds: int = 5) -> DataFrame:
    """Trend, weekly seasonal part, residual and robustness weight of daily series, one row per series while it is fitted.

    ``rounds`` times: the seasonal part is the weighted mean per weekday of what the trend leaves,
    the trend is a LOESS of what the seasonal part leaves, and days far from both get bisquare
    weights by six median residuals, so that a holiday moves neither. Days without value are left
    out. Everything is array expressions; thousands of series are fitted side by side. A series has a row per
    calendar day, which bounds its arrays.
    """
    keys = list(keys)
    day = F.struct(F.col(date).alias("date"), F.col(value).cast("double").alias("y"))
    rows = series.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(day)).alias("days"))
    zeros = F.transform("days", lambda d: F.lit(0.0))
    # The first trend is a plain LOESS of the values, with all weights one.
    rows = rows.withColumns({"weight": F.transform("days", lambda d: F.lit(1.0)), "seasonal": zeros})

    def places(of) -> Column:
        return F.transform("days", of)

    for number in range(rounds + 1):
        rows = rows.withColumn("z", places(lambda d, i: F.struct(i.alias("j"), (d["y"] - F.get("seasonal", i)).alias("y"), F.get("weight", i).alias("w"))))
        rows = rows.withColumn("trend", _loess(span))
        if number == rounds:
            break
        rows = rows.withColumn("z", places(lambda d, i: F.struct(F.weekday(d["date"]).alias("dow"), d["y"].alias("y"), F.get("trend", i).alias("t"), F.get("weight", i).alias("w"))))
        rows = rows.withColumn("means", _weekday_means())
        known = F.filter("means", lambda m: m.isNotNull())
        center = F.aggregate(known, F.lit(0.0), lambda s, m: s + m) / F.size(known)
        rows = rows.withColumn("center", center).withColumn("seasonal", places(lambda d, i: F.coalesce(F.get("means", F.weekday(d["date"])) - F.col("center"), F.lit(0.0))))
        rows = rows.withColumn("off", places(lambda d, i: F.abs(d["y"] - F.get("trend", i) - F.get("seasonal", i))))
        ordered, half = F.sort_array("off"), F.size("off") / 2
        middle = (F.get(ordered, F.floor((F.size("off") - 1) / 2).cast("int")) + F.get(ordered, F.floor(half).cast("int"))) / 2
        rows = rows.withColumn("limit", 6.0 * middle)
        rows = rows.withColumn("weight", F.transform("off", lambda r: F.when(F.col("limit") <= 1e-12, 1.0).when(
            r >= F.col("limit"), 0.0).otherwise(F.pow(1.0 - F.pow(r / F.col("limit"), F.lit(2.0)), F.lit(2.0)))))
    out = rows.select(*keys, F.posexplode("days").alias("i", "d"), "trend", "seasonal", "weight")
    at = lambda c: F.get(c, F.col("i"))
    return out.select(*keys, F.col("d.date").alias(date), F.col("d.y").alias(value), at("trend").alias("trend"), at("seasonal").alias("seasonal"),
                      (F.col("d.y") - at("trend") - at("seasonal")).alias("residual"), at("weight").alias("weight"))


def weekday_spread(decomposed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Peak weekday and weekend minus midweek of the seasonal profile."""
    profile = decomposed.select(*keys, "dow", "seasonal").distinct()
    return profile.groupBy(*keys).agg(
        F.min_by("dow", F.struct(-F.col("seasonal"), F.col("dow"))).alias("peak_dow"),
        (F.max("seasonal") - F.min("seasonal")).alias("spread"),
        (F.avg(F.when(F.col("dow") >= 5, F.col("seasonal"))) - F.avg(F.when(F.col("dow").between(1, 4), F.col("seasonal")))).alias("weekend_minus_midweek"))


