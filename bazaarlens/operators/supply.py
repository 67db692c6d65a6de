"""Supply against demand, duplicates, contact-channel coverage and project cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarlens.functions.buckets import area_bucket
from bazaarlens.functions.columns import flag, is_explicit, is_login, is_pageview, is_positive, pct, ratio
from bazaarlens.operators.core import join_keys, quantiles, share_of_all, share_within, unpivot_row
from bazaarlens.operators.funnel import session_item_flags
from bazaarlens.operators.joins import flag_left_join, full_outer_zero, verified_chat_join
from bazaarlens.operators.quality import normalize_text
from bazaarlens.operators.stats import gini, numeric_compare, two_proportion_ztest
from bazaarlens.schemas import EXPLICIT


def item_events(events: DataFrame) -> DataFrame:
    """Explicit and positive counts per item: the only form in which events meet the dimension."""
    return events.groupBy("item_id").agg(F.count_if(is_explicit()).alias("explicit"), F.count_if(is_positive()).alias("positive"))


def supply_demand_by_category(dim: DataFrame, snapshot: DataFrame, events: DataFrame) -> DataFrame:
    """Listings and demand per category with per-1k rates and shares, plus a total row (category 0)."""
    bounds = snapshot.agg(F.struct(F.min("date").alias("lo"), F.max("date").alias("hi"))).scalar()
    days = snapshot.groupBy("item_id").agg(F.count("*").alias("days"))
    cats = dim.select("item_id", "category")
    supply = days.join(cats, "item_id").groupBy("category").agg(F.count("*").alias("listings"), F.sum("days").alias("listing_days"))
    inside = events.filter(F.col("date").between(bounds["lo"], bounds["hi"]))
    demand = item_events(inside).join(cats, "item_id").groupBy("category").agg(
        F.sum("explicit").alias("explicit"), F.sum("positive").alias("positive"))
    base = supply.join(demand, "category", "left").fillna(0, ["explicit", "positive"])
    sums = ["listings", "listing_days", "explicit", "positive"]
    both = base.rollup("category").agg(*[F.sum(c).alias(c) for c in sums]).withColumn("category", F.coalesce("category", F.lit(0)))
    whole = {c: F.max(c).over(W.partitionBy(F.lit(1))) for c in sums}
    return both.withColumns({
        "explicit_per_1k": ratio("explicit", "listings", 1000.0), "positive_per_1k": ratio("positive", "listings", 1000.0),
        "explicit_of_positive_pct": pct("explicit", "positive"), "listings_pct": pct("listings", whole["listings"]),
        "explicit_pct": pct("explicit", whole["explicit"]), "positive_pct": pct("positive", whole["positive"])})


def metro_share(dim: DataFrame, events: DataFrame, metro: Column) -> DataFrame:
    joined = dim.withColumn("metro", flag(metro)).join(item_events(events), "item_id", "left").fillna(0, ["explicit", "positive"])
    cells = joined.groupBy("category", "metro").agg(
        F.count("*").alias("listings"), F.sum("explicit").alias("explicit"), F.sum("positive").alias("positive"),
        F.count_if(F.col("positive") > 0).alias("listings_with_positive"))
    shared = share_within(share_within(cells, ["category"], "listings", "supply_pct"), ["category"], "positive", "demand_pct")
    return shared.withColumns({
        "explicit_per_1k": ratio("explicit", "listings", 1000.0), "positive_per_1k": ratio("positive", "listings", 1000.0)})


def top_cities_supply_demand(dim: DataFrame, events: DataFrame, n: int = 5) -> DataFrame:
    cities = dim.select("item_id", "city_name").join(item_events(events), "item_id", "left").groupBy("city_name").agg(
        F.count("*").alias("listings"), F.coalesce(F.sum("positive"), F.lit(0)).alias("positive"))
    scored = cities.withColumn("rank_score", F.col("listings") + F.col("positive") / 1000.0)
    best = scored.orderBy(F.desc("rank_score"), F.asc("city_name")).limit(n)
    peak = best.agg(F.struct(F.max("listings").alias("l"), F.max("positive").alias("p"))).scalar()
    return best.withColumns({"supply_index": pct("listings", peak["l"]), "demand_index": pct("positive", peak["p"])})


def area_gap(dim: DataFrame, events: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Demand percent minus supply percent per area bucket of each (category, ad type)."""
    scoped = dim.filter(F.col("ad_type").isNotNull() & F.col("area_sqm").between(1, 5000)).withColumn("area", area_bucket("area_sqm"))
    keys = ["category", "ad_type"]
    supply = share_within(scoped.groupBy(*keys, "area").agg(F.count("*").alias("listings")), keys, "listings", "supply_pct")
    wanted = scoped.select("item_id", *keys, "area").join(item_events(events).filter("positive > 0"), "item_id")
    demand = share_within(wanted.groupBy(*keys, "area").agg(F.sum("positive").alias("events")), keys, "events", "demand_pct")
    both = full_outer_zero(supply, demand, [*keys, "area"], ["listings", "supply_pct", "events", "demand_pct"])
    gap = F.col("demand_pct") - F.col("supply_pct")
    label = F.when(gap >= threshold, "under_supplied").when(gap <= -threshold, "over_supplied").otherwise("balanced")
    return both.withColumns({"gap_pp": gap, "verdict": label})


def district_gap(dim: DataFrame, events: DataFrame, dims: Sequence[str], min_supply: int = 1) -> DataFrame:
    per_item = events.groupBy("item_id").agg(F.count("*").alias("events"), F.count_if(is_explicit()).alias("contacts"))
    cells = dim.select("item_id", *dims).join(per_item, "item_id", "left").groupBy(*dims).agg(
        F.count("*").alias("supply"), F.coalesce(F.sum("events"), F.lit(0)).alias("demand"), F.coalesce(F.sum("contacts"), F.lit(0)).alias("contacts"))
    kept = cells.filter(F.col("supply") >= min_supply)
    shared = share_of_all(share_of_all(kept, "supply", "supply_pct"), "demand", "demand_pct")
    balance = ratio("supply", F.greatest(F.col("demand"), F.lit(1)))
    return shared.withColumns({"contacts_per_listing": ratio("contacts", "supply"), "log_ratio": F.ln(balance)})


def geo_hotspots(dim: DataFrame, events: DataFrame, key: str) -> DataFrame:
    joined = item_events(events).filter("positive > 0").join(dim.select("item_id", key), "item_id")
    return joined.groupBy(key).agg(
        F.sum("positive").alias("leads"), F.count("*").alias("items"), ratio(F.sum("positive"), F.count("*")).alias("leads_per_item"))


def price_landscape(dim: DataFrame, geo: str, price: str = "price", area: str = "area_sqm") -> DataFrame:
    keys = [geo, "ad_type"]
    rows = dim.withColumn("per_sqm", F.when(F.col(area) > 0, ratio(price, area)))
    base = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    a = quantiles(rows, keys, price, {"price_p25": 0.25, "price_median": 0.5, "price_p75": 0.75})
    b = quantiles(rows, keys, "per_sqm", {"sqm_p25": 0.25, "sqm_median": 0.5, "sqm_p75": 0.75})
    return join_keys(join_keys(base, a, keys, "left"), b, keys, "left")


# ---- duplicates ---------------------------------------------------------------------------------

def fingerprints(dim: DataFrame) -> DataFrame:
    texts = ("title", "city_name", "district_name", "ward_name", "price_bucket")
    return dim.filter(F.trim("title") != "").withColumns(
        {f"{c}_norm": F.coalesce(normalize_text(c), F.lit("")) for c in texts}
    ).withColumn("area_norm", F.round(F.coalesce("area_sqm", F.lit(-1.0)), 1))


DUPLICATE_LEVELS = {
    "L1_title_category": ["title_norm", "category"],
    "L2_title_geo_price": ["title_norm", "category", "ad_type", "city_name_norm", "district_name_norm", "price_bucket_norm"],
    "L3_full_fingerprint": ["title_norm", "category", "ad_type", "seller_id", "city_name_norm", "district_name_norm", "ward_name_norm",
                            "price_bucket_norm", "area_norm"],
    "L4_title_seller": ["title_norm", "category", "seller_id"],
}


def duplicate_groups(prints: DataFrame, level: str) -> DataFrame:
    """Groups of more than one listing. Grouping combines before the shuffle, so a text copied over
    a third of all listings moves as one row per map task."""
    keys = DUPLICATE_LEVELS[level]
    s = F.col("seller_id")
    return prints.groupBy(*keys).agg(
        F.count("*").alias("n_items"), (F.min(s) == F.max(s)).alias("one_seller")).filter("n_items > 1")


def duplicate_levels(dim: DataFrame) -> DataFrame:
    prints = fingerprints(dim)
    rows = prints.agg(F.count("*")).scalar()
    out = None
    for level in DUPLICATE_LEVELS:
        one = duplicate_groups(prints, level).agg(
            F.count("*").alias("groups"), F.coalesce(F.sum("n_items"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.col("n_items") - 1), F.lit(0)).alias("excess_rows"), F.count_if("one_seller").alias("same_seller"),
            F.count_if(~F.col("one_seller")).alias("multi_seller"), F.coalesce(F.max("n_items"), F.lit(0)).alias("max_size"),
        ).withColumns({"level": F.lit(level), "rows_pct": pct("rows", rows)})
        out = one if out is None else out.unionByName(one)
    return out


def duplicates_by_category(dim: DataFrame, level: str = "L2_title_geo_price") -> DataFrame:
    return duplicate_groups(fingerprints(dim), level).groupBy("category").agg(
        F.count("*").alias("groups"), F.sum("n_items").alias("rows"), F.max("n_items").alias("max_size"))


def top_duplicate_groups(dim: DataFrame, level: str = "L1_title_category", n: int = 20) -> DataFrame:
    keys = DUPLICATE_LEVELS[level]
    return duplicate_groups(fingerprints(dim), level).select(*keys, "n_items").orderBy(F.desc("n_items"), *keys).limit(n)


# ---- channel coverage ---------------------------------------------------------------------------

def channel_flags(dim: DataFrame, events: DataFrame) -> DataFrame:
    """Which explicit channels each listing ever received, and its coverage group."""
    seen = events.filter("item_id IS NOT NULL").groupBy("item_id").agg(
        F.lit(1).alias("has_event"), *[F.max(flag(F.col("event_type") == t)).alias(f"has_{t}") for t in EXPLICIT],
        F.count_if(is_pageview()).alias("pageviews"))
    flags = [f"has_{t}" for t in EXPLICIT]
    joined = dim.join(seen, "item_id", "left").fillna(0, ["has_event", *flags, "pageviews"])
    joined = joined.withColumn("n_types", sum((F.col(f) for f in flags), F.lit(0)))
    group = (
        F.when(F.col("n_types") == 4, "full_four").when(F.col("n_types") >= 1, "partial_1_3")
        .when(F.col("has_event") == 1, "zero_explicit").otherwise("no_events"))
    return joined.withColumn("coverage", group)


def channel_coverage(dim: DataFrame, events: DataFrame, key: str = "category") -> DataFrame:
    counts = channel_flags(dim, events).groupBy(key, "coverage").agg(F.count("*").alias("items"))
    return share_within(share_of_all(counts, "items", "pct_total"), [key], "items", "pct_within")


def missing_channels(dim: DataFrame, events: DataFrame) -> DataFrame:
    partial = channel_flags(dim, events).filter("coverage = 'partial_1_3'").groupBy("category").agg(
        F.count("*").alias("items"), *[F.sum(1 - F.col(f"has_{t}")).alias(t) for t in EXPLICIT])
    long = unpivot_row(partial, ["category", "items"], {t: t for t in EXPLICIT}, "channel", "n_missing")
    return long.withColumn("missing_pct", pct("n_missing", "items"))


def covered_session_items(dim: DataFrame, events: DataFrame) -> DataFrame:
    base = session_item_flags(events.filter(is_login())).filter("has_pageview = 1").select("item_id", "has_explicit")
    joined = base.join(channel_flags(dim, events).select("item_id", "coverage"), "item_id")
    return joined.withColumn("bucket", F.when(F.col("coverage") == "full_four", "full_four").otherwise("not_full_four"))


def coverage_contact_rate(dim: DataFrame, events: DataFrame) -> DataFrame:
    return covered_session_items(dim, events).groupBy("coverage").agg(
        F.count("*").alias("session_items"), F.sum("has_explicit").alias("with_explicit"), (F.avg("has_explicit") * 100).alias("contact_rate_pct"))


def coverage_ztest(dim: DataFrame, events: DataFrame) -> DataFrame:
    rows = covered_session_items(dim, events)
    return two_proportion_ztest(rows, "bucket", F.col("has_explicit") == 1, "not_full_four", "full_four")


def coverage_snapshot_cvr(dim: DataFrame, events: DataFrame, snapshot: DataFrame) -> DataFrame:
    totals = snapshot.groupBy("item_id").agg(F.sum("contacts_24h").alias("c"), F.sum("views_24h").alias("v")).filter("v > 0")
    rows = totals.join(channel_flags(dim, events).select("item_id", "coverage"), "item_id").withColumn("cvr", pct("c", "v"))
    base = rows.groupBy("coverage").agg(F.count("*").alias("listings"), F.avg("cvr").alias("mean_cvr"))
    return base.join(quantiles(rows, ["coverage"], "cvr", {"median_cvr": 0.5}), "coverage")


def coverage_sensitivity_profile(dim: DataFrame, events: DataFrame, interactions: DataFrame) -> DataFrame:
    """Full-four listings with raw chats and with chats that hold messages, and their profile."""
    chats = verified_chat_join(events, interactions).select("item_id").distinct()
    flags = flag_left_join(channel_flags(dim, events), chats, ["item_id"], "chat_verified")
    others = (F.col("has_view_phone") == 1) & (F.col("has_contact_zalo") == 1) & (F.col("has_contact_sms") == 1)
    return flags.groupBy("coverage").agg(
        F.count("*").alias("items"), F.count_if(others & (F.col("has_contact_chat") == 1)).alias("full_four_raw"),
        F.count_if(others & (F.col("chat_verified") == 1)).alias("full_four_verified"), F.avg("images_count").alias("avg_images"),
        F.avg("area_sqm").alias("avg_area"), (F.avg(flag(F.col("ad_type") == "sell")) * 100).alias("sell_pct"),
        (F.avg(flag(F.col("seller_type") == "agent")) * 100).alias("agent_pct"))


# ---- project cohort -----------------------------------------------------------------------------

def with_project(dim: DataFrame) -> DataFrame:
    return dim.withColumn("has_project", flag(F.coalesce(F.trim("project_id") != "", F.lit(False))))


def project_cohort(dim: DataFrame, snapshot: DataFrame, events: DataFrame) -> DataFrame:
    """Listings with and without a project: supply, snapshot performance, CVR per category."""
    perf = snapshot.groupBy("item_id").agg(F.sum("views_24h").alias("v"), F.sum("contacts_24h").alias("c"))
    joined = with_project(dim).join(perf, "item_id", "left").join(item_events(events), "item_id", "left").fillna(
        0, ["v", "c", "explicit", "positive"])
    cells = joined.groupBy("category", "has_project").agg(
        F.count("*").alias("listings"), F.avg("v").alias("avg_views"), F.avg("c").alias("avg_contacts"),
        pct(F.sum("c"), F.sum("v")).alias("contact_rate_pct"), pct(F.count_if(F.col("positive") > 0), F.count("*")).alias("positive_cvr_pct"),
        pct(F.count_if(F.col("explicit") > 0), F.count("*")).alias("explicit_cvr_pct"))
    return share_within(cells, ["category"], "listings", "supply_pct")


def cross_category_projects(dim: DataFrame) -> DataFrame:
    """Projects listed under more than one category, with the category list."""
    pairs = dim.filter("project_id IS NOT NULL").groupBy("project_id", "category").agg(F.count("*").alias("n"))
    return pairs.groupBy("project_id").agg(
        F.count("*").alias("categories"), F.sum("n").alias("listings"),
        F.array_join(F.sort_array(F.collect_list(F.col("category").cast("string"))), ", ").alias("category_list")).filter("categories > 1")


def project_concentration(dim: DataFrame) -> DataFrame:
    items = dim.filter("project_id IS NOT NULL").groupBy("category", "project_id").agg(F.count("*").alias("n"))
    base = items.groupBy("category").agg(F.count("*").alias("projects"), F.max("n").alias("max_items"), F.avg("n").alias("avg_items"))
    spread = quantiles(items.withColumnRenamed("n", "x"), ["category"], "x", {"median_items": 0.5}, bounded=True)
    return base.join(spread, "category").join(gini(items.withColumnRenamed("n", "x"), ["category"], "x", bounded=True), "category")


def project_profile(dim: DataFrame, columns: Sequence[str]) -> DataFrame:
    return numeric_compare(with_project(dim), "has_project", columns)


def project_interest(dim: DataFrame, events: DataFrame) -> DataFrame:
    """Users who looked at project listings: how many, and how many contacted one."""
    keys = with_project(dim).select("item_id", "has_project")
    users = events.join(keys, "item_id").groupBy("has_project", "user_id").agg(
        F.max(flag(is_pageview())).alias("v"), F.max(flag(is_explicit())).alias("e"))
    return users.groupBy("has_project").agg(
        F.count("*").alias("users"), F.sum("v").alias("viewers"), F.sum("e").alias("contacters"),
        pct(F.count_if((F.col("v") == 1) & (F.col("e") == 1)), F.sum("v")).alias("viewer_contact_pct"))


