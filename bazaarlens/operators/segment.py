"""Entity feature tables, clusters, rule labels, health segments and activity cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarlens.functions.buckets import event_flags
from bazaarlens.functions.columns import flag, is_explicit, is_pageview, is_positive, pct, ratio, seconds
from bazaarlens.operators.components import components
from bazaarlens.operators.core import join_keys, quantiles, top_n
from bazaarlens.operators.stats import entropy
from bazaarlens.operators.windows import pct_rank
from bazaarlens.session import durable


def enriched_events(events: DataFrame, dim: DataFrame) -> DataFrame:
    attrs = dim.select("item_id", "district_name", "area_sqm", "bedrooms", "ad_type")
    return event_flags(events).join(attrs, "item_id").withColumn("contact", flag(is_explicit()))


def user_intent_features(events: DataFrame, dim: DataFrame, min_events: int = 5) -> DataFrame:
    """Behavior of every (user, category) with enough events, with district entropy."""
    ev = enriched_events(events, dim)
    keys = ["user_id", "category"]
    viewed = F.col("is_pageview") == 1
    base = ev.groupBy(*keys).agg(
        F.count("*").alias("n_events"), F.countDistinct("session_id").alias("n_sessions"), F.countDistinct("item_id").alias("n_listings"),
        F.countDistinct("district_name").alias("n_districts"), F.sum("is_pageview").alias("n_pageviews"), F.sum("contact").alias("n_contacts"),
        F.sum("is_search").alias("n_searches"), pct(F.sum("contact"), F.sum("is_pageview")).alias("contact_rate_pct"),
        (F.avg("is_weekend") * 100).alias("weekend_pct"), (F.avg("is_night") * 100).alias("night_pct"),
        F.avg(F.when(viewed, F.col("dwell_time_sec"))).alias("avg_dwell"), F.avg(F.when(viewed, F.col("position"))).alias("avg_position"),
        F.avg("area_sqm").alias("avg_area"), F.avg("bedrooms").alias("avg_bedrooms"),
        (F.avg(flag(F.col("ad_type") == "let")) * 100).alias("let_pct")).filter(F.col("n_events") >= min_events)
    places = ev.filter("district_name IS NOT NULL").groupBy(*keys, "district_name").agg(F.count("*").alias("c"))
    spread = entropy(places, keys, "c").select(*keys, F.col("entropy").alias("district_entropy"))
    return join_keys(base, spread, keys, "left").fillna(0.0, ["district_entropy"])


def snapshot_medians(snapshot: DataFrame) -> DataFrame:
    """Medians per listing; a listing has at most one row per day, so each group is small."""
    return snapshot.groupBy("item_id").agg(
        F.median("views_24h").alias("median_views"), F.median("contacts_24h").alias("median_contacts"), F.median("listing_age_days").alias("median_age"))


def listing_behavior_features(events: DataFrame, dim: DataFrame, snapshot: DataFrame, min_views: int = 5) -> DataFrame:
    v = is_pageview()
    base = events.groupBy("item_id", "category").agg(
        F.count_if(v).alias("n_pageviews"), F.count_if(is_explicit()).alias("n_contacts"), F.countDistinct("user_id").alias("n_users"),
        F.avg(F.when(v, F.col("dwell_time_sec"))).alias("avg_dwell"), F.avg(F.when(v, F.col("position"))).alias("avg_position"),
        pct(F.count_if(is_explicit()), F.count_if(v)).alias("contact_rate_pct")).filter(F.col("n_pageviews") >= min_views)
    pairs = events.groupBy("item_id", "user_id").agg(F.count_if(v).alias("pv"))
    repeat = pairs.groupBy("item_id").agg(pct(F.count_if(F.col("pv") > 1), F.count("*")).alias("repeat_viewer_pct"))
    attrs = dim.select("item_id", "ad_type", "area_sqm", "district_name", "seller_type")
    return base.join(attrs, "item_id").join(repeat, "item_id", "left").join(snapshot_medians(snapshot), "item_id", "left")


def seller_features(events: DataFrame, dim: DataFrame, min_listings: int = 3) -> DataFrame:
    items = events.groupBy("item_id").agg(
        F.count_if(is_pageview()).alias("pv"), F.count_if(is_explicit()).alias("ct"),
        pct(F.count_if(is_explicit()), F.count_if(is_pageview())).alias("rate"))
    joined = dim.filter("seller_id IS NOT NULL").select("item_id", "seller_id", "category", "seller_type").join(items, "item_id", "left")
    sellers = joined.groupBy("seller_id", "category", "seller_type").agg(
        F.count("*").alias("n_listings"), F.coalesce(F.sum("pv"), F.lit(0)).alias("pageviews"), F.coalesce(F.sum("ct"), F.lit(0)).alias("contacts"),
        F.avg(F.coalesce("rate", F.lit(0.0))).alias("avg_listing_rate")).filter(F.col("n_listings") >= min_listings)
    return sellers.withColumns({"contacts_per_listing": ratio("contacts", "n_listings"), "pageviews_per_listing": ratio("pageviews", "n_listings")})


def session_journey_features(events: DataFrame, min_events: int = 3, owner: bool = False) -> DataFrame:
    """Behavior of every (session, category) with enough events; with ``owner`` also its user (the largest id of several)."""
    ev = event_flags(events)
    users = [F.max("user_id").alias("user_id")] if owner else []
    s = ev.groupBy("session_id", "category").agg(
        F.max("device").alias("device"), F.count("*").alias("n_events"), F.countDistinct("item_id").alias("n_items"),
        F.max("is_search").alias("has_search"), F.max(flag(is_explicit())).alias("has_contact"), F.sum("is_pageview").alias("n_pageviews"),
        F.max("dwell_time_sec").alias("max_dwell"), F.avg(F.when(F.col("is_pageview") == 1, F.col("dwell_time_sec"))).alias("avg_dwell"),
        ((seconds(F.max("event_ts")) - seconds(F.min("event_ts"))) / 60.0).alias("duration_min"), *users).filter(F.col("n_events") >= min_events)
    deep = (F.col("n_items") >= 3) & (F.coalesce("max_dwell", F.lit(0.0)) >= 60)
    bounce = (F.col("n_pageviews") >= 2) & (F.col("has_contact") == 0) & (F.coalesce("avg_dwell", F.lit(0.0)) < 15)
    return s.withColumns({"deep_compare": flag(deep), "bounce_like": flag(bounce)})


def behavioral_clusters(features: DataFrame, key: str, columns: Sequence[str], groups: Sequence, k: int = 5, seed: int = 42) -> DataFrame:
    """Robust-scaled k-means per category with a 2-D projection; entities keep cluster, x and y.

    The features are written once, in order, so that every fit iterates over that table and starts
    from the same rows.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA, RobustScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    table = durable(features.fillna(0.0, list(columns)).sort("category", key), "features")
    out = None
    for group in groups:
        part = table.filter(F.col("category") == group)
        if part.isEmpty():
            continue
        stages = [
            VectorAssembler(inputCols=list(columns), outputCol="__raw"),
            RobustScaler(inputCol="__raw", outputCol="__scaled", withCentering=True),
            KMeans(k=k, seed=seed, featuresCol="__scaled", predictionCol="cluster"),
            PCA(k=2, inputCol="__scaled", outputCol="__pc"),
        ]
        fitted = Pipeline(stages=stages).fit(part).transform(part)
        xy = vector_to_array("__pc")
        one = fitted.select(key, "category", "cluster", xy[0].alias("x"), xy[1].alias("y"), *columns)
        out = one if out is None else out.unionByName(one)
    return out


def projected(features: DataFrame, key: str, columns: Sequence[str], groups: Sequence) -> DataFrame:
    """(key, category, x, y, columns): robust-scaled features of each category on their two main axes."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, RobustScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    table = durable(features.fillna(0.0, list(columns)), "features")
    out = None
    for group in groups:
        part = table.filter(F.col("category") == group)
        if part.isEmpty():
            continue
        stages = [VectorAssembler(inputCols=list(columns), outputCol="__raw"), RobustScaler(inputCol="__raw", outputCol="__scaled", withCentering=True), PCA(k=2, inputCol="__scaled", outputCol="__pc")]
        xy = vector_to_array("__pc")
        one = Pipeline(stages=stages).fit(part).transform(part).select(key, "category", xy[0].alias("x"), xy[1].alias("y"), *columns)
        out = one if out is None else out.unionByName(one)
    return table.select(key, "category", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), *columns).limit(0) if out is None else out


def density_clusters(points: DataFrame, groups: Sequence[str] = ("category",), side: float = 0.5, min_points: int = 10) -> DataFrame:
    """The rows of ``points`` (x, y) with ``cluster``: 0 is the largest of its group, -1 is noise.

    The plane is cut into squares of ``side``. A square is dense where it and its eight neighbours
    hold ``min_points`` rows; touching dense squares are one cluster; a square that is not dense
    belongs to its fullest dense neighbour (ties: the first), else its rows are noise. All work is done on counted squares,
    so a square with a third of the rows is one row. Rows without finite coordinates are noise.
    """
    groups = list(groups)
    sound = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    square = lambda c: F.when(sound("x") & sound("y"), F.floor(F.col(c) / side))
    placed = points.withColumns({"__i": square("x"), "__j": square("y")})
    here = [*groups, "__i", "__j"]
    squares = durable(placed.filter(F.col("__i").isNotNull()).groupBy(*here).agg(F.count("*").alias("n")), "squares")
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    spread = squares.withColumn("__o", F.explode(around)).select(*groups, (F.col("__i") + F.col("__o.a")).alias("__i"), (F.col("__j") + F.col("__o.b")).alias("__j"), "n")
    reach = spread.groupBy(*here).agg(F.sum("n").alias("__around"))
    dense = durable(join_keys(squares, reach, here).filter(F.col("__around") >= min_points).select(
        *here, "n", F.struct(*groups, "__i", "__j").alias("id")), "dense")
    near = dense.withColumn("__o", F.explode(around)).select(
        *groups, (F.col("__i") + F.col("__o.a")).alias("__i"), (F.col("__j") + F.col("__o.b")).alias("__j"), F.col("id").alias("a"), F.col("n").alias("a_n"))
    links = join_keys(near, dense.select(*here, F.col("id").alias("b")), here).filter("a <> b").select("a", "b")
    joined = dense.select(*here, "id").join(components(links).withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"), "left")
    core = durable(joined.select(*here, "id", F.coalesce("component", "id").alias("component")), "core")
    fullest = near.groupBy(*here).agg(F.min(F.struct((-F.col("a_n")).alias("n"), "a")).alias("best"))
    border = join_keys(join_keys(squares, dense.select(*here, "id"), here, "left").filter(F.col("id").isNull()), fullest, here).select(*here, F.col("best.a").alias("__id"))
    border = border.join(core.select("id", "component"), F.col("__id") == F.col("id")).select(*here, "component")
    owned = durable(core.select(*here, "component").unionByName(border), "owned")
    sizes = join_keys(owned, squares, here).groupBy(*groups, "component").agg(F.sum("n").alias("__rows"))
    by_size = W.partitionBy(*groups).orderBy(F.desc("__rows"), F.asc("component"))
    numbered = sizes.withColumn("cluster", F.row_number().over(by_size) - 1)  # one row per cluster
    labels = owned.join(numbered.select(F.col("component").alias("__c"), "cluster"), F.col("component") == F.col("__c")).select(*here, "cluster")
    return join_keys(placed, labels, here, "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1))).drop("__i", "__j")


def cluster_profiles(clustered: DataFrame, columns: Sequence[str]) -> DataFrame:
    return clustered.groupBy("category", "cluster").agg(F.count("*").alias("size"), *[F.avg(c).alias(c) for c in columns])


def user_rule_label() -> Column:
    c = F.col
    return (
        F.when((c("contact_rate_pct") >= 8) & (c("n_contacts") >= 2), "High-intent / urgent")
        .when((F.coalesce("contact_rate_pct", F.lit(0.0)) < 1) & (c("n_pageviews") >= 15), "Window shopper")
        .when(c("district_entropy") >= 1.8, "Geo explorer").when(c("night_pct") >= 40, "Night-active searcher")
        .when(c("avg_area") >= 120, "Large-space seeker").otherwise("Typical browser"))


def listing_rule_label() -> Column:
    rate, views = F.coalesce("contact_rate_pct", F.lit(0.0)), F.col("n_pageviews")
    age = F.when(F.coalesce("median_age", F.lit(0.0)) == 0, 999.0).otherwise(F.col("median_age"))
    return (
        F.when((rate >= 25) & (views >= 20), "High-conversion gem").when((views >= 50) & (rate < 3), "Clickbait / high view low contact")
        .when((age <= 7) & (rate >= 10), "Fresh fast-moving").when((age >= 60) & (views < 15), "Cold inventory").otherwise("Evergreen average"))


def health_segments(listings: DataFrame) -> DataFrame:
    """Contact-rate and exposure percentiles per category and the two problem segments."""
    rows = listings.withColumn("exposure", F.coalesce("median_views", F.col("n_pageviews").cast("double")))
    ranked = pct_rank(pct_rank(rows, ["category"], "contact_rate_pct", "contact_rank"), ["category"], "exposure", "exposure_rank")
    c, e = F.col("contact_rank"), F.col("exposure_rank")
    segment = (
        F.when((c <= 0.25) & (e >= 0.75), "oversaturated_low_conversion")
        .when((c >= 0.75) & (e <= 0.35), "high_quality_underexposed").otherwise("normal"))
    return ranked.withColumn("health_segment", segment)


def with_positive(health: DataFrame, events: DataFrame) -> DataFrame:
    keys = events.filter(is_positive()).select("item_id").distinct().withColumn("__p", F.lit(1))
    return health.join(keys, "item_id", "left").withColumn("has_positive", F.coalesce("__p", F.lit(0))).drop("__p")


def segment_bridge(health: DataFrame, dims: Sequence[str], min_n: int = 30) -> DataFrame:
    """CVR of listings by any of health segment, cluster, ad type."""
    return health.groupBy(*dims).agg(
        F.count("*").alias("n"), F.sum("has_positive").alias("n_positive"), (F.avg("has_positive") * 100).alias("cvr_pct")).filter(F.col("n") >= min_n)


def segment_efficiency(health: DataFrame) -> DataFrame:
    keys = ["category", "health_segment"]
    base = health.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("contact_rate_pct").alias("avg_rate"), F.avg("exposure").alias("avg_exposure"),
        F.avg("n_pageviews").alias("avg_pageviews"), F.avg("n_users").alias("avg_users"), F.avg("repeat_viewer_pct").alias("avg_repeat"),
        F.avg("median_age").alias("avg_age"))
    rate = quantiles(health, keys, "contact_rate_pct", {"med_rate": 0.5})
    seen = quantiles(health, keys, "exposure", {"med_exposure": 0.5})
    return join_keys(join_keys(base, rate, keys, "left"), seen, keys, "left")


def ranked_underexposed(health: DataFrame, n: int = 500) -> DataFrame:
    """Underexposed listings by contact rank minus exposure rank, per category."""
    rows = health.filter("health_segment = 'high_quality_underexposed'").withColumn("lift_score", F.col("contact_rank") - F.col("exposure_rank"))
    return top_n(rows, ["category"], [F.desc("lift_score"), F.asc("item_id")], n).select(
        "category", "item_id", "rank", "lift_score", "contact_rate_pct", "exposure", "has_positive")


def user_positive_rate(users: DataFrame, events: DataFrame, group: str) -> DataFrame:
    keys = ["user_id", "category"]
    positive = events.filter(is_positive()).select(*keys).distinct().withColumn("__p", F.lit(1))
    joined = users.join(positive, keys, "left").withColumn("p", F.coalesce("__p", F.lit(0)))
    return joined.groupBy("category", group).agg(F.count("*").alias("users"), (F.avg("p") * 100).alias("positive_pct"))


def session_funnel_by_cluster(events: DataFrame, sessions: DataFrame, clusters: DataFrame) -> DataFrame:
    """Contact, search, compare and bounce rates per user cluster; unclustered users are -1. Sessions that
    do not carry their ``user_id`` get it from the events."""
    if "user_id" in sessions.columns:
        owned = sessions.filter("session_id IS NOT NULL AND category IS NOT NULL")
    else:
        owned = sessions.join(events.groupBy("session_id", "category").agg(F.max("user_id").alias("user_id")), ["session_id", "category"])
    joined = owned.join(
        clusters.select("user_id", "category", "cluster"), ["user_id", "category"], "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
    return joined.groupBy("category", "cluster").agg(
        F.count("*").alias("sessions"), *[(F.avg(c) * 100).alias(f"{c}_pct") for c in ("has_contact", "has_search", "deep_compare", "bounce_like")])


def what_if_impacts(efficiency: DataFrame, sessions: DataFrame, slices: DataFrame, target_exposure: float = 4.0, cvr_gain: float = 2.0) -> DataFrame:
    """Four scenario values per category from segment aggregates."""
    def seg(name: str, column: str) -> Column:
        return F.max(F.when(F.col("health_segment") == name, F.col(column).cast("double")))

    hq, over = "high_quality_underexposed", "oversaturated_low_conversion"
    wide = efficiency.groupBy("category").agg(
        (seg(hq, "n") * seg(hq, "avg_pageviews") * F.greatest(F.lit(target_exposure) - seg(hq, "med_exposure"), F.lit(0.0))
         * seg(hq, "avg_rate") / 100.0 * 0.35).alias("boost"),
        (seg(over, "n") * seg(over, "med_exposure") * seg(over, "avg_pageviews") * 0.25).alias("demote"))
    leads = sessions.groupBy("category").agg((F.countDistinct("session_id") * F.lit(0.01)).alias("session"))
    weak = slices.groupBy("category").agg((F.sum("listings") * F.lit(cvr_gain / 100.0)).alias("weak"))
    joined = join_keys(join_keys(wide, leads, ["category"], "left"), weak, ["category"], "left")
    rows = [F.struct(F.lit(n).alias("scenario"), F.coalesce(F.col(c), F.lit(0.0)).alias("value"), F.lit(u).alias("unit")) for n, c, u in (
        ("boost_underexposed", "boost", "contact events"), ("session_plus_1pp", "session", "sessions with contact"),
        ("demote_oversaturated", "demote", "impressions saved"), ("weak_slice_lift", "weak", "listings with contact"))]
    return joined.select("category", F.explode(F.array(*rows)).alias("r")).select("category", "r.*")


def activity_cohorts(users: DataFrame, value: str, low: float = 0.33, high: float = 0.67) -> DataFrame:
    cuts = quantiles(users, [], value, {"lo": low, "hi": high}, bounded=True).select(F.struct("lo", "hi")).scalar()
    v = F.col(value)
    return users.withColumn("cohort", F.when(v <= cuts["lo"], "cold").when(v <= cuts["hi"], "warm").otherwise("hot"))


def cohort_scores(scores: DataFrame, cohorts: DataFrame, score: str = "score") -> DataFrame:
    joined = scores.join(cohorts.select("user_id", "cohort"), "user_id")
    base = joined.groupBy("cohort").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return base.join(quantiles(joined, ["cohort"], score, {"median": 0.5, "q25": 0.25, "q75": 0.75}), "cohort")


def item_tiers(dim: DataFrame, events: DataFrame, snapshot: DataFrame, as_of: str, fact_start: str, recent_days: int = 30) -> DataFrame:
    """A active, B older events, C no events but contacts, D dead or deleted; with the facts behind it."""
    end = F.lit(as_of).cast("date")
    seen = events.filter(is_positive()).groupBy("item_id").agg(
        F.count("*").alias("n_pos"), F.countDistinct("user_id").alias("n_users"), F.min("date").alias("first_event"), F.max("date").alias("last_event"))
    days = snapshot.groupBy("item_id").agg(
        F.count("*").alias("n_days"), F.sum("views_24h").alias("views_total"), F.sum("contacts_24h").alias("contacts_total"))
    joined = dim.join(seen, "item_id", "left").join(days, "item_id", "left").fillna(
        0, ["n_pos", "n_users", "n_days", "views_total", "contacts_total"])
    recency = F.datediff(end, "last_event")
    dead = ((F.col("n_pos") == 0) & (F.col("contacts_total") == 0)) | (F.lower(F.coalesce("ad_status", F.lit(""))) == "deleted")
    tier = F.when(dead, "D").when((F.col("n_pos") > 0) & (recency <= recent_days), "A").when(F.col("n_pos") > 0, "B").otherwise("C")
    return joined.withColumns({
        "age_days": F.datediff(end, "posted_date"), "is_pre_window": flag(F.col("posted_date") < F.lit(fact_start).cast("date")),
        "recency_days": recency, "is_dead": flag(dead), "tier": tier})
