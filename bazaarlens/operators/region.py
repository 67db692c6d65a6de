"""Regional portfolio: cells of (region, city, category, ad type), growth, quadrants, actions.

Events shrink to one row per item before anything is joined; a cell table has at most
cities x categories x ad types rows, so windows over it are small at any data size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarlens.functions.columns import flag, is_explicit, is_positive, pct, ratio
from bazaarlens.operators.core import join_keys, share_of_all, top_n
from bazaarlens.operators.joins import alias_lookup, full_outer_zero
from bazaarlens.session import durable

CELL = ["region", "city_name", "is_metro", "category", "ad_type"]
SEGMENT = ["region", "category", "ad_type"]
QUADRANTS = ["stars", "cash_cows", "question_marks", "dogs"]
# Weight of an uplift by quadrant, band around the median, unstable survival.
MULTIPLIER = {"stars": 1.0, "cash_cows": 0.95, "question_marks": 0.85, "dogs": 0.50}
BUFFER_PCT = 5.0
UNSTABLE_SURVIVAL = 0.30
UNSTABLE_FACTOR = 0.7
# Pools for the medians, from the narrowest to all cells.
SCOPES = [
    ("regional", ["region", "category", "ad_type"]), ("national_cat_ad", ["category", "ad_type"]),
    ("national_cat", ["category"]), ("national_ad", ["ad_type"]), ("national_all", []),
]


def period_middle(events: DataFrame) -> Column:
    """Middle day of the events' window, as a scalar subquery."""
    lo, hi = F.min("date"), F.max("date")
    return events.agg(F.date_add(lo, F.floor(F.datediff(hi, lo) / 2).cast("int"))).scalar()


def regional_totals(events: DataFrame, dim: DataFrame, mapping: DataFrame, metro: Column) -> DataFrame:
    """Listings, contacts and half-period counts per cell; cells with supply or demand only stay."""
    mid = period_middle(events)
    early = F.col("date") < mid
    items = events.groupBy("item_id").agg(
        F.count_if(is_explicit()).alias("explicit"), F.count_if(is_positive()).alias("positive"),
        F.count_if(is_explicit() & early).alias("explicit_h1"), F.count_if(is_explicit() & ~early).alias("explicit_h2"),
        F.count_if(is_positive() & early).alias("positive_h1"), F.count_if(is_positive() & ~early).alias("positive_h2"))
    placed = alias_lookup(dim.select("item_id", "city_name", "category", "ad_type"), mapping, "city_name", "region")
    placed = placed.withColumn("is_metro", flag(metro))
    measures = ["explicit", "positive", "explicit_h1", "explicit_h2", "positive_h1", "positive_h2"]
    supply = placed.groupBy(*CELL).agg(F.count("*").alias("listings"))
    demand = items.join(placed, "item_id").groupBy(*CELL).agg(*[F.sum(m).alias(m) for m in measures])
    cells = full_outer_zero(supply, demand, CELL, ["listings", *measures])
    return cells.withColumns({
        "explicit_per_1k": ratio("explicit", "listings", 1000.0), "positive_per_1k": ratio("positive", "listings", 1000.0)})


def share_excluding_metro(cells: DataFrame) -> DataFrame:
    """Share inside the segment without the metropolis; the metropolis as share of the nation."""
    outside = F.col("is_metro") == 0
    w = W.partitionBy(*SEGMENT)
    totals = cells.agg(F.struct(F.sum("explicit").alias("e"), F.sum("positive").alias("p"))).scalar()
    out = cells
    for m, key in (("explicit", "e"), ("positive", "p")):
        rest = F.sum(F.when(outside, F.col(m))).over(w)
        out = out.withColumn(f"share_{m}_pct", F.when(outside, pct(m, rest)))
        out = out.withColumn(f"metro_{m}_nation_pct", F.when(~outside, pct(m, totals[key])))
    return out


def growth_pct(h1: Column, h2: Column) -> Column:
    """Percent change; 0 from nothing to nothing, NULL from nothing to something."""
    return F.when((h1 <= 0) & (h2 > 0), None).when(h1 <= 0, 0.0).otherwise(F.try_divide(F.lit(100.0) * (h2 - h1), h1.cast("double")))


def half_period_growth(cells: DataFrame) -> DataFrame:
    c = F.col
    halves = cells.withColumns({
        "cvr_per_listing": ratio("explicit", "listings"), "cvr_h1": ratio("explicit_h1", "listings"), "cvr_h2": ratio("explicit_h2", "listings")})
    return halves.withColumns({
        "growth_explicit_pct": growth_pct(c("explicit_h1"), c("explicit_h2")), "growth_positive_pct": growth_pct(c("positive_h1"), c("positive_h2")),
        "growth_cvr_pct": growth_pct(c("cvr_h1"), c("cvr_h2")),
        "is_new_market": flag((c("explicit_h1") == 0) & (c("explicit_h2") > 0))})


def eligible(min_listings: int, min_explicit: int) -> Column:
    return (F.col("is_metro") == 0) & (F.col("listings") >= min_listings) & (F.col("explicit") >= min_explicit)


def _pool(cells: DataFrame, keys: Sequence[str], name: str, ok: Column) -> DataFrame:
    median = F.percentile("explicit_per_1k", F.lit(0.5))
    peak = F.max("explicit_per_1k")
    return cells.filter(ok).groupBy(*keys).agg(
        F.count("*").alias(f"n_{name}"), F.percentile("growth_cvr_pct", F.lit(0.5)).alias(f"growth_{name}"),
        F.try_divide(median, peak).alias(f"rel_{name}"), peak.alias(f"peak_{name}"),
        F.percentile("cvr_per_listing", F.lit(0.5)).alias(f"cvr_{name}"))


def reference_median_pool(cells: DataFrame, min_listings: int, min_explicit: int, regional: bool = True) -> DataFrame:
    """Medians of the narrowest pool with at least two eligible cells, for every cell."""
    ok = eligible(min_listings, min_explicit)
    out = cells
    names = []
    for name, keys in SCOPES:
        pool = _pool(cells, keys, name, ok)
        if keys:
            out = join_keys(out, pool, keys, "left")
        else:
            one = pool.select(F.struct(*pool.columns)).scalar()
            out = out.withColumns({c: one[c] for c in pool.columns})
        names.append(name)
    usable = names if regional else names[1:]

    def pick(prefix: str) -> Column:
        chosen = None
        for n in usable:
            chosen = (F if chosen is None else chosen).when(F.col(f"n_{n}") >= 2, F.col(f"{prefix}_{n}"))
        return chosen

    scope = None
    for n in usable:
        scope = (F if scope is None else scope).when(F.col(f"n_{n}") >= 2, F.lit(n))
    target = (
        F.when(F.col("median_scope") == "national_cat", F.col("cvr_national_cat"))
        .when(F.col("median_scope") == "national_ad", F.col("cvr_national_ad"))
        .when(F.col("median_scope") == "national_all", F.col("cvr_national_all")).otherwise(F.col("cvr_national_cat_ad")))
    out = out.withColumns({
        "eligible": flag(ok), "median_scope": scope.otherwise("none"), "median_growth": pick("growth"), "median_relative": pick("rel"),
        "pool_peak": pick("peak")}).withColumn("cvr_target", target)
    out = out.withColumn("relative_cvr", F.when(F.col("eligible") == 1, F.try_divide(F.col("explicit_per_1k"), F.when(F.col("pool_peak") > 0, F.col("pool_peak")))))
    helpers = [f"{p}_{n}" for n in names for p in ("n", "growth", "rel", "peak", "cvr")]
    return out.drop(*helpers)


def _corner(high_growth: Column, high_share: Column) -> Column:
    return (
        F.when(high_growth & high_share, "stars").when(high_share, "cash_cows").when(high_growth, "question_marks").otherwise("dogs"))


def portfolio_quadrants(cells: DataFrame, min_listings: int, min_explicit: int, regional: bool = True) -> DataFrame:
    """Quadrant of every cell against its pool medians."""
    ref = reference_median_pool(half_period_growth(cells), min_listings, min_explicit, regional)
    g, s, mg, ms = (F.col(c) for c in ("growth_cvr_pct", "relative_cvr", "median_growth", "median_relative"))
    quadrant = (
        F.when(F.col("is_metro") == 1, "metro_excluded").when(F.col("eligible") == 0, "low_volume")
        .when(F.col("is_new_market") == 1, "question_marks").when(mg.isNull() | ms.isNull(), "low_volume")
        .when(g.isNull(), "question_marks").otherwise(_corner(g >= mg, F.coalesce(s >= ms, F.lit(False)))))
    return ref.withColumn("quadrant", quadrant)


def action_matrix(quadrants: DataFrame, survival: DataFrame) -> DataFrame:
    """Gaps to the medians, expected uplift, impact, defence, weakness and deep-dive flag per cell.

    The scored cells are written once because ranks, cuts and the defence list each read them.
    """
    keys = ["region", "city_name", "category", "ad_type"]
    rows = quadrants.filter((F.col("eligible") == 1) & F.col("quadrant").isin(QUADRANTS))
    rows = join_keys(rows, survival.select(*keys, "survival_rate", "churn_pct", "growth_quality"), keys, "left")
    g, s, mg, ms, target, cvr = (F.col(c) for c in (
        "growth_cvr_pct", "relative_cvr", "median_growth", "median_relative", "cvr_target", "cvr_per_listing"))
    lo, hi = 1 - BUFFER_PCT / 100, 1 + BUFFER_PCT / 100
    near_g = F.coalesce((g > mg * lo) & (g < mg * hi) & s.isNotNull(), F.lit(False))
    near_s = F.coalesce((s > ms * lo) & (s < ms * hi) & g.isNotNull(), F.lit(False))
    axis = F.when(near_g & near_s, "both").when(near_g, "growth").when(near_s, "cvr").otherwise("")
    weights = reduce(lambda acc, q: acc.when(F.col("quadrant") == q, F.lit(MULTIPLIER[q])), QUADRANTS[1:],
                     F.when(F.col("quadrant") == QUADRANTS[0], F.lit(MULTIPLIER[QUADRANTS[0]])))
    known = g.isNotNull() & mg.isNotNull() & s.isNotNull() & ms.isNotNull()
    weak = (
        F.when(~known, "unknown").when((g < mg) & (s < ms), "both").when(g < mg, "growth").when(s < ms, "cvr").otherwise("none"))
    uplift = F.coalesce(F.greatest(F.lit(0.0), (target - cvr) * F.col("listings")), F.lit(0.0))
    stable = F.when(F.col("survival_rate") < UNSTABLE_SURVIVAL, UNSTABLE_FACTOR).otherwise(1.0)
    defend = F.when(F.col("quadrant").isin("stars", "cash_cows") & (g < mg), F.col("explicit") * (mg - g) / 100.0).otherwise(0.0)
    rows = rows.withColumns({
        "borderline_axis": axis, "borderline_flag": flag(axis != ""), "growth_gap_pp": g - mg, "cvr_gap": s - ms,
        "uplift_explicit": uplift, "priority_impact": uplift * weights * stable, "priority_defend": F.coalesce(defend, F.lit(0.0)),
        "primary_weakness": weak, "need_growth_pp": F.greatest(F.lit(0.0), mg - g), "need_cvr": F.greatest(F.lit(0.0), (ms - s) * target)})
    rows = durable(rows, "actions")
    n = F.count("*").over(W.partitionBy(F.lit(1)))
    tied = F.count("*").over(W.partitionBy("explicit"))
    rank = F.rank().over(W.partitionBy(F.lit(1)).orderBy("explicit")) + (tied - 1) / 2.0
    rows = rows.withColumn("explicit_pct_rank", rank / n * 100.0)
    cuts = rows.agg(F.struct(F.percentile("explicit", F.lit(0.75)).alias("e"), F.percentile("priority_impact", F.lit(0.8)).alias("i"))).scalar()
    best = rows.orderBy(F.desc("priority_defend"), *keys).limit(10).select(*keys, F.lit(1).alias("__d"))
    rows = join_keys(rows, best, keys, "left")
    deep = (F.col("priority_impact") >= cuts["i"]) | F.col("__d").isNotNull() | (
        F.col("quadrant").isin("question_marks", "dogs") & (F.col("explicit") >= cuts["e"]))
    return rows.withColumn("deep_dive", flag(deep)).drop("__d")


def peer_top3(action: DataFrame) -> DataFrame:
    """The three largest other cities of the same segment and quadrant, as text.

    Of a group's four largest cells at least three are not the row's own city, so each row needs
    only those four: one bounded list per group instead of a self join of all pairs.
    """
    keys = ["category", "ad_type", "quadrant"]
    label = F.concat(F.col("city_name"), F.lit("("), F.round("cvr_per_listing", 1).cast("string"), F.lit(")"))
    largest = top_n(action.select(*keys, "region", "city_name", "explicit", label.alias("label")), keys,
                    [F.desc("explicit"), F.asc("city_name")], 4, "r")
    lists = largest.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("r", "city_name", "label"))).alias("l"))
    joined = join_keys(action, lists, keys, "left")
    others = F.slice(F.filter("l", lambda x: x["city_name"] != F.col("city_name")), 1, 3)
    return joined.withColumn("peers", F.array_join(F.transform(others, lambda x: x["label"]), "; ")).select(
        "region", "city_name", "category", "ad_type", "quadrant", "peers")


def quadrant_profiles(action: DataFrame) -> DataFrame:
    return action.groupBy("quadrant").agg(
        F.count("*").alias("cells"), F.sum("explicit").alias("explicit"), F.percentile("cvr_per_listing", F.lit(0.5)).alias("median_cvr"),
        F.percentile("growth_cvr_pct", F.lit(0.5)).alias("median_growth"), F.percentile("listings", F.lit(0.5)).alias("median_listings"),
        (F.avg("borderline_flag") * 100).alias("borderline_pct"), (F.avg(flag(F.col("growth_quality") == "unstable_growth")) * 100).alias("unstable_pct"),
        F.percentile("priority_impact", F.lit(0.5)).alias("median_impact"))


def migration_table(quadrants: DataFrame) -> DataFrame:
    """Quadrant by first-half rate with no growth, and by second-half rate with the real growth."""
    rows = quadrants.filter((F.col("eligible") == 1) & (F.col("median_scope") != "none"))
    mg, ms = F.col("median_growth"), F.col("median_relative")

    def proxy(rate: str, growth: Column) -> Column:
        rel = F.try_divide(F.col(rate) * 1000.0, F.when(F.col("pool_peak") > 0, F.col("pool_peak")))
        return F.when(mg.isNull() | ms.isNull() | rel.isNull(), "low_volume").otherwise(_corner(growth >= mg, rel >= ms))

    move = F.when(F.col("explicit_h2") == F.col("explicit_h1"), "flat").when(F.col("explicit_h2") > F.col("explicit_h1"), "up").otherwise("down")
    return rows.select(
        "region", "city_name", "category", "ad_type", "quadrant", "median_scope", proxy("cvr_h1", F.lit(0.0)).alias("quadrant_h1"),
        proxy("cvr_h2", F.coalesce("growth_cvr_pct", F.lit(0.0))).alias("quadrant_h2"), move.alias("migration"))


def city_quadrant_summary(quadrants: DataFrame) -> DataFrame:
    """The quadrant with most contacts per city; else the most frequent label; metro stays apart."""
    per = quadrants.groupBy("region", "city_name", "is_metro", "quadrant").agg(F.sum("explicit").alias("e"), F.count("*").alias("n"))
    ranked = F.col("quadrant").isin(QUADRANTS)
    city = per.groupBy("region", "city_name", "is_metro").agg(
        F.min_by("quadrant", F.when(ranked, F.struct(-F.col("e"), F.col("quadrant")))).alias("main"),
        F.min_by("quadrant", F.struct(-F.col("n"), F.col("quadrant"))).alias("mode"))
    label = F.when(F.col("is_metro") == 1, "metro_excluded").otherwise(F.coalesce("main", "mode"))
    return city.select("region", "city_name", "is_metro", label.alias("quadrant"))


def quadrant_wide(quadrants: DataFrame, categories: Sequence[int], ad_types: Sequence[str]) -> DataFrame:
    cols = [(c, a) for c in categories for a in ad_types]
    return quadrants.groupBy("region", "city_name").agg(*[
        F.max(F.when((F.col("category") == c) & (F.col("ad_type") == a), F.col("quadrant"))).alias(f"q_{c}_{a}") for c, a in cols])


def slice_totals(cells: DataFrame) -> DataFrame:
    cities = cells.groupBy("region", "city_name", "is_metro").agg(
        *[F.sum(c).alias(c) for c in ("explicit", "positive", "listings")])
    return share_of_all(cities, "explicit", "explicit_pct").withColumn("explicit_per_1k", ratio("explicit", "listings", 1000.0))
