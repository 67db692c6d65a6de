"""Post-processing of ranked lists: blending, boosts, caps, fusion, cold users, validation.

Ranked lists hold at most a few hundred rows per user, so windows and arrays per user are small;
users spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarlens.functions.columns import decay, flag, is_login, is_positive, weighted
from bazaarlens.operators.core import at_most, first_rows, histogram, join_keys, prefix_sums, top_n
from bazaarlens.operators.joins import anti_exists
from bazaarlens.operators.windows import min_max_norm

KEYS = ["user_id", "item_id"]
# Weights of the fusion recipes.
RRF_K = 60.0
FUSION = {"primary": 1.0, "alt": 0.95, "bonus": 0.12}
HISTORY_BOOST = 0.08
HISTORY_FUSION = {"base": 1.0, "history": 1.35, "raw": 1.15}
INTERACTION_WEIGHTS = {"lead": 8.0, "chat": 3.0, "view": 0.15}
EVENT_WEIGHTS = {"view_phone": 10.0, "contact_chat": 9.0, "contact_zalo": 9.0, "contact_sms": 8.0, "other_interaction": 2.5}


def _rank(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return top_n(df, ["user_id"], order, k)


def blend_scores(base: DataFrame, models: Mapping[str, DataFrame], weights: Mapping[str, float]) -> DataFrame:
    """Weighted sum of per-user normalized model scores over the base list's pairs."""
    out = min_max_norm(base, ["user_id"], ["score"]).withColumn("blended", F.lit(weights["base"]) * F.col("score_norm"))
    for name, df in models.items():
        joined = out.join(df.select(*KEYS, F.col("score").alias(name)), KEYS, "left")
        out = min_max_norm(joined, ["user_id"], [name]).withColumn("blended", F.col("blended") + F.lit(weights[name]) * F.col(f"{name}_norm"))
    return out.select(*KEYS, F.col("blended").alias("score"))


def score_range(df: DataFrame, score: str = "score") -> Column:
    return df.agg(F.max(score) - F.min(score)).scalar()


def freshness_boost(ranked: DataFrame, ages: DataFrame, factor: float = 0.015, max_age: int = 7) -> DataFrame:
    """Add a share of the score range to listings at most a week old."""
    boost = score_range(ranked) * F.lit(factor)
    joined = ranked.join(ages.select("item_id", "age"), "item_id", "left")
    return joined.withColumn("score", F.col("score") + F.when(F.col("age") <= max_age, boost).otherwise(0.0))


def fresh_multiplier(age: Column, quality: Column) -> Column:
    return (
        F.when((age < 1) & (quality > 0.7), 1.5).when((age < 3) & (quality > 0.6), 1.25)
        .when(age < 7, 1.0 + 0.1 * (7 - age) / 7).otherwise(1.0))


def fresh_multiplier_guarded(ranked: DataFrame, items: DataFrame, k: int = 10, min_overlap: float = 7.0) -> DataFrame:
    """Multiply fresh good listings up, but only if the users' top-k overlaps the old one enough."""
    joined = ranked.join(items.select("item_id", "age", "quality"), "item_id", "left")
    age, quality = F.coalesce(F.col("age").cast("double"), F.lit(999.0)), F.coalesce("quality", F.lit(0.0))
    scored = joined.withColumn("multiplied", F.col("score") * fresh_multiplier(age, quality))

    def best(score: str) -> DataFrame:
        return _rank(scored.select(*KEYS, score), [F.desc(F.round(score, 9)), F.asc("item_id")], k).select(*KEYS)

    shared = best("score").join(best("multiplied"), KEYS).groupBy("user_id").agg(F.count("*").alias("n"))
    overlap = shared.agg(F.avg("n")).scalar()
    return scored.withColumn("mean_overlap", overlap).withColumn(
        "score", F.when(F.col("mean_overlap") >= min_overlap, F.col("multiplied")).otherwise(F.col("score"))).drop("multiplied", "age", "quality")


def category_boost(ranked: DataFrame, profiles: DataFrame, items: DataFrame, factor: float = 0.006) -> DataFrame:
    boost = score_range(ranked) * F.lit(factor)
    joined = ranked.join(items.select("item_id", "category"), "item_id", "left").join(profiles.select("user_id", "pref_category"), "user_id", "left")
    return joined.withColumn("score", F.col("score") + F.when(F.col("category") == F.col("pref_category"), boost).otherwise(0.0)).select(*ranked.columns)


def fill_to_k(ranked: DataFrame, users: DataFrame, pool: Column, k: int = 10) -> DataFrame:
    """Exactly k distinct items for every user: own list first, then the pool in order."""
    own = ranked.select("user_id", "item_id", F.lit(0).alias("tier"), F.col("rank").alias("pos"))
    padding = users.select("user_id", F.posexplode(pool).alias("pos", "item_id")).select("user_id", "item_id", F.lit(1).alias("tier"), "pos")
    best = own.unionByName(padding).groupBy(*KEYS).agg(F.min(F.struct("tier", "pos")).alias("o"))
    return _rank(best, [F.asc("o"), F.asc("item_id")], k).select("user_id", "item_id", "rank")


def cvr_popularity(popularity: DataFrame, pos: str, events: str) -> DataFrame:
    """Positives times conversion, for the CVR-weighted cold list."""
    cvr = F.col(pos) / F.greatest(F.col(events), F.lit(1))
    return popularity.select("item_id", (F.col(pos) * cvr).alias("cold_score"))


def age_boost_popularity(popularity: DataFrame, boosts: DataFrame, pos: str) -> DataFrame:
    joined = popularity.join(boosts.select("item_id", "age_boost"), "item_id", "left")
    return joined.select("item_id", (F.col(pos) * F.coalesce("age_boost", F.lit(1.0))).alias("cold_score"))


def guarded_cold_list(track: Column, popular: Column, k: int = 10) -> Column:
    """The trained cold list if it overlaps the popular one enough, a mix if partly, else popular."""
    shared = F.size(F.array_intersect(track, popular))
    turns = F.flatten(F.array(*[F.array(F.get(track, F.lit(i)), F.get(popular, F.lit(i))) for i in range(k)]))
    mixed = F.slice(F.array_distinct(turns), 1, k)
    return F.when(shared >= 7, track).when(shared >= 4, mixed).otherwise(popular)


def cold_override(ranked: DataFrame, cold_users: DataFrame, cold_list: Column) -> DataFrame:
    kept = anti_exists(ranked.select("user_id", "item_id", "rank"), cold_users, ["user_id"])
    forced = cold_users.select("user_id", F.posexplode(cold_list).alias("pos", "item_id")).select("user_id", "item_id", (F.col("pos") + 1).alias("rank"))
    return kept.unionByName(forced)


def diversity_cap(
    ranked: DataFrame, dim: DataFrame, k: int = 10, max_seller: int = 7, max_district: int = 8, bonus: float = 0.05, fresh_days: int = 7, most: int = 5000
) -> DataFrame:
    """Greedy list under a seller and a district cap with a freshness bonus, back-filled to k.

    The two caps depend on earlier picks, so each user's short sorted list is folded once; a list of
    more than ``most`` candidates raises.
    """
    short = at_most(ranked.select("user_id", "item_id", "score"), ["user_id"], [F.desc("score"), F.asc("item_id")], most)
    joined = short.join(dim.select("item_id", "seller_id", "district_name", "age"), "item_id", "left")
    scored = joined.withColumn("score", F.col("score") + F.when(F.col("age") <= fresh_days, bonus).otherwise(0.0))
    row = F.struct((-F.round("score", 9)).alias("o"), F.col("item_id"), F.col("seller_id"), F.col("district_name"), F.col("score"))
    lists = scored.groupBy("user_id").agg(F.sort_array(F.collect_list(row)).alias("all"))

    def step(picked: Column, x: Column) -> Column:
        sellers = F.size(F.filter(picked, lambda p: p["seller_id"] == x["seller_id"]))
        places = F.size(F.filter(picked, lambda p: p["district_name"] == x["district_name"]))
        full = (F.size(picked) >= k) | (sellers >= max_seller) | (places >= max_district)
        return F.when(full, picked).otherwise(F.concat(picked, F.array(x)))

    empty = F.slice("all", 1, 0)
    picked = lists.withColumn("picked", F.aggregate("all", empty, step))
    rest = F.filter("all", lambda x: ~F.exists("picked", lambda p: p["item_id"] == x["item_id"]))
    final = picked.select("user_id", F.slice(F.concat(F.col("picked"), rest), 1, k).alias("final"))
    return final.select("user_id", F.posexplode("final").alias("pos", "x")).select(
        "user_id", F.col("x.item_id").alias("item_id"), (F.col("pos") + 1).alias("rank"), F.col("x.score").alias("score"))


def seller_cap_defer(ranked: DataFrame, dim: DataFrame, max_per_seller: int = 2, k: int = 10) -> DataFrame:
    """At most n per seller first; the others keep their order behind them."""
    joined = ranked.select("user_id", "item_id", "rank").join(dim.select("item_id", "seller_id"), "item_id", "left").withColumnRenamed("rank", "old_rank")
    nth = F.row_number().over(W.partitionBy("user_id", "seller_id").orderBy("old_rank"))
    late = flag(F.col("seller_id").isNotNull() & (nth > max_per_seller))
    return _rank(joined.withColumn("late", late), [F.asc("late"), F.asc("old_rank")], k).select("user_id", "item_id", "rank")


def _two_lists(primary: DataFrame, alt: DataFrame) -> DataFrame:
    """Best ranks of both lists per pair, from one shuffle instead of a full outer join."""
    tagged = primary.select(*KEYS, "rank", F.lit("p").alias("src")).unionByName(alt.select(*KEYS, "rank", F.lit("a").alias("src")))
    return tagged.groupBy(*KEYS).agg(
        F.min(F.when(F.col("src") == "p", F.col("rank"))).alias("rank_p"), F.min(F.when(F.col("src") == "a", F.col("rank"))).alias("rank_a"))


def rrf_ensemble(primary: DataFrame, alt: DataFrame, k: int = 10, weights: Mapping[str, float] = FUSION, smooth: float = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two lists with a bonus for items in both."""
    pool = _two_lists(primary, alt)
    a = F.coalesce(F.lit(weights["primary"]) / (smooth + F.col("rank_p")), F.lit(0.0))
    b = F.coalesce(F.lit(weights["alt"]) / (smooth + F.col("rank_a")), F.lit(0.0))
    both = flag(F.col("rank_p").isNotNull() & F.col("rank_a").isNotNull())
    scored = pool.withColumns({"score": a + b + F.lit(weights["bonus"]) * both, "rp": F.coalesce("rank_p", F.lit(99)), "ra": F.coalesce("rank_a", F.lit(99))})
    order = [F.desc(F.round("score", 9)), F.asc("rp"), F.asc("ra"), F.asc("item_id")]
    return _rank(scored, order, k).select("user_id", "item_id", "rank", "score")


def rerank_within_list(ranked: DataFrame, history: DataFrame, boost: float = HISTORY_BOOST, k: int = 10) -> DataFrame:
    """Reorder by 1/rank plus the item's share of the user's largest history score."""
    top = history.groupBy("user_id").agg(F.max("hist_raw").alias("peak"))
    joined = ranked.select("user_id", "item_id", F.col("rank").alias("old_rank")).join(
        history.select(*KEYS, "hist_raw"), KEYS, "left").join(top, "user_id", "left")
    share = F.when(F.col("peak") > 0, F.coalesce("hist_raw", F.lit(0.0)) / F.col("peak")).otherwise(0.0)
    scored = joined.withColumn("score", F.lit(1.0) / F.col("old_rank") + F.lit(boost) * share)
    return _rank(scored, [F.desc(F.round("score", 9)), F.asc("old_rank"), F.asc("item_id")], k).select("user_id", "item_id", "rank")


def rrf_with_history(ranked: DataFrame, history: DataFrame, weights: Mapping[str, float] = HISTORY_FUSION, smooth: float = RRF_K, k: int = 10) -> DataFrame:
    """Fusion of a list with the history, which may bring in items the list does not hold."""
    top = history.groupBy("user_id").agg(F.max("hist_raw").alias("peak"))
    past = history.join(top, "user_id").select(
        *KEYS, "hist_raw", (F.lit(weights["history"]) / (smooth + F.col("hist_rank")) + F.lit(weights["raw"]) * F.col("hist_raw") / (F.col("peak") + 1e-9)).alias("h"))
    base = ranked.groupBy(*KEYS).agg((F.lit(weights["base"]) / (smooth + F.min("rank"))).alias("b"))
    joined = base.join(past, KEYS, "full")
    scored = joined.withColumns({"score": F.coalesce("b", F.lit(0.0)) + F.coalesce("h", F.lit(0.0)), "hist_raw": F.coalesce("hist_raw", F.lit(0.0))})
    return _rank(scored, [F.desc(F.round("score", 9)), F.desc(F.round("hist_raw", 9)), F.asc("item_id")], k).select("user_id", "item_id", "rank")


def history_score(
    interactions: DataFrame, events: DataFrame, as_of: str, half_life: float = 21.0,
    inter_weights: Mapping[str, float] = INTERACTION_WEIGHTS, event_weights: Mapping[str, float] = EVENT_WEIGHTS,
) -> DataFrame:
    """Decayed interactions plus decayed positive events, last touch and rank per user.

    Both facts become long contributions and meet in one aggregation instead of a full outer join.
    """
    end = F.lit(as_of).cast("date")
    fade = decay(F.datediff(end, "date"), half_life, "half_life")
    w = inter_weights
    amount = w["lead"] * F.col("lead_count") + w["chat"] * F.col("chat_message_count") + w["view"] * F.col("adview_count")
    a = interactions.select(*KEYS, (amount * fade).alias("x"), "date")
    b = events.filter(is_login() & is_positive()).select(*KEYS, (weighted("event_type", event_weights) * fade).alias("x"), "date")
    total = a.unionByName(b).groupBy(*KEYS).agg(F.sum("x").alias("hist_raw"), F.max("date").alias("last_touch")).filter("hist_raw > 0")
    # All pairs of a user are ranked: the slices of prefix_sums count the pairs with a larger score,
    # a window orders only the pairs with the same score, so a user with most pairs is spread out.
    scored = total.withColumn("__neg", -F.round("hist_raw", 9))
    above = prefix_sums(histogram(scored, ["user_id"], "__neg"), ["user_id"], "__neg", {"n": F.col("n")}).select("user_id", "__neg", "n_before")
    tie = F.row_number().over(W.partitionBy("user_id", "__neg").orderBy(F.desc("last_touch"), F.asc("item_id")))
    ranked = join_keys(scored.withColumn("__tie", tie), above, ["user_id", "__neg"])
    return ranked.withColumn("hist_rank", (F.col("n_before") + F.col("__tie")).cast("int")).drop("__neg", "__tie", "n_before")


def prune_list(dim: DataFrame, cutoff: str) -> DataFrame:
    """Refused or expired listings."""
    expired = F.col("expected_expired_date") < F.lit(cutoff).cast("date")
    return dim.filter((F.col("ad_status") == "refused") | F.coalesce(expired, F.lit(False))).select("item_id")


def _allowed(df: DataFrame, prune: DataFrame, purchased: DataFrame) -> DataFrame:
    return anti_exists(anti_exists(df, prune, ["item_id"]), purchased, KEYS)


def tiered_cold_list(
    users: DataFrame, primary: DataFrame, alt: DataFrame, user_city: DataFrame, city_popular: DataFrame, prune: DataFrame, purchased: DataFrame, k: int = 10
) -> DataFrame:
    """Items of both lists, then of the primary one, then popular in the user's city; pruned."""
    pool = _two_lists(primary, alt).join(users.select("user_id"), "user_id", "left_semi")
    fill = F.coalesce(F.lit(1.0) / (RRF_K + F.col("rank_p")), F.lit(0.0))
    tier = F.when(F.col("rank_p").isNotNull() & F.col("rank_a").isNotNull(), 1).when(F.col("rank_p").isNotNull(), 2)
    listed = pool.select(*KEYS, tier.alias("tier"), fill.alias("fill"), F.col("rank_p").alias("r")).filter("tier IS NOT NULL")
    near = users.select("user_id").join(user_city, "user_id").join(city_popular, "city_name")
    local = near.select(*KEYS, F.lit(3).alias("tier"), (F.lit(1.0) / (3 + F.col("city_rank"))).alias("fill"), F.col("city_rank").alias("r"))
    best = _allowed(listed.unionByName(local), prune, purchased).groupBy(*KEYS).agg(F.min("tier").alias("tier"), F.max("fill").alias("fill"), F.min("r").alias("r"))
    return _rank(best, [F.asc("tier"), F.desc("fill"), F.asc("r"), F.asc("item_id")], k).select("user_id", "item_id", "rank")


def city_popularity(events: DataFrame, prune: DataFrame, keep: int = 15) -> DataFrame:
    counts = anti_exists(events.filter(is_positive()), prune, ["item_id"]).groupBy("city_name", "item_id").agg(F.count("*").alias("n"))
    return top_n(counts, ["city_name"], [F.desc("n"), F.asc("item_id")], keep, "city_rank")


def user_main_city(events: DataFrame) -> DataFrame:
    counts = events.filter(is_login() & F.col("city_name").isNotNull()).groupBy("user_id", "city_name").agg(F.count("*").alias("n"))
    return first_rows(counts, ["user_id"], [F.desc("n"), F.asc("city_name")]).select("user_id", "city_name")


def warm_prune(warm: DataFrame, primary: DataFrame, alt: DataFrame, prune: DataFrame, purchased: DataFrame, k: int = 10) -> DataFrame:
    """The user's own list without pruned items, refilled from both lists, padded from the primary."""
    own = primary.join(warm.select("user_id"), "user_id", "left_semi")
    kept = _allowed(own.select(*KEYS, "rank"), prune, purchased).select(*KEYS, F.lit(0).alias("tier"), F.col("rank").cast("double").alias("o"))
    pool = _two_lists(own, alt).filter("rank_p IS NOT NULL")
    refill = _allowed(pool, prune, purchased).select(*KEYS, F.lit(1).alias("tier"), (F.col("rank_p") - 100 * flag(F.col("rank_a").isNotNull())).cast("double").alias("o"))
    padding = own.select(*KEYS, F.lit(2).alias("tier"), F.col("rank").cast("double").alias("o"))
    best = kept.unionByName(refill).unionByName(padding).groupBy(*KEYS).agg(F.min(F.struct("tier", "o")).alias("o"))
    return _rank(best, [F.asc("o"), F.asc("item_id")], k).select("user_id", "item_id", "rank")


def capped_blend(primary: DataFrame, alt: DataFrame, max_alt_only: int = 2, smooth: float = RRF_K, k: int = 10) -> DataFrame:
    """Both, then primary only, then at most two of the other list only."""
    pool = _two_lists(primary, alt)
    p, a = F.coalesce(F.lit(1.0) / (smooth + F.col("rank_p")), F.lit(0.0)), F.coalesce(F.lit(1.0) / (smooth + F.col("rank_a")), F.lit(0.0))
    both = F.col("rank_p").isNotNull() & F.col("rank_a").isNotNull()
    scored = pool.withColumns({"tier": F.when(both, 1).when(F.col("rank_p").isNotNull(), 2).otherwise(3), "s": F.when(both, p + a).otherwise(0.0), "p": p, "a": a})
    w = W.partitionBy("user_id", "tier").orderBy(F.desc(F.round("s", 9)), F.desc("p"), F.desc("a"), F.asc("rank_p"), F.asc("rank_a"), F.asc("item_id"))
    kept = scored.withColumn("rn", F.row_number().over(w)).filter((F.col("tier") < 3) | (F.col("rn") <= max_alt_only))
    return _rank(kept, [F.asc("tier"), F.asc("rn")], k).select("user_id", "item_id", "rank")


def validate_ranked_list(ranked: DataFrame, users: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Every check as a row (check, violations, ok)."""
    per_user = ranked.groupBy("user_id").agg(
        F.count("*").alias("n"), F.countDistinct("rank").alias("ranks"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.countDistinct("item_id").alias("items"))
    wrong = per_user.agg(
        F.count_if(F.col("n") != k).alias("row_count"), F.count_if((F.col("lo") < 1) | (F.col("hi") > k)).alias("rank_range"),
        F.count_if(F.col("ranks") != F.col("n")).alias("rank_unique"), F.count_if(F.col("items") != F.col("n")).alias("item_unique"))
    invalid = anti_exists(ranked, items, ["item_id"]).agg(F.count("*")).scalar()
    missing = anti_exists(users.select("user_id"), ranked, ["user_id"]).agg(F.count("*")).scalar()
    unknown = anti_exists(ranked.select("user_id").distinct(), users, ["user_id"]).agg(F.count("*")).scalar()
    wide = wrong.withColumns({"invalid_items": invalid, "missing_users": missing, "unknown_users": unknown})
    checks = [F.struct(F.lit(c).alias("check"), F.col(c).alias("violations"), (F.col(c) == 0).alias("ok")) for c in wide.columns]
    return wide.select(F.explode(F.array(*checks)).alias("r")).select("r.*")
