"""Recommendation evaluation and marketplace health."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarlens.functions.buckets import post_age_bucket
from bazaarlens.functions.columns import flag, pct, ratio
from bazaarlens.operators.core import histogram, prefix_sums, quantiles, share_of_all, top_n, unpivot_row
from bazaarlens.operators.joins import anti_exists
from bazaarlens.operators.stats import entropy, gini, hhi, lorenz_curve
from bazaarlens.session import durable

KEYS = ["user_id", "item_id"]


def gain(rank: Column) -> Column:
    return F.lit(math.log(2.0)) / F.ln(rank + 1.0)


def user_metrics(ranked: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """Hits, recall@k and NDCG@k of every user with truth."""
    pairs = truth.select(*KEYS).distinct()
    sizes = pairs.groupBy("user_id").agg(F.count("*").alias("n_truth"))
    hits = ranked.filter(F.col("rank") <= k).select(*KEYS, "rank").join(pairs, KEYS, "left_semi").groupBy("user_id").agg(
        F.count("*").alias("hits"), F.sum(gain(F.col("rank"))).alias("dcg"))
    joined = sizes.join(hits, "user_id", "left").fillna(0, ["hits", "dcg"])
    # Fixed table of k cumulative gains: the ideal sum for 1..k relevant items.
    ideal = F.array(*[F.lit(sum(1.0 / math.log2(i + 1) for i in range(1, n + 1))) for n in range(1, k + 1)])
    best = F.get(ideal, F.least(F.col("n_truth"), F.lit(k)).cast("int") - 1)
    return joined.withColumns({f"recall_at_{k}": ratio("hits", "n_truth"), f"ndcg_at_{k}": F.col("dcg") / best}).drop("dcg")


def recall_at_k(ranked: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    return user_metrics(ranked, truth, k).agg(F.count("*").alias("users"), F.avg(f"recall_at_{k}").alias("recall"))


def ndcg_at_k(ranked: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    return user_metrics(ranked, truth, k).agg(F.count("*").alias("users"), F.avg(f"ndcg_at_{k}").alias("ndcg"))


def offline_validation(ranked: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    m = user_metrics(ranked, truth, k)
    r = f"recall_at_{k}"
    return m.agg(
        F.count("*").alias("users"), F.avg(r).alias("recall"), F.avg(f"ndcg_at_{k}").alias("ndcg"), (F.avg(flag(F.col(r) > 0)) * 100).alias("hit_users_pct"),
        F.percentile(r, F.lit(0.5)).alias("recall_p50"), F.percentile(r, F.lit(0.75)).alias("recall_p75"), F.percentile(r, F.lit(0.9)).alias("recall_p90"))


def candidate_recall_ceiling(candidates: DataFrame, truth: DataFrame, k: int = 500) -> DataFrame:
    pairs = truth.select(*KEYS).distinct()
    sizes = pairs.groupBy("user_id").agg(F.count("*").alias("n"))
    hits = candidates.filter(F.col("rank") <= k).select(*KEYS).distinct().join(pairs, KEYS, "left_semi").groupBy("user_id").agg(F.count("*").alias("h"))
    joined = sizes.join(hits, "user_id", "left").fillna(0, ["h"])
    return joined.agg(F.count("*").alias("users"), F.avg(ratio("h", "n")).alias("recall_ceiling"))


def fold_metrics(ranked: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """Recall and NDCG per fold, for lists and truth tagged with ``fold``."""
    pairs = truth.select("fold", *KEYS).distinct()
    sizes = pairs.groupBy("fold", "user_id").agg(F.count("*").alias("n"))
    hits = ranked.filter(F.col("rank") <= k).select("fold", *KEYS, "rank").join(pairs, ["fold", *KEYS], "left_semi").groupBy("fold", "user_id").agg(
        F.count("*").alias("h"), F.sum(gain(F.col("rank"))).alias("dcg"))
    joined = sizes.join(hits, ["fold", "user_id"], "left").fillna(0, ["h", "dcg"])
    ideal = F.array(*[F.lit(sum(1.0 / math.log2(i + 1) for i in range(1, n + 1))) for n in range(1, k + 1)])
    best = F.get(ideal, F.least(F.col("n"), F.lit(k)).cast("int") - 1)
    return joined.groupBy("fold").agg(F.count("*").alias("users"), F.avg(ratio("h", "n")).alias("recall"), F.avg(F.col("dcg") / best).alias("ndcg"))


def walk_forward_report(folds: DataFrame) -> DataFrame:
    """The folds with a mean and a standard-deviation row."""
    mean = folds.agg(F.avg("recall").alias("recall"), F.avg("ndcg").alias("ndcg")).select(F.lit("mean").alias("fold"), "recall", "ndcg")
    std = folds.agg(F.stddev_pop("recall").alias("recall"), F.stddev_pop("ndcg").alias("ndcg")).select(F.lit("std").alias("fold"), "recall", "ndcg")
    return folds.select(F.col("fold").cast("string").alias("fold"), "recall", "ndcg").unionByName(mean).unionByName(std)


# ---- list comparison ----------------------------------------------------------------------------

def shared_stats(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """Per common user: overlap at 1, 5 and k, Jaccard, identity and rank correlation of shared items."""
    tagged = a.filter(F.col("rank") <= k).select(*KEYS, F.col("rank").alias("ra"), F.lit(None).cast("int").alias("rb")).unionByName(
        b.filter(F.col("rank") <= k).select(*KEYS, F.lit(None).cast("int").alias("ra"), F.col("rank").alias("rb")))
    pairs = tagged.groupBy(*KEYS).agg(F.min("ra").alias("ra"), F.min("rb").alias("rb"))
    shared = F.col("ra").isNotNull() & F.col("rb").isNotNull()
    inner = W.partitionBy("user_id", "both")
    pairs = pairs.withColumn("both", flag(shared))
    pairs = pairs.withColumns({"xa": F.row_number().over(inner.orderBy("ra")), "xb": F.row_number().over(inner.orderBy("rb"))})
    is_shared = F.col("both") == 1
    users = pairs.groupBy("user_id").agg(
        F.count("ra").alias("n_a"), F.count("rb").alias("n_b"), F.sum("both").alias("overlap"),
        F.count_if(is_shared & (F.col("ra") <= 5) & (F.col("rb") <= 5)).alias("overlap_5"),
        F.count_if((F.col("ra") == 1) & (F.col("rb") == 1)).alias("top1_same"), F.count_if(F.col("ra") == F.col("rb")).alias("same_slot"),
        F.count("*").alias("n_union"),
        F.sum(F.when(is_shared, (F.col("xa") - F.col("xb")) * (F.col("xa") - F.col("xb")))).alias("d2"))
    both_users = users.filter("n_a > 0 AND n_b > 0")
    m = F.col("overlap").cast("double")
    rho = F.when(F.col("overlap") >= 2, 1.0 - 6.0 * F.col("d2") / (m * (m * m - 1.0)))
    identical = flag((F.col("same_slot") == F.col("n_a")) & (F.col("n_a") == F.col("n_b")))
    return both_users.select("user_id", "overlap", "overlap_5", "top1_same", ratio("overlap", "n_union").alias("jaccard"), identical.alias("identical"), rho.alias("spearman"))


def compare_lists(a: DataFrame, b: DataFrame, warm: DataFrame, k: int = 10) -> DataFrame:
    """Summary of the per-user comparison for all, warm and cold users."""
    stats = shared_stats(a, b, k)
    marked = stats.join(warm.select("user_id").distinct().withColumn("w", F.lit("warm")), "user_id", "left").withColumn("w", F.coalesce("w", F.lit("cold")))
    groups = marked.withColumn("grp", F.explode(F.array(F.lit("all"), F.col("w"))))
    return groups.groupBy("grp").agg(
        F.count("*").alias("users"), F.avg("jaccard").alias("jaccard"), F.avg("overlap").alias("overlap"), F.avg("overlap_5").alias("overlap_5"),
        (F.avg("top1_same") * 100).alias("top1_same_pct"), (F.avg("identical") * 100).alias("identical_pct"), F.avg("spearman").alias("spearman"))


def overlap_histogram(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    return share_of_all(shared_stats(a, b, k).groupBy("overlap").agg(F.count("*").alias("users")), "users", "pct", bounded=True)


def list_diff_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """Long report (section, rank, value): matches and injections by rank, removed and added ranks,
    and how position changes split into reorder, injection and removal."""
    slots = a.select("user_id", "rank", F.col("item_id").alias("ia")).join(b.select("user_id", "rank", F.col("item_id").alias("ib")), ["user_id", "rank"])
    in_a = a.select("user_id", F.col("item_id").alias("ib")).distinct().withColumn("b_in_a", F.lit(1))
    in_b = b.select("user_id", F.col("item_id").alias("ia")).distinct().withColumn("a_in_b", F.lit(1))
    marked = slots.join(in_a, ["user_id", "ib"], "left").join(in_b, ["user_id", "ia"], "left").fillna(0, ["b_in_a", "a_in_b"])
    differs = F.col("ia") != F.col("ib")
    by_rank = marked.groupBy("rank").agg(F.avg(flag(~differs)).alias("positional_match"), F.avg(1 - F.col("b_in_a")).alias("new_at_rank"))
    ranks = unpivot_row(by_rank, ["rank"], {"positional_match": "positional_match", "new_at_rank": "new_at_rank"}, "section", "value")
    gone = anti_exists(a, b, KEYS).groupBy("rank").agg(F.count("*").cast("double").alias("value")).withColumn("section", F.lit("removed"))
    added = anti_exists(b, a, KEYS).groupBy("rank").agg(F.count("*").cast("double").alias("value")).withColumn("section", F.lit("added"))
    moved = marked.agg(
        F.count_if(differs & (F.col("b_in_a") == 1) & (F.col("a_in_b") == 1)).alias("reorder"), F.count_if(differs & (F.col("b_in_a") == 0)).alias("injection"),
        F.count_if(differs & (F.col("a_in_b") == 0)).alias("removal"))
    kinds = unpivot_row(moved.withColumn("rank", F.lit(0)), ["rank"], {c: c for c in ("reorder", "injection", "removal")}, "section", "value")
    cols = ["section", "rank", "value"]
    return reduce(DataFrame.unionByName, [df.select(*cols) for df in (ranks, gone, added, kinds)])


def slots_changed(a: DataFrame, b: DataFrame) -> DataFrame:
    gone = anti_exists(a, b, KEYS).groupBy("user_id").agg(F.count("*").alias("removed"))
    added = anti_exists(b, a, KEYS).groupBy("user_id").agg(F.count("*").alias("added"))
    users = a.select("user_id").distinct().join(gone, "user_id", "left").join(added, "user_id", "left").fillna(0, ["removed", "added"])
    return users.agg(F.count("*").alias("users"), F.avg("removed").alias("avg_removed"), F.avg("added").alias("avg_added"))


def score_cohorts(ranked: DataFrame, warm: DataFrame) -> DataFrame:
    """Score distribution of cold and warm users and candidates per user."""
    marked = ranked.join(warm.select("user_id").distinct().withColumn("w", F.lit("warm")), "user_id", "left").withColumn("cohort", F.coalesce("w", F.lit("cold")))
    base = marked.groupBy("cohort").agg(F.count("*").alias("rows"), F.countDistinct("user_id").alias("users"), F.avg("score").alias("mean"))
    spread = quantiles(marked, ["cohort"], "score", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return base.join(spread, "cohort").withColumn("per_user", ratio("rows", "users"))


def score_by_rank(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("rank").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.min("score").alias("min"), F.max("score").alias("max"))


# ---- marketplace health -------------------------------------------------------------------------

def coverage(ranked: DataFrame, dim: DataFrame) -> DataFrame:
    """Percent of listings and sellers that appear in any list."""
    shown = ranked.select("item_id").distinct().withColumn("s", F.lit(1))
    joined = dim.select("item_id", "seller_id").join(shown, "item_id", "left")
    return joined.agg(
        pct(F.count("s"), F.count("*")).alias("item_coverage_pct"),
        pct(F.countDistinct(F.when(F.col("s") == 1, F.col("seller_id"))), F.countDistinct("seller_id")).alias("seller_coverage_pct"))


def freshness_at_k(ranked: DataFrame, ages: DataFrame, k: int = 10, max_age: int = 7) -> DataFrame:
    joined = ranked.filter(F.col("rank") <= k).join(ages.select("item_id", "age"), "item_id", "left")
    return joined.agg(F.count("*").alias("slots"), (F.avg(flag(F.col("age") <= max_age)) * 100).alias("freshness_pct"))


def exposure_vs_pool(ranked: DataFrame, dim: DataFrame, dims: Sequence[str] = ("age_bucket", "category", "seller_type")) -> DataFrame:
    """Share of recommended slots against share of listings, by age, category and seller type."""
    slots = ranked.groupBy("item_id").agg(F.count("*").alias("slots"))
    joined = dim.withColumn("age_bucket", post_age_bucket("age")).join(slots, "item_id", "left")
    pairs = [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims]
    cells = joined.select("slots", F.explode(F.array(*pairs)).alias("p")).groupBy("p.dimension", "p.value").agg(
        F.count("*").alias("listings"), F.coalesce(F.sum("slots"), F.lit(0)).alias("slots"))
    w = W.partitionBy("dimension")
    shares = cells.withColumns({
        "pool_pct": pct("listings", F.sum("listings").over(w)), "exposure_pct": pct("slots", F.sum("slots").over(w))})
    return shares.withColumn("exposure_ratio", ratio("exposure_pct", "pool_pct"))


def seller_exposure(ranked: DataFrame, dim: DataFrame) -> DataFrame:
    slots = ranked.groupBy("item_id").agg(F.count("*").alias("slots"))
    return slots.join(dim.select("item_id", "seller_id"), "item_id").groupBy("seller_id").agg(F.sum("slots").alias("exposure"))


def seller_exposure_inequality(ranked: DataFrame, dim: DataFrame) -> DataFrame:
    """Gini, top 10 % and bottom 50 % share of the sellers' exposure."""
    exposure = seller_exposure(ranked, dim).filter("exposure > 0")
    table = prefix_sums(histogram(exposure, [], "exposure"), [], "exposure", {"n": F.col("n")}, bounded=True)
    x, n, b, total = F.col("exposure"), F.col("n"), F.col("n_before"), F.col("n_total")
    top = F.greatest(F.lit(1), F.ceil(total * 0.1))
    low = F.floor(total * 0.5)
    in_top = F.greatest(F.lit(0), F.least(n, top - (total - b - n)))
    in_low = F.greatest(F.lit(0), F.least(n, low - b))
    return table.agg(
        F.sum("n").alias("sellers"), ratio(F.sum(x * n * (2 * b + n - total)), F.max("n_total") * F.sum(x * n)).alias("gini"),
        pct(F.sum(x * in_top), F.sum(x * n)).alias("top10_pct"), pct(F.sum(x * in_low), F.sum(x * n)).alias("bottom50_pct"))


def seller_lorenz(ranked: DataFrame, dim: DataFrame) -> DataFrame:
    return lorenz_curve(seller_exposure(ranked, dim), [], "exposure", bounded=True)


def item_exposure_hhi(ranked: DataFrame, k: int = 10) -> DataFrame:
    """HHI of item exposure beside the popularity-only and the uniform list."""
    shown = ranked.groupBy("item_id").agg(F.count("*").alias("x"))
    return hhi(shown, [], "x").select(F.col("hhi").alias("item_hhi"), F.lit(10000.0 / k).alias("popularity_hhi"), (F.lit(10000.0) / shown.agg(F.count("*")).scalar()).alias("uniform_hhi"))


def personalization(ranked: DataFrame, popular: Column, k: int = 10) -> DataFrame:
    """Overlap of the users' lists with the popular list."""
    hit = F.array_contains(popular, F.col("item_id"))
    users = ranked.filter(F.col("rank") <= k).groupBy("user_id").agg(F.count_if(hit).alias("overlap"), F.count("*").alias("n"))
    return users.agg(
        F.count("*").alias("users"), F.avg(F.col("n") - F.col("overlap")).alias("avg_personal"), (F.avg(flag(F.col("overlap") == 0)) * 100).alias("fully_personal_pct"),
        (F.avg(flag(F.col("overlap") >= 5)) * 100).alias("mostly_popular_pct"))


# Thresholds (low, high) and direction of the six health metrics.
HEALTH = {
    "freshness_at_10": (1.0, 3.0, "higher"), "seller_coverage": (5.0, 15.0, "higher"), "item_coverage": (2.0, 5.0, "higher"),
    "category_entropy": (0.7, 0.9, "higher"), "seller_gini": (0.85, 0.95, "lower"), "item_hhi": (200.0, 1000.0, "lower"),
}


def item_exposure(ranked: DataFrame, dim: DataFrame, k: int = 10, max_age: int = 7) -> DataFrame:
    """One row per listing or listed item: its slots, those of them that are fresh, and whose it is."""
    slots = ranked.groupBy("item_id").agg(F.count("*").alias("x"), F.count_if(F.col("rank") <= k).alias("top"))
    known = dim.select("item_id", "seller_id", "category", "age", F.lit(1).alias("listed"))
    both = known.join(slots, "item_id", "full").fillna(0, ["x", "top", "listed"])
    return both.withColumn("fresh", F.when(F.col("age") <= max_age, F.col("top")).otherwise(0))


def health_scorecard(ranked: DataFrame, dim: DataFrame, thresholds: Mapping[str, tuple] = HEALTH) -> DataFrame:
    """Six metrics with good / warn / bad by their thresholds, all from one written table of exposure per item."""
    items = durable(item_exposure(ranked, dim), "exposure")
    shown, listed = F.col("x") > 0, F.col("listed") == 1
    plain = items.agg(
        pct(F.sum("fresh"), F.sum("top")).alias("freshness"), pct(F.count_if(listed & shown), F.count_if(listed)).alias("items"),
        (F.lit(10000.0) * F.sum(F.col("x").cast("double") * F.col("x")) / F.pow(F.sum("x").cast("double"), F.lit(2.0))).alias("hhi"))
    sellers = durable(items.filter(listed).groupBy("seller_id").agg(F.sum("x").alias("exposure")), "sellers")
    owned = F.col("seller_id").isNotNull()
    cats = items.filter(listed & shown).groupBy("category").agg(F.sum("x").alias("x"))
    values = {
        "freshness_at_10": plain.select("freshness"), "item_coverage": plain.select("items"), "item_hhi": plain.select("hhi"),
        "seller_coverage": sellers.agg(pct(F.count_if(owned & (F.col("exposure") > 0)), F.count_if(owned)).alias("sellers")),
        "category_entropy": entropy(cats, [], "x").select("normalized_entropy"),
        "seller_gini": gini(sellers.filter("exposure > 0"), [], "exposure", bounded=True).select("gini")}
    rows = None
    for name, (low, high, direction) in thresholds.items():
        one = values[name].toDF("value").select(F.lit(name).alias("metric"), F.col("value").cast("double").alias("value"))
        v = F.col("value")
        verdict = (F.when(v >= high, "good").when(v >= low, "warn") if direction == "higher" else F.when(v <= low, "good").when(v <= high, "warn")).otherwise("bad")
        one = one.withColumns({"verdict": verdict, "direction": F.lit(direction)})
        rows = one if rows is None else rows.unionByName(one)
    return rows


def popular_list(popularity: DataFrame, users: DataFrame, order: Sequence[Column], k: int = 10) -> DataFrame:
    from bazaarlens.operators.joins import with_pool

    return with_pool(users, popularity, k, order)


def top_ranked(scores: DataFrame, k: int = 10, score: str = "score") -> DataFrame:
    return top_n(scores, ["user_id"], [F.desc(F.round(score, 9)), F.asc("item_id")], k)
