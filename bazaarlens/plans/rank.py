"""Ranking-model queries (no SQL form; checked by structure)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarlens.functions.columns import is_positive
from bazaarlens.operators import listwise as L
from bazaarlens.operators import rank as K
from bazaarlens.operators import segment as E
from bazaarlens.operators.evaluate import ndcg_at_k
from bazaarlens.operators.post import cold_override
from bazaarlens.plans.features import assembled
from bazaarlens.plans.post import cold_users
from bazaarlens.plans.registry import query
from bazaarlens.plans.segment import cohorts
from bazaarlens.session import durable
from bazaarlens.sources.star import hash_split

FEATURES = ["days_since_posted", "trend_pos_log", "velocity_7d", "item_cvr", "age_boost", "contact_rate", "total_pos", "unique_items", "days_since_last",
            "days_since_ui", "pos_count_log", "intent_score_log", "intent_ratio", "decay_score", "decay_total", "leads"]
USER_FEATURES = FEATURES[6:]
SMALL = {"depth": 3, "iterations": 5}


def rows(s):
    return durable(assembled(s).select("user_id", "item_id", "label", *FEATURES), "ranking")


@query("train_ranker")
def _(s):
    """Label rate and mean score by model bucket: the higher bucket must hold more labels."""
    table = rows(s)
    scored = K.score(table, K.train_ranker(table, FEATURES, seeds=(1, 2), **SMALL), FEATURES)
    return scored.groupBy(F.floor(F.col("score") * 10).alias("bucket")).agg(F.count("*").alias("n"), F.avg("score").alias("score"), F.avg("label").alias("label_rate"))


@query("score_and_top_k")
def _(s):
    table = rows(s)
    return K.score_and_top_k(table, K.train_ranker(table, FEATURES, **SMALL), FEATURES).select("user_id", "item_id", "rank", "score")


@query("feature_importance")
def _(s):
    return K.feature_importance(s.spark, K.train_ranker(rows(s), FEATURES, **SMALL), FEATURES)


@query("geo_expert_ranker")
def _(s):
    placed = rows(s).join(s.dim.select("item_id", "city_name"), "item_id", "left").fillna("", ["city_name"])
    metro = F.col("city_name").isin([f"NATION_{i}" for i in range(8)])
    scored = K.geo_expert_ranker(placed, FEATURES, metro, **SMALL)
    return scored.groupBy("city_name").agg(F.count("*").alias("n"), F.avg("score").alias("score"))


@query("cold_track")
def _(s):
    table = rows(s)
    pop = s.ev.filter(is_positive()).groupBy("item_id").agg(F.count("*").alias("pos"))
    pool = table.groupBy("item_id").agg(*[F.max(f).alias(f) for f in FEATURES]).join(pop, "item_id", "left").fillna(0, ["pos"])
    best = K.cold_track(table, FEATURES, USER_FEATURES, pool, "pos", **SMALL)
    empty = s.ev.limit(0).select("user_id", "item_id", F.lit(1).alias("rank"))
    return cold_override(empty, cold_users(s), best)


@query("tune_ranker")
def _(s):
    return K.tune_ranker(rows(s), FEATURES, [{"depth": 2, "iterations": 3}, {"depth": 4, "iterations": 5}])


# ---- grouped ranking -----------------------------------------------------------------------------

ROUNDS = {"rounds": 10, "depth": 3, "every": 5}


@query("train_listwise")
def _(s):
    """NDCG@10 of the held-out users by the grouped model, the pointwise one and the popularity of items."""
    table = rows(s)
    held = durable(hash_split(table, "user_id").filter("is_train = 0").drop("is_train"), "heldout")
    truth = held.filter("label = 1").select("user_id", "item_id")
    lists = {
        "listwise": L.listwise_top_k(held, L.train_listwise(table, FEATURES, **ROUNDS), 10),
        "pointwise": K.score_and_top_k(held, K.train_ranker(table, FEATURES, **SMALL), FEATURES, 10),
        "popularity": L.listwise_top_k(held, L.ListwiseModel([], 0.1, FEATURES, []), 10, "trend_pos_log")}
    out = None
    for name, ranked in lists.items():
        one = ndcg_at_k(ranked, truth).select(F.lit(name).alias("model"), "users", "ndcg")
        out = one if out is None else out.unionByName(one)
    return out


@query("listwise_top_k")
def _(s):
    table = rows(s)
    return L.listwise_top_k(table, L.train_listwise(table, FEATURES, **ROUNDS), 30, "trend_pos_log").select("user_id", "item_id", "rank", "score")


@query("cohort_model_scores")
def _(s):
    """Scores of the grouped model by the activity cohort of the users."""
    table = rows(s)
    scored = L.score_listwise(table, L.train_listwise(table, FEATURES, **ROUNDS))
    return E.cohort_scores(scored.select("user_id", "score"), cohorts(s))


@query("search_listwise")
def _(s):
    """Successive halving over parameter sets: the trees each one got and the NDCG@10 of the held-out users."""
    grid = [{"depth": d, "step": x} for d in (2, 4) for x in (0.1, 0.3)]
    trials = L.search_listwise(rows(s), FEATURES, grid, rungs=(2, 6), keep=3)
    found = [(t.number, str(dict(t.params)), len(t.model.trees), float(t.ndcg), i + 1) for i, t in enumerate(trials)]
    return s.spark.createDataFrame(found, "params_no int, params string, trees int, ndcg double, place int")
