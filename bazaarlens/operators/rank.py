"""Ranking models on Spark ML: distributed gradient-boosted trees, averaged over seeds."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.operators.core import top_n
from bazaarlens.operators.evaluate import ndcg_at_k
from bazaarlens.operators.retrieve import top_array
from bazaarlens.session import durable, shared_folder
from bazaarlens.sources.star import hash_split

KEYS = ["user_id", "item_id"]


def clean_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Numeric features with infinities and NaN as 0."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return df.withColumns({f: F.when(bad(F.col(f).cast("double")), 0.0).otherwise(F.col(f).cast("double")) for f in features})


def train_ranker(
    rows: DataFrame, features: Sequence[str], label: str = "label", seeds: Sequence[int] = (42,), depth: int = 6, iterations: int = 50, step: float = 0.1,
):
    """One boosted-tree model per seed on an 80/20 user split; the held-out users stop training early.

    The training table is written once: every boosting round scans it, and no round depends on the
    plan behind it.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    spark = rows.sparkSession
    spark.sparkContext.setCheckpointDir(shared_folder(spark))
    split = hash_split(clean_features(rows, features), "user_id").withColumn("is_validation", F.col("is_train") == 0)
    assembled = VectorAssembler(inputCols=list(features), outputCol="features").transform(split)
    table = durable(assembled.select("features", F.col(label).cast("double").alias("label"), "is_validation"), "training")
    models = []
    for seed in seeds:
        gbt = GBTClassifier(maxDepth=depth, maxIter=iterations, stepSize=step, seed=seed, subsamplingRate=0.8, featureSubsetStrategy="0.8",
                            validationIndicatorCol="is_validation", checkpointInterval=10)
        models.append(gbt.fit(table))
    return models


def score(rows: DataFrame, models: Iterable, features: Sequence[str], out: str = "score") -> DataFrame:
    """Mean positive probability of the models."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    scored = VectorAssembler(inputCols=list(features), outputCol="features").transform(clean_features(rows, features))
    total, models = F.lit(0.0), list(models)
    for i, model in enumerate(models):
        scored = model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol(f"__p{i}").transform(scored)
        total = total + vector_to_array(F.col(f"__p{i}"))[1]
    return scored.withColumn(out, total / len(models)).drop("features", *[f"__p{i}" for i in range(len(models))])


def score_and_top_k(rows: DataFrame, models: Iterable, features: Sequence[str], k: int = 30, tiebreak: str | None = None) -> DataFrame:
    scored = score(rows, models, features)
    order: list[Column] = [F.desc("score")] + ([F.desc(tiebreak)] if tiebreak else []) + [F.asc("item_id")]
    return top_n(scored, ["user_id"], order, k)


def feature_importance(spark, models: Iterable, features: Sequence[str]) -> DataFrame:
    """Mean importance of each feature, a model summary with one row per feature."""
    models = list(models)
    rows = [(f, float(sum(m.featureImportances[i] for m in models) / len(models))) for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), F.asc("feature"))


def geo_expert_ranker(rows: DataFrame, features: Sequence[str], metro: Column, **options) -> DataFrame:
    """One model for metropolitan listings, one for the rest; scores are united."""
    parts = []
    for condition in (metro, ~metro):
        part = rows.filter(condition)
        parts.append(score(part, train_ranker(part, features, **options), features))
    return parts[0].unionByName(parts[1])


def cold_track(rows: DataFrame, features: Sequence[str], user_features: Sequence[str], pool: DataFrame, popularity: str, size: int = 1000, k: int = 10, **options) -> Column:
    """Train with user features masked, re-rank the most popular ``size`` items, return the best k."""
    masked = rows.withColumns({f: F.lit(0.0) for f in user_features})
    models = train_ranker(masked, features, **options)
    candidates = pool.orderBy(F.desc(popularity), F.asc("item_id")).limit(size).withColumns({f: F.lit(0.0) for f in user_features})
    scored = durable(score(candidates, models, features).select("item_id", "score"), "coldtrack")
    return top_array(scored, [F.desc("score"), F.asc("item_id")], k)


def tune_ranker(rows: DataFrame, features: Sequence[str], grid: Sequence[Mapping], k: int = 10) -> DataFrame:
    """NDCG@k of every parameter set on the held-out users; one row per set."""
    table = durable(rows, "tuning")
    held_out = hash_split(table, "user_id").filter("is_train = 0")
    truth = held_out.filter("label = 1").select(*KEYS)
    out = None
    for number, params in enumerate(grid):
        ranked = score_and_top_k(held_out, train_ranker(table, features, **params), features, k)
        one = ndcg_at_k(ranked, truth, k).select(F.lit(number).alias("params_no"), F.lit(str(dict(params))).alias("params"), "users", "ndcg")
        out = one if out is None else out.unionByName(one)
    return out


