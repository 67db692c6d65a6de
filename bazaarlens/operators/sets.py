"""Top-k, ranking, interleaving and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarlens.operators.core import top_n


def global_top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Ordered limit: each partition keeps k rows, no full sort."""
    return df.orderBy(*order).limit(k)


def multi_key_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rank", k: int | None = None) -> DataFrame:
    if k is not None:
        return top_n(df, keys, order, k, out)
    return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def slot_allocation(volume: DataFrame, group: str, weight: str, pool: int, minimum: int = 3) -> DataFrame:
    """Slots per group: weight share times pool rounded half-even, at least ``minimum``, then one
    slot at a time taken from or given to the largest group until the sum is ``pool``.

    The table has one row per category, so the adjustment is a fold over one short array.
    """
    total = volume.agg(F.sum(weight)).scalar()
    start = F.greatest(F.bround(F.col(weight) / total * pool, 0), F.lit(float(minimum))).cast("int")
    row = F.struct((-F.col(weight)).alias("o"), F.col(group).alias("g"), start.alias("s"))
    packed = volume.agg(F.sort_array(F.collect_list(row)).alias("a")).select(
        F.transform("a", lambda x: x["g"]).alias("g"), F.transform("a", lambda x: x["s"]).alias("s")
    )
    diff = F.aggregate("s", F.lit(pool), lambda acc, x: acc - x)

    def step(state: Column, _: Column) -> Column:
        top = F.array_position(state, F.array_max(state)) - 1
        return F.transform(state, lambda x, i: F.when(i == top, x + F.signum(F.col("d").cast("double")).cast("int")).otherwise(x))

    steps = F.when(F.col("d") == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.abs("d").cast("int")))
    fixed = packed.withColumn("d", diff).select(F.arrays_zip("g", F.aggregate(steps, F.col("s"), step).alias("s")).alias("z"))
    return fixed.select(F.posexplode("z").alias("pos", "z")).select(
        F.col("z.g").alias(group), F.col("z.s").alias("slots"), (F.col("pos") + 1).alias("volume_order")
    )


def interleave_by_category(
    items: DataFrame, slots: DataFrame, group: str, score: str, pool: int, item: str = "item_id"
) -> DataFrame:
    """Rank-1 item of every group, then every rank-2 item, up to each group's slots.

    No group has more slots than the pool, so ranks beyond it are cut before the shuffle.
    """
    ranked = top_n(items, [group], [F.desc(score), F.asc(item)], pool, "group_rank")
    kept = ranked.join(slots, group).filter(F.col("group_rank") <= F.col("slots"))
    first = kept.orderBy("group_rank", "volume_order").limit(pool)
    w = W.partitionBy(F.lit(1)).orderBy("group_rank", "volume_order")
    return first.select(item, group, score, F.row_number().over(w).alias("pool_rank"))


def union_all(sources: Mapping[str, DataFrame], tag: str = "source") -> DataFrame:
    return reduce(
        lambda a, b: a.unionByName(b), [df.withColumn(tag, F.lit(name)) for name, df in sources.items()]
    )


def union_distinct(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).union(right.select(key)).filter(F.col(key).isNotNull()).distinct()


def list_intersect(a: DataFrame, b: DataFrame, key: str, item: str = "item_id") -> DataFrame:
    """Overlap of two ranked lists per user and whether they hold the same items."""
    tagged = a.select(key, item, F.lit(1).alias("s")).union(b.select(key, item, F.lit(2).alias("s")))
    sides = tagged.distinct().groupBy(key, item).agg(F.count("*").alias("c"), F.max("s").alias("m"))
    return sides.groupBy(key).agg(
        F.count_if(F.col("c") == 2).alias("n_common"),
        F.count_if((F.col("c") == 2) | (F.col("m") == 1)).alias("n_a"),
        F.count_if((F.col("c") == 2) | (F.col("m") == 2)).alias("n_b"),
    ).withColumn("same_set", (F.col("n_common") == F.col("n_a")) & (F.col("n_common") == F.col("n_b")))


def set_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_anti")
