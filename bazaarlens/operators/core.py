"""Primitives that keep whole results while no task ever holds a whole hot group.

Ordered work over a group (ranks, cumulative sums, quantiles, lag) is done in two levels: inside
slices of the group, and over the few slice totals. A group that holds a third of all rows is then
spread over its slices.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarlens.functions.columns import as_col
from bazaarlens.session import durable


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL keys match each other; key columns come from ``left``.

    Without keys ``right`` must be one row; it is attached as a scalar subquery, never crossed.
    """
    if not keys:
        one = right.select(F.struct(*right.columns)).scalar()
        return left.withColumns({c: one[c] for c in right.columns})
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    cond = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per key. The row-number filter lets Spark cut each map partition to
    ``n`` rows per key before the shuffle, so a hot key moves at most ``n`` rows per partition."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def at_most(df: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """``df``, once it is sure that no key has more than ``most`` rows; else the job raises.

    For operators that gather a key's rows in one array: map tasks stop at one row too many, so a
    key beyond the bound is never gathered, and nothing is cut in silence.
    """
    rows = top_n(df, keys, order, most + 1, "__nth")
    told = F.concat(F.lit(f"more than {most} rows for "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    return rows.filter(F.when(F.col("__nth") > most, F.raise_error(told).cast("boolean")).otherwise(F.lit(True))).drop("__nth")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_n(df, keys, order, 1, "__rn").drop("__rn")


def histogram(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per key and distinct value with its frequency ``n``; NULL values are left out."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    measures: Mapping[str, Column],
    bounded: bool = False,
) -> DataFrame:
    """Add ``<m>_before`` (sum over smaller ``order`` values) and ``<m>_total`` per key.

    ``df`` has one row per (keys, order). ``bounded=True`` states that a key has few distinct
    values (counts of N events take at most sqrt(2N) values; ages and positions fewer still), so
    one window per key is enough. Otherwise rows are range-partitioned by key and value and written
    once with their partition number; sums run inside (key, partition) and are shifted by the key's
    totals of the partitions before, of which there are few.
    """
    keys = list(keys)
    df = df.withColumns({f"__m_{m}": c for m, c in measures.items()})
    if bounded:
        before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        every = W.partitionBy(*keys)
        for m in measures:
            df = df.withColumn(f"{m}_before", F.coalesce(F.sum(f"__m_{m}").over(before), F.lit(0)))
            df = df.withColumn(f"{m}_total", F.sum(f"__m_{m}").over(every))
        return df.drop(*[f"__m_{m}" for m in measures])
    ranged = durable(df.repartitionByRange(*keys, order).withColumn("__part", F.spark_partition_id()), "slices")
    local = W.partitionBy(*keys, "__part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    sliced = ranged.withColumns({f"__in_{m}": F.coalesce(F.sum(f"__m_{m}").over(local), F.lit(0)) for m in measures})
    sums = ranged.groupBy(*keys, "__part").agg(*[F.sum(f"__m_{m}").alias(f"__s_{m}") for m in measures])
    every = W.partitionBy(*keys)
    earlier = every.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        *keys, "__part", *[F.coalesce(F.sum(f"__s_{m}").over(earlier), F.lit(0)).alias(f"__o_{m}") for m in measures],
        *[F.sum(f"__s_{m}").over(every).alias(f"{m}_total") for m in measures])
    out = join_keys(sliced, offsets, [*keys, "__part"])
    out = out.withColumns({f"{m}_before": F.col(f"__in_{m}") + F.col(f"__o_{m}") for m in measures})
    return out.drop("__part", *[f"__{p}_{m}" for p in ("m", "in", "o") for m in measures])


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], bounded: bool = False
) -> DataFrame:
    """Exact interpolated quantiles per key (the ``quantile_cont`` rule), from the histogram."""
    keys = list(keys)
    hist = histogram(df, keys, value)
    if bounded:
        aggs = [F.percentile(value, F.lit(float(p)), F.col("n")).alias(name) for name, p in probs.items()]
        return hist.groupBy(*keys).agg(*aggs)
    ranked = prefix_sums(hist, keys, value, {"n": F.col("n")})
    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("n_total") - 1)
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("n_before") <= at) & (at < F.col("n_before") + F.col("n"))
            aggs.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"__{side}_{name}"))
    picked = ranked.groupBy(*keys).agg(F.max("n_total").alias("__n"), *aggs)
    out = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("__n") - 1)
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return picked.select(*keys, *out)


def ranks(df: DataFrame, keys: Sequence[str], value: str, bounded: bool = False) -> DataFrame:
    """One row per (keys, value): average rank ``avg_rank``, ties ``n``, group size ``n_total``."""
    ranked = prefix_sums(histogram(df, keys, value), keys, value, {"n": F.col("n")}, bounded)
    return ranked.withColumn("avg_rank", F.col("n_before") + (F.col("n") + 1) / 2.0).drop("n_before")


def in_slices(df: DataFrame, keys: Sequence[str], ts: str, tie: str) -> DataFrame:
    """``df`` with ``__slice``, written once: slices are ranges of (keys, ts, tie) of about equal size.

    A key with a third of all rows, even within one second, spans as many slices as its share; a
    small key lies in one or two.
    """
    return durable(df.repartitionByRange(*keys, ts, tie).withColumn("__slice", F.spark_partition_id()), "ordered")


def lag_in_slices(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    columns: Sequence[str],
    prefix: str = "prev_",
) -> DataFrame:
    """The previous row's ``columns`` per key in (ts, tie) order, for keys of any size.

    Lag runs inside (keys, slice); the first row of a slice takes the last row of the key's slice
    before from a table with one row per key and slice. Rows that ``in_slices`` has cut are used as they are.
    """
    keys = list(keys)
    cut = df if "__slice" in df.columns else in_slices(df, keys, ts, tie)
    row = F.struct(*columns)
    inside = W.partitionBy(*keys, "__slice").orderBy(ts, tie)
    lagged = cut.withColumn("__prev", F.lag(row).over(inside))
    lasts = cut.groupBy(*keys, "__slice").agg(F.max_by(row, F.struct(ts, tie)).alias("__last"))
    over = W.partitionBy(*keys).orderBy("__slice")
    carried = lasts.select(*keys, "__slice", F.lag("__last").over(over).alias("__carry"))
    out = join_keys(lagged, carried, [*keys, "__slice"])
    prev = F.coalesce(F.col("__prev"), F.col("__carry"))
    out = out.withColumns({f"{prefix}{c}": prev[c] for c in columns}).drop("__prev", "__carry")
    return out if "__slice" in df.columns else out.drop("__slice")


def running_count(df: DataFrame, keys: Sequence[str], ts: str, tie: str, flag: Column, out: str) -> DataFrame:
    """Inclusive running sum of ``flag`` per key in (ts, tie) order, sliced like ``lag_in_slices``."""
    keys = list(keys)
    cut = (df if "__slice" in df.columns else in_slices(df, keys, ts, tie)).withColumn("__f", flag.cast("long"))
    inside = W.partitionBy(*keys, "__slice").orderBy(ts, tie).rowsBetween(W.unboundedPreceding, 0)
    local = cut.withColumn("__local", F.sum("__f").over(inside))
    sums = cut.groupBy(*keys, "__slice").agg(F.sum("__f").alias("__sum"))
    over = W.partitionBy(*keys).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*keys, "__slice", F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__off"))
    joined = join_keys(local, offsets, [*keys, "__slice"]).withColumn(out, F.col("__local") + F.col("__off")).drop("__f", "__local", "__off")
    return joined if "__slice" in df.columns else joined.drop("__slice")


def share_within(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Percent of the key's total, for an already aggregated table."""
    total = F.sum(value).over(W.partitionBy(*keys))
    return df.withColumn(out, F.try_divide(F.col(value) * 100.0, total.cast("double")))


def share_of_all(df: DataFrame, value: str, out: str, bounded: bool = False) -> DataFrame:
    """Percent of the grand total.

    A report with one row per cell of a few dimensions (``bounded``) gets its total from a window
    over those rows, so the facts behind it are read once. A table that grows with the data gets
    it from a scalar subquery, so its rows never meet in one task.
    """
    if bounded:
        total = F.sum(value).over(W.partitionBy(F.lit(1))).cast("double")
    else:
        total = df.agg(F.sum(value).cast("double")).scalar()
    return df.withColumn(out, F.try_divide(F.col(value) * 100.0, total))


def unpivot_row(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str], name: str, value: str) -> DataFrame:
    """Turn wide measure columns into (name, value) rows."""
    pairs = [F.struct(F.lit(label).alias(name), as_col(c).cast("double").alias(value)) for label, c in columns.items()]
    return df.select(*keys, F.explode(F.array(*pairs)).alias("__p")).select(*keys, f"__p.{name}", f"__p.{value}")
