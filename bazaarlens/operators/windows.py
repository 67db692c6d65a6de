"""Window operators: transitions, sessions, normalization, rolling means, latest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarlens.functions.columns import has_query, is_explicit, is_pageview, pct, seconds
from bazaarlens.operators.core import (
    in_slices, join_keys, lag_in_slices, quantiles, ranks, running_count, top_n,
)

top_n_per_group = top_n


def lag_transition(df: DataFrame, keys: Sequence[str], order: str, state: str) -> DataFrame:
    """Previous order value and state per key, for tables with one row per key and calendar bucket."""
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumns({f"prev_{order}": F.lag(order).over(w), f"prev_{state}": F.lag(state).over(w)})


def normalized_query(c: Column | str = "query") -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def query_refinement_lag(events: DataFrame, keys: Sequence[str] = ("category", "session_id")) -> DataFrame:
    """Search pageviews with the previous normalized query of the session and a refinement flag."""
    searches = events.filter(is_pageview() & has_query()).withColumn("q", normalized_query())
    lagged = lag_in_slices(searches, list(keys), "event_ts", "event_id", ["q"])
    changed = F.col("prev_q").isNotNull() & (F.col("prev_q") != F.col("q"))
    return lagged.withColumn("is_refinement", F.when(changed, 1).otherwise(0))


def gap_sessionize(
    events: DataFrame, user: str = "user_id", ts: str = "event_ts", tie: str = "event_id", gap_seconds: float = 1800, out: str = "session_no",
) -> DataFrame:
    """Number the sessions of each user: a new one starts when the gap exceeds the threshold.

    The events are cut into slices once; both the gaps and the numbers are found in them.
    """
    cut = events if "__slice" in events.columns else in_slices(events, [user], ts, tie)
    lagged = lag_in_slices(cut, [user], ts, tie, [ts], "__prev_")
    gap = seconds(ts) - seconds(f"__prev_{ts}")
    starts = F.when(gap.isNull() | (gap > F.lit(float(gap_seconds))), 1).otherwise(0)
    numbered = running_count(lagged.withColumn("__new", starts).drop(f"__prev_{ts}"), [user], ts, tie, F.col("__new"), out).drop("__new")
    return numbered if "__slice" in events.columns else numbered.drop("__slice")


def min_max_norm(df: DataFrame, keys: Sequence[str], columns: Sequence[str], suffix: str = "_norm") -> DataFrame:
    """(x-min)/(max-min+1e-10) per key; missing values become 0.

    Bounds come from a combining aggregation joined back, so a large key is never in one window.
    """
    bounds = df.groupBy(*keys).agg(
        *[F.min(c).alias(f"__lo_{c}") for c in columns], *[F.max(c).alias(f"__hi_{c}") for c in columns]
    )
    joined = join_keys(df, bounds, keys)
    for c in columns:
        span = F.col(f"__hi_{c}") - F.col(f"__lo_{c}") + F.lit(1e-10)
        joined = joined.withColumn(f"{c}{suffix}", F.coalesce((F.col(c) - F.col(f"__lo_{c}")) / span, F.lit(0.0)))
    return joined.drop(*[f"__{b}_{c}" for b in ("lo", "hi") for c in columns])


def pct_rank(df: DataFrame, keys: Sequence[str], value: str, out: str, bounded: bool = False) -> DataFrame:
    """Average-rank percentile of ``value`` inside its key: avg rank / group size."""
    table = ranks(df, keys, value, bounded).select(*keys, value, (F.col("avg_rank") / F.col("n_total")).alias(out))
    return join_keys(df, table, [*keys, value], "left")


def segment_zscore(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """(x - segment median) / max(segment std, 0.1)."""
    stats = df.groupBy(*keys).agg(F.stddev_samp(value).alias("__sd"))
    stats = join_keys(stats, quantiles(df, keys, value, {"__med": 0.5}), keys, "left")
    z = (F.col(value) - F.col("__med")) / F.greatest(F.coalesce(F.col("__sd"), F.lit(0.0)), F.lit(0.1))
    return join_keys(df, stats, keys, "left").withColumn(out, z).drop("__sd", "__med")


def rolling_mean(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, rows: int = 7) -> DataFrame:
    """Trailing mean over a table with one row per key and calendar day."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0)
    return df.withColumn(out, F.avg(value).over(w))


def first_contact_rank(events: DataFrame, session: str = "session_id") -> DataFrame:
    """Ordinal of the first explicit contact among the session's events.

    The first contact's position is the number of events up to it: an aggregation and a join, no
    ordering of whole sessions.
    """
    at = F.struct("event_ts", "event_id")
    first = events.filter(is_explicit()).groupBy(session).agg(F.min(at).alias("first_at"))
    return (
        events.select(session, at.alias("at")).join(first, session)
        .groupBy(session).agg(F.count_if(F.col("at") <= F.col("first_at")).alias("first_contact_rank"))
    )


def last_n_per_user(events: DataFrame, n: int = 50) -> DataFrame:
    """Each user's newest ``n`` distinct items, newest first."""
    last = events.groupBy("user_id", "item_id").agg(F.max("event_ts").alias("last_ts"))
    return top_n(last, ["user_id"], [F.desc("last_ts"), F.asc("item_id")], n)


def latest_row(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], cutoff=None) -> DataFrame:
    """Last non-null value of each column up to ``cutoff``; one combining aggregation."""
    rows = df if cutoff is None else df.filter(F.col(order) <= F.lit(cutoff))
    return rows.groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns],
        F.max(order).alias(f"last_{order}"),
    )


def relative_to_group_max(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Share of the key's largest value; the maxima combine before the shuffle and are joined back."""
    peak = df.groupBy(*keys).agg(F.max(value).alias("__peak"))
    return join_keys(df, peak, keys, "left").withColumn(out, F.try_divide(F.col(value).cast("double"), F.col("__peak").cast("double"))).drop("__peak")


def index_to_first_bucket(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """Value as percent of the key's first bucket, for a table with few buckets per key."""
    first = F.first(value).over(W.partitionBy(*keys).orderBy(order))
    return df.withColumn(out, pct(value, first))
