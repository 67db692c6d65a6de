"""Distinct counts over moving windows from stored, mergeable daily sketches.

A day is sketched once; any window is the union of its days' sketches, so neither older events nor
the ids behind them are read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2 ** 14 registers: a standard error of about 0.8 percent, 16 KB for a full sketch, less for a small one.
PRECISION = 14


def daily_sketches(events: DataFrame, keys: Sequence[str], who: str = "user_id", date: str = "date", precision: int = PRECISION) -> DataFrame:
    """(keys, date, sketch): who was seen that day; sketches combine inside map tasks."""
    return events.filter(F.col(who).isNotNull()).groupBy(*keys, date).agg(F.hll_sketch_agg(F.col(who).cast("string"), F.lit(precision)).alias("sketch"))


def window_uniques(sketches: DataFrame, keys: Sequence[str], as_of: str, days: Sequence[int], date: str = "date", prefix: str = "users") -> DataFrame:
    """(keys, users_<n>d): distinct visitors of the last n days up to and with ``as_of``; all windows in one pass."""
    end = F.lit(as_of).cast("date")
    age = F.datediff(end, F.col(date))
    rows = sketches.filter((age >= 0) & (age < max(days)))
    merged = rows.groupBy(*keys).agg(*[F.hll_union_agg(F.when(age < d, F.col("sketch"))).alias(f"__{d}") for d in days])
    return merged.select(*keys, *[F.coalesce(F.hll_sketch_estimate(f"__{d}"), F.lit(0)).alias(f"{prefix}_{d}d") for d in days])


def exact_window_uniques(events: DataFrame, keys: Sequence[str], as_of: str, days: Sequence[int], who: str = "user_id", date: str = "date", prefix: str = "users") -> DataFrame:
    """The same counts from the events themselves: the newest day on which each pair was seen decides all windows."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col(date))
    seen = events.filter(F.col(who).isNotNull() & (age >= 0) & (age < max(days))).groupBy(*keys, who).agg(F.min(age).alias("__age"))
    return seen.groupBy(*keys).agg(*[F.count_if(F.col("__age") < d).alias(f"{prefix}_{d}d") for d in days])
