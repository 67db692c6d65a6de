"""Event predicates, listing buckets and encodings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.columns import (
    as_col, bucketize, flag, has_query, is_explicit, is_login, is_other, is_pageview, is_positive,
)
from bazaarlens.operators.core import quantiles
from bazaarlens.session import durable
from bazaarlens.sources.star import global_row_number

# Bucket edges and labels of the reports.
AGE_LABELS = ["0-2d", "3-7d", "8-14d", "15-30d", "31-60d", "60+d"]
AGE_EDGES = [2, 7, 14, 30, 60]
POST_AGE_LABELS = ["0-7d (fresh)", "8-30d", "31-90d", "91-365d", ">365d"]
POST_AGE_EDGES = [7, 30, 90, 365]
AREA_EDGES = [20, 30, 45, 60, 80, 100, 150, 200, 300, 500]
AREA_LABELS = ["<20", "20-30", "30-45", "45-60", "60-80", "80-100", "100-150", "150-200", "200-300", "300-500", ">500"]
AREA5_EDGES = [30, 50, 80, 120]
AREA5_LABELS = ["<30", "30-50", "50-80", "80-120", "120+"]
POSITION_LABELS = ["1-5", "6-10", "11-20", "21+"]
DWELL_LABELS = ["bounce_<5s", "skim_5-15s", "engaged_15s+"]
METRO_NAMES = ["tp hồ chí minh", "tp ho chi minh", "hồ chí minh"]


def event_filters(
    events: DataFrame, categories=None, types=None, login_only=False, start=None, end=None, not_null: Sequence[str] = ()
) -> DataFrame:
    """The usual scan predicates, all pushed to the parquet reader."""
    out = events
    if categories is not None:
        out = out.filter(F.col("category").isin(list(categories)))
    if types is not None:
        out = out.filter(F.col("event_type").isin(list(types)))
    if login_only:
        out = out.filter(is_login())
    if start is not None:
        out = out.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.filter(F.col("date") <= F.lit(end).cast("date"))
    for c in not_null:
        out = out.filter(F.col(c).isNotNull())
    return out


def exclude_window(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return df.filter(~((F.col(ts) >= lo) & (F.col(ts) < hi)))


def event_layer(c: Column | str = "event_type") -> Column:
    return (
        F.when(is_pageview(c), "pageview").when(is_other(c), "other_interaction")
        .when(is_explicit(c), "explicit_contact").otherwise("other_event_type")
    )


def event_flags(events: DataFrame) -> DataFrame:
    hour = F.hour("event_ts")
    return events.withColumns({
        "is_positive": flag(is_positive()), "is_pageview": flag(is_pageview()),
        "is_search": flag(is_pageview() & has_query()), "hour": hour,
        "is_weekend": flag(F.weekday("event_ts") >= 5), "is_night": flag((hour >= 22) | (hour < 6)),
    })


def age_bucket(c: Column | str) -> Column:
    return bucketize(c, AGE_EDGES, AGE_LABELS, "right", "unk")


def post_age_bucket(c: Column | str) -> Column:
    return bucketize(c, POST_AGE_EDGES, POST_AGE_LABELS, "right", None)


def area_bucket(c: Column | str, edges=AREA_EDGES, labels=AREA_LABELS) -> Column:
    return bucketize(c, edges, labels, "left", None)


def _filled(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))


def _unknown_or(c: str, col: Column) -> Column:
    return F.when(F.col(c).isNull() | (F.col(c) <= 0), "unknown_or_0").otherwise(col)


def structure_buckets(dim: DataFrame) -> DataFrame:
    return dim.withColumns({
        "bed_bucket": _unknown_or("bedrooms", bucketize("bedrooms", [1, 2, 3], ["1", "2", "3", "4+"], "right")),
        "floors_bucket": _unknown_or("floors", bucketize("floors", [2, 4], ["1-2", "3-4", "5+"], "right")),
        "has_project": flag(_filled("project_id")), "has_legal": flag(_filled("legal_status")),
        "has_furnishing": flag(_filled("furnishing")), "has_width": flag(F.col("width_m") > 0),
        "area_bucket": _unknown_or("area_sqm", bucketize("area_sqm", AREA5_EDGES, AREA5_LABELS)),
    })


def position_bucket(c: Column | str = "position") -> Column:
    return bucketize(c, [5, 10, 20], POSITION_LABELS, "right", None)


def dwell_band(c: Column | str = "dwell_time_sec") -> Column:
    return bucketize(c, [5, 15], DWELL_LABELS, "left", "unknown")


def quantile_buckets(df: DataFrame, value: str, q: int, out: str, clip_upper: float | None = None) -> DataFrame:
    """Quantile bins 1..q with equal edges merged; equal values always share a bin."""
    v = F.col(value).cast("double") if clip_upper is None else F.least(F.col(value).cast("double"), F.lit(float(clip_upper)))
    valued = df.withColumn("__v", v)
    names = {f"e{i}": i / q for i in range(q + 1)}
    row = quantiles(valued, [], "__v", names).select(F.array_distinct(F.array(*names)))
    return (
        valued.withColumn("__edges", row.scalar())
        .withColumn(out, F.greatest(F.size(F.filter("__edges", lambda e: e < F.col("__v"))), F.lit(1)))
        .withColumn(out, F.when(F.col("__v").isNotNull(), F.col(out)))
        .drop("__v", "__edges")
    )


def city_predicate(c: Column | str = "city_name", names: Sequence[str] = METRO_NAMES) -> Column:
    """Metropolis test on the normalized name; the names are an argument."""
    clean = F.lower(F.replace(F.replace(F.trim(as_col(c)), F.lit("tp."), F.lit("tp")), F.lit("  "), F.lit(" ")))
    hit = clean.isin(list(names))
    if list(names) == METRO_NAMES:
        hit = hit | clean.like("%hồ chí minh%") | clean.like("%ho chi minh%")
    return F.coalesce(hit, F.lit(False))


def label_encode_all(df: DataFrame, columns: Mapping[str, str], unknown: str = "unknown") -> DataFrame:
    """Codes 0..n-1 in alphabetical order of each column's distinct values.

    One pass collects the distinct (column, value) rows, which are numbered over range partitions
    and written once; every column then joins its codes by value, so no dictionary meets in one task.
    """
    value = {c: F.coalesce(F.col(c).cast("string"), F.lit(unknown)) for c in columns}
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), v.alias("word")) for c, v in value.items()])).alias("p")).select("p.*").distinct()
    numbered = global_row_number(pairs, ["column", "word"], "n")
    first = numbered.groupBy("column").agg(F.min("n").alias("first"))
    codes = durable(numbered.join(first, "column").select("column", "word", (F.col("n") - F.col("first")).cast("int").alias("code")), "codes")
    for c, out in columns.items():
        own = codes.filter(F.col("column") == c).select(F.col("word").alias("__word"), F.col("code").alias(out))
        df = df.join(own, value[c] == F.col("__word"), "left").drop("__word")
    return df


def label_encode(df: DataFrame, column: str, out: str, unknown: str = "unknown") -> DataFrame:
    return label_encode_all(df, {column: out}, unknown)


def cases(c: Column | str, mapping: Mapping[str, str], default=None) -> Column:
    out = None
    for key, label in mapping.items():
        out = (F if out is None else out).when(as_col(c) == key, F.lit(label))
    return out.otherwise(F.lit(default))
