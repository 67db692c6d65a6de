"""Join patterns. No broadcast is forced: Spark broadcasts a side only when its size allows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarlens.functions.columns import is_explicit, pct, ratio
from bazaarlens.operators.core import join_keys
from bazaarlens.session import durable


def enrich_events(events: DataFrame, dim: DataFrame, columns: Sequence[str]) -> DataFrame:
    return events.join(dim.select("item_id", *columns), "item_id")


def flag_left_join(df: DataFrame, keys_df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """1 where the row's key occurs in ``keys_df`` (made distinct first), else 0."""
    keyed = keys_df.select(*keys).distinct().withColumn("__hit", F.lit(1))
    return df.join(keyed, list(keys), "left").withColumn(out, F.coalesce("__hit", F.lit(0))).drop("__hit")


def full_outer_zero(left: DataFrame, right: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Full outer join with coalesced keys; missing measures become 0."""
    joined = left.alias("l").join(right.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], "full")
    out = [F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in keys]
    for m in measures:
        side = "l" if m in left.columns else "r"
        out.append(F.coalesce(F.col(f"{side}.{m}"), F.lit(0)).alias(m))
    return joined.select(*out)


def supply_demand_full_outer(dim: DataFrame, demand: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Listings and events aggregated on their own sides, then joined on the few cells."""
    supply = dim.groupBy(*keys).agg(F.count("*").alias("listings"))
    wanted = demand.groupBy(*keys).agg(F.count("*").alias("events"))
    joined = full_outer_zero(supply, wanted, keys, ["listings", "events"])
    return joined.withColumn("events_per_1k", ratio("events", "listings", 1000.0))


def scope_semi(df: DataFrame, scope: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(scope.select(*keys), list(keys), "left_semi")


def anti_exists(df: DataFrame, exclude: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(exclude.select(*keys), list(keys), "left_anti")


def within_bounds(df: DataFrame, bounds: DataFrame, value: str, low: str, high: str) -> DataFrame:
    """Rows whose value lies in a one-row bounds table, read as a scalar subquery."""
    lo = bounds.select(F.min(low)).scalar()
    hi = bounds.select(F.max(high)).scalar()
    return df.filter((F.col(value) >= lo) & (F.col(value) <= hi))


def with_pool(users: DataFrame, pool: DataFrame, k: int, order: Sequence[Column], item: str = "item_id") -> DataFrame:
    """Give every user the first ``k`` pool items.

    The pool is cut to ``k`` rows and becomes one array literal; nothing is shuffled or crossed.
    """
    row = W.partitionBy(F.lit(1)).orderBy(*order)
    best = pool.orderBy(*order).limit(k).select(F.row_number().over(row).alias("rank"), item)
    packed = best.agg(F.sort_array(F.collect_list(F.struct("rank", item)))).scalar()
    exploded = users.select(*users.columns, F.explode(packed).alias("__p"))
    return exploded.select(*users.columns, f"__p.{item}", "__p.rank")


def event_snapshot_join(events: DataFrame, snapshot: DataFrame, how: str = "inner") -> DataFrame:
    """Listing age on the day of the event: equality on item and date."""
    return events.join(snapshot.select("item_id", "date", "listing_age_days"), ["item_id", "date"], how)


def verified_chat_join(events: DataFrame, interactions: DataFrame) -> DataFrame:
    """Chat events with at least one message the same day, one row per (session, user, item, date)."""
    talked = interactions.filter(F.col("chat_message_count") > 0).select("user_id", "item_id", "date").distinct()
    chats = events.filter(F.col("event_type") == "contact_chat")
    return chats.join(talked, ["user_id", "item_id", "date"], "left_semi").select(
        "category", "session_id", "user_id", "item_id", "date"
    ).distinct()


def first_contacts(events: DataFrame, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    return events.filter(is_explicit()).groupBy(*keys).agg(F.min("event_ts").alias("t0"))


def before_first_contact(events: DataFrame, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """Events strictly before each key's first explicit contact."""
    return join_keys(events, first_contacts(events, keys), list(keys)).filter(F.col("event_ts") < F.col("t0"))


def ordinal_band_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_ord: str, right_ord: str, band: int = 1
) -> DataFrame:
    """Equality on ``keys`` and ordinals at most ``band`` apart, or one of them unknown (negative).

    The band becomes part of the equality: a known left ordinal looks up its neighbors and the
    unknown ones, so no pair outside the band is ever made.
    """
    keys = list(keys)
    o = F.col(left_ord)
    near = F.concat(F.sequence(F.greatest(o - band, F.lit(0)), o + band), F.array(F.lit(-1)))
    known = left.filter(o >= 0).withColumn("__o", F.explode(near))
    lookup = right.withColumn("__o", F.greatest(F.col(right_ord), F.lit(-1)))
    in_band = known.join(lookup, [*keys, "__o"]).drop("__o")
    unknown = left.filter(o < 0).join(right, keys)
    return in_band.unionByName(unknown)


def ordinal_band_counts(
    left: DataFrame, right: DataFrame, who: str, keys: Sequence[str], left_ord: str, right_ord: str, band: int = 1
) -> DataFrame:
    """(who, n, items): the pairs of ``ordinal_band_join`` and their distinct right rows, without making them.

    The right side is counted once per cell (keys, ordinal); a left row looks up the cells of its
    band, an unknown ordinal all cells of its keys. As a right row lies in one cell, the distinct
    rows of ``who`` are those of the distinct cells met. Rows made: left rows times ordinals.
    """
    keys = list(keys)
    cells = right.withColumn("__o", F.greatest(F.col(right_ord), F.lit(-1))).groupBy(*keys, "__o").agg(F.count("*").alias("__n"))
    steps = durable(cells, "steps")
    o = F.col(left_ord)
    wished = left.groupBy(who, *keys, F.greatest(o, F.lit(-1)).alias("__w")).agg(F.count("*").alias("__times"))
    near = F.concat(F.sequence(F.greatest(F.col("__w") - band, F.lit(0)), F.col("__w") + band), F.array(F.lit(-1)))
    known = wished.filter("__w >= 0").withColumn("__o", F.explode(near)).join(steps, [*keys, "__o"])
    unknown = wished.filter("__w < 0").join(steps, keys)
    met = known.unionByName(unknown).groupBy(who, *keys, "__o").agg(F.sum(F.col("__times") * F.col("__n")).alias("__pairs"), F.max("__n").alias("__n"))
    return met.groupBy(who).agg(F.sum("__pairs").alias("n"), F.sum("__n").alias("items"))


def first_last(df: DataFrame, keys: Sequence[str], order: str, state: str) -> DataFrame:
    """First and last state per key without joining the table to its own bounds."""
    return df.groupBy(*keys).agg(
        F.min_by(state, order).alias(f"first_{state}"), F.max_by(state, order).alias(f"last_{state}")
    )


def alias_lookup(df: DataFrame, mapping: DataFrame, key: str, value: str, unknown: str = "Unknown") -> DataFrame:
    joined = df.join(mapping.select(key, value), key, "left")
    return joined.withColumn(value, F.coalesce(value, F.lit(unknown)))


def role_overlap(demand: DataFrame, supply: DataFrame, key: str) -> DataFrame:
    """Ids seen only as demand, only as supply, in both; Jaccard and conditional percents."""
    a = demand.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("d", F.lit(1))
    b = supply.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("s", F.lit(1))
    both = F.col("d").isNotNull() & F.col("s").isNotNull()
    counts = a.join(b, key, "full").agg(
        F.count_if(F.col("s").isNull()).alias("only_demand"),
        F.count_if(F.col("d").isNull()).alias("only_supply"),
        F.count_if(both).alias("both"),
    )
    union = F.col("only_demand") + F.col("only_supply") + F.col("both")
    return counts.withColumns({
        "jaccard": ratio("both", union),
        "pct_demand_also_supply": pct("both", F.col("only_demand") + F.col("both")),
        "pct_supply_also_demand": pct("both", F.col("only_supply") + F.col("both")),
    })
