"""Data quality and normalization."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.columns import as_col, flag, is_explicit, is_login, pct, ratio
from bazaarlens.operators.core import first_rows, join_keys, quantiles, unpivot_row

# Price texts, units and patterns of the listings' price buckets.
UNITS = {"k": 1e3, "nghìn": 1e3, "m": 1e6, "triệu": 1e6, "b": 1e9, "tỷ": 1e9}
RANGE_CODES = r"([\d.,]+)\s*([MBKmbk])\s*[-–~]\s*([\d.,]+)\s*([MBKmbk])"
RANGE_WORDS = r"([\d.,]+)\s*(tỷ|triệu|nghìn)\s*(?:/tháng)?\s*[-–~]\s*([\d.,]+)\s*(tỷ|triệu|nghìn)"
BELOW = r"(?:^<|dưới|duoi)\s*([\d.,]+)\s*([MBKmbk])"
ABOVE = r"(?:^>|trên|tren)\s*([\d.,]+)\s*([MBKmbk])"
NEGOTIABLE = ["thỏa thuận", "thoa thuan"]
BILLIONS = r"(\d+(?:[.,]\d+)?)\s*(?:tỷ|ty|billion)"
MILLIONS = r"(\d+(?:[.,]\d+)?)\s*(?:triệu|tr|million)"
RENT_WORDS = r"cho thu[eê]|thuê |thuê|phòng trọ"
SELL_WORDS = r"(^|[^\p{L}])bán($|[^\p{L}])"
BALCONY_WORDS = r"ban công|ban cong|bán công|luỹ bán|lũy bán|bán bích"
# Order of the price buckets, from the cheapest up, for sale and for rent.
SALE_ORDER = ["<500M", "500M–800M", "800M–1B", "1B–1.5B", "1.5B–2B", "2B–3B", "3B–5B", "5B–7B", "7B–10B", "10B–15B",
              "15B–20B", ">20B"]
RENT_ORDER = ["<2M/tháng", "2M–3M/tháng", "3M–5M/tháng", "5M–7M/tháng", "7M–10M/tháng", "10M–15M/tháng",
              "15M–20M/tháng", "20M–30M/tháng", ">30M/tháng"]


def dedupe_items(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The best row per key in ``order``; map partitions drop all but one row per key first."""
    return first_rows(df, keys, order)


def dropped_duplicates(df: DataFrame, kept: DataFrame, row_id: str) -> DataFrame:
    return df.join(kept.select(row_id), row_id, "left_anti")


def cap_contacts(snapshot: DataFrame) -> DataFrame:
    over = F.col("contacts_24h") > F.col("views_24h")
    return snapshot.withColumns({
        "contact_violation": flag(over), "contacts_24h": F.least("contacts_24h", "views_24h")})


def recompute_contact_flag(events: DataFrame) -> DataFrame:
    return events.withColumn("is_contact", flag(is_explicit()))


def contact_flag_consistency(events: DataFrame) -> DataFrame:
    """How the delivered flag agrees with the one derived from the event type."""
    derived = is_explicit()
    return events.groupBy("category").agg(
        F.count_if((F.col("is_contact") == 1) & derived).alias("both"),
        F.count_if((F.col("is_contact") == 1) & ~derived).alias("flag_only"),
        F.count_if((F.coalesce("is_contact", F.lit(0)) == 0) & derived).alias("type_only"),
    )


def category_mismatch(events: DataFrame, dim: DataFrame) -> DataFrame:
    known = dim.select("item_id", F.col("category").alias("dim_category"))
    joined = events.select("item_id", "category").join(known, "item_id", "left")
    differs = F.col("dim_category").isNotNull() & (F.col("category") != F.col("dim_category"))
    return joined.groupBy("category").agg(
        F.count("*").alias("n"), F.count_if(differs).alias("mismatched"),
        F.count_if(F.col("dim_category").isNull()).alias("no_dim"))


def drop_orphans(facts: DataFrame, dim: DataFrame, key: str = "item_id") -> DataFrame:
    return facts.join(dim.select(key), key, "left_semi")


def orphans(facts: DataFrame, dim: DataFrame, key: str = "item_id") -> DataFrame:
    return facts.join(dim.select(key), key, "left_anti")


def drop_future(df: DataFrame, column: str, window_end) -> DataFrame:
    end = F.lit(window_end).cast("date")
    return df.filter(F.col(column).isNull() | (F.to_date(column) <= end))


def fix_expiry(dim: DataFrame) -> DataFrame:
    bad = F.col("expected_expired_date") < F.col("posted_date")
    return dim.withColumn("expected_expired_date", F.when(~F.coalesce(bad, F.lit(False)), F.col("expected_expired_date")))


def normalize_event_time(events: DataFrame, shift: str | None = None) -> DataFrame:
    """Naive event time and its calendar date; ``date_mismatch`` marks rows whose date differed."""
    naive = F.col("event_ts").cast("timestamp_ntz")
    if shift:
        naive = naive + F.expr(f"INTERVAL {shift}")
    return events.withColumns({
        "event_ts": naive, "date_mismatch": flag(F.col("date") != F.to_date(naive)), "date": F.to_date(naive)})


def normalize_dwell(events: DataFrame, column: str = "dwell_time_sec", cap_prob: float = 0.99) -> DataFrame:
    """Seconds from a column that may hold milliseconds (median above 1000), capped at the p99.

    One pass of exact quantiles gives both numbers; they enter as a scalar subquery.
    """
    stats = quantiles(events, [], column, {"median": 0.5, "cap": cap_prob}).select(F.struct("median", "cap").alias("s"))
    row = stats.scalar()
    factor = F.when(row["median"] > 1000, F.lit(1000.0)).otherwise(F.lit(1.0))
    return events.withColumn(column, F.least(F.col(column), row["cap"]) / factor)


def flag_zero_views(snapshot: DataFrame) -> DataFrame:
    return snapshot.withColumn("zero_views", flag(F.coalesce(F.col("views_24h"), F.lit(0.0)) == 0))


def null_outliers(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column).between(low, high), F.col(column)))


def null_rates(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    wide = df.groupBy(*keys).agg(*[F.avg(flag(F.col(c).isNull())).alias(c) for c in columns])
    return unpivot_row(wide, keys, {c: c for c in columns}, "column", "null_rate")


def drop_sparse_columns(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Drop columns whose null rate exceeds the threshold. Which columns remain is part of the
    schema, so this runs one aggregation and reads one row of rates."""
    rates = df.agg(*[F.avg(flag(F.col(c).isNull())).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if (rates[c] or 0.0) > threshold])


def normalize_text(c: Column | str) -> Column:
    """Trimmed lower text with single spaces; 'nan', 'none' and '' become NULL."""
    text = F.lower(F.trim(F.regexp_replace(as_col(c), r"\s+", " ")))
    return F.when(~text.isin("", "nan", "none"), text)


def _amount(text: Column, pattern: str, number: int, unit: int) -> Column:
    value = F.replace(F.regexp_extract(text, pattern, number), F.lit(","), F.lit(".")).try_cast("double")
    code = F.lower(F.regexp_extract(text, pattern, unit))
    factor = None
    for name, size in UNITS.items():
        factor = (F if factor is None else factor).when(code == name, F.lit(size))
    return value * factor


def price_bucket_to_numeric(df: DataFrame, column: str = "price_bucket") -> DataFrame:
    """low, high, mid in VND and a negotiable flag from the price text.

    Each distinct text is parsed once and joined back, so the patterns do not run on every row.
    """
    return join_keys(df, _parse_prices(df.select(column).distinct(), column), [column], "left")


def _parse_prices(df: DataFrame, column: str) -> DataFrame:
    text = F.lower(F.trim(column))
    negotiable = text.contains(NEGOTIABLE[0]) | text.contains(NEGOTIABLE[1])
    rules = [  # pattern, low, high
        (RANGE_CODES, lambda p: _amount(text, p, 1, 2), lambda p: _amount(text, p, 3, 4)),
        (BELOW, lambda p: F.lit(0.0), lambda p: _amount(text, p, 1, 2)),
        (ABOVE, lambda p: _amount(text, p, 1, 2), lambda p: _amount(text, p, 1, 2) * 1.5),
        (RANGE_WORDS, lambda p: _amount(text, p, 1, 2), lambda p: _amount(text, p, 3, 4)),
    ]
    nothing = F.lit(None).cast("double")
    low, high = F.when(negotiable, nothing), F.when(negotiable, nothing)
    matched = None
    for pattern, lo, hi in rules:
        hit = text.rlike(pattern)
        low, high = low.when(hit, lo(pattern)), high.when(hit, hi(pattern))
        matched = hit if matched is None else matched | hit
    priced = df.withColumns({
        "price_low": low, "price_high": high,
        "is_negotiable": F.when(negotiable, True).when(matched, False),
    })
    some = F.col("price_low").isNotNull() | F.col("price_high").isNotNull()
    mid = (F.coalesce("price_low", F.lit(0.0)) + F.coalesce("price_high", F.lit(0.0))) / 2
    return priced.withColumn("price_mid", F.when(some, mid))


def price_log(c: Column | str) -> Column:
    """log1p of the price in the text: billions plus millions, else its first number."""
    text = F.lower(as_col(c).cast("string"))

    def part(pattern: str, size: float) -> Column:
        number = F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit(".")).try_cast("double")
        return F.coalesce(number * F.lit(size), F.lit(0.0))

    value = part(BILLIONS, 1e9) + part(MILLIONS, 1e6)
    first = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"(\d+)", 1).try_cast("double")
    chosen = F.when(value > 0, value).otherwise(first)
    return F.when(chosen > 0, F.log1p(chosen))


def price_ordinal(c: Column | str) -> Column:
    """Position of the price bucket in its sale or rent order, -1 when unknown."""
    text = as_col(c)
    sale = F.array_position(F.array(*[F.lit(v) for v in SALE_ORDER]), text)
    rent = F.array_position(F.array(*[F.lit(v) for v in RENT_ORDER]), text)
    return F.coalesce(F.greatest(sale, rent) - 1, F.lit(-1)).cast("int")


def price_per_sqm_winsor(df: DataFrame, price: str = "price_mid", area: str = "area_sqm") -> DataFrame:
    raw = df.withColumn("price_per_sqm", F.when(F.col(area) > 0, ratio(price, area)))
    limits = quantiles(raw, [], "price_per_sqm", {"lo": 0.01, "hi": 0.99}).select(F.struct("lo", "hi")).scalar()
    v = F.col("price_per_sqm")
    return raw.withColumn("price_per_sqm", F.when(v.isNotNull(), F.greatest(F.least(v, limits["hi"]), limits["lo"])))


def user_scope_id(events: DataFrame) -> DataFrame:
    scope = F.when(is_login(), F.col("user_id").cast("string")).otherwise(F.col("session_id"))
    return events.withColumn("scope_id", scope)


def session_login_state(events: DataFrame) -> DataFrame:
    """Per session: whether login states mix, and the state that counts (login wins)."""
    return events.groupBy("session_id").agg(
        flag(F.min("is_login") != F.max("is_login")).alias("is_mixed"),
        F.when(F.max(flag(is_login())) == 1, "login").otherwise("non-login").alias("session_login"))


def quality_log(issues: Sequence[tuple[str, str, DataFrame, Column, str]]) -> DataFrame:
    """(group, issue, n_issue, total, pct, action), one row per check, each one aggregation."""
    rows = [
        df.agg(F.count_if(cond).alias("n_issue"), F.count("*").alias("total")).select(
            F.lit(group).alias("group"), F.lit(issue).alias("issue"), "n_issue", "total",
            pct("n_issue", "total").alias("pct"), F.lit(action).alias("action"))
        for group, issue, df, cond, action in issues
    ]
    return reduce(DataFrame.unionByName, rows)


def quality_log_rollup(log: DataFrame) -> DataFrame:
    return log.groupBy("group").agg(F.count("*").alias("issues"), F.sum("n_issue").alias("n_issue"))


def null_rate_matrix(df: DataFrame, key: str, columns: Sequence[str], valid_nulls: Mapping[str, Sequence]) -> DataFrame:
    """Null percent per category and column; ``valid_nulls`` names categories where NULL is expected."""
    long = null_rates(df, columns, [key]).select(key, "column", (F.col("null_rate") * 100).alias("null_pct"))
    expected = F.lit(False)
    for column, cats in valid_nulls.items():
        expected = expected | ((F.col("column") == column) & F.col(key).isin(list(cats)))
    return long.withColumn("valid_null", flag(expected))


def fill_rate(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Percent truly filled: numbers above zero, texts not blank."""
    kinds = dict(df.dtypes)

    def filled(c: str) -> Column:
        cond = F.trim(c) != "" if kinds[c] == "string" else F.col(c).isNotNull() if kinds[c] == "date" else F.col(c) > 0
        return F.avg(flag(cond)) * 100

    wide = df.groupBy(key).agg(*[filled(c).alias(c) for c in columns])
    return unpivot_row(wide, [key], {c: c for c in columns}, "field", "fill_pct")


def snapshot_sanity(snapshot: DataFrame, dim: DataFrame, events: DataFrame) -> DataFrame:
    """Contacts above views, zero views, and daily snapshot contacts against explicit events."""
    joined = snapshot.join(dim.select("item_id", "category"), "item_id")
    zero = F.coalesce(F.col("views_24h"), F.lit(0.0)) == 0
    rates = joined.groupBy("category").agg(
        F.count("*").alias("listing_days"),
        pct(F.count_if(F.col("contacts_24h") > F.col("views_24h")), F.count("*")).alias("pct_contact_gt_view"),
        pct(F.count_if(zero), F.count("*")).alias("pct_views_zero"))
    snap_daily = joined.groupBy("category", "date").agg(F.sum("contacts_24h").alias("snap_contacts"))
    ev_daily = events.filter(is_login() & is_explicit()).groupBy("category", "date").agg(F.count("*").alias("explicit"))
    daily = snap_daily.join(ev_daily, ["category", "date"], "left").groupBy("category").agg(
        F.avg("snap_contacts").alias("avg_daily_snap"), F.avg("explicit").alias("avg_daily_explicit"),
        F.avg(ratio("explicit", "snap_contacts")).alias("avg_event_snap_ratio"))
    return rates.join(daily, "category")


def time_coverage(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    rows = [
        df.agg(F.min(F.to_date(c)).alias("t_min"), F.max(F.to_date(c)).alias("t_max"), F.count("*").alias("n_rows"))
        .select(F.lit(name).alias("source"), "t_min", "t_max", "n_rows")
        for name, (df, c) in tables.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def posted_cohort(start: str, end: str, c: str = "posted_date") -> Column:
    d = F.col(c)
    return (
        F.when(d.isNull(), "unknown").when(d < F.lit(start).cast("date"), "pre_window")
        .when(d > F.lit(end).cast("date"), "post_window").otherwise("in_window")
    )


def cohort_event_overlap(dim: DataFrame, events: DataFrame, start: str, end: str) -> DataFrame:
    """Listings by posted cohort, with the share that has events and the share with a positive one."""
    from bazaarlens.functions.columns import is_positive

    seen = events.groupBy("item_id").agg(F.max(flag(is_positive())).alias("positive"))
    joined = dim.withColumn("cohort", posted_cohort(start, end)).join(seen, "item_id", "left")
    return joined.groupBy("category", "cohort").agg(
        F.count("*").alias("listings"), F.count("positive").alias("with_events"),
        pct(F.count("positive"), F.count("*")).alias("pct_with_events"),
        pct(F.coalesce(F.sum("positive"), F.lit(0)), F.count("*")).alias("cvr_pct"))


def alive_in_window(dim: DataFrame, start: str, end: str) -> DataFrame:
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    alive = (F.col("expected_expired_date") >= lo) & (F.col("posted_date") <= hi)
    return dim.groupBy("category").agg(F.count("*").alias("n"), (F.avg(flag(alive)) * 100).alias("alive_pct"))


def table_scale(events: DataFrame) -> DataFrame:
    return events.groupBy("category", "is_login").agg(
        F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.countDistinct("item_id").alias("items"))


def unexpected_categories(df: DataFrame, known: Sequence[int]) -> DataFrame:
    return df.filter(F.col("category").isNull() | ~F.col("category").isin(list(known))).groupBy("category").agg(
        F.count("*").alias("n"))


def location_completeness(dim: DataFrame, levels: Sequence[str] = ("city_name", "district_name", "ward_name")) -> DataFrame:
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in levels])
    return dim.groupBy("category").agg(
        F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in levels],
        (F.avg(flag(complete)) * 100).alias("complete_pct"))


def metrics_long(section: str, table: DataFrame, key: str, metrics: Mapping[str, str]) -> DataFrame:
    """(section, metric, category, value, unit) rows from a wide table; ``metrics`` maps name to unit."""
    long = unpivot_row(table, [key], {m: m for m in metrics}, "metric", "value")
    unit = F.lit(None).cast("string")
    for name, u in metrics.items():
        unit = F.when(F.col("metric") == name, F.lit(u)).otherwise(unit)
    return long.select(F.lit(section).alias("section"), "metric", F.col(key).alias("category"), "value", unit.alias("unit"))


def adtype_title_mismatch(dim: DataFrame) -> DataFrame:
    """Sale listings whose title talks of renting and the reverse, ignoring balcony phrases."""
    title = F.lower(F.coalesce("title", F.lit("")))
    rent = title.rlike(RENT_WORDS)
    sell = title.rlike(SELL_WORDS) & ~title.rlike(BALCONY_WORDS)
    a, b = (F.col("ad_type") == "sell") & rent, (F.col("ad_type") == "let") & sell
    return dim.groupBy("category").agg(
        F.count("*").alias("n"), F.count_if(a).alias("sell_rent_title"), F.count_if(b).alias("let_sell_title"),
        pct(F.count_if(a), F.count("*")).alias("pct_sell_rent"), pct(F.count_if(b), F.count("*")).alias("pct_let_sell"))


def dim_prep_summary(
    dim: DataFrame, categories: Sequence[int], active: Sequence[str], start: str, end: str,
    keys: Sequence[str], order: Sequence[Column],
) -> DataFrame:
    """Rows left after each preparation stage: in scope, active in the window, deduplicated, dropped."""
    scoped = dim.filter(F.col("category").isin(list(categories)) & F.col("ad_type").isin("let", "sell"))
    live = scoped.filter(
        F.col("ad_status").isin(list(active)) & (posted_cohort(start, end) == "in_window")
        & (F.trim("city_name") != ""))
    one = dedupe_items(live, keys, order)
    counts = [df.agg(F.count("*").alias("rows")) for df in (scoped, live, one)]
    named = [c.select(F.lit(n).alias("stage"), "rows") for n, c in zip(("in_scope", "active_in_window", "deduplicated"), counts)]
    dropped = counts[1].select((F.col("rows") - counts[2].scalar()).alias("rows")).select(F.lit("dropped").alias("stage"), "rows")
    return reduce(DataFrame.unionByName, [*named, dropped])
