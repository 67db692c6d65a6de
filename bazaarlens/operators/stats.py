"""Aggregations and statistics: counts, quantiles, shares, concentration, correlation, tests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.columns import as_col, pct, ratio
from bazaarlens.operators.core import (
    at_most, histogram, join_keys, prefix_sums, quantiles, ranks, share_of_all, share_within,
)


def conditional_counts(df: DataFrame, keys: Sequence[str], conds: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in conds.items()])


def distinct_counts(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.countDistinct(c).alias(n) for n, c in columns.items()])


def approx_distinct(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str], rsd: float = 0.01) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.approx_count_distinct(c, rsd).alias(n) for n, c in columns.items()])


def filtered_agg(df: DataFrame, keys: Sequence[str], value: str, conds: Mapping[str, Column]) -> DataFrame:
    """Count and sum of ``value`` over the rows meeting each condition."""
    aggs = []
    for name, cond in conds.items():
        aggs += [F.count_if(cond).alias(f"n_{name}"), F.sum(F.when(cond, F.col(value))).alias(f"sum_{name}")]
    return df.groupBy(*keys).agg(*aggs)


def mode_value(df: DataFrame, keys: Sequence[str], value: str, out: str = "mode", count: str = "n_mode") -> DataFrame:
    """Most frequent non-null value per key, the smallest on ties. Two combining aggregations."""
    hist = histogram(df, keys, value)
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col(value).alias("v"))).alias("__b")
    return hist.groupBy(*keys).agg(best).select(
        *keys, F.col("__b.v").alias(out), (-F.col("__b.neg")).alias(count)
    )


def string_list_agg(df: DataFrame, keys: Sequence[str], value: str, out: str, sep: str = ", ", most: int = 1000) -> DataFrame:
    """Distinct values of a small domain (categories, channels) joined into one text per key; more than ``most`` raise."""
    values = at_most(df.select(*keys, value).distinct(), keys, [F.asc(value)], most)
    return values.groupBy(*keys).agg(
        F.array_join(F.sort_array(F.collect_list(value)), sep).alias(out)
    )


def ordered_list_agg(df: DataFrame, keys: Sequence[str], rank: str, value: str, out: str, most: int = 10_000) -> DataFrame:
    """The key's list in rank order; meant for ranked lists, so more than ``most`` rows of a key raise."""
    pairs = F.sort_array(F.collect_list(F.struct(rank, value)))
    return at_most(df, keys, [F.asc(rank), F.asc(value)], most).groupBy(*keys).agg(F.transform(pairs, lambda p: p[value]).alias(out))


def having_min_n(df: DataFrame, dims: Sequence[str], aggs: Sequence[Column], min_n: int) -> DataFrame:
    return df.groupBy(*dims).agg(F.count("*").alias("n"), *aggs).filter(F.col("n") >= min_n)


def share_of_total(df: DataFrame, dims: Sequence[str], within: Sequence[str]) -> DataFrame:
    """Row counts by ``dims`` with percent of the grand total and percent within ``within``."""
    counts = df.groupBy(*dims).agg(F.count("*").alias("n"))
    return share_within(share_of_all(counts, "n", "pct_total", bounded=False), within, "n", "pct_within")


def crosstab_pct(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Cross table of row percentages; the column values are given, so no extra scan finds them."""
    wide = df.filter(F.col(column).isin(list(values))).groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1)))
    total = sum((F.coalesce(F.col(f"`{v}`"), F.lit(0)) for v in values), F.lit(0))
    return wide.select(row, *[pct(F.coalesce(F.col(f"`{v}`"), F.lit(0)), total).alias(f"pct_{v}") for v in values])


def gini(df: DataFrame, keys: Sequence[str], value: str, include_zeros: bool = False, bounded: bool = False) -> DataFrame:
    """Gini coefficient of ``value`` per key: sum((2i-n-1)x) / (n sum x).

    Rows with equal value are handled together: c rows after b smaller ones add x*c*(2b+c-n).
    """
    rows = df if include_zeros else df.filter(F.col(value) > 0)
    ranked = prefix_sums(histogram(rows, keys, value), keys, value, {"n": F.col("n")}, bounded)
    weight = F.col(value) * F.col("n")
    term = weight * (2 * F.col("n_before") + F.col("n") - F.col("n_total"))
    return ranked.groupBy(*keys).agg(
        ratio(F.sum(term), F.max("n_total") * F.sum(weight)).alias("gini")
    )


def top_pct_share(df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[int], bounded: bool = False) -> DataFrame:
    """Percent of the total held by the top p percent of rows (k = ceil(n*p), at least one)."""
    ranked = prefix_sums(histogram(df, keys, value), keys, value, {"n": F.col("n")}, bounded)
    return ranked.groupBy(*keys).agg(*[_top_share(value, p).alias(f"top_{p}pct_share") for p in percents])


def _top_share(value: str, percent: int) -> Column:
    k = F.greatest(F.lit(1), F.ceil(F.col("n_total") * percent / F.lit(100.0)))
    above = F.col("n_total") - F.col("n_before") - F.col("n")
    take = F.greatest(F.lit(0), F.least(F.col("n"), k - above))
    return pct(F.sum(F.col(value) * take), F.sum(F.col(value) * F.col("n")))


def hhi(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Herfindahl index on the 10,000 and the 0-1 scale, with the largest share, in one pass."""
    v = F.when(F.col(value) > 0, F.col(value).cast("double"))
    total = F.sum(v)
    return df.groupBy(*keys).agg(
        ratio(F.sum(v * v), total * total, 10000.0).alias("hhi"),
        ratio(F.sum(v * v), total * total).alias("hhi_01"),
        ratio(F.max(v), total).alias("top1_share"),
    )


def entropy(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Shannon entropy of the shares of ``value`` (natural log) and its base-2 normalized form.

    -sum(p ln p) = ln T - sum(v ln v)/T, so no share window is needed.
    """
    v = F.when(F.col(value) > 0, F.col(value).cast("double"))
    total, n = F.sum(v), F.count(v)
    h = F.greatest(F.ln(total) - F.try_divide(F.sum(v * F.ln(v)), total), F.lit(0.0))
    return df.groupBy(*keys).agg(
        h.alias("entropy"),
        F.when(n > 1, h / F.ln(n)).otherwise(F.lit(0.0)).alias("normalized_entropy"),
    )


def lorenz_curve(df: DataFrame, keys: Sequence[str], value: str, bounded: bool = False) -> DataFrame:
    """Cumulative population percent against cumulative value percent, one point per distinct value."""
    measures = {"n": F.col("n"), "v": F.col("n") * F.col(value)}
    ranked = prefix_sums(histogram(df, keys, value), keys, value, measures, bounded)
    return ranked.select(
        *keys,
        value,
        pct(F.col("n_before") + F.col("n"), "n_total").alias("cum_population_pct"),
        pct(F.col("v_before") + F.col("n") * F.col(value), "v_total").alias("cum_value_pct"),
    )


def concentration_table(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Entity counts summarized per key: size, mean, median, Gini, top shares, singletons.

    ``df`` has one row per entity with an integer count; the histogram of counts is small.
    """
    ranked = prefix_sums(histogram(df, keys, value), keys, value, {"n": F.col("n")}, bounded=True)
    weight = F.col(value) * F.col("n")
    term = weight * (2 * F.col("n_before") + F.col("n") - F.col("n_total"))
    return ranked.groupBy(*keys).agg(
        F.sum("n").alias("n_entities"),
        F.sum(weight).alias("total"),
        ratio(F.sum(weight), F.sum("n")).alias("mean"),
        F.percentile(value, F.lit(0.5), F.col("n")).alias("median"),
        ratio(F.sum(term), F.max("n_total") * F.sum(weight)).alias("gini"),
        *[_top_share(value, p).alias(f"top_{p}pct_share") for p in (1, 5, 10, 20)],
        pct(F.sum(F.when(F.col(value) == 1, F.col("n")).otherwise(0)), F.sum("n")).alias("singleton_pct"),
    )


def capped_histogram(df: DataFrame, value: str, prob: float = 0.99) -> DataFrame:
    """Histogram of integer ``value`` with everything above the p99 put into the p99 bin."""
    cap = quantiles(df, [], value, {"cap": prob}, bounded=True).scalar()
    binned = df.select(F.least(F.col(value).cast("double"), cap).alias("bin"))
    return binned.groupBy("bin").agg(F.count("*").alias("n"))


def pearson_vs_label(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Correlation of every feature with the label from one aggregation."""
    wide = df.agg(*[F.corr(f, label).alias(f) for f in features])
    pairs = [F.struct(F.lit(f).alias("feature"), F.col(f).alias("corr")) for f in features]
    return wide.select(F.explode(F.array(*pairs)).alias("p")).select("p.feature", "p.corr")


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, bounded: bool = False) -> DataFrame:
    """Rank correlation with average ranks for ties, over rows where both values are present."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    pairs = rows.groupBy(*keys, x, y).agg(F.count("*").alias("__w"))
    rx = ranks(rows, keys, x, bounded).select(*keys, x, F.col("avg_rank").alias("__rx"))
    ry = ranks(rows, keys, y, bounded).select(*keys, y, F.col("avg_rank").alias("__ry"))
    joined = join_keys(join_keys(pairs, rx, [*keys, x]), ry, [*keys, y])
    w, a, b = F.col("__w"), F.col("__rx"), F.col("__ry")
    sums = joined.groupBy(*keys).agg(
        F.sum(w).cast("double").alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"),
        F.sum(w * a * b).alias("sab"), F.sum(w * a * a).alias("saa"), F.sum(w * b * b).alias("sbb"),
    )
    cov = F.col("n") * F.col("sab") - F.col("sa") * F.col("sb")
    var = (F.col("n") * F.col("saa") - F.col("sa") ** 2) * (F.col("n") * F.col("sbb") - F.col("sb") ** 2)
    return sums.select(*keys, ratio(cov, F.sqrt(var)).alias("spearman"), F.col("n").cast("long").alias("n_pairs"))


def two_sided_p(z: Column) -> Column:
    """Two-sided normal p-value by the Abramowitz-Stegun 7.1.26 approximation (error < 2e-7)."""
    # Fixed values of the approximation.
    coef = [1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592]
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = F.lit(0.0)
    for c in coef:
        poly = (poly + F.lit(c)) * t
    return poly * F.exp(-x * x)


def two_proportion_ztest(df: DataFrame, group: str, success: Column, first, second) -> DataFrame:
    """Pooled two-proportion z-test between the rows of two group values."""
    g = F.col(group)
    one = df.agg(
        F.count_if(g == first).alias("n_a"), F.count_if((g == first) & success).alias("x_a"),
        F.count_if(g == second).alias("n_b"), F.count_if((g == second) & success).alias("x_b"),
    )
    pa, pb = ratio("x_a", "n_a"), ratio("x_b", "n_b")
    pooled = ratio(F.col("x_a") + F.col("x_b"), F.col("n_a") + F.col("n_b"))
    se = F.sqrt(pooled * (1 - pooled) * (ratio(F.lit(1), "n_a") + ratio(F.lit(1), "n_b")))
    scored = one.withColumns({"p_a": pa, "p_b": pb, "z": F.try_divide(pa - pb, se)})
    return scored.withColumn("p_value", two_sided_p(F.col("z")))


def categorical_compare(df: DataFrame, cohort: str, columns: Sequence[str]) -> DataFrame:
    """Share of each value of each column inside each cohort, long form."""
    pairs = [F.struct(F.lit(c).alias("variable"), F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("bucket"))
             for c in columns]
    long = df.select(cohort, F.explode(F.array(*pairs)).alias("p")).select(cohort, "p.variable", "p.bucket")
    counts = long.groupBy(cohort, "variable", "bucket").agg(F.count("*").alias("n"))
    return share_within(counts, [cohort, "variable"], "n", "pct")


def numeric_compare(df: DataFrame, cohort: str, columns: Sequence[str]) -> DataFrame:
    """Quartiles and mean of each numeric column inside each cohort, long form."""
    pairs = [F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns]
    long = df.select(cohort, F.explode(F.array(*pairs)).alias("p")).select(cohort, "p.variable", "p.value")
    keys = [cohort, "variable"]
    means = long.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    return join_keys(means, quantiles(long, keys, "value", {"p25": 0.25, "median": 0.5, "p75": 0.75}), keys, "left")


def correlation_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pairwise Pearson correlations in long form; one aggregation with one ``corr`` per pair."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    wide = df.select(*[as_col(f).cast("double").alias(f) for f in features]).agg(
        *[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs]
    )
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs]
    cells += [F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"`{a}|{b}`").alias("corr"))
              for a, b in pairs if a != b]
    return wide.select(F.explode(F.array(*cells)).alias("p")).select("p.a", "p.b", "p.corr")


def area_percentiles(df: DataFrame, keys: Sequence[str], value: str, bands: Mapping[str, Column]) -> DataFrame:
    present = df.filter(F.col(value).isNotNull())
    shares = present.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"),
        *[pct(F.count_if(c), F.count("*")).alias(name) for name, c in bands.items()],
    )
    quart = quantiles(present, keys, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return join_keys(shares, quart, keys)
