"""Column expressions shared by the operators: ratios, buckets, decay, flags, dates, hashing."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from bazaarlens.schemas import EXPLICIT, LOGIN, OTHER, PAGEVIEW, POSITIVE


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ratio(num: Column | str, den: Column | str, scale: float = 1.0) -> Column:
    """``scale * num / den``; NULL when the denominator is zero or NULL."""
    return F.try_divide(as_col(num) * F.lit(float(scale)), as_col(den).cast("double"))


def pct(num: Column | str, den: Column | str) -> Column:
    return ratio(num, den, 100.0)


def flag(cond: Column) -> Column:
    """1 where the condition holds, else 0 (NULL counts as 0)."""
    return F.when(cond, 1).otherwise(0)


def is_positive(c: Column | str = "event_type") -> Column:
    return as_col(c).isin(POSITIVE)


def is_explicit(c: Column | str = "event_type") -> Column:
    return as_col(c).isin(EXPLICIT)


def is_pageview(c: Column | str = "event_type") -> Column:
    return as_col(c) == PAGEVIEW


def is_other(c: Column | str = "event_type") -> Column:
    return as_col(c) == OTHER


def is_login(c: Column | str = "is_login") -> Column:
    return as_col(c) == LOGIN


def has_query(c: Column | str = "query") -> Column:
    return F.coalesce(F.trim(as_col(c)) != "", F.lit(False))


def bucketize(
    value: Column | str,
    edges: Sequence[float],
    labels: Sequence,
    closed: str = "left",
    missing=None,
) -> Column:
    """Label of the interval ``value`` falls in.

    ``edges`` are the inner cut points, so there is one more label than edges. With
    ``closed='left'`` an edge belongs to the upper interval, with ``'right'`` to the lower one.
    """
    if len(labels) != len(edges) + 1:
        raise ValueError("need one more label than edges")
    v = as_col(value)
    out = F.when(v.isNull(), F.lit(missing))
    for edge, label in zip(edges, labels):
        out = out.when(v < edge if closed == "left" else v <= edge, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def width_bin(value: Column | str, width: float, maximum: float | None = None) -> Column:
    v = as_col(value)
    binned = F.floor(v / F.lit(float(width))) * F.lit(int(width))
    return binned if maximum is None else F.when(v <= maximum, binned)


def weighted(c: Column | str, weights: Mapping[str, float], default: float = 0.0) -> Column:
    """Event weight by type; the map is an argument because several maps are in use."""
    out = None
    for key, w in weights.items():
        out = (F if out is None else out).when(as_col(c) == key, F.lit(float(w)))
    return out.otherwise(F.lit(float(default)))


def decay(age_days: Column, tau: float, kind: str = "exp") -> Column:
    """Recency weight: ``exp(-age/tau)``, true half-life ``2^(-age/tau)``, or ``exp(-tau*age)``."""
    rate = {"exp": 1.0 / tau, "half_life": math.log(2.0) / tau, "rate": tau}[kind]
    return F.exp(age_days.cast("double") * F.lit(-rate))


def seconds(ts: Column | str) -> Column:
    """Seconds since the epoch with microsecond precision, for naive or zoned timestamps."""
    return F.unix_micros(as_col(ts).cast("timestamp")) / F.lit(1e6)


def days_between(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(as_col(later), as_col(earlier))


def weekday(c: Column | str) -> Column:
    """0 = Monday ... 6 = Sunday, the one convention used throughout."""
    return F.weekday(as_col(c))


def month(c: Column | str) -> Column:
    return F.date_format(as_col(c), "yyyy-MM")


def md5_mod(key: Column | str, modulus: int) -> Column:
    """``int(md5(key), 16) % modulus`` from the two 64-bit halves of the digest."""
    digest = F.md5(as_col(key).cast("string"))
    high = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    low = F.conv(F.substring(digest, 17, 16), 16, 10).cast("decimal(20,0)")
    step = (2**64) % modulus
    return (((high % modulus) * step + (low % modulus)) % modulus).cast("int")


def argmax_label(pairs: Sequence[tuple[str, Column]], missing=None) -> Column:
    """Label of the largest positive value; earlier labels win ties."""
    best = F.greatest(*[c for _, c in pairs])
    out = F.when(F.coalesce(best, F.lit(0)) <= 0, F.lit(missing))
    for label, c in pairs:
        out = out.when(c == best, F.lit(label))
    return out


def all_of(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def any_of(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column | str) -> Column:
    """The vector scaled to length 1 (zero vectors stay as they are)."""
    norm = F.greatest(l2_norm(a), F.lit(1e-12))
    return F.transform(as_col(a), lambda x: x.cast("double") / norm)


def cosine(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))


def ordinal(index: int) -> Column:
    return F.lit(index)


def log_base(value: Column, base: float) -> Column:
    return F.ln(value) / F.lit(math.log(base))
