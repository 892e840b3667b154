"""Interval joins on the match clock without a per-match cross product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def near_in_time(left: DataFrame, right: DataFrame, keys, left_t: str, right_t: str, back: int = 0, ahead: int = 0,
                 extra: Column | None = None, how: str = "inner") -> DataFrame:
    """Pairs with equal ``keys`` and ``left_t - back <= right_t <= left_t + ahead`` (whole seconds).

    Time is cut into buckets as long as the whole interval; the left row (the rarer side) is copied into
    the two or three buckets its interval can touch. The join is then an equi-join on keys and bucket: a
    busy match spreads over its buckets instead of meeting in one task, and only rows of neighbouring
    buckets are compared.
    """
    width = max(1, back + ahead)
    lo = F.floor((F.col(left_t) - back) / width).cast("bigint")
    hi = F.floor((F.col(left_t) + ahead) / width).cast("bigint")
    lhs = left.withColumn("_b", F.explode(F.sequence(lo, hi)))
    rhs = right.withColumn("_rb", F.floor(F.col(right_t) / width).cast("bigint"))
    cond = (F.col("_b") == F.col("_rb")) & (F.col(right_t) >= F.col(left_t) - back) & (F.col(right_t) <= F.col(left_t) + ahead)
    for k in keys:
        lk, rk = k if isinstance(k, tuple) else (k, k)
        cond = cond & (lhs[lk] == rhs[rk])
    if extra is not None:
        cond = cond & extra
    return lhs.join(rhs, cond, how).drop("_b", "_rb")


def prefixed(df: DataFrame, prefix: str, cols) -> DataFrame:
    """Only these columns, each with a prefix, so that both join sides stay distinguishable."""
    return df.select(*[F.col(n).alias(f"{prefix}{n}") for n in cols])
