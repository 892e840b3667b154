"""Small column helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICRO = 1e6


def fixed(c: Column) -> Column:
    """A double as a whole number of millionths."""
    return F.floor(c * F.lit(MICRO) + F.lit(0.5)).cast("long")


def fsum(c: Column) -> Column:
    """Sum of doubles that does not depend on row order or partition count.

    Doubles are added as whole millionths, so a retried task or another partitioning gives the
    same bits. NULLs count as nothing; an empty group gives 0.
    """
    return F.coalesce(F.sum(fixed(c)), F.lit(0)).cast("double") / F.lit(MICRO)


def fmean(c: Column) -> Column:
    """Order-independent mean; NULL for an empty group."""
    return F.sum(fixed(c)).cast("double") / F.lit(MICRO) / F.nullif(F.count(c), F.lit(0)).cast("double")


def n_if(cond: Column) -> Column:
    """Number of rows where the condition holds (NULL counts as not)."""
    return F.count_if(F.coalesce(cond, F.lit(False)))


def sum_if(cond: Column, c: Column) -> Column:
    return fsum(F.when(cond, c))


def ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    """num / den * scale as double, 0 when the denominator is 0."""
    den = den.cast("double")
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") * F.lit(float(scale)) / den)


def pct(num: Column, den: Column) -> Column:
    return ratio(num, den, 100.0)


def truthy(c: Column) -> Column:
    """Loose provider booleans: true/1/yes/y in any case, non-zero numbers; NULL and NaN are false."""
    text = F.lower(F.trim(c.cast("string")))
    number = text.try_cast("double")
    return F.coalesce(text.isin("1", "true", "yes", "y"), F.lit(False)) | F.coalesce(
        (number != 0) & ~F.isnan(number), F.lit(False))


def has(name: str, quals: str = "qualifiers") -> Column:
    """Whether the qualifier list holds this exact name."""
    return F.coalesce(F.array_contains(F.col(quals), name), F.lit(False))


def has_like(pattern: str, quals: str = "qualifiers") -> Column:
    """Whether any qualifier name matches the pattern."""
    return F.coalesce(F.exists(F.col(quals), lambda q: q.rlike(pattern)), F.lit(False))


def dist(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = ax - bx, ay - by
    return F.sqrt(dx * dx + dy * dy)
