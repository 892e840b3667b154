"""Array expressions that the JVM-only operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once for the row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def neighbours(items: Column, size: Column, step, gap: int = 1) -> Column:
    """step(item, item `gap` places on) for each place that has one; `size` is the array's."""
    return F.when(size > gap, F.zip_with(F.slice(items, 1, F.greatest(size - gap, F.lit(0))),
                                         F.slice(items, gap + 1, F.greatest(size - gap, F.lit(0))), step)).otherwise(F.array())
