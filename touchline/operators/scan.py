"""Ordered scans over a match that never put a whole match into one task.

A plain ``Window.partitionBy("matchId")`` sorts a match in one task. That is fine for a clean match but
not for a feed where one id collects a large share of all rows. These helpers cut a match into segments
of the dense event position (``index``), scan each segment on its own, and hand each segment the state
of the ones before (or after) it. The handed-over state has one row per segment: a group of four billion
rows hands over as many rows as one segment holds. More ``levels`` scan that state the same way.

Where the position column carries a bound in its metadata (see ``bounded``) that fits in one segment,
nothing can be handed over and the scan is the plain window: one shuffle for a whole chain of scans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SEGMENT = 65_536
LEVELS = 2


@dataclass(frozen=True)
class RunningSum:
    """Sum of a whole-number column over all earlier rows (and this row when inclusive)."""
    out: str
    value: Column
    inclusive: bool = False


@dataclass(frozen=True)
class LastBefore:
    """Value of the nearest earlier row (or this one when inclusive) where the condition holds."""
    out: str
    value: Column
    where: Column | None = None
    inclusive: bool = False


@dataclass(frozen=True)
class NextAfter:
    """Value of the nearest later row where the condition holds."""
    out: str
    value: Column
    where: Column | None = None


def bounded(c: Column, name: str, below: int | None) -> Column:
    """The column with a note that its values stay below a number; sources set it where they can prove it."""
    return c.alias(name, metadata={"below": int(below)}) if below else c.alias(name)


def bound_of(df: DataFrame, pos: str) -> int | None:
    return df.schema[pos].metadata.get("below")


def fits_one_segment(df: DataFrame, pos: str, segment: int) -> bool:
    below = bound_of(df, pos)
    return below is not None and below <= segment


def _plain_scan(df: DataFrame, specs, keys, pos: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(pos)
    before, upto = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(*keys).orderBy(F.desc(pos)).rowsBetween(W.unboundedPreceding, -1)
    cols, boxed = {}, []
    for s in specs:
        if isinstance(s, RunningSum):
            run = F.sum(s.value).over(upto if s.inclusive else before)
            cols[s.out] = run if s.inclusive else F.coalesce(run, F.lit(0))
            continue
        box = F.struct(s.value.alias("v"))
        box = box if s.where is None else F.when(s.where, box)
        frame = after if isinstance(s, NextAfter) else upto if s.inclusive else before
        cols[s.out] = F.last(box, ignorenulls=True).over(frame).getField("v")
    return df.withColumns(cols)


def scan(df: DataFrame, specs, keys=("matchId",), pos: str = "index",
         segment: int = SEGMENT, levels: int = LEVELS) -> DataFrame:
    """Add one column per spec. ``pos`` must be a unique, dense position inside the key group."""
    keys = list(keys)
    if fits_one_segment(df, pos, segment):
        return _plain_scan(df, specs, keys, pos)
    names = [s.out for s in specs]
    work = df.withColumn("_seg", F.floor(F.col(pos) / F.lit(segment)).cast("long"))
    w = W.partitionBy(*keys, "_seg").orderBy(pos)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    # Looking ahead = looking back in reverse order: a frame that grows by one row costs one step per row,
    # a frame that shrinks from the end is evaluated anew for every row.
    after = W.partitionBy(*keys, "_seg").orderBy(F.desc(pos)).rowsBetween(W.unboundedPreceding, -1)

    local, summary = {}, []
    for s in specs:
        if isinstance(s, RunningSum):
            local[s.out] = F.sum(s.value).over(upto if s.inclusive else before)
            summary.append(F.sum(s.value).alias(s.out))
            continue
        boxed = F.struct(s.value.alias("v"))
        if s.where is not None:
            boxed = F.when(s.where, boxed)
        at = F.col(pos) if s.where is None else F.when(s.where, F.col(pos))
        if isinstance(s, LastBefore):
            local[s.out] = F.last(boxed, ignorenulls=True).over(upto if s.inclusive else before)
            summary.append(F.max_by(boxed, at).alias(s.out))
        else:
            local[s.out] = F.last(boxed, ignorenulls=True).over(after)
            summary.append(F.min_by(boxed, at).alias(s.out))

    carried = _carry(work.groupBy(*keys, "_seg").agg(*summary), specs, keys, segment, levels - 1)
    carried = carried.select(*keys, "_seg", *[F.col(n).alias(f"_in_{n}") for n in names])
    out = work.withColumns(local).join(carried, keys + ["_seg"], "left")
    final = {}
    for s in specs:
        inside, handed = F.col(s.out), F.col(f"_in_{s.out}")
        if isinstance(s, RunningSum):
            final[s.out] = F.coalesce(inside, F.lit(0)) + F.coalesce(handed, F.lit(0))
        else:
            final[s.out] = F.coalesce(inside, handed).getField("v")
    return out.withColumns(final).drop("_seg", *[f"_in_{n}" for n in names])


def _carry(summary: DataFrame, specs, keys, segment: int, levels: int) -> DataFrame:
    """State handed to each segment from its neighbours (exclusive of the segment itself)."""
    up = []
    for s in specs:
        c = F.col(s.out)
        if isinstance(s, RunningSum):
            up.append(RunningSum(s.out + "_c", c))
        elif isinstance(s, LastBefore):
            up.append(LastBefore(s.out + "_c", c, c.isNotNull()))
        else:
            up.append(NextAfter(s.out + "_c", c, c.isNotNull()))
    if levels > 1:
        got = scan(summary.withColumnRenamed("_seg", "_at"), up, keys, "_at", segment, levels - 1)
        got = got.withColumnRenamed("_at", "_seg")
    else:
        w = W.partitionBy(*keys).orderBy("_seg")
        before = w.rowsBetween(W.unboundedPreceding, -1)
        after = W.partitionBy(*keys).orderBy(F.desc("_seg")).rowsBetween(W.unboundedPreceding, -1)
        cols = {}
        for s in up:
            if isinstance(s, RunningSum):
                cols[s.out] = F.sum(s.value).over(before)
            elif isinstance(s, LastBefore):
                cols[s.out] = F.last(s.value, ignorenulls=True).over(before)
            else:
                cols[s.out] = F.last(s.value, ignorenulls=True).over(after)
        got = summary.withColumns(cols)
    return got.select(*keys, "_seg", *[F.col(s.out + "_c").alias(s.out) for s in specs])


def with_halo(df: DataFrame, back: int = 0, ahead: int = 0, pos: str = "index",
              segment: int = SEGMENT) -> DataFrame:
    """Cut groups into segments by dense position and copy the edge rows into the neighbours.

    ``lag``/``lead`` and small row frames over ``(keys, _seg)`` ordered by ``pos`` then see what they
    would see over the whole group for the rows with ``_own`` true; drop the others afterwards.
    """
    if fits_one_segment(df, pos, segment):
        return df.withColumns({"_seg": F.lit(0).cast("bigint"), "_own": F.lit(True)})
    at, n = F.col(pos), F.lit(segment)
    home = F.floor(at / n).cast("long")
    inside = F.pmod(at, n)
    copies = [home]
    if back:
        copies.append(F.when(inside >= F.lit(segment - back), home + 1))
    if ahead:
        copies.append(F.when(inside < F.lit(ahead), home - 1))
    return (df.withColumn("_home", home)
            .withColumn("_seg", F.explode(F.array_compact(F.array(*copies))))
            .withColumn("_own", F.col("_seg") == F.col("_home")).drop("_home"))


def dense_position(df: DataFrame, out: str, keys=("matchId",), pos: str = "index") -> DataFrame:
    """0-based position of each row among those present (after a filter the old one has gaps)."""
    below = bound_of(df, pos)
    got = scan(df, [RunningSum(out, F.lit(1).cast("bigint"))], keys, pos)
    return got.select(*[bounded(F.col(c), c, below) if c == out else F.col(c) for c in got.columns])
