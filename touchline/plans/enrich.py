"""The enrichment chain from a raw event feed to the canonical event table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F

from touchline.functions.names import ascii_fold
from touchline.functions.predicates import prog_carry, prog_pass
from touchline.operators.carries import with_carries
from touchline.operators.grids import with_epv, with_xt, with_xt_grid
from touchline.operators.state import with_match_clock
from touchline.session import materialise


def scale_pitch(events: DataFrame) -> DataFrame:
    """0-100 feed coordinates to metres on 105 x 68."""
    return events.withColumns({**{n: F.col(n) * 1.05 for n in ("x", "endX")}, **{n: F.col(n) * 0.68 for n in ("y", "endY", "goalMouthY") if n in events.columns}})


def unscale_pitch(events: DataFrame) -> DataFrame:
    return events.withColumns({**{n: F.col(n) / 1.05 for n in ("x", "endX")}, **{n: F.col(n) / 0.68 for n in ("y", "endY", "goalMouthY") if n in events.columns}})


def with_progress(events: DataFrame) -> DataFrame:
    """Metres gained by passes and carries and their direction in degrees."""
    return events.withColumns({"prog_pass": prog_pass(), "prog_carry": prog_carry(),
                               "pass_or_carry_angle": F.degrees(F.atan2(F.col("endY") - F.col("y"), F.col("endX") - F.col("x")))})


@dataclass(frozen=True)
class ModelStep:
    """A scoring step: its name, the columns it adds with their types, and the function on events. A keyed step gives only the rows it has values
    for, with match and position; another one gives the events with the columns added."""
    name: str
    columns: dict[str, str]
    apply: Callable[[DataFrame], DataFrame]
    keyed: bool = False


def with_models(events: DataFrame, steps, keys=("matchId", "index"), written: bool = False) -> DataFrame:
    """Run scoring steps in order, each on what the ones before it wrote.

    The events are written once and each step's values into a table of their own before they reach the events: a step that cannot be planned
    or that fails on some row leaves its columns as they were, or NULL, and its name in ``failed_models``, and the others still run. A row for
    which a keyed step has no value keeps what it had. Events that are a written table already (``written``) are not written again.
    """
    keys, failed = list(keys), []
    if steps and not written:
        events = materialise(events, "events")
    for step in steps:
        names = list(step.columns)
        try:
            done = step.apply(events)
            if set(names) - set(done.columns):
                raise ValueError(f"{step.name} adds {sorted(done.columns)}")
            values = materialise(done.select(*keys, F.struct(*[F.col(n).cast(t).alias(n) for n, t in step.columns.items()]).alias("_new")), "scores")
        except (PySparkException, ValueError, OSError, Py4JError):
            failed.append(step.name)
            events = events.withColumns({n: F.lit(None).cast(t) for n, t in step.columns.items() if n not in events.columns})
            continue
        have = set(events.columns)
        # Values are as many as the events but compress to a few MB, which a planner that goes by file size would send to the driver.
        joined = events.join(values.hint("merge"), keys, "left")
        new = F.col("_new").isNotNull()
        events = joined.withColumns({n: F.when(new, F.col("_new")[n]).otherwise(F.col(n) if n in have else F.lit(None).cast(t)) for n, t in step.columns.items()}).drop("_new")
    return events.withColumn("failed_models", F.array(*map(F.lit, failed)).cast("array<string>"))


def enrich(events: DataFrame, xt_grid: DataFrame | None = None, epv_grid: DataFrame | None = None, raw_scale: bool = False, models=()) -> DataFrame:
    """Clock, carries, scale, xT, EPV, progress, plain names, then the given model steps in order.

    A model step that fails leaves its columns NULL, so a missing model shows in the data instead of turning into zeros.
    """
    ev = scale_pitch(events) if raw_scale else events
    ev = with_carries(with_match_clock(ev))
    ev = with_xt(ev) if xt_grid is None else with_xt_grid(ev, xt_grid, 8, 12)
    ev = with_progress(with_epv(ev, epv_grid))
    ev = ev.withColumn("playerName", ascii_fold(F.col("playerName")))
    return with_models(ev, models)
