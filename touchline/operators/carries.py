"""Synthetic carries: the ball movement between one event and the next usable one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from touchline.operators.scan import NextAfter, RunningSum, bound_of, bounded, dense_position, scan
from touchline.operators.state import period_ord

# Effective limits in metres and seconds, and the type groups of the rule.
MIN_LENGTH, MAX_LENGTH, MIN_SECONDS, MAX_SECONDS = 3.0, 60.0, 1, 10
MOVES = ["Pass", "Carry", "TakeOn", "GoodSkill"]
POINT_ACTIONS = ["Tackle", "Challenge", "BallRecovery", "Interception", "Aerial", "Foul"]


def find_carries(events: DataFrame) -> DataFrame:
    """Each event with a struct ``carry`` (NULL when no carry follows it).

    The next usable event skips take-ons, fouls and failed challenges *by the other team*; the last one
    depends on who has the ball, so one "next" is kept per side and the right one picked afterwards.
    Start time and minute come from the very next event, the end from the next usable one. An event
    with no usable successor has no carry. Needs ``clock_s``.
    """
    fail = F.col("outcomeType") == "Unsuccessful"
    skip = F.coalesce((F.col("type") == "Foul") | ((F.col("type") == "TakeOn") & F.col("outcomeType").isin(
        "Successful", "Unsuccessful")), F.lit(False))
    challenge = F.coalesce((F.col("type") == "Challenge") & fail, F.lit(False))
    beaten = F.coalesce((F.col("type") == "TakeOn") & (F.col("outcomeType") == "Successful"), F.lit(False))
    ev = scan(events, [RunningSum("_beat", beaten.cast("bigint"))])
    nxt = F.struct("eventId", "teamId", "teamName", "opponentName", "h_a", "playerId", "playerName", "type",
                   "outcomeType", "x", "y", "period", "clock_s", "_beat")
    now = F.struct("minute", "second", "expandedMinute", "clock_s")
    ev = scan(ev, [
        NextAfter("_home", nxt, ~skip & ~(challenge & (F.col("h_a") != "h"))),
        NextAfter("_away", nxt, ~skip & ~(challenge & (F.col("h_a") != "a"))),
        NextAfter("_init", now),
    ])
    n = F.when(F.col("h_a") == "h", F.col("_home")).otherwise(F.col("_away"))
    ev = ev.withColumn("_n", n)
    n, init = F.col("_n"), F.col("_init")
    same = F.col("teamId") == n["teamId"]
    turned = (~same & F.col("type").isin(*MOVES, "Clearance") & fail
              & n["type"].isin(MOVES) & (n["outcomeType"] == "Successful"))
    no_end = (F.col("endX").isNull() | F.col("endY").isNull()
              | ((F.col("endX") == 0) & (F.col("endY") == 0) & F.col("type").isin(POINT_ACTIONS)))
    sx = F.when(same & no_end, F.col("x")).when(turned, 105.0 - F.col("endX")).otherwise(F.col("endX"))
    sy = F.when(same & no_end, F.col("y")).when(turned, 68.0 - F.col("endY")).otherwise(F.col("endY"))
    ev = ev.withColumn("_sx", sx).withColumn("_sy", sy)
    dx, dy = F.col("_sx") - n["x"], F.col("_sy") - n["y"]
    far = dx * dx + dy * dy
    dt = n["clock_s"] - F.col("clock_s")
    ok = ((same | turned) & (F.col("type") != "BallTouch")
          & (far >= MIN_LENGTH ** 2) & (far <= MAX_LENGTH ** 2)
          & (dt >= MIN_SECONDS) & (dt < MAX_SECONDS) & (F.col("period") == n["period"]))
    t2 = (init["minute"] * 60 + init["second"]) + (F.col("minute") * 60 + F.col("second"))
    e2 = (init["expandedMinute"] * 60 + init["second"]) + (F.col("expandedMinute") * 60 + F.col("second"))
    minute = F.floor(t2 / 120).cast("int")
    carry = F.struct(
        n["teamId"].alias("teamId"), n["teamName"].alias("teamName"), n["opponentName"].alias("opponentName"),
        n["h_a"].alias("h_a"), n["playerId"].alias("playerId"), n["playerName"].alias("playerName"),
        F.col("_sx").alias("x"), F.col("_sy").alias("y"), n["x"].alias("endX"), n["y"].alias("endY"),
        minute.alias("minute"), (t2 / 2.0 - minute * 60).alias("second"),
        F.floor(e2 / 120).cast("int").alias("expandedMinute"), n["period"].alias("period"),
        ((F.col("clock_s") + init["clock_s"]) / 2.0 / 60.0).alias("cumulative_mins"),
        n["eventId"].alias("relatedEventId"),
        (n["_beat"] - F.col("_beat") - beaten.cast("bigint")).alias("takeOns"))
    return (ev.withColumn("carry", F.when(F.coalesce(ok, F.lit(False)), carry))
            .drop("_home", "_away", "_init", "_n", "_sx", "_sy", "_beat"))


def with_carries(events: DataFrame) -> DataFrame:
    """Events and generated carries in one table with a fresh dense ``index``.

    Carries get the order key ``event_ord = eventId + 0.5`` and ``is_generated = true``; ``second`` is
    a double because the midpoint may fall on half a second.
    """
    found = find_carries(events.drop("event_ord", "is_generated"))
    found = scan(found, [RunningSum("_made", F.col("carry").isNotNull().cast("bigint"))])
    base = {**{n: F.col(n) for n in found.columns if n not in ("carry", "_made", "index")}, "event_ord": F.col("eventId").cast("double"), "is_generated": F.lit(False),
            "takeOns": F.lit(None).cast("bigint"), "second": F.col("second").cast("double"), "_new": F.col("index") + F.col("_made")}
    made = {**{n: F.col(n) for n in ("league", "season", "matchId", "startDate")}, **{n: F.col("carry")[n] for n in found.schema["carry"].dataType.names},
            "event_ord": F.col("eventId") + 0.5, "is_generated": F.lit(True), "type": F.lit("Carry"), "outcomeType": F.lit("Successful"), "isTouch": F.lit(True),
            "_new": F.col("index") + F.col("_made") + 1}
    names = [*base, *[n for n in made if n not in base]]
    # An event and its carry come out of one row, so that the scans run once.
    out = found.select("*", F.explode(F.when(F.col("carry").isNull(), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("_gen"))
    none = F.lit(None)
    out = out.select(*[F.when(F.col("_gen"), made.get(n, none)).otherwise(base.get(n, none)).alias(n) for n in names])
    below = bound_of(events, "index")
    # Every event adds one carry at most.
    return out.withColumn("index", bounded(F.col("_new"), "index", 2 * below if below else None)).drop("_new")


def rebuild_carries(events: DataFrame) -> DataFrame:
    """Drop generated carries and make them anew: running it twice changes nothing."""
    kept = events.where(~F.coalesce(F.col("is_generated"), F.lit(False)))
    kept = dense_position(kept.withColumnRenamed("index", "_old"), "index", pos="_old")
    return with_carries(kept.drop("_old").withColumn("second", F.col("second").cast("int")))


__all__ = ["find_carries", "with_carries", "rebuild_carries", "period_ord"]
