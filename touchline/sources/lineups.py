"""Line-up rows that go with the driver's feed: formations and substitutions by a fixed rule on its sides.

Shirt numbers 0-10 start in slots 1-11, 11-13 sit on the bench; three substitutions follow, and every
fourth side changes formation at minute 70 and swaps two slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SQUAD = 14
_FORMATIONS = "case (m + teamId) % 3 when 0 then 2 when 1 then 4 else 8 end"


def sides(feed: DataFrame) -> DataFrame:
    return feed.groupBy("league", "season", "matchId", "startDate", "teamId", "teamName", "opponentName", "h_a").agg(
        F.count("*").alias("events")).withColumn("m", F.col("matchId").cast("bigint"))


def lineup_events(feed: DataFrame) -> DataFrame:
    """FormationSet, FormationChange, SubstitutionOff and SubstitutionOn rows of every side.

    Formation rows carry ``players`` (id, slot); a substitution carries the slot taken over and the id of
    its partner row.
    """
    s = sides(feed).selectExpr("*", "(teamId + 1) * 100 as base", f"{_FORMATIONS} as f0")
    shirts = f"sequence(0, {SQUAD - 1})"
    players = f"transform({shirts}, n -> struct(base + n as playerId, if(n < 11, cast(n + 1 as int), 0) as slot))"
    start = s.selectExpr("*", "'FormationSet' as type", "0 as minute", "cast(null as bigint) as playerId", "cast(null as bigint) as eventId",
                         "cast(null as bigint) as relatedEventId", "cast(null as int) as slot", "f0 as formation_id", f"{players} as players")
    sub = s.selectExpr("*", "explode(sequence(0, 2)) as i").selectExpr(
        "*", "cast(50 + 10 * i + (m * 7 + teamId * 3 + i) % 9 as int) as minute", "m * 10000 + teamId * 10 + i * 2 as _id")
    off = sub.selectExpr("*", "'SubstitutionOff' as type", "base + 3 + 2 * i as playerId", "_id as eventId", "cast(null as bigint) as relatedEventId",
                         "cast(null as int) as slot", "cast(null as int) as formation_id")
    on = sub.selectExpr("*", "'SubstitutionOn' as type", "base + 11 + i as playerId", "_id + 1 as eventId", "_id as relatedEventId",
                        "cast(4 + 2 * i as int) as slot", "cast(null as int) as formation_id")
    swap = "transform(array(4, 10), n -> struct(base + n as playerId, if(n = 4, 11, 5) as slot))"
    change = s.where("(m + teamId) % 4 = 0").selectExpr(
        "*", "'FormationChange' as type", "70 as minute", "cast(null as bigint) as playerId", "cast(null as bigint) as eventId", "cast(null as bigint) as relatedEventId",
        "cast(null as int) as slot", "5 as formation_id", f"{swap} as players")
    keep = ["league", "season", "matchId", "startDate", "teamId", "teamName", "opponentName", "h_a", "type", "minute", "playerId", "eventId", "relatedEventId", "slot", "formation_id", "players"]
    out = start.select(keep)
    for part in (off, on, change):
        cols = [c if c in part.columns else F.lit(None).alias(c) for c in keep]
        out = out.unionByName(part.select(cols))
    return out
