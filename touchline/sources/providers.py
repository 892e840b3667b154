"""Provider payloads to canonical events: nested JSON in, flat rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Provider event names and what they become.
EVENT_NAMES = {"Pass": "Pass", "Carry": "Carry", "Dribble": "TakeOn", "Ball Recovery": "BallRecovery", "Interception": "Interception", "Clearance": "Clearance",
               "Block": "BlockedPass", "Foul Committed": "Foul", "Dispossessed": "Dispossessed", "Miscontrol": "Turnover", "Duel": "Tackle", "Goal Keeper": "KeeperPickup",
               "Pressure": "Pressure", "Substitution": "SubstitutionOff", "Starting XI": "FormationSet", "Tactical Shift": "FormationChange", "Bad Behaviour": "Card"}
SHOT_OUTCOMES = {"Goal": "Goal", "Saved": "SavedShot", "Post": "ShotOnPost"}
PERIODS = {1: "FirstHalf", 2: "SecondHalf", 3: "FirstPeriodOfExtraTime", 4: "SecondPeriodOfExtraTime", 5: "PenaltyShootout"}

PAYLOAD_SCHEMA = """match struct<match_id:bigint,match_date:string,competition:string,season:string,home:struct<id:bigint,name:string>,away:struct<id:bigint,name:string>>,
 events array<struct<id:string,index:int,period:int,minute:int,second:int,type:struct<name:string>,team:struct<id:bigint,name:string>,player:struct<id:bigint,name:string>,location:array<double>,
 pass:struct<end_location:array<double>,outcome:struct<name:string>,cross:boolean,through_ball:boolean,height:struct<name:string>,type:struct<name:string>,shot_assist:boolean,goal_assist:boolean>,
 shot:struct<statsbomb_xg:double,outcome:struct<name:string>,end_location:array<double>,body_part:struct<name:string>,type:struct<name:string>,key_pass_id:string>,
 carry:struct<end_location:array<double>>,dribble:struct<outcome:struct<name:string>>,
 tactics:struct<formation:int,lineup:array<struct<player:struct<id:bigint,name:string>,position:struct<id:int,name:string>,jersey_number:int>>>>>"""


def lookup(table: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in table.items() for v in pair])


def from_yards(loc: Column, i: int) -> Column:
    """120 x 80 with y downwards to 105 x 68 with y from the attacking right."""
    v = F.get(loc, F.lit(i))
    return v / 120.0 * 105.0 if i == 0 else (80.0 - v) / 80.0 * 68.0


def read_payloads(df: DataFrame, column: str = "payload") -> DataFrame:
    """Parsed payloads; text that is no payload gives a NULL struct."""
    return df.withColumn("_p", F.from_json(column, f"struct<{PAYLOAD_SCHEMA}>"))


def nested_events(payloads: DataFrame) -> DataFrame:
    """One canonical row per event of an events-array payload (object with match and events)."""
    e = payloads.select(F.col("_p.match").alias("m"), F.explode("_p.events").alias("e"))
    t = F.col("e.type.name")
    shot = t == "Shot"
    kind = F.when(shot, F.coalesce(F.try_element_at(lookup(SHOT_OUTCOMES), F.col("e.shot.outcome.name")), F.lit("MissedShots"))).otherwise(
        F.coalesce(F.try_element_at(lookup(EVENT_NAMES), t), t))
    failed = F.col("e.pass.outcome.name").isNotNull() | (F.col("e.dribble.outcome.name") == "Incomplete")
    end = F.coalesce("e.pass.end_location", "e.carry.end_location", "e.shot.end_location")
    q = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    quals = F.array_compact(F.array(
        q(F.col("e.pass.cross"), "Cross"), q(F.col("e.pass.through_ball"), "Throughball"), q(F.col("e.pass.height.name") == "High Pass", "Chipped"),
        q(F.col("e.pass.type.name") == "Corner", "CornerTaken"), q(F.col("e.pass.type.name") == "Free Kick", "FreekickTaken"), q(F.col("e.pass.type.name") == "Throw-in", "ThrowIn"),
        q(F.col("e.pass.type.name") == "Goal Kick", "GoalKick"), q(F.col("e.pass.shot_assist"), "ShotAssist"), q(F.col("e.pass.goal_assist"), "IntentionalGoalAssist"),
        q(F.col("e.shot.body_part.name") == "Head", "Head"), q(F.col("e.shot.body_part.name") == "Right Foot", "RightFoot"), q(F.col("e.shot.body_part.name") == "Left Foot", "LeftFoot"),
        q(F.col("e.shot.type.name") == "Penalty", "Penalty"), q(F.col("e.shot.outcome.name") == "Blocked", "Blocked")))
    situation = F.when(shot, F.when(F.col("e.shot.type.name") == "Penalty", "Penalty").when(F.col("e.shot.type.name") == "Free Kick", "DirectFreekick").when(
        F.col("e.shot.type.name") == "Corner", "FromCorner").otherwise("OpenPlay"))
    home = F.col("e.team.id") == F.col("m.home.id")
    return e.select(
        F.col("m.match_id").cast("string").alias("matchId"), F.col("m.competition").alias("league"), F.col("m.season").alias("season"), F.to_date("m.match_date").alias("startDate"),
        F.col("e.id").alias("sourceId"), F.col("e.index").cast("bigint").alias("index"), F.col("e.team.id").alias("teamId"), F.col("e.team.name").alias("teamName"),
        F.when(home, F.col("m.away.name")).otherwise(F.col("m.home.name")).alias("opponentName"), F.when(home, "h").otherwise("a").alias("h_a"),
        F.col("e.player.id").alias("playerId"), F.col("e.player.name").alias("playerName"), F.col("e.minute").alias("minute"), F.col("e.second").alias("second"),
        F.try_element_at(lookup(PERIODS), F.col("e.period")).alias("period"), kind.alias("type"), F.when(failed, "Unsuccessful").otherwise("Successful").alias("outcomeType"),
        from_yards(F.col("e.location"), 0).alias("x"), from_yards(F.col("e.location"), 1).alias("y"), from_yards(end, 0).alias("endX"), from_yards(end, 1).alias("endY"),
        shot.alias("isShot"), (F.col("e.shot.outcome.name") == "Goal").alias("isGoal"), F.col("e.shot.statsbomb_xg").alias("xG"), F.col("e.shot.key_pass_id").alias("keyPassId"), quals.alias("qualifiers"), situation.alias("situation"))


def with_related_passes(events: DataFrame) -> DataFrame:
    """Passes named by a shot get the ShotAssist / KeyPass / assist tags and the shot's xG."""
    shots = events.where("isShot and keyPassId is not null").groupBy("matchId", F.col("keyPassId").alias("sourceId")).agg(
        F.max("isGoal").alias("_g"), F.max("xG").alias("_xg"))
    out = events.join(shots, ["matchId", "sourceId"], "left")
    extra = F.when(F.col("_g").isNotNull(), F.array_compact(F.array(F.lit("ShotAssist"), F.lit("KeyPass"), F.when(F.col("_g"), "IntentionalGoalAssist"))))
    return out.withColumn("qualifiers", F.when(extra.isNull(), F.col("qualifiers")).otherwise(F.array_union("qualifiers", extra))).withColumn("target_xg", F.col("_xg")).drop("_g", "_xg")


def lineup_rows(payloads: DataFrame) -> DataFrame:
    """Players of starting-eleven and shift events with slot by position order."""
    e = payloads.select(F.col("_p.match.match_id").cast("string").alias("matchId"), F.explode("_p.events").alias("e")).where(F.col("e.tactics").isNotNull())
    p = e.select("matchId", F.col("e.team.name").alias("teamName"), F.col("e.minute").alias("minute"), F.col("e.tactics.formation").alias("formation"),
                 F.posexplode(F.array_sort(F.transform("e.tactics.lineup", lambda q: F.struct(q["position"]["id"].alias("pos"), q["player"]["id"].alias("playerId"), q["player"]["name"].alias("playerName"))))).alias("slot0", "q"))
    return p.select("matchId", "teamName", "minute", formation_text("formation").alias("formation"), (F.col("slot0") + 1).alias("slot"), "q.playerId", "q.playerName", "q.pos")


def formation_text(c) -> Column:
    """433 -> 4-3-3."""
    return F.array_join(F.filter(F.split(F.col(c).cast("string"), ""), lambda d: d != ""), "-")


def match_rows(payloads: DataFrame) -> DataFrame:
    return payloads.select(F.col("_p.match.match_id").cast("string").alias("matchId"), F.to_date("_p.match.match_date").alias("startDate"), F.col("_p.match.competition").alias("league"),
                           F.col("_p.match.season").alias("season"), F.col("_p.match.home.name").alias("home_team"), F.col("_p.match.away.name").alias("away_team"), F.size("_p.events").alias("events"))


KEYED_SCHEMA = "match struct<id:bigint,date:string>, teams map<string,struct<name:string,side:string>>, players map<string,struct<name:string,team:string>>, events array<struct<id:bigint,player:string,team:string,type:string,x:double,y:double,minute:int,second:int,half:string>>"


def keyed_events(df: DataFrame, column: str = "payload") -> DataFrame:
    """Payload whose teams and players are maps by id: lookups inside the payload, no join."""
    p = df.select(F.from_json(column, f"struct<{KEYED_SCHEMA}>").alias("p"))
    e = p.select("p", F.posexplode("p.events").alias("index", "e"))
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(100.0), v))
    team = F.try_element_at(F.col("p.teams"), F.col("e.team"))
    return e.select(F.col("p.match.id").cast("string").alias("matchId"), F.to_date("p.match.date").alias("startDate"), F.col("e.id").alias("eventId"), F.col("index").cast("bigint").alias("index"),
                    team["name"].alias("teamName"), F.when(team["side"] == "home", "h").otherwise("a").alias("h_a"), F.try_element_at(F.col("p.players"), F.col("e.player"))["name"].alias("playerName"),
                    F.col("e.type").alias("type"), (clamp(F.col("e.x")) * 1.05).alias("x"), ((100.0 - clamp(F.col("e.y"))) * 0.68).alias("y"), F.col("e.minute").alias("minute"), F.col("e.second").alias("second"),
                    F.when(F.col("e.half") == "1H", "FirstHalf").when(F.col("e.half") == "2H", "SecondHalf").alias("period"))
