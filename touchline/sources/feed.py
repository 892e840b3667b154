"""The driver's ``events`` table seen as a match-event feed (see FIXTURES.md).

``event_id`` is unique and dense, so ``event_id div 500`` gives matches of at most 500 rows and
``event_id % 500`` their dense position. All arithmetic is on whole numbers; coordinates are tenths.
The text below is one expression list; ``{div}`` is the only word that differs between SQL dialects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from touchline.operators.scan import bounded

ROWS_PER_MATCH = 500

# Step 1: keys and two mixing numbers.
_KEYS = [
    ("m", "event_id {div} 500"),
    ("s", "event_id % 500"),
    ("r", "(event_id*37 + user_id) % 100"),
    ("q", "(event_id*61 + k*17) % 100"),
    ("v100", "cast(round(value*100) as bigint) % 100"),
    ("h_a", "case when user_id % 2 = 0 then 'h' else 'a' end"),
]
# Step 2: event type, team numbers, clock.
_TYPES = [
    ("t_sec", "case when s < 250 then (s*54) {div} (5*{pace}) else 2700 + ((s-250)*54) {div} (5*{pace}) end"),
    ("home_no", "m % {teams}"),
    ("away_no", "(m + 1 + (m {div} {teams}) % ({teams} - 1)) % {teams}"),
    ("type", """case when r < 50 then 'Pass' when r < 62 then 'Carry' when r < 68 then 'TakeOn'
        when r < 74 then 'BallRecovery' when r < 79 then 'Tackle' when r < 83 then 'Interception'
        when r < 87 then 'Aerial' when r < 90 then 'Foul' when r < 93 then 'Dispossessed'
        when r < 95 then 'MissedShots' when r < 97 then 'SavedShot' when r < 98 then 'Goal'
        when r = 99 then 'Clearance'
        when q < 25 then 'Challenge' when q < 40 then 'BlockedPass' when q < 50 then 'KeeperPickup'
        when q < 60 then 'Claim' when q < 65 then 'KeeperSweeper' when q < 75 then 'Error'
        when q < 85 then 'CornerAwarded' when q < 95 then 'Card' else 'OffsideGiven' end"""),
    ("outcomeType", "case when k < 75 then 'Successful' else 'Unsuccessful' end"),
]
# Step 3: everything else.
_FINAL = [
    ("league", "'League One'"),
    ("season", "cast(2000 + m {div} ({teams} * ({teams} - 1)) as {text})"),
    ("matchId", "cast(m as {text})"),
    ("startDate", "date '2023-08-01' + cast(m {div} ({teams} {div} 2) % 20000 as int)"),
    ("eventId", "event_id"),
    ("index", "s"),
    ("teamId", "case when h_a = 'h' then home_no else away_no end"),
    ("teamName", "concat('Team ', cast(case when h_a = 'h' then home_no else away_no end as {text}))"),
    ("opponentName", "concat('Team ', cast(case when h_a = 'h' then away_no else home_no end as {text}))"),
    ("h_a", "h_a"),
    ("playerId", "{player}"),
    ("playerName", "concat('Player ', cast({player} as {text}))"),
    ("minute", "cast(t_sec {div} 60 as int)"),
    ("second", "cast(t_sec % 60 as int)"),
    ("expandedMinute", "cast(t_sec {div} 60 as int)"),
    ("period", "case when t_sec < 2700 then 'FirstHalf' else 'SecondHalf' end"),
    ("type", "type"),
    ("outcomeType", "outcomeType"),
    ("isShot", "type in ('MissedShots','SavedShot','Goal')"),
    ("isGoal", "type = 'Goal'"),
    ("goalOwn", "type = 'Goal' and q >= 94"),
    ("isTouch", "type not in ('Card','CornerAwarded','OffsideGiven','Error','Challenge')"),
    ("turnover", "type = 'Dispossessed' or (type = 'TakeOn' and k >= 75)"),
    ("cardType", "case when type <> 'Card' then null when q < 90 then 'Yellow' when q < 93 then 'SecondYellow' else 'Red' end"),
    ("situation", """case when type not in ('MissedShots','SavedShot','Goal') then null when q < 8 then 'Penalty'
        when q < 76 then 'OpenPlay' when q < 86 then 'FromCorner' when q < 92 then 'SetPiece' else 'DirectFreekick' end"""),
    ("x10", "event_id*7919 % 1051"),
    ("y10", "event_id*10473 % 681"),
    ("endX10", "event_id*6151 % 1051"),
    ("endY10", "event_id*8923 % 681"),
    ("x", "(event_id*7919 % 1051) / cast(10 as double)"),
    ("y", "(event_id*10473 % 681) / cast(10 as double)"),
    ("endX", "case when type in ('Pass','Carry') then (event_id*6151 % 1051) / cast(10 as double) end"),
    ("endY", "case when type in ('Pass','Carry') then (event_id*8923 % 681) / cast(10 as double) end"),
    ("goalMouthY", "case when type in ('MissedShots','SavedShot','Goal') then (event_id*311 % 110 + 285) / cast(10 as double) end"),
    ("goalMouthZ", "case when type in ('MissedShots','SavedShot','Goal') then (event_id*173 % 40) / cast(10 as double) end"),
    ("relatedEventId", "case when s > 0 and (type in ('MissedShots','SavedShot','Goal')) and q % 2 = 0 then event_id - 1 when s > 1 and type in ('MissedShots','SavedShot','Goal') then event_id - 2 end"),
    ("v100", "v100"),
    ("xG", "case when type in ('MissedShots','SavedShot','Goal') then v100 / cast(100 as double) end"),
    ("xGOT", "case when type in ('SavedShot','Goal') then (v100*7 % 100) / cast(100 as double) end"),
    ("xA", "case when type = 'Pass' and q >= 39 and q < 50 then (v100 % 40) / cast(100 as double) end"),
    ("xPass", "case when type = 'Pass' then (v100*3 % 100) / cast(100 as double) end"),
    ("q", "q"),
    ("qual", """case when type = 'Pass' then case when q < 10 then 'Cross' when q < 14 then 'Throughball'
            when q < 24 then 'Longball' when q < 29 then 'CornerTaken' when q < 33 then 'FreekickTaken'
            when q < 39 then 'ThrowIn' when q < 47 then 'KeyPass' when q < 50 then 'IntentionalGoalAssist'
            when q < 55 then 'HeadPass' when q < 58 then 'GoalKick' end
        when type in ('MissedShots','SavedShot','Goal') then case when q < 8 then 'Penalty' when q < 16 then 'BigChance'
            when q >= 76 and q < 86 then 'FromCorner' when q >= 86 and q < 92 then 'SetPiece'
            when q >= 92 then 'DirectFreekick' end
        when type = 'Aerial' then case when q < 50 then 'Defensive' else 'Offensive' end end"""),
    ("qual2", """case when type in ('MissedShots','SavedShot','Goal') then case when v100 % 5 = 0 then 'Head'
            when v100 % 5 < 3 then 'RightFoot' else 'LeftFoot' end
        when type = 'Pass' and v100 % 3 = 0 then 'Chipped' end"""),
]


def _fill(text: str, teams: int, pace: int, squad: int, div: str, kind: str) -> str:
    player = "user_id" if not squad else (
        "((case when h_a = 'h' then home_no else away_no end + 1) * 100 + (user_id {div} 2) % {squad})".replace("{squad}", str(squad)))
    text = text.replace("{player}", player)
    return text.replace("{teams}", str(teams)).replace("{pace}", str(pace)).replace("{div}", div).replace("{text}", kind)


def match_feed(spark: SparkSession, sf_dir: str, teams: int = 20, pace: int = 1, squad: int = 0) -> DataFrame:
    """Canonical match events. ``teams`` = league size; a season is a full home-and-away round.

    ``pace`` plays each half that many times faster, so that rules over a few seconds have rows to act on.
    ``squad`` folds the users of a team onto that many shirt numbers (0 keeps user ids as players).
    """
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return as_match_feed(ev, teams, pace, squad)


def as_match_feed(ev: DataFrame, teams: int = 20, pace: int = 1, squad: int = 0) -> DataFrame:
    def fill(pairs):
        return [f"{_fill(e, teams, pace, squad, 'div', 'string')} as `{n}`" for n, e in pairs]
    ev = ev.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    keyed = ev.selectExpr("event_id", "user_id", "k", "ts", *fill(_KEYS))
    typed = keyed.selectExpr("*", *fill(_TYPES))
    final = typed.selectExpr("k", "ts", *fill(_FINAL))
    final = final.withColumn("qualifiers", F.array_compact(F.array("qual", "qual2"))).drop("qual", "qual2")
    # event_id % 500 is below 500 whatever the data: a match cannot hold more positions.
    return final.withColumn("index", bounded(F.col("index"), "index", ROWS_PER_MATCH))


def feed_sql(teams: int = 20, pace: int = 1, squad: int = 0) -> str:
    """The same table as a chain of common table expressions ending in ``feed``."""
    def fill(pairs):
        return ", ".join(f'{_fill(e, teams, pace, squad, "//", "varchar")} as "{n}"' for n, e in pairs)
    return f"""WITH raw0 AS (SELECT event_id, user_id, ts, value,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
raw1 AS (SELECT event_id, user_id, k, ts, {fill(_KEYS)} FROM raw0),
raw2 AS (SELECT *, {fill(_TYPES)} FROM raw1),
raw3 AS (SELECT k, ts, {fill(_FINAL)} FROM raw2),
feed AS (SELECT * EXCLUDE (qual, qual2),
  list_filter([qual, qual2], lambda z: z IS NOT NULL) AS qualifiers FROM raw3)"""
