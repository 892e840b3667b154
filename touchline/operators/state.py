"""Per-event match state: clock, score before the event, possession, receiver, previous action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from touchline.functions.predicates import NOT_AN_ACTION, own_goal
from touchline.functions.zones import score_state, score_state_label
from touchline.operators.scan import LastBefore, NextAfter, RunningSum, scan

# Feed words.
PERIOD_ORDER = {"FirstHalf": 1, "SecondHalf": 2, "FirstPeriodOfExtraTime": 3, "SecondPeriodOfExtraTime": 4,
                "PenaltyShootout": 5, "PostGame": 14, "PreMatch": 16}
OUTSIDE_POSSESSION = ["SubstitutionOn", "SubstitutionOff", "FormationChange", "FormationSet", "End",
                      "OffsideProvoked", "Start", "GoodSkill", "PenaltyFaced", "ChanceMissed", "CrossNotClaimed"]
TAKES_CONTROL = ["Tackle", "Interception", "Clearance", "BallRecovery", "Aerial", "BlockedPass", "Challenge",
                 "KeeperPickup", "KeeperSweeper", "Claim"]
ENDS_POSSESSION = ["Goal", "SavedShot", "MissedShots", "ShotOnPost", "OffsideGiven", "Dispossessed", "CornerAwarded"]


def period_ord(c: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in PERIOD_ORDER.items() for v in pair])
    return F.coalesce(table[c], c.try_cast("int"))


def clock_seconds() -> Column:
    return (F.coalesce(F.col("minute"), F.lit(0)) * 60 + F.coalesce(F.col("second"), F.lit(0))).cast("bigint")


def with_match_clock(events: DataFrame) -> DataFrame:
    """Continuous clock ``cumulative_mins``: each period starts where the one before ended.

    The shift is previous maximum minus own minimum and may be negative; a missing period before
    (other than before the first) leaves the clock NULL. Codes after the shoot-out are not shifted.
    """
    ev = events.withColumn("_p", period_ord(F.col("period"))).withColumn("_t", clock_seconds())
    spans = (ev.where(F.col("_p").between(1, 5)).groupBy("matchId", "_p")
             .agg(F.min("_t").alias("lo"), F.max("_t").alias("hi")))
    # At most five periods per match reach this window.
    w = W.partitionBy("matchId").orderBy("_p")
    step = (F.when(F.col("_p") == 1, F.lit(0))
            .when(F.lag("_p").over(w) == F.col("_p") - 1, F.lag("hi").over(w) - F.col("lo")))
    spans = spans.withColumn("step", step)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    broken = F.sum(F.col("step").isNull().cast("int")).over(run) > 0
    spans = spans.select("matchId", "_p", F.when(~broken, F.sum("step").over(run)).alias("_shift"))
    out = ev.join(spans, ["matchId", "_p"], "left")
    shift = F.when(F.col("_p").between(1, 5), F.col("_shift")).otherwise(F.lit(0))
    return (out.withColumn("clock_s", F.col("_t") + shift)
            .withColumn("cumulative_mins", F.col("clock_s").cast("double") / 60.0)
            .drop("_p", "_t", "_shift"))


def score_specs() -> list[RunningSum]:
    goal, own = F.col("type") == "Goal", own_goal()
    home = F.col("h_a") == "h"
    return [RunningSum("home_score_before", (goal & (home != own)).cast("bigint")),
            RunningSum("away_score_before", (goal & (home == own)).cast("bigint"))]


def add_score_columns(df: DataFrame) -> DataFrame:
    diff = F.col("home_score_before") - F.col("away_score_before")
    return (df.withColumn("team_goal_diff_before", F.when(F.col("h_a") == "h", diff).otherwise(-diff))
            .withColumn("team_score_state", score_state(F.col("team_goal_diff_before")))
            .withColumn("team_score_state_label", score_state_label(F.col("team_goal_diff_before")))
            .withColumn("score_before", F.concat_ws("-", F.col("home_score_before").cast("string"),
                                                    F.col("away_score_before").cast("string"))))


def with_score(events: DataFrame) -> DataFrame:
    """Running score and score state before each event; an own goal credits the opponent."""
    return add_score_columns(scan(events, score_specs()))


def _previous() -> LastBefore:
    kept = ~F.col("type").isin(OUTSIDE_POSSESSION)
    return LastBefore("_prev", F.struct("teamName", "type", "outcomeType", "turnover"), kept)


def _change(view_rule: bool) -> Column:
    """Whether a new possession starts at this row (False on the first counted row)."""
    p = F.col("_prev")
    other = F.col("teamName") != p["teamName"]
    takes = F.col("type").isin(TAKES_CONTROL) & (F.col("outcomeType") == "Successful")
    lost = F.coalesce(p["turnover"], F.lit(False))
    if view_rule:
        lost = lost | F.coalesce(F.col("turnover"), F.lit(False))
    change = (p["type"] == "Goal") | (other & (lost | takes | p["type"].isin(ENDS_POSSESSION)
                                               | (p["outcomeType"] == "Unsuccessful")))
    return F.when(~F.col("type").isin(OUTSIDE_POSSESSION), F.coalesce(change, F.lit(False)))


def with_possession(events: DataFrame, rule: str = "view", score: bool = False) -> DataFrame:
    """Possession number per match and the team that opened it.

    ``rule="ingest"`` looks at the previous row's turnover only; ``rule="view"`` at this row's too.
    Rows outside play (substitutions, period marks) get NULL.
    """
    first = scan(events, [_previous()] + (score_specs() if score else []))
    first = first.withColumn("_new", _change(rule == "view"))
    opens = F.coalesce(F.col("_new"), F.lit(False)) | (F.col("_new").isNotNull() & F.col("_prev").isNull())
    out = scan(first, [RunningSum("_n", F.coalesce(F.col("_new"), F.lit(False)).cast("bigint"), inclusive=True),
                       LastBefore("_team", F.col("teamName"), opens, inclusive=True)])
    counted = F.col("_new").isNotNull()
    out = (out.withColumn("possession_id", F.when(counted, F.col("_n") + 1))
           .withColumn("possession_team", F.when(counted, F.col("_team")))
           .drop("_prev", "_new", "_n", "_team"))
    return add_score_columns(out) if score else out


def with_receiver(events: DataFrame, mode: str = "network") -> DataFrame:
    """Who plays the next event of the same team.

    ``network``: next event after dropping substitutions, formation rows and cards (id and name).
    ``season``: the raw next event, for successful passes only (name).
    """
    nxt = F.struct("teamName", "playerId", "playerName")
    if mode == "season":
        out = scan(events, [NextAfter("_next", nxt)])
        hit = ((F.col("type") == "Pass") & (F.col("outcomeType") == "Successful")
               & (F.col("_next.teamName") == F.col("teamName")))
        return out.withColumn("receiverName", F.when(hit, F.col("_next.playerName"))).drop("_next")
    skip = F.col("type").rlike("(?i)SubstitutionOn|FormationChange|FormationSet|Card")
    out = scan(events.where(~skip), [NextAfter("_next", nxt)])
    same = F.col("_next.teamName") == F.col("teamName")
    return (out.withColumn("receiver", F.when(same, F.col("_next.playerId")))
            .withColumn("receiverName", F.when(same, F.col("_next.playerName"))).drop("_next"))


def with_previous_action(events: DataFrame, max_age: int = 20) -> DataFrame:
    """Nearest earlier real action not older than ``max_age`` seconds, as a struct ``prev``."""
    t = clock_seconds()
    prev = F.struct(t.alias("t"), "eventId", "type", "outcomeType", "teamId", "x", "y", "endX", "endY", "qualifiers")
    out = scan(events, [LastBefore("prev", prev, ~F.col("type").isin(NOT_AN_ACTION))])
    return out.withColumn("prev", F.when(t - F.col("prev.t") <= max_age, F.col("prev")))


CONTROL = ["Pass", "BallRecovery", "BallTouch", "KeeperPickup", "TakeOn", "Goal", "SavedShot", "Claim", "Carry",
           "ShotOnPost"]
DEFENCE = ["Tackle", "Dispossessed", "Interception", "Clearance", "BlockedPass", "Challenge", "Aerial",
           "KeeperSweeper", "Punch"]
STOPPAGE = ["Foul", "OffsidePass", "OffsideGiven", "OffsideProvoked", "Card", "Error", "CornerAwarded", "MissedShots",
            "ChanceMissed", "End", "FormationChange", "SubstitutionOn", "SubstitutionOff", "FormationSet", "Start"]
