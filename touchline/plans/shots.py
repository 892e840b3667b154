"""Shots: details, shot-creating actions, player and team totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from touchline.functions import predicates as p, zones as z
from touchline.functions.core import dist, fmean, fsum, has_like, n_if, ratio, sum_if
from touchline.operators.intervals import near_in_time, prefixed

LEAD_SECONDS, PAIRED_SECONDS, MAX_LEADUP = 15, 3, 3
# Which actions can create a shot, and duel types that merely pair with it.
CREATING = ["Pass", "Carry", "TakeOn", "BallRecovery", "Interception", "Tackle", "Challenge", "Aerial", "Clearance",
            "BlockedPass"]
PAIRED = ["Aerial", "Challenge", "Tackle", "BallRecovery", "Interception", "Clearance", "BlockedPass"]


def c(name):
    return F.col(name)


def zero(name):
    return F.coalesce(F.col(name), F.lit(0.0))


def shot_leadup(events: DataFrame) -> DataFrame:
    """Up to three same-team actions in the 15 seconds before each shot, one row per pair.

    Direct assists (the related event or a tagged assist by somebody else) come first; the rest are
    successful actions, of the shot's own possession if there are any, without the shooter's own duel of
    the last 3 seconds. An assist before a rebound shot is no assist. Needs ``clock_s``, ``possession_id``.
    """
    shots = events.where(p.is_shot())
    s = prefixed(shots, "s_", ["matchId", "eventId", "index", "teamName", "period", "playerName", "type", "relatedEventId",
                               "clock_s", "possession_id", "x", "y"])
    keep = ["matchId", "eventId", "index", "teamName", "period", "playerName", "type", "outcomeType", "qualifiers", "minute",
            "second", "clock_s", "possession_id", "x", "y", "endX", "endY", "xT", "xA", "epv_added"]
    usable = F.col("type").isin(CREATING + p.SHOT_TYPES) | has_like("(?i)ShotAssist|IntentionalGoalAssist|BigChanceCreated")
    # Rows that could only qualify as a related event are kept too: relatedEventId may point anywhere.
    cand = events.select(*[c(n) for n in keep], usable.alias("usable"))
    pairs = near_in_time(s, cand, [("s_matchId", "matchId"), ("s_teamName", "teamName"), ("s_period", "period")],
                         "s_clock_s", "clock_s", back=LEAD_SECONDS, extra=c("clock_s") < c("s_clock_s"))
    tagged = has_like("(?i)ShotAssist|IntentionalGoalAssist|BigChanceCreated")
    direct = (F.coalesce(c("eventId") == c("s_relatedEventId"), F.lit(False)) | tagged) & ~F.coalesce(
        c("playerName") == c("s_playerName"), F.lit(False))
    shot_row = p.is_shot()
    plain = (c("type").isin(CREATING + p.SHOT_TYPES) & (shot_row | (F.lower("outcomeType") == "successful"))
             & ~F.coalesce((c("playerName") == c("s_playerName")) & c("type").isin(PAIRED)
                           & (c("s_clock_s") - c("clock_s") <= PAIRED_SECONDS), F.lit(False)))
    pairs = pairs.withColumn("direct", direct).where(c("direct") | F.coalesce(plain, F.lit(False)))
    shot_key = ["s_matchId", "s_eventId"]
    own = ~c("direct") & F.coalesce(c("possession_id") == c("s_possession_id"), F.lit(False))
    pairs = pairs.withColumn("_own", own).withColumn("_any", F.max("_own").over(W.partitionBy(*shot_key)))
    pairs = pairs.where(c("direct") | c("_own") | ~c("_any"))
    recent = W.partitionBy(*shot_key, "direct").orderBy(F.desc("index"))
    pairs = (pairs.withColumn("_n", F.row_number().over(recent))
             .withColumn("_direct", F.least(F.lit(MAX_LEADUP), F.count_if(c("direct")).over(W.partitionBy(*shot_key)))))
    pairs = pairs.where(F.when(c("direct"), c("_n") <= MAX_LEADUP).otherwise(c("_n") <= MAX_LEADUP - c("_direct")))
    rebound = F.max(F.when(shot_row, c("index"))).over(W.partitionBy(*shot_key))
    pairs = pairs.withColumn("_rebound", rebound)
    no_end = c("endX").isNull() | c("endY").isNull() | ((c("endX") == 0) & (c("endY") == 0))
    pairs = pairs.withColumn("_ex", F.when(no_end, c("x")).otherwise(c("endX"))).withColumn(
        "_ey", F.when(no_end, c("y")).otherwise(c("endY")))
    still = c("direct") & (F.abs(c("_ex") - c("x")) < 0.01) & (F.abs(c("_ey") - c("y")) < 0.01)
    return pairs.select(
        c("s_matchId").alias("matchId"), c("s_eventId").alias("shot_id"), "eventId", "index", "minute", "second",
        c("playerName").alias("player"), "type", c("outcomeType").alias("outcome"),
        (c("direct") & (c("s_type") == "Goal") & ~F.coalesce(c("index") < c("_rebound"), F.lit(False))).alias("is_assist"),
        zero("xT").alias("xT"), zero("xA").alias("xA"), zero("epv_added").alias("epv_added"), "x", "y",
        F.when(still, c("s_x")).otherwise(c("_ex")).alias("end_x"), F.when(still, c("s_y")).otherwise(c("_ey")).alias("end_y"))


def shot_rows(events: DataFrame) -> DataFrame:
    """Display rows of shots: own goals go to the other side with mirrored place and no xG."""
    own = p.own_goal()
    diff = F.when(own, -c("team_goal_diff_before")).otherwise(c("team_goal_diff_before"))
    x = F.when(own, 105.0 - c("x")).otherwise(c("x"))
    y = F.when(own, 68.0 - c("y")).otherwise(c("y"))
    return events.where(p.is_shot()).select(
        "matchId", c("eventId").alias("shot_id"), "index", "minute", "second", "period", "situation", "type",
        F.when(own, F.concat("playerName", F.lit(" (OG)"))).otherwise(c("playerName")).alias("player"),
        c("teamName").alias("shooting_team"), F.when(own, c("opponentName")).otherwise(c("teamName")).alias("team"),
        F.when(own, 0.0).otherwise(F.coalesce("xG", F.lit(0.05))).alias("xg"), F.when(own, 0.0).otherwise(zero("xGOT")).alias("xgot"),
        p.shot_blocked().alias("blocked"), p.on_target().alias("on_target"),
        dist(F.lit(105.0), F.lit(34.0), x, y).alias("shot_distance"), x.alias("x"), y.alias("y"),
        c("x").alias("raw_x"), c("y").alias("raw_y"), zero("goalMouthY").alias("goal_mouth_y"), zero("goalMouthZ").alias("goal_mouth_z"),
        own.alias("own_goal"), "score_before", diff.alias("goal_diff_before"), z.score_state(diff).alias("game_state"),
        z.score_state_label(diff).alias("game_state_label"))


def shot_details(events: DataFrame) -> DataFrame:
    """Shot rows with their lead-up as an ordered array of at most three structs."""
    lead = shot_leadup(events).groupBy("matchId", "shot_id").agg(F.array_sort(F.collect_list(F.struct(
        "index", c("eventId").alias("event_id"), "player", "type", "is_assist"))).alias("leadup_events"))
    return shot_rows(events).join(lead, ["matchId", "shot_id"], "left")


RESULTS = [("Goals", "Goal"), ("On Target", "SavedShot"), ("Woodwork", "ShotOnPost")]


def shot_result():
    out = F.when(c("blocked"), "BlockedShots")
    for name, kind in RESULTS:
        out = out.when(c("type") == kind, name)
    return out.otherwise("Off Target")


def creation_category():
    return (F.when(c("type") == "Pass", "passes").when(c("type") == "Carry", "carries").when(c("type") == "TakeOn", "takeons")
            .when(c("type").isin(p.SHOT_TYPES), "shots").otherwise("def_actions"))


def shot_player_summary(events: DataFrame) -> DataFrame:
    """Shooters and creators in one table: shooting and creating rows are stacked, then grouped once."""
    rows = shot_rows(events)
    lead = shot_leadup(events).join(rows.select("matchId", "shot_id", "team", c("index").alias("shot_index")), ["matchId", "shot_id"])
    shooting = rows.where(~c("own_goal")).select(
        "matchId", c("player").alias("playerName"), "team", (c("index") * 8).alias("seq"), shot_result().alias("result"),
        "xg", "xgot", "shot_distance", F.lit(None).cast("string").alias("creation"), F.lit(0.0).alias("xT"), F.lit(0.0).alias("xA"),
        F.lit(False).alias("is_assist"))
    creating = lead.select(
        "matchId", c("player").alias("playerName"), "team", (c("shot_index") * 8 + 1).alias("seq"), F.lit(None).cast("string").alias("result"),
        F.lit(None).cast("double").alias("xg"), F.lit(None).cast("double").alias("xgot"), F.lit(None).cast("double").alias("shot_distance"),
        creation_category().alias("creation"), "xT", "xA", "is_assist")
    made, shot = c("creation").isNotNull(), c("result").isNotNull()
    agg = shooting.unionByName(creating).groupBy("matchId", "playerName").agg(
        F.min_by("team", "seq").alias("team"),
        *[n_if(c("result") == n).alias(a) for n, a in (("Goals", "goals"), ("On Target", "on_target"), ("Off Target", "off_target"),
                                                       ("Woodwork", "woodwork"), ("BlockedShots", "blocked_shots"))],
        n_if(shot).alias("total_shots"), fsum(c("xg")).alias("total_xg"), fsum(c("xgot")).alias("total_xgot"),
        F.coalesce(fmean(c("shot_distance")), F.lit(0.0)).alias("avg_shot_distance"), n_if(made).alias("sca_count"),
        *[n_if(c("creation") == n).alias(f"sca_{n}") for n in ("passes", "carries", "takeons", "shots", "def_actions")],
        fsum(c("xT")).alias("sca_xt"), n_if(c("is_assist")).alias("assists"), fsum(c("xA")).alias("xa"))
    return (agg.withColumn("shots_on_target", c("goals") + c("on_target")).withColumn("xg_per_shot", ratio(c("total_xg"), c("total_shots")))
            .withColumn("xgot_per_shot", ratio(c("total_xgot"), c("total_shots"))).withColumn("xt_per_sca", ratio(c("sca_xt"), c("sca_count"))))


def shot_team_totals(events: DataFrame, state: str | None = None, minutes: tuple[int, int] | None = None) -> DataFrame:
    """Shot and creation totals per match and credited team, optionally within a score state and minutes."""
    rows = shot_rows(events)
    if state and state != "all":
        rows = rows.where((c("goal_diff_before") > 0) if state == "leading" else (c("goal_diff_before") < 0) if state == "trailing"
                          else (c("game_state") == state))
    if minutes:
        rows = rows.where((c("minute") >= minutes[0]) & (c("minute") < minutes[1]))
    lead = shot_leadup(events).groupBy("matchId", "shot_id").agg(
        F.count("*").alias("n"), fsum(c("xT")).alias("xt"), fsum(c("xA")).alias("xa"), n_if(c("is_assist")).alias("a"))
    real = ~c("own_goal")
    return rows.join(lead, ["matchId", "shot_id"], "left").groupBy("matchId", "team").agg(
        n_if(real).alias("shots"), n_if(c("type") == "Goal").alias("goals"), n_if(real & c("on_target")).alias("shots_on_target"),
        sum_if(real, c("xg")).alias("xg"), sum_if(real, c("xgot")).alias("xgot"), F.coalesce(F.sum("n"), F.lit(0)).alias("sca"),
        fsum(c("xt")).alias("sca_xt"), F.coalesce(F.sum("a"), F.lit(0)).alias("assists"), fsum(c("xa")).alias("xa"))
