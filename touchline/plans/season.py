"""Season tables: team and player match rows, keepers, event locations, league table, form, leaders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from touchline.functions import predicates as p
from touchline.functions.core import dist, fmean, fsum, has_like, n_if, pct, ratio, sum_if
from touchline.operators.scan import LastBefore, scan
from touchline.operators.state import with_receiver
from touchline.sources.store import dedupe_events, validate_matches

KEYS = ["league", "season", "matchId"]


def c(name):
    return F.col(name)


def zero(name):
    return F.coalesce(F.col(name), F.lit(0.0))


def with_touch_change(events: DataFrame) -> DataFrame:
    """Marks a touch whose previous touch in the match was by the other team (or none)."""
    touch = F.coalesce(c("isTouch"), F.lit(False))
    ev = scan(events, [LastBefore("_touch", F.struct("teamName"), touch)])
    return ev.withColumn("touch_change", touch & ~F.coalesce(c("_touch.teamName") == c("teamName"), F.lit(False))).drop("_touch")


def team_match_stats(events: DataFrame) -> DataFrame:
    """One row per match and team.

    One grouped pass; the opponent's side is the match total minus the own side, so no self-join.
    Uses xG, xGOT, xT, epv_added, xPass where present (NULL counts as 0).
    """
    ev = with_touch_change(events)
    shot, passed = p.is_shot(), p.is_pass()
    touch3 = F.coalesce(c("isTouch"), F.lit(False)) & (zero("x") >= p.FINAL_THIRD)
    card = F.coalesce(c("cardType"), F.lit(""))
    agg = ev.groupBy(*KEYS, "teamName").agg(
        F.min("startDate").alias("date"), F.min("opponentName").alias("opponentName"), F.min("h_a").alias("homeAway"),
        F.count("*").alias("events"),
        n_if(c("type") == "Goal").alias("goals_raw"), n_if((c("type") == "Goal") & p.own_goal()).alias("_own"),
        fsum(c("xG")).alias("xG"), n_if(shot).alias("shots"), n_if(p.kind(*p.ON_TARGET_TYPES)).alias("shots_on_target"),
        n_if(passed).alias("passes"), n_if(passed & p.completed()).alias("passes_completed"),
        n_if(p.kind(*p.PPDA_TYPES)).alias("_press"),
        n_if(p.kind("Turnover", "Dispossessed")).alias("turnovers"),
        n_if(shot & (c("xG") > 0.35)).alias("big_chances"),
        n_if(passed & has_like("Cross")).alias("crosses"), n_if(passed & has_like("Throughball")).alias("through_balls"),
        n_if(passed & has_like("Longball")).alias("long_balls"),
        n_if(c("type") == "TakeOn").alias("dribbles_attempted"),
        n_if((c("type") == "TakeOn") & p.completed()).alias("dribbles_won"),
        n_if(c("type") == "Clearance").alias("clearances"), n_if(c("type") == "Foul").alias("fouls_committed"),
        n_if(c("type") == "Aerial").alias("aerial_duels_total"),
        n_if((c("type") == "Aerial") & p.completed()).alias("aerial_duels_won"),
        n_if(card.rlike("Yellow")).alias("yellow_cards"),
        n_if(card.rlike("(?<![Ss]econd)Red|SecondYellow")).alias("red_cards"),
        fsum(c("xGOT")).alias("xGOT"),
        sum_if(p.on_ball_success(), F.greatest(zero("xT"), F.lit(0.0))).alias("xT"),
        sum_if(p.on_ball_success(), zero("epv_added")).alias("epv_added"),
        n_if(p.prog_pass() > 0).alias("prog_passes"), n_if(p.prog_carry() > 0).alias("prog_carries"),
        n_if(p.box_entry_season()).alias("box_entries"), n_if(touch3).alias("_tilt"),
        n_if(c("touch_change")).alias("possessions"),
        sum_if(passed, c("xPass")).alias("xpass_exp_completed"))
    # Two rows per match reach this window.
    m = W.partitionBy("matchId")
    other = lambda name: F.sum(name).over(m) - c(name)
    opp_pass = other("passes")
    agg = (agg.withColumn("goals", c("goals_raw") - c("_own") + other("_own"))
           .withColumn("goals_against_raw", other("goals_raw"))
           .withColumn("goals_against", other("goals_raw") - other("_own") + c("_own"))
           .withColumn("xG_against", F.round(other("xG"), 6)).withColumn("xGOT_against", F.round(other("xGOT"), 6))
           .withColumn("shots_against", other("shots")).withColumn("big_chances_against", other("big_chances"))
           .withColumn("possession_pct", pct(c("events"), F.sum("events").over(m)))
           .withColumn("field_tilt_pct", pct(c("_tilt"), F.sum("_tilt").over(m)))
           .withColumn("ppda", ratio(opp_pass, F.greatest(F.lit(1), c("_press")))))
    return (agg.withColumn("pass_accuracy", pct(c("passes_completed"), c("passes")))
            .withColumn("shot_accuracy", ratio(c("shots_on_target"), F.greatest(F.lit(1), c("shots")), 100.0))
            .withColumn("xG_per_shot", ratio(c("xG"), F.greatest(F.lit(1), c("shots"))))
            .drop("_own", "_press", "_tilt", "events"))


def player_match_stats(events: DataFrame) -> DataFrame:
    """One row per match and player: minutes, counters, duels, defensive actions by third, receptions."""
    shot, passed = p.is_shot(), p.is_pass()
    done = passed & p.completed()
    penalty = has_like("Penalty") & ~has_like("PenaltyShootout")
    card = F.coalesce(c("cardType"), F.lit(""))
    length = dist(zero("endX"), zero("endY"), zero("x"), zero("y"))
    acts = p.defensive_action()
    mins = (F.coalesce(c("minute"), F.lit(0)) + c("second") / 60.0)
    types = {"tackles": "Tackle", "interceptions": "Interception", "clearances": "Clearance", "fouls_committed": "Foul",
             "recoveries": "BallRecovery", "blocked_passes": "BlockedPass", "dribbled_past": "Challenge",
             "aerial_duels_total": "Aerial", "dribbles_attempted": "TakeOn", "carries": "Carry"}
    agg = events.where(c("playerName").isNotNull()).groupBy(*KEYS, "playerName").agg(
        F.min("startDate").alias("date"), F.min_by("teamName", "index").alias("teamName"),
        F.min(mins).alias("_first"), F.max(mins).alias("_last"),
        n_if(c("type") == "Goal").alias("goals"), fsum(c("xG")).alias("xG"), n_if(shot).alias("shots"),
        n_if(p.kind(*p.ON_TARGET_TYPES)).alias("shots_on_target"), n_if(shot & (c("xG") > 0.35)).alias("big_chances"),
        n_if(has_like("KeyPass")).alias("key_passes"), fsum(c("xA")).alias("xA"),
        n_if(passed & has_like("Cross")).alias("crosses"), n_if(passed & has_like("Throughball")).alias("through_balls"),
        n_if(passed & has_like("Longball")).alias("long_balls"), n_if(p.prog_pass() > 0).alias("prog_passes"),
        n_if(p.prog_carry() > 0).alias("prog_carries"), fsum(c("xT")).alias("xT"),
        *[n_if(c("type") == t).alias(n) for n, t in types.items()],
        n_if((c("type") == "Aerial") & p.completed()).alias("aerial_duels_won"),
        n_if((c("type") == "TakeOn") & p.completed()).alias("dribbles_won"),
        n_if(card.rlike("Yellow")).alias("yellow_cards"),
        n_if(card.rlike("(?<![Ss]econd)Red|SecondYellow")).alias("red_cards"),
        n_if(passed).alias("passes_attempted"), n_if(done).alias("passes_completed"),
        fmean(F.when(done, length)).alias("avg_pass_distance"),
        n_if(done & (zero("endX") > 75)).alias("final_third_passes"),
        n_if(done & (zero("endX") >= p.BOX_X) & zero("endY").between(13.6, 54.4)).alias("box_passes"),
        n_if(p.kind("Turnover", "Dispossessed")).alias("turnovers"),
        n_if(p.duel()).alias("duels_total"), n_if(p.duel_won()).alias("duels_won"), n_if(p.duel("Ground")).alias("ground_duels"),
        n_if(acts).alias("def_actions_total"), n_if(acts & (zero("x") < 35)).alias("def_actions_def_third"),
        n_if(acts & (zero("x") >= 35) & (zero("x") < 70)).alias("def_actions_mid_third"),
        n_if(acts & (zero("x") >= 70)).alias("def_actions_att_third"),
        fsum(c("xGOT")).alias("xGOT"), sum_if(p.on_ball_success(), zero("epv_added")).alias("epv_added"),
        n_if(F.coalesce(c("isTouch"), F.lit(False))).alias("touches"),
        sum_if(~(shot & penalty), c("xG")).alias("npxG"), sum_if(passed, c("xPass")).alias("xpass_exp_completed"))
    received = (with_receiver(events, "season").where(c("receiverName").isNotNull())
                .groupBy("matchId", c("receiverName").alias("playerName"))
                .agg(F.count("*").alias("passes_received"), n_if(p.prog_pass() > 0).alias("prog_passes_received")))
    start = F.when(c("_first") < 5.0, 0.0).otherwise(c("_first"))
    out = (agg.join(received, ["matchId", "playerName"], "left")
           .fillna(0, ["passes_received", "prog_passes_received"]))
    return (out.withColumn("mins_played", F.greatest(F.lit(1), F.bround(c("_last") - start).cast("bigint")))
            .withColumn("shot_accuracy", ratio(c("shots_on_target"), F.greatest(F.lit(1), c("shots")), 100.0))
            .withColumn("xG_per_shot", ratio(c("xG"), F.greatest(F.lit(1), c("shots"))))
            .withColumn("pass_accuracy", pct(c("passes_completed"), c("passes_attempted")))
            .drop("_first", "_last"))


def match_keepers(events: DataFrame) -> DataFrame:
    """The keeper of each side: most keeper events, smallest name on ties."""
    n = (events.where(p.kind(*p.KEEPER_TYPES) & c("playerName").isNotNull())
         .groupBy("matchId", "teamName", "playerName").agg(F.count("*").alias("n")))
    best = n.groupBy("matchId", "teamName").agg(F.min(F.struct((-c("n")).alias("rank"), "playerName")).alias("k"))
    return best.select("matchId", "teamName", c("k.playerName").alias("playerName"))


def keeper_match_stats(events: DataFrame) -> DataFrame:
    """Shot stopping, distribution and sweeping of each side's keeper."""
    shot = p.is_shot() & ~p.own_goal()
    target = shot & p.kind(*p.ON_TARGET_TYPES)
    faced = (events.where(p.is_shot()).groupBy("matchId", c("opponentName").alias("teamName")).agg(
        n_if(target).alias("gk_sot_faced"), n_if(shot & (c("type") == "Goal")).alias("gk_goals_conceded"),
        sum_if(target, c("xG")).alias("gk_xg_on_target_faced"), sum_if(target, c("xGOT")).alias("gk_xgot_faced")))
    length = dist(zero("endX"), zero("endY"), zero("x"), zero("y"))
    passed = p.is_pass()
    own = events.groupBy("matchId", "teamName", "playerName").agg(
        n_if(p.kind("Claim", "Punch")).alias("gk_claims"), n_if(c("type") == "KeeperPickup").alias("gk_pickups"),
        n_if(c("type") == "KeeperSweeper").alias("gk_sweeper_actions"), n_if(passed).alias("_n"),
        n_if(passed & p.completed()).alias("_ok"), n_if(passed & (length >= 32.0)).alias("_long"),
        F.coalesce(fmean(F.when(passed, length)), F.lit(0.0)).alias("gk_avg_pass_length"))
    out = (match_keepers(events).join(own, ["matchId", "teamName", "playerName"])
           .join(faced, ["matchId", "teamName"], "left")
           .fillna(0, ["gk_sot_faced", "gk_goals_conceded"])
           .fillna(0.0, ["gk_xg_on_target_faced", "gk_xgot_faced"]))
    saves = F.greatest(F.lit(0), c("gk_sot_faced") - c("gk_goals_conceded"))
    return (out.withColumn("gk_saves", saves).withColumn("gk_save_pct", pct(c("gk_saves"), c("gk_sot_faced")))
            .withColumn("gk_goals_prevented", c("gk_xgot_faced") - c("gk_goals_conceded"))
            .withColumn("gk_pass_completion_pct", pct(c("_ok"), c("_n")))
            .withColumn("gk_long_pass_pct", pct(c("_long"), c("_n"))).drop("_n", "_ok", "_long"))


def event_locations(events: DataFrame) -> DataFrame:
    """Trackable events with coordinates and values, absent numbers as 0."""
    zeros = ["x", "y", "endX", "endY", "xG", "xA", "xT"]
    cols = [zero(n).alias(n) if n in events.columns else F.lit(0.0).alias(n) for n in zeros]
    return events.where(p.kind(*p.LOCATION_TYPES)).select(
        "matchId", c("startDate").alias("date"), "league", "season", "eventId", "teamName", "playerName", "type", "outcomeType",
        F.coalesce("isGoal", F.lit(False)).alias("isGoal"), *cols, "qualifiers", "period", "minute")


def league_table(team_rows: DataFrame) -> DataFrame:
    """Played, won, drawn, lost, goals, points and position per league and season.

    ``position`` orders by points, goal difference, goals, then name.
    """
    won, drew = c("goals") > c("goals_against"), c("goals") == c("goals_against")
    agg = team_rows.groupBy("league", "season", "teamName").agg(
        F.count("*").alias("played"), n_if(won).alias("won"), n_if(drew).alias("drawn"),
        n_if(c("goals") < c("goals_against")).alias("lost"), F.sum("goals").alias("gf"), F.sum("goals_against").alias("ga"),
        fsum(c("xG")).alias("xg"), fsum(c("xG_against")).alias("xga"))
    agg = (agg.withColumn("gd", c("gf") - c("ga")).withColumn("pts", c("won") * 3 + c("drawn"))
           .withColumn("xgd", F.round(c("xg") - c("xga"), 6)))
    # One row per team of one league season reaches this window.
    w = W.partitionBy("league", "season").orderBy(F.desc("pts"), F.desc("gd"), F.desc("gf"), "teamName")
    return agg.withColumn("position", F.row_number().over(w))


def team_form(team_rows: DataFrame, window: int = 5) -> DataFrame:
    """Each team's last matches of the season, oldest first, with result and points."""
    # One row per match of one team season reaches this window.
    w = W.partitionBy("league", "season", "teamName").orderBy(F.desc("date"), F.desc("matchId"))
    won, drew = c("goals") > c("goals_against"), c("goals") == c("goals_against")
    return (team_rows.withColumn("recency", F.row_number().over(w)).where(c("recency") <= window)
            .withColumn("result", F.when(won, "W").when(drew, "D").otherwise("L"))
            .withColumn("points", F.when(won, 3).when(drew, 1).otherwise(0))
            .select("league", "season", "teamName", "recency", "date", "matchId", "opponentName", "homeAway", "goals",
                    "goals_against", "xG", "xG_against", "result", "points"))


LEADER_SUMS = ["goals", "shots", "key_passes", "prog_passes", "tackles", "interceptions", "recoveries", "dribbles_won"]
LEADER_VALUES = ["xG", "xA", "xT", "npxG"]


def player_season(player_rows: DataFrame) -> DataFrame:
    agg = player_rows.groupBy("league", "season", "playerName").agg(
        F.max_by("teamName", F.struct("date", "matchId")).alias("teamName"), F.count("*").alias("matches"),
        F.sum("mins_played").alias("mins_played"), *[F.sum(n).alias(n) for n in LEADER_SUMS],
        *[fsum(c(n)).alias(n) for n in LEADER_VALUES])
    for n in ("goals", "xG", "xA", "shots", "key_passes"):
        agg = agg.withColumn(f"{n}_p90", ratio(c(n), c("mins_played"), 90.0))
    return agg


def player_leaderboard(player_rows: DataFrame, sort_by: str = "xG", min_mins: int = 90, top: int = 50) -> DataFrame:
    """Top players of each league season by one metric, with a minutes gate and per-90 rates."""
    per = player_season(player_rows).where(c("mins_played") >= min_mins)
    # A season's players reach this window; Spark keeps only the first rows per partition (group limit).
    w = W.partitionBy("league", "season").orderBy(F.desc(sort_by), "playerName")
    return per.withColumn("rank", F.row_number().over(w)).where(c("rank") <= top)


def season_verification(team_rows: DataFrame, player_rows: DataFrame) -> DataFrame:
    """Row, match and team counts plus the five highest xG teams and players per league season."""
    def top(df, key):
        per = df.groupBy("league", "season", key).agg(fsum(c("xG")).alias("xG"))
        w = W.partitionBy("league", "season").orderBy(F.desc("xG"), key)
        return (per.withColumn("rank", F.row_number().over(w)).where(c("rank") <= 5)
                .select("league", "season", F.lit(f"top_xg_{key}").alias("check"), "rank", c(key).alias("name"), c("xG").alias("value")))
    counts = team_rows.groupBy("league", "season").agg(
        F.count("*").cast("double").alias("rows"), F.count_distinct("matchId").cast("double").alias("matches"),
        F.count_distinct("teamName").cast("double").alias("teams"))
    counts = counts.unpivot(["league", "season"], ["rows", "matches", "teams"], "name", "value").select(
        "league", "season", F.lit("count").alias("check"), F.lit(0).alias("rank"), "name", "value")
    return counts.unionByName(top(team_rows, "teamName")).unionByName(top(player_rows, "playerName"))


def season_tables(events: DataFrame, minimum: int = 50) -> dict[str, DataFrame]:
    """The four season tables of an event table: repeats dropped, team names repaired by the side's name, matches that fail
    validation left out."""
    bad = validate_matches(events, minimum).where(F.size("violations") > 0).select("matchId")
    named = events.where(c("teamName").isNotNull() & (c("teamName") != "None")).groupBy("matchId", "teamId").agg(F.min("teamName").alias("_name"))
    rows = dedupe_events(events, "index").join(bad, "matchId", "left_anti").join(named, ["matchId", "teamId"], "left")
    rows = rows.withColumn("teamName", F.coalesce("_name", "teamName")).drop("_name")
    of = rows.select("league", "season", "matchId").distinct()
    return {"team_matches": team_match_stats(rows), "player_matches": player_match_stats(rows), "keeper_matches": keeper_match_stats(rows).join(of, "matchId"),
            "event_locations": event_locations(rows)}
