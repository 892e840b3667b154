"""Match views over all matches at once: summaries, dynamics, breakdowns, timelines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from touchline.functions import predicates as p, zones as z
from touchline.functions.core import fsum, has, n_if, pct, ratio, sum_if
from touchline.operators.scan import dense_position
from touchline.operators.state import with_match_clock

WINDOW = 15
ATTACK_TYPES = ["Pass", "Carry", "SavedShot", "MissedShots", "Goal", "ShotOnPost"]
DECAY = [math.exp(-0.1 * k) for k in range(3)]


def c(name):
    return F.col(name)


def zero(name):
    return F.coalesce(F.col(name), F.lit(0.0))


def match_teams(events: DataFrame) -> DataFrame:
    """Teams of each match with ``full_time``: the last minute, 90 at least. Two rows per match."""
    per = events.groupBy("matchId", "teamName").agg(F.max("minute").alias("_last"), F.min("h_a").alias("h_a"))
    m = W.partitionBy("matchId")
    return per.withColumn("full_time", F.greatest(F.lit(90), F.max("_last").over(m))).drop("_last")


def window_spine(teams: DataFrame) -> DataFrame:
    return teams.withColumn("window", F.explode(F.sequence(F.lit(0), c("full_time"), F.lit(WINDOW))))


def minute_spine(teams: DataFrame) -> DataFrame:
    return teams.withColumn("minute", F.explode(F.sequence(F.lit(0), c("full_time"))))


def match_context(events: DataFrame) -> DataFrame:
    """Home and away team, date, competition and score of each match (own goals to the opponent)."""
    goal, own = c("type") == "Goal", p.own_goal()
    home = c("h_a") == "h"
    return events.groupBy("matchId").agg(
        F.min("league").alias("league"), F.min("season").alias("season"), F.min("startDate").alias("date"),
        F.max(F.when(home, c("teamName"))).alias("home_team"), F.max(F.when(~home, c("teamName"))).alias("away_team"),
        n_if(goal & (home != own)).alias("home_goals"), n_if(goal & (home == own)).alias("away_goals"),
        F.count("*").alias("events"))


def team_summaries(events: DataFrame) -> DataFrame:
    passed = p.is_pass()
    return events.groupBy("matchId", "teamName").agg(
        F.count("*").alias("events"), n_if(c("isGoal")).alias("goals"), n_if(c("isShot")).alias("shots"),
        fsum(c("xG")).alias("xg"), fsum(c("xGOT")).alias("xgot"), n_if(passed & p.completed()).alias("completed_passes"),
        pct(n_if(passed & p.completed()), n_if(passed)).alias("pass_accuracy"))


def period_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("matchId", "period").agg(
        F.count("*").alias("events"), n_if(c("isShot")).alias("shots"), n_if(c("isGoal")).alias("goals"))


def summary_cards(events: DataFrame) -> DataFrame:
    return events.groupBy("matchId").agg(
        F.count("*").alias("events"), n_if(c("isShot")).alias("shots"), n_if(c("isGoal")).alias("goals"),
        fsum(c("xG")).alias("xg_total"), fsum(c("xGOT")).alias("xgot_total"))


def available_filters(events: DataFrame) -> DataFrame:
    """Distinct values of the filter columns, one row per match, column and value.

    Rows instead of collected lists: a value list is as long as the data makes it.
    """
    names = ["teamName", "playerName", "period", "situation", "type"]
    long = events.select("matchId", F.explode(F.array(*[
        F.struct(F.lit(n).alias("filter"), F.col(n).cast("string").alias("value")) for n in names])).alias("f"))
    return long.select("matchId", "f.filter", "f.value").where(c("value").isNotNull()).distinct()


def player_table(events: DataFrame, top: int = 25) -> DataFrame:
    """Best players of each match by goals, xG, events."""
    per = events.where(c("playerName").isNotNull()).groupBy("matchId", "playerName").agg(
        F.min_by("teamName", "index").alias("teamName"), F.count("*").alias("events"),
        n_if(c("isShot")).alias("shots"), n_if(c("isGoal")).alias("goals"), fsum(c("xG")).alias("xg"))
    w = W.partitionBy("matchId").orderBy(F.desc("goals"), F.desc("xg"), F.desc("events"), "playerName")
    return per.withColumn("rank", F.row_number().over(w)).where(c("rank") <= top)


def event_timeline(events: DataFrame, first: int | None = None) -> DataFrame:
    """Events as (minute, team, player, event) rows; ``first`` keeps each match's first events after whatever filter came before."""
    rows = events.where(c("minute").isNotNull())
    if first is not None:
        rows = dense_position(rows, "_place").where(c("_place") < first)
    return rows.select("matchId", "index", "minute", "teamName", "playerName", "type", "outcomeType",
                       F.coalesce("isShot", F.lit(False)).alias("is_shot"), F.coalesce("isGoal", F.lit(False)).alias("is_goal"))


def attack_direction(events: DataFrame) -> DataFrame:
    """Whether a team attacks to the right: median of its shot x and pass end x at least 52.5."""
    shots = events.where(p.is_shot()).select("matchId", "teamName", c("x").alias("v"))
    ends = events.where(p.is_pass()).select("matchId", "teamName", c("endX").alias("v"))
    return (shots.unionByName(ends).where(c("v").isNotNull()).groupBy("matchId", "teamName")
            .agg(F.median("v").alias("median_x")).withColumn("attacks_right", c("median_x") >= 52.5))


def filter_shots(events: DataFrame, team=None, situation=None, player=None) -> DataFrame:
    """Shots under optional filters; missing xG counts 0.05 here, missing xGOT 0."""
    out = events.where(p.is_shot())
    if team:
        out = out.where(c("teamName") == team)
    if situation and situation != "All":
        out = out.where(c("situation") == situation)
    if player:
        out = out.where(c("playerName") == player)
    return out.withColumn("xG", F.coalesce("xG", F.lit(0.05))).withColumn("xGOT", zero("xGOT"))


def xg_flow(events: DataFrame) -> DataFrame:
    """Cumulative xG of each team for every minute of the match."""
    per = filter_shots(events).groupBy("matchId", "teamName", "minute").agg(fsum(c("xG")).alias("xg"))
    spine = minute_spine(match_teams(events)).join(per, ["matchId", "teamName", "minute"], "left")
    # One row per minute reaches this window.
    w = W.partitionBy("matchId", "teamName").orderBy("minute").rowsBetween(W.unboundedPreceding, 0)
    micro = F.sum(F.round(zero("xg") * 1e6).cast("bigint")).over(w)
    return spine.select("matchId", "teamName", "minute", (micro.cast("double") / 1e6).alias("cumulative_xg"))


def momentum(events: DataFrame, value: str, cap: float) -> DataFrame:
    """Per-minute pressure: best capped action value now and in the two minutes before, decayed.

    Teams are taken in name order; the second counts negative.
    """
    teams = match_teams(events).groupBy("matchId").agg(
        F.min("teamName").alias("team_1"), F.max("teamName").alias("team_2"), F.max("full_time").alias("full_time"))
    best = (events.where(p.on_ball_success()).groupBy("matchId", "teamName", "minute")
            .agg(F.max(F.greatest(F.lit(0.0), F.least(F.lit(cap), zero(value)))).alias("v")))
    spine = minute_spine(teams)
    out = spine
    for n in (1, 2):
        side = best.select("matchId", c("teamName").alias(f"team_{n}"), "minute", c("v").alias(f"v{n}"))
        out = out.join(side, ["matchId", f"team_{n}", "minute"], "left")
    w = W.partitionBy("matchId").orderBy("minute")
    for n in (1, 2):
        v = zero(f"v{n}")
        out = out.withColumn(f"m{n}", v + DECAY[1] * F.coalesce(F.lag(v, 1).over(w), F.lit(0.0))
                             + DECAY[2] * F.coalesce(F.lag(v, 2).over(w), F.lit(0.0)))
    return out.select("matchId", "minute", c("m1").alias("first_team"), (-c("m2")).alias("second_team"),
                      (c("m1") - c("m2")).alias("momentum"))


def possession_by_duration(events: DataFrame) -> DataFrame:
    """Share of ball time by 15-minute window: length of each possession, credited to its first team."""
    ev = with_match_clock(events.where(c("possession_id").isNotNull()))
    poss = ev.groupBy("matchId", "possession_id").agg(
        F.min_by("teamName", "index").alias("teamName"), F.min("clock_s").alias("s"), F.max("clock_s").alias("e"))
    per = poss.groupBy("matchId", (F.floor(c("s") / 900) * 15).cast("int").alias("window"), "teamName").agg(
        F.sum(c("e") - c("s")).alias("seconds"))
    return per.withColumn("possession_pct", pct(c("seconds"), F.sum("seconds").over(W.partitionBy("matchId", "window"))))


def windowed_dynamics(events: DataFrame) -> DataFrame:
    """By 15-minute window and team: pass share, pass accuracy, turnovers, pressing (PPDA).

    PPDA counts whole possessions at their starting window: passes over successful defensive actions,
    credited to the side without the ball. Needs ``possession_id``.
    """
    ev = with_match_clock(events)
    spine = window_spine(match_teams(events))
    win = (F.floor(c("clock_s") / (WINDOW * 60)) * WINDOW).cast("int")
    passed = p.is_pass()
    lost = F.coalesce(c("turnover"), F.lit(False)).cast("int") + (c("type") == "Dispossessed").cast("int")
    per = ev.groupBy("matchId", "teamName", win.alias("window")).agg(
        n_if(passed).alias("passes"), n_if(passed & p.completed()).alias("completed"), F.sum(lost).alias("turnovers"))
    press = (p.kind(*p.PRESS_TYPES) & (c("outcomeType").isNull() | (c("outcomeType") == "Successful")))
    raw = (F.floor((c("minute") * 60 + c("second")) / 900) * 15).cast("int")
    poss = ev.where(c("possession_id").isNotNull()).groupBy("matchId", "possession_id").agg(
        F.min_by("opponentName", "index").alias("teamName"), F.min_by(raw, "index").alias("window"),
        n_if(passed).alias("p"), n_if(press).alias("d"))
    ppda = poss.groupBy("matchId", "teamName", "window").agg(ratio(F.sum("p"), F.sum("d")).alias("ppda"))
    out = (spine.join(per, ["matchId", "teamName", "window"], "left").join(ppda, ["matchId", "teamName", "window"], "left")
           .fillna(0, ["passes", "completed", "turnovers"]).fillna(0.0, ["ppda"]))
    both = F.sum("passes").over(W.partitionBy("matchId", "window"))
    return out.select("matchId", "teamName", "window", pct(c("passes"), both).alias("possession_pct"),
                      pct(c("completed"), c("passes")).alias("pass_accuracy_pct"), "turnovers", "ppda")


def attack_flanks(events: DataFrame) -> DataFrame:
    """Attacks per flank: the lane of the first final-third action of each team possession, with its xG."""
    inside = events.where(p.kind(*ATTACK_TYPES) & (c("x") > 70.12) & c("possession_id").isNotNull())
    per = inside.groupBy("matchId", "teamName", "possession_id").agg(
        F.min_by("y", "index").alias("y"), sum_if(p.is_shot(), zero("xG")).alias("xg"))
    got = per.groupBy("matchId", "teamName", z.flank(c("y")).alias("flank")).agg(
        F.count("*").alias("num_attacks"), fsum(c("xg")).alias("total_xg"))
    spine = match_teams(events).select("matchId", "teamName", F.explode(F.array(*map(F.lit, ["Left", "Center", "Right"]))).alias("flank"))
    return spine.join(got, ["matchId", "teamName", "flank"], "left").fillna(0, ["num_attacks"]).fillna(0.0, ["total_xg"])


def attack_flanks_by_event(events: DataFrame) -> DataFrame:
    """The same by single final-third events, for feeds without possessions."""
    inside = events.where(p.kind(*ATTACK_TYPES) & (c("x") > 70.12))
    return inside.groupBy("matchId", "teamName", z.flank(F.coalesce("y", F.lit(34.0))).alias("flank")).agg(
        F.count("*").alias("num_attacks"), sum_if(p.is_shot(), zero("xG")).alias("total_xg"))


def dynamics_summary(events: DataFrame) -> DataFrame:
    """One row per match and team for the dynamics page."""
    passed, corner = p.is_pass(), has("CornerTaken")
    base = events.groupBy("matchId", "teamName").agg(
        F.count("*").alias("events"), n_if(c("isGoal")).alias("goals"), n_if(c("isShot")).alias("shots"),
        fsum(c("xG")).alias("xg"), fsum(c("xGOT")).alias("xgot"), n_if(p.on_target()).alias("shots_on_target"),
        n_if(passed & p.completed()).alias("completed_passes"), pct(n_if(passed & p.completed()), n_if(passed)).alias("pass_accuracy"),
        n_if(passed & p.completed() & (zero("endX") > 75)).alias("final_third_entries"),
        n_if(has("BigChance") & (c("type") != "Goal")).alias("big_chances_missed"), n_if(corner).alias("_taken"),
        n_if(c("type") == "CornerAwarded").alias("_awarded"), n_if(passed).alias("_passes"),
        sum_if(p.on_ball_success(), F.greatest(zero("xT"), F.lit(0.0))).alias("xt"),
        sum_if(p.on_ball_success(), zero("epv_added")).alias("epv_added"))
    m = W.partitionBy("matchId")
    base = (base.withColumn("event_share", pct(c("events"), F.sum("events").over(m)))
            .withColumn("possession_pct", pct(c("_passes"), F.sum("_passes").over(m)))
            .withColumn("corners_taken", F.when(c("_taken") > 0, c("_taken")).otherwise(c("_awarded")))
            .drop("_taken", "_awarded", "_passes"))
    win = windowed_dynamics(events).groupBy("matchId", "teamName").agg(
        F.sum("turnovers").alias("turnovers"),
        ratio(fsum(F.when(c("ppda") > 0, c("ppda"))), F.count_if(c("ppda") > 0)).alias("ppda"))
    fl = attack_flanks(events).groupBy("matchId", "teamName").agg(
        F.sum("num_attacks").alias("attacks"), fsum(c("total_xg")).alias("flank_xg"))
    return base.join(win, ["matchId", "teamName"]).join(fl, ["matchId", "teamName"])


def event_markers(events: DataFrame) -> DataFrame:
    """Goals and cards with the minute used on charts (95 at most, not past full time)."""
    ft = match_teams(events).select("matchId", "full_time").distinct()
    card = F.lower(F.concat_ws(" ", "type", "cardType", F.concat_ws(" ", "qualifiers")))
    second = card.rlike("second ?yellow|2nd yellow|second booking|second caution|yellow[ -]red")
    red = card.contains("red") | second
    marks = (events.where(p.kind("Goal", "Card") & (c("minute") >= 0)).join(ft, "matchId"))
    is_card = c("type") == "Card"
    return marks.select(
        "matchId", "eventId", "teamName", "playerName", F.least(c("minute"), F.lit(95), c("full_time")).alias("minute"),
        F.when(~is_card, "goal").when(red, "red_card").otherwise("yellow_card").alias("event_type"),
        F.when(is_card, F.when(second, "second_yellow_red").when(red, "straight_red").otherwise("yellow")).alias("card_kind"))


def stat_breakdowns(events: DataFrame) -> DataFrame:
    """Splits of the team stats by situation, half and third, one wide row per match and team."""
    shot, penalty = p.is_shot(), p.is_shot() & has("Penalty")
    set_piece = shot & ~penalty & F.coalesce(c("situation").isin("FromCorner", "SetPiece", "DirectFreekick"), F.lit(False))
    xg = F.coalesce("xG", F.lit(0.05))
    h1, h2 = c("period") == "FirstHalf", c("period") == "SecondHalf"
    lost = F.coalesce(c("turnover"), F.lit(False)) | (c("type") == "Dispossessed")
    corner = has("CornerTaken") & p.is_pass()
    move, gain = p.on_ball_success(), F.greatest(zero("xT"), F.lit(0.0))
    touch = F.coalesce(c("isTouch"), F.lit(False))
    own3, their3 = z.third(zero("x")), z.third(105.0 - zero("x"))
    aggs = [
        sum_if(shot & ~set_piece & ~penalty, xg).alias("xg_open_play"), sum_if(set_piece, xg).alias("xg_set_piece"),
        sum_if(penalty, xg).alias("xg_penalty"), sum_if(shot & ~penalty, xg).alias("xg_non_penalty"),
        sum_if(shot & h1, xg).alias("xg_first_half"), sum_if(shot & h2, xg).alias("xg_second_half"),
        n_if(p.on_target()).alias("shots_on_target"),
        n_if(shot & ~p.on_target() & ~p.shot_blocked() & (c("type") != "ShotOnPost")).alias("shots_off_target"),
        n_if(shot & p.shot_blocked()).alias("shots_blocked"), n_if(c("type") == "ShotOnPost").alias("shots_woodwork"),
        n_if(shot & h1).alias("shots_first_half"), n_if(shot & h2).alias("shots_second_half"),
        n_if(corner & (zero("y") < 34)).alias("corners_right"), n_if(corner & (zero("y") >= 34)).alias("corners_left"),
        n_if(corner & h1).alias("corners_first_half"), n_if(corner & h2).alias("corners_second_half"),
        n_if(lost & h1).alias("turnovers_first_half"), n_if(lost & h2).alias("turnovers_second_half"),
        sum_if(move & p.is_pass(), gain).alias("xt_passes"), sum_if(move & (c("type") == "Carry"), gain).alias("xt_carries")]
    for name, _ in z.THIRDS:
        here = own3 == name
        aggs += [n_if(touch & here).alias(f"_own_{name}"), n_if(touch & (their3 == name)).alias(f"_opp_{name}"),
                 n_if(p.is_pass() & here).alias(f"passes_{name}"), n_if(p.is_pass() & here & p.completed()).alias(f"completed_{name}"),
                 n_if(lost & here).alias(f"turnovers_{name}"), sum_if(move & here, gain).alias(f"xt_{name}")]
    for half, cond in (("first_half", h1), ("second_half", h2)):
        aggs += [n_if(p.is_pass() & cond).alias(f"_p_{half}"), n_if(p.kind(*p.PRESS_TYPES) & cond).alias(f"_d_{half}")]
    out = events.groupBy("matchId", "teamName").agg(*aggs)
    m = W.partitionBy("matchId")
    other = lambda n: F.sum(n).over(m) - c(n)
    for name, _ in z.THIRDS:
        opp = other(f"_opp_{name}")
        out = (out.withColumn(f"possession_pct_{name}", ratio(c(f"_own_{name}"), F.greatest(F.lit(1), c(f"_own_{name}") + opp), 100.0))
               .withColumn(f"pass_accuracy_{name}", pct(c(f"completed_{name}"), c(f"passes_{name}"))))
    for half in ("first_half", "second_half"):
        out = out.withColumn(f"ppda_{half}", ratio(other(f"_p_{half}"), c(f"_d_{half}")))
    return out.drop(*[n for n in out.columns if n.startswith("_")])


def goal_list(events: DataFrame) -> DataFrame:
    """Goals with scorer and xG, credited to the scoring side; own goals carry xG 0."""
    own = p.own_goal()
    return events.where(c("type") == "Goal").select(
        "matchId", "eventId", F.when(own, c("opponentName")).otherwise(c("teamName")).alias("team"),
        c("playerName").alias("player"), "minute", "second", F.when(own, 0.0).otherwise(zero("xG")).alias("xg"),
        (has("Penalty") & ~own).alias("penalty"), own.alias("own_goal"))


def thirds_series(events: DataFrame) -> DataFrame:
    """Possession, pass accuracy, PPDA and turnovers by window, team and third.

    Every event counts twice: for its team in the third it happened in, and for the opponent in the
    mirrored third, so one grouping gives both sides.
    """
    ev = with_match_clock(events)
    touch = F.coalesce(c("isTouch"), F.lit(False))
    lost = F.coalesce(c("turnover"), F.lit(False)) | (c("type") == "Dispossessed")
    sides = F.array(
        F.struct(c("teamName").alias("team"), z.third(zero("x")).alias("third"), F.lit(True).alias("own")),
        F.struct(c("opponentName").alias("team"), z.third(105.0 - zero("x")).alias("third"), F.lit(False).alias("own")))
    ev = ev.select("matchId", (F.floor(c("clock_s") / 900) * 15).cast("int").alias("window"), "type", "outcomeType",
                   touch.alias("touch"), lost.alias("lost"), F.explode(sides).alias("s"))
    own, opp = c("s.own"), ~c("s.own")
    per = ev.groupBy("matchId", "window", c("s.team").alias("teamName"), c("s.third").alias("third")).agg(
        n_if(own & c("touch")).alias("ot"), n_if(opp & c("touch")).alias("pt"), n_if(own & p.is_pass()).alias("att"),
        n_if(own & p.is_pass() & p.completed()).alias("ok"), n_if(opp & p.is_pass()).alias("op"),
        n_if(own & p.kind(*p.PRESS_TYPES)).alias("da"), n_if(own & c("lost")).alias("turnovers"))
    spine = window_spine(match_teams(events)).select(
        "matchId", "teamName", "window", F.explode(F.array(*[F.lit(n) for n, _ in z.THIRDS])).alias("third"))
    out = spine.join(per, ["matchId", "teamName", "window", "third"], "left").fillna(0)
    return out.select("matchId", "teamName", "window", "third",
                      ratio(c("ot"), F.greatest(F.lit(1), c("ot") + c("pt")), 100.0).alias("possession_pct"),
                      pct(c("ok"), c("att")).alias("pass_accuracy_pct"), ratio(c("op"), c("da")).alias("ppda"), "turnovers")


def third_kpis(events: DataFrame) -> DataFrame:
    """Passing and threat by the third where the pass starts."""
    done = p.completed()
    return (events.where(p.is_pass()).groupBy("matchId", "teamName", z.third(zero("x")).alias("third")).agg(
        F.count("*").alias("passes"), n_if(done).alias("completed"), pct(n_if(done), F.count("*")).alias("completion_pct"),
        sum_if(done, zero("xT")).alias("xt"), n_if(p.progressive() & done).alias("progressive")))


def filter_score_state(events: DataFrame, state: str | None) -> DataFrame:
    if not state or state == "all":
        return events
    if state == "leading":
        return events.where(c("team_goal_diff_before") > 0)
    if state == "trailing":
        return events.where(c("team_goal_diff_before") < 0)
    return events.where(c("team_score_state") == state)


def filter_time_range(events: DataFrame, time_range: str | None) -> DataFrame:
    """``"15-30"`` keeps 15 <= minute < 30; anything unreadable keeps all."""
    try:
        start, end = (int(float(v)) for v in str(time_range).split("-", 1))
    except ValueError:
        return events
    start = max(0, start)
    return events.where((c("minute") >= start) & (c("minute") < max(start + 1, end)))


def filter_third(events: DataFrame, third: str | None) -> DataFrame:
    if not third or third == "all":
        return events
    return events.where(z.third(zero("x")) == third)


# Filter labels.
STATE_LABELS = {"all": "All states", "level": "Level", "leading": "Leading", "trailing": "Trailing",
                "leading_by_1": "Leading by 1", "leading_by_2_plus": "Leading by 2+",
                "trailing_by_1": "Trailing by 1", "trailing_by_2_plus": "Trailing by 2+"}


def game_state_options(events: DataFrame) -> DataFrame:
    """Score-state filter values present for a team, with label and the minutes they span."""
    ft = match_teams(events).select("matchId", "teamName", "full_time")
    s, diff = c("team_score_state"), c("team_goal_diff_before")
    states = F.array_compact(F.array(F.lit("all"), s, F.when(diff > 0, "leading"), F.when(diff < 0, "trailing")))
    per = (events.select("matchId", "teamName", "minute", F.explode(states).alias("value"))
           .groupBy("matchId", "teamName", "value").agg(F.min("minute").alias("lo"), F.max("minute").alias("hi")))
    out = per.join(ft, ["matchId", "teamName"])
    whole = c("value") == "all"
    labels = F.create_map(*[F.lit(v) for pair in STATE_LABELS.items() for v in pair])
    out = out.withColumn("minute_start", F.when(whole, 0).otherwise(F.greatest(F.lit(0), c("lo"))))
    end = F.when(whole, c("full_time")).otherwise(F.greatest(c("minute_start") + 1, F.least(c("full_time"), c("hi"))))
    return out.select("matchId", "teamName", "value", labels[c("value")].alias("label"), "minute_start", end.alias("minute_end"))


def time_range_options(events: DataFrame, size: int = WINDOW) -> DataFrame:
    """Time filter values of each match: the whole match, then 15-minute ranges; from 90 on "Stoppage"."""
    ft = events.groupBy("matchId").agg(F.greatest(F.lit(90), F.max("minute")).alias("ft"))
    out = ft.withColumn("minute_start", F.explode(F.sequence(F.lit(0), c("ft"), F.lit(size))))
    out = out.withColumn("minute_end", F.least(c("minute_start") + size, c("ft"))).where(c("minute_start") < c("minute_end"))
    a, b = c("minute_start").cast("string"), c("minute_end").cast("string")
    ranges = out.select("matchId", F.concat_ws("-", a, b).alias("value"), F.when(c("minute_start") >= 90, "Stoppage").otherwise(
        F.concat(a, F.lit("'-"), b, F.lit("'"))).alias("label"), "minute_start", "minute_end")
    whole = ft.select("matchId", F.lit("all").alias("value"), F.lit("Full match").alias("label"), F.lit(0).alias("minute_start"),
                      c("ft").alias("minute_end"))
    return whole.unionByName(ranges)
