"""Season tables over the whole feed."""

import uuid

from pyspark.sql import functions as F

from touchline.catalog.feed_checks import FEED, FEED4
from touchline.catalog.match_state import EPV_SQL, XT_SQL
from touchline.catalog.registry import QUERIES, fmean_sql, fsum_sql, n_sql, pct_sql, query, ratio_sql
from touchline.operators import grids
from touchline.plans import season
from touchline.session import checkpoint_dir
from touchline.sources import store
from touchline.sources.feed import match_feed

PP = "sqrt((105-x)*(105-x)+(34-y)*(34-y)) - sqrt((105-endX)*(105-endX)+(34-endY)*(34-endY))"
BOX_END = "endX >= 88.5 AND endY >= 13.84 AND endY <= 54.16"
BOX_START = "(x >= 88.5 AND y >= 13.84 AND y <= 54.16)"
SHOT = "type IN ('Goal','SavedShot','MissedShots','ShotOnPost')"
OK = "outcomeType = 'Successful'"
MOVE_OK = f"type IN ('Pass','Carry') AND {OK}"


def enriched(spark, sf_dir, teams=4):
    return grids.with_epv(grids.with_xt(match_feed(spark, sf_dir, teams)))


# Feed with values ("ev") for season queries.
ENRICHED_SQL = FEED4 + XT_SQL + EPV_SQL + """,
ev AS (SELECT f.*, coalesce(xt.xt, 0) AS "xT", epv.epv_added FROM feed f LEFT JOIN xt USING (eventId) LEFT JOIN epv USING (eventId))"""

TEAM_SQL = ENRICHED_SQL + f""",
tch AS (SELECT matchId, teamName, count(*) AS possessions FROM (SELECT matchId, teamName, lag(teamName) OVER (PARTITION BY matchId ORDER BY "index") AS pt
   FROM ev WHERE isTouch) WHERE pt IS DISTINCT FROM teamName GROUP BY ALL),
tm0 AS (SELECT league, season, matchId, teamName, min(startDate) AS date, min(opponentName) AS "opponentName", min(h_a) AS "homeAway", count(*) AS n_ev,
  {n_sql("type = 'Goal'")} AS goals_raw, {n_sql("type = 'Goal' AND goalOwn")} AS own, {fsum_sql('xG')} AS "xG", {n_sql(SHOT)} AS shots,
  {n_sql("type IN ('Goal','SavedShot')")} AS shots_on_target, {n_sql("type = 'Pass'")} AS passes, {n_sql("type = 'Pass' AND " + OK)} AS passes_completed,
  {n_sql("type IN ('Tackle','Interception','Challenge','BlockedPass')")} AS press, {n_sql("type = 'Dispossessed'")} AS turnovers,
  {n_sql(SHOT + " AND xG > 0.35")} AS big_chances, {n_sql("list_contains(qualifiers,'Cross')")} AS crosses,
  {n_sql("list_contains(qualifiers,'Throughball')")} AS through_balls, {n_sql("list_contains(qualifiers,'Longball')")} AS long_balls,
  {n_sql("type = 'TakeOn'")} AS dribbles_attempted, {n_sql("type = 'TakeOn' AND " + OK)} AS dribbles_won,
  {n_sql("type = 'Clearance'")} AS clearances, {n_sql("type = 'Foul'")} AS fouls_committed, {n_sql("type = 'Aerial'")} AS aerial_duels_total,
  {n_sql("type = 'Aerial' AND " + OK)} AS aerial_duels_won, {n_sql("cardType IN ('Yellow','SecondYellow')")} AS yellow_cards,
  {n_sql("cardType IN ('Red','SecondYellow')")} AS red_cards, {fsum_sql('xGOT')} AS "xGOT",
  {fsum_sql(f'CASE WHEN {MOVE_OK} THEN greatest("xT", 0) END')} AS "xT", {fsum_sql(f'CASE WHEN {MOVE_OK} THEN coalesce(epv_added, 0) END')} AS epv_added,
  {n_sql("type = 'Pass' AND " + PP + " > 0")} AS prog_passes, {n_sql("type = 'Carry' AND " + PP + " > 0")} AS prog_carries,
  {n_sql(MOVE_OK + " AND NOT " + BOX_START + " AND " + BOX_END)} AS box_entries, {n_sql("isTouch AND x >= 70")} AS tilt,
  {fsum_sql("CASE WHEN type = 'Pass' THEN xPass END")} AS xpass_exp_completed
  FROM ev GROUP BY league, season, matchId, teamName),
tm AS (SELECT a.league, a.season, a.matchId, a.teamName, a.date, a."opponentName", a."homeAway", a.goals_raw, a."xG", a.shots, a.shots_on_target,
  a.passes, a.passes_completed, a.turnovers, a.big_chances, a.crosses, a.through_balls, a.long_balls, a.dribbles_attempted, a.dribbles_won,
  a.clearances, a.fouls_committed, a.aerial_duels_total, a.aerial_duels_won, a.yellow_cards, a.red_cards, a."xGOT", a."xT", a.epv_added,
  a.prog_passes, a.prog_carries, a.box_entries, coalesce(t.possessions, 0) AS possessions, a.xpass_exp_completed,
  a.goals_raw - a.own + b.own AS goals, b.goals_raw AS goals_against_raw, b.goals_raw - b.own + a.own AS goals_against,
  b."xG" AS "xG_against", b."xGOT" AS "xGOT_against", b.shots AS shots_against, b.big_chances AS big_chances_against,
  {pct_sql('a.n_ev', '(a.n_ev + b.n_ev)')} AS possession_pct, {pct_sql('a.tilt', '(a.tilt + b.tilt)')} AS field_tilt_pct,
  {ratio_sql('b.passes', 'greatest(1, a.press)')} AS ppda, {pct_sql('a.passes_completed', 'a.passes')} AS pass_accuracy,
  {ratio_sql('a.shots_on_target', 'greatest(1, a.shots)', 100)} AS shot_accuracy, {ratio_sql('a."xG"', 'greatest(1, a.shots)')} AS "xG_per_shot"
  FROM tm0 a JOIN tm0 b ON a.matchId = b.matchId AND a.teamName <> b.teamName LEFT JOIN tch t ON t.matchId = a.matchId AND t.teamName = a.teamName)"""


@query("team_match_stats", "A1 J18 W10 P6 P11 P19 P46", TEAM_SQL + " SELECT * FROM tm")
def team_match_stats(spark, sf_dir):
    return season.team_match_stats(enriched(spark, sf_dir))


def team_rows(spark, sf_dir):
    """Team rows without the value grids, for queries that do not read them."""
    return season.team_match_stats(match_feed(spark, sf_dir, 4).withColumn("xT", F.lit(None).cast("double"))
                                   .withColumn("epv_added", F.lit(None).cast("double")))


TABLE_SQL = TEAM_SQL + f""",
lt AS (SELECT league, season, teamName, count(*) AS played, {n_sql('goals > goals_against')} AS won, {n_sql('goals = goals_against')} AS drawn,
  {n_sql('goals < goals_against')} AS lost, CAST(sum(goals) AS BIGINT) AS gf, CAST(sum(goals_against) AS BIGINT) AS ga,
  {fsum_sql('"xG"')} AS xg, {fsum_sql('"xG_against"')} AS xga FROM tm GROUP BY ALL),
tab AS (SELECT *, gf - ga AS gd, won*3 + drawn AS pts, round(xg - xga, 6) AS xgd FROM lt)"""


@query("league_table", "A33 W12", TABLE_SQL + """
SELECT *, row_number() OVER (PARTITION BY league, season ORDER BY pts DESC, gd DESC, gf DESC, teamName) AS position FROM tab""")
def league_table(spark, sf_dir):
    return season.league_table(team_rows(spark, sf_dir))


@query("team_form", "A34 W13", TEAM_SQL + """
SELECT league, season, teamName, recency, date, matchId, "opponentName", "homeAway", goals, goals_against, "xG", "xG_against",
 CASE WHEN goals > goals_against THEN 'W' WHEN goals = goals_against THEN 'D' ELSE 'L' END AS result,
 CASE WHEN goals > goals_against THEN 3 WHEN goals = goals_against THEN 1 ELSE 0 END AS points
FROM (SELECT *, row_number() OVER (PARTITION BY league, season, teamName ORDER BY date DESC, matchId DESC) AS recency FROM tm) WHERE recency <= 5""")
def team_form(spark, sf_dir):
    return season.team_form(team_rows(spark, sf_dir))


GROUND = "type IN ('TakeOn','GoodSkill','ShieldBallOpp','Foul','Tackle','Challenge')"
DUEL = f"({GROUND} OR type = 'Aerial')"
DEF = ("type IN ('Aerial','BallRecovery','BlockedPass','Challenge','Clearance','Error','Foul','Interception','Tackle') "
       f"AND (type <> 'Aerial' OR list_contains(qualifiers,'Defensive')) AND {OK}")
LEN = "sqrt((endX-x)*(endX-x)+(endY-y)*(endY-y))"
DONE = f"type = 'Pass' AND {OK}"
_TYPES = {"tackles": "Tackle", "interceptions": "Interception", "clearances": "Clearance", "fouls_committed": "Foul",
          "recoveries": "BallRecovery", "blocked_passes": "BlockedPass", "dribbled_past": "Challenge",
          "aerial_duels_total": "Aerial", "dribbles_attempted": "TakeOn", "carries": "Carry"}
PLAYER_SQL = ENRICHED_SQL + f""",
rcv AS (SELECT matchId, nn AS "playerName", count(*) AS passes_received, {n_sql(PP + ' > 0')} AS prog_passes_received FROM
  (SELECT *, lead(teamName) OVER w AS nt, lead(playerName) OVER w AS nn FROM ev WINDOW w AS (PARTITION BY matchId ORDER BY "index"))
  WHERE {DONE} AND nt = teamName GROUP BY ALL),
pm0 AS (SELECT league, season, matchId, playerName, min(startDate) AS date, min_by(teamName, "index") AS "teamName",
  min("minute" + "second"/60.0::double) AS f_, max("minute" + "second"/60.0::double) AS l_, {n_sql("type = 'Goal'")} AS goals, {fsum_sql('xG')} AS "xG",
  {n_sql(SHOT)} AS shots, {n_sql("type IN ('Goal','SavedShot')")} AS shots_on_target, {n_sql(SHOT + " AND xG > 0.35")} AS big_chances,
  {n_sql("list_contains(qualifiers,'KeyPass')")} AS key_passes, {fsum_sql('xA')} AS "xA", {n_sql("list_contains(qualifiers,'Cross')")} AS crosses,
  {n_sql("list_contains(qualifiers,'Throughball')")} AS through_balls, {n_sql("list_contains(qualifiers,'Longball')")} AS long_balls,
  {n_sql("type = 'Pass' AND " + PP + " > 0")} AS prog_passes, {n_sql("type = 'Carry' AND " + PP + " > 0")} AS prog_carries, {fsum_sql('"xT"')} AS "xT",
  {", ".join(n_sql(f"type = '{t}'") + f" AS {n}" for n, t in _TYPES.items())},
  {n_sql("type = 'Aerial' AND " + OK)} AS aerial_duels_won, {n_sql("type = 'TakeOn' AND " + OK)} AS dribbles_won,
  {n_sql("cardType IN ('Yellow','SecondYellow')")} AS yellow_cards, {n_sql("cardType IN ('Red','SecondYellow')")} AS red_cards,
  {n_sql("type = 'Pass'")} AS passes_attempted, {n_sql(DONE)} AS passes_completed, {fmean_sql(f"CASE WHEN {DONE} THEN {LEN} END")} AS avg_pass_distance,
  {n_sql(DONE + " AND endX > 75")} AS final_third_passes, {n_sql(DONE + " AND endX >= 88.5 AND endY BETWEEN 13.6 AND 54.4")} AS box_passes,
  {n_sql("type = 'Dispossessed'")} AS turnovers, {n_sql(DUEL)} AS duels_total, {n_sql(DUEL + " AND " + OK)} AS duels_won, {n_sql(GROUND)} AS ground_duels,
  {n_sql(DEF)} AS def_actions_total, {n_sql(DEF + " AND x < 35")} AS def_actions_def_third, {n_sql(DEF + " AND x >= 35 AND x < 70")} AS def_actions_mid_third,
  {n_sql(DEF + " AND x >= 70")} AS def_actions_att_third, {fsum_sql('xGOT')} AS "xGOT", {fsum_sql(f'CASE WHEN {MOVE_OK} THEN coalesce(epv_added,0) END')} AS epv_added,
  {n_sql("isTouch")} AS touches, {fsum_sql(f"CASE WHEN NOT ({SHOT} AND list_contains(qualifiers,'Penalty')) THEN xG END")} AS "npxG",
  {fsum_sql("CASE WHEN type = 'Pass' THEN xPass END")} AS xpass_exp_completed FROM ev GROUP BY league, season, matchId, playerName),
pm AS (SELECT p.* EXCLUDE (f_, l_), coalesce(passes_received, 0) AS passes_received, coalesce(prog_passes_received, 0) AS prog_passes_received,
  greatest(1, CAST(round_even(l_ - CASE WHEN f_ < 5 THEN 0 ELSE f_ END, 0) AS BIGINT)) AS mins_played,
  {ratio_sql('shots_on_target', 'greatest(1, shots)', 100)} AS shot_accuracy, {ratio_sql('"xG"', 'greatest(1, shots)')} AS "xG_per_shot",
  {pct_sql('passes_completed', 'passes_attempted')} AS pass_accuracy FROM pm0 p LEFT JOIN rcv USING (matchId, playerName))"""


@query("player_match_stats", "A2 P15 P16 P17", PLAYER_SQL + " SELECT * FROM pm")
def player_match_stats(spark, sf_dir):
    return season.player_match_stats(enriched(spark, sf_dir))


def player_rows(spark, sf_dir):
    return season.player_match_stats(enriched(spark, sf_dir))


KEEP = "type IN ('Save','KeeperSave','KeeperPickup','Claim','Punch','Smother','KeeperSweeper')"
SOT = f"type IN ('Goal','SavedShot') AND NOT goalOwn"


@query("keeper_match_stats", "A3", FEED4 + f""",
kn AS (SELECT matchId, teamName, playerName, row_number() OVER (PARTITION BY matchId, teamName ORDER BY count(*) DESC, playerName) AS rn
  FROM feed WHERE {KEEP} GROUP BY matchId, teamName, playerName),
fc AS (SELECT matchId, opponentName AS tn, {n_sql(SOT)} AS sot, {n_sql("type = 'Goal' AND NOT goalOwn")} AS gc, {fsum_sql(f'CASE WHEN {SOT} THEN xG END')} AS xf,
  {fsum_sql(f'CASE WHEN {SOT} THEN xGOT END')} AS xgf FROM feed GROUP BY ALL),
o AS (SELECT matchId, teamName, playerName, {n_sql("type IN ('Claim','Punch')")} AS gk_claims, {n_sql("type = 'KeeperPickup'")} AS gk_pickups,
  {n_sql("type = 'KeeperSweeper'")} AS gk_sweeper_actions, {n_sql("type = 'Pass'")} AS n_, {n_sql(DONE)} AS ok_, {n_sql("type = 'Pass' AND " + LEN + " >= 32")} AS lg_,
  coalesce({fmean_sql(f"CASE WHEN type = 'Pass' THEN {LEN} END")}, 0) AS gk_avg_pass_length FROM feed GROUP BY ALL)
SELECT kn.matchId, kn.teamName, kn.playerName, gk_claims, gk_pickups, gk_sweeper_actions, gk_avg_pass_length, coalesce(sot,0) AS gk_sot_faced, coalesce(gc,0) AS gk_goals_conceded,
  coalesce(xf,0) AS gk_xg_on_target_faced, coalesce(xgf,0) AS gk_xgot_faced, greatest(0, coalesce(sot-gc,0)) AS gk_saves, {pct_sql('greatest(0, coalesce(sot-gc,0))','coalesce(sot,0)')} AS gk_save_pct,
  coalesce(xgf,0) - coalesce(gc,0) AS gk_goals_prevented, {pct_sql('ok_','n_')} AS gk_pass_completion_pct, {pct_sql('lg_','n_')} AS gk_long_pass_pct
FROM kn JOIN o USING (matchId, teamName, playerName) LEFT JOIN fc ON fc.matchId = kn.matchId AND fc.tn = kn.teamName WHERE rn = 1""")
def keeper_match_stats(spark, sf_dir):
    return season.keeper_match_stats(match_feed(spark, sf_dir, 4))


@query("event_locations", "P41", ENRICHED_SQL + """
SELECT matchId, startDate AS date, league, season, eventId, teamName, playerName, type, outcomeType, isGoal, x, y, coalesce(endX,0) AS "endX", coalesce(endY,0) AS "endY",
 coalesce(xG,0) AS "xG", coalesce(xA,0) AS "xA", floor(coalesce("xT",0)*1e6+0.5) AS xt_micro, array_to_string(qualifiers, ',') AS qualifiers, period, "minute" FROM ev
WHERE type IN ('Goal','SavedShot','MissedShots','ShotOnPost','Pass','Carry','TakeOn','Tackle','Interception','Challenge','Clearance','BallRecovery','BlockedPass','Aerial','Foul')""")
def event_locations(spark, sf_dir):
    out = season.event_locations(grids.with_xt(match_feed(spark, sf_dir, 4)))
    return out.withColumn("xt_micro", F.floor(F.col("xT") * 1e6 + 0.5).cast("double")).withColumn("qualifiers", F.array_join("qualifiers", ",")).drop("xT")


_S = season.LEADER_SUMS
_V = season.LEADER_VALUES
PSEASON_SQL = PLAYER_SQL + f""",
ps0 AS (SELECT league, season, playerName, max_by("teamName", (date, matchId)) AS "teamName", count(*) AS matches, CAST(sum(mins_played) AS BIGINT) AS mins_played,
  {", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in _S)}, {", ".join(fsum_sql(chr(34) + n + chr(34)) + f' AS "{n}"' for n in _V)} FROM pm GROUP BY league, season, playerName),
ps AS (SELECT *, {", ".join(ratio_sql(chr(34) + n + chr(34), "mins_played", 90) + f' AS "{n}_p90"' for n in ("goals", "xG", "xA", "shots", "key_passes"))} FROM ps0)"""


@query("player_leaderboard", "A35 T2 T3", PSEASON_SQL + """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY league, season ORDER BY "xG" DESC, playerName) AS "rank" FROM ps WHERE mins_played >= 90) WHERE "rank" <= 50""")
def player_leaderboard(spark, sf_dir):
    return season.player_leaderboard(player_rows(spark, sf_dir))


@query("season_verification", "A6", PLAYER_SQL + "," + TEAM_SQL[len(ENRICHED_SQL) + 1:] + f""",
ct AS (SELECT league, season, count(*)::double AS r, count(DISTINCT matchId)::double AS m, count(DISTINCT teamName)::double AS t FROM tm GROUP BY ALL),
tt AS (SELECT league, season, teamName AS name, {fsum_sql('"xG"')} AS v FROM tm GROUP BY league, season, teamName),
tp AS (SELECT league, season, playerName AS name, {fsum_sql('"xG"')} AS v FROM pm GROUP BY league, season, playerName)
SELECT league, season, 'count' AS "check", 0 AS "rank", 'rows' AS name, r AS value FROM ct UNION ALL SELECT league, season, 'count', 0, 'matches', m FROM ct
UNION ALL SELECT league, season, 'count', 0, 'teams', t FROM ct
UNION ALL SELECT league, season, 'top_xg_teamName', rk, name, v FROM (SELECT *, row_number() OVER (PARTITION BY league, season ORDER BY v DESC, name) rk FROM tt) WHERE rk <= 5
UNION ALL SELECT league, season, 'top_xg_playerName', rk, name, v FROM (SELECT *, row_number() OVER (PARTITION BY league, season ORDER BY v DESC, name) rk FROM tp) WHERE rk <= 5""")
def season_verification(spark, sf_dir):
    ev = match_feed(spark, sf_dir, 4).withColumn("xT", F.lit(None).cast("double")).withColumn("epv_added", F.lit(None).cast("double"))
    return season.season_verification(season.team_match_stats(ev), season.player_match_stats(ev))


def _counts(name: str, table: str) -> str:
    return f"""SELECT '{table}' AS "table", count(*) AS "rows", count(DISTINCT matchId) AS matches FROM ({QUERIES[name].sql})"""


@query("season_tables_written", "A5 S12 S13", " UNION ALL ".join([
    _counts("team_match_stats", "team_matches"), _counts("player_match_stats", "player_matches"), _counts("keeper_match_stats", "keeper_matches"),
    _counts("event_locations", "event_locations"), """SELECT 'absent', 0, 0"""]))
def season_tables_written(spark, sf_dir):
    """The season tables are written to the shared folder and loaded again, with one that was never written."""
    ev = match_feed(spark, sf_dir, 4).withColumn("xT", F.lit(None).cast("double")).withColumn("epv_added", F.lit(None).cast("double"))
    repeated = ev.unionByName(ev.where(F.col("index") % 7 == 0))
    tables = season.season_tables(repeated)
    root = f"{checkpoint_dir(spark).rstrip('/')}/season-{uuid.uuid4().hex}"
    store.write_season_tables(tables, root, "feed")
    out = None
    for name in [*tables, "absent"]:
        rows = store.read_season_table(spark, root, name, tables.get(name, tables["team_matches"]).schema)
        one = rows.agg(F.count("*").alias("rows"), F.count_distinct("matchId").alias("matches")).select(F.lit(name).alias("table"), "rows", "matches")
        out = one if out is None else out.unionByName(one)
    return out
