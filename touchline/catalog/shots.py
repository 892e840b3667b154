"""Shot views: lead-up actions, details, player and team totals."""

from pyspark.sql import functions as F

from touchline.catalog.feed_checks import DENSE
from touchline.catalog.match_state import CLOCK_SQL, STATE_SQL, XT_SQL
from touchline.catalog.registry import fmean_sql, fsum_sql, n_sql, query, ratio_sql
from touchline.functions.core import fixed
from touchline.operators import grids, state
from touchline.plans import shots
from touchline.sources.feed import match_feed

SHOT = "type IN ('Goal','SavedShot','MissedShots','ShotOnPost')"
CREATE = "('Pass','Carry','TakeOn','BallRecovery','Interception','Tackle','Challenge','Aerial','Clearance','BlockedPass')"
PAIRED = "('Aerial','Challenge','Tackle','BallRecovery','Interception','Clearance','BlockedPass')"


def shot_feed(spark, sf_dir):
    ev = state.with_possession(state.with_match_clock(match_feed(spark, sf_dir, pace=4)), score=True)
    return grids.with_xt(ev).withColumn("epv_added", F.lit(None).cast("double"))


SHOT_STATE_SQL = STATE_SQL + CLOCK_SQL + XT_SQL + """,
cs AS (SELECT s.*, ck.c, coalesce(xt.xt, 0) AS xtv FROM st s JOIN ck USING (eventId) LEFT JOIN xt USING (eventId))"""
LEAD_SQL = SHOT_STATE_SQL + f""",
lp AS (SELECT s.eventId AS shot_id, s.playerName AS s_pl, s.possession_id AS s_po, s.type AS s_type, s.x AS s_x, s.y AS s_y, s.c AS s_c, e.*,
   (e.eventId IS NOT DISTINCT FROM s.relatedEventId OR list_contains(e.qualifiers, 'IntentionalGoalAssist')) AND e.playerName <> s.playerName AS direct
   FROM cs s JOIN cs e ON e.matchId = s.matchId AND e.teamName = s.teamName AND e.period = s.period AND e.c < s.c AND s.c - e.c <= 15 WHERE s.{SHOT}),
l1 AS (SELECT *, NOT direct AND possession_id IS NOT DISTINCT FROM s_po AND s_po IS NOT NULL AS own FROM lp WHERE direct OR
   ((type IN {CREATE} AND outcomeType = 'Successful' OR {SHOT}) AND NOT (playerName = s_pl AND type IN {PAIRED} AND s_c - c <= 3))),
l2 AS (SELECT *, bool_or(own) OVER (PARTITION BY shot_id) AS anyown FROM l1),
l3 AS (SELECT *, row_number() OVER (PARTITION BY shot_id, direct ORDER BY "index" DESC) AS n, least(3, count(*) FILTER (WHERE direct) OVER (PARTITION BY shot_id)) AS nd
   FROM l2 WHERE direct OR own OR NOT anyown),
l4 AS (SELECT *, max(CASE WHEN {SHOT} THEN "index" END) OVER (PARTITION BY shot_id) AS reb FROM l3 WHERE CASE WHEN direct THEN n <= 3 ELSE n <= 3 - nd END),
l5 AS (SELECT *, CASE WHEN endX IS NULL THEN x ELSE endX END AS ex, CASE WHEN endY IS NULL THEN y ELSE endY END AS ey FROM l4),
lead_ AS (SELECT matchId, shot_id, eventId, "index", playerName AS player, type, direct AND s_type = 'Goal' AND NOT coalesce("index" < reb, false) AS is_assist, xtv, coalesce(xA,0) AS xa,
  CASE WHEN direct AND abs(ex-x) < 0.01 AND abs(ey-y) < 0.01 THEN s_x ELSE ex END AS end_x, CASE WHEN direct AND abs(ex-x) < 0.01 AND abs(ey-y) < 0.01 THEN s_y ELSE ey END AS end_y FROM l5),
sr AS (SELECT matchId, eventId AS shot_id, "index", "minute", "second", type, situation, CASE WHEN goalOwn THEN concat(playerName, ' (OG)') ELSE playerName END AS player, teamName AS shooting_team,
  CASE WHEN goalOwn THEN opponentName ELSE teamName END AS team, CASE WHEN goalOwn THEN 0 ELSE xG END AS xg, CASE WHEN goalOwn THEN 0 ELSE coalesce(xGOT,0) END AS xgot,
  type IN ('Goal','SavedShot') AS on_target, CASE WHEN goalOwn THEN 105-x ELSE x END AS dx, CASE WHEN goalOwn THEN 68-y ELSE y END AS dy, goalOwn AS own_goal,
  concat(home_score_before,'-',away_score_before) AS score_before, CASE WHEN goalOwn THEN -team_goal_diff_before ELSE team_goal_diff_before END AS goal_diff_before FROM cs WHERE {SHOT}),
srd AS (SELECT *, sqrt((105-dx)*(105-dx)+(34-dy)*(34-dy)) AS dist FROM sr)"""


@query("shot_creating_actions", "J6", DENSE + LEAD_SQL + """
SELECT shot_id, eventId, player, type, is_assist, CAST(floor(xtv*1e6+0.5) AS BIGINT) AS xt_micro, xa AS "xA", end_x, end_y FROM lead_""")
def shot_creating_actions(spark, sf_dir):
    out = shots.shot_leadup(shot_feed(spark, sf_dir))
    return out.select("shot_id", "eventId", "player", "type", "is_assist", fixed(F.col("xT")).alias("xt_micro"), "xA", "end_x", "end_y")


@query("shot_details", "A9 P35", DENSE + LEAD_SQL + """
SELECT shot_id, "minute", "second", type, situation, player, shooting_team, team, xg, xgot, on_target, dx AS x, dy AS y, dist AS shot_distance, own_goal, score_before, goal_diff_before,
 (SELECT string_agg(concat(eventId, ':', is_assist), ',' ORDER BY l."index") FROM lead_ l WHERE l.shot_id = srd.shot_id) AS leadup FROM srd""")
def shot_details(spark, sf_dir):
    out = shots.shot_details(shot_feed(spark, sf_dir))
    lead = F.array_join(F.transform("leadup_events", lambda e: F.concat(e["event_id"].cast("string"), F.lit(":"), e["is_assist"].cast("string"))), ",")
    return out.select("shot_id", "minute", "second", "type", "situation", "player", "shooting_team", "team", "xg", "xgot", "on_target", "x", "y",
                      "shot_distance", "own_goal", "score_before", "goal_diff_before", lead.alias("leadup"))


@query("shot_player_summary", "A10", DENSE + LEAD_SQL + f""",
u AS (SELECT matchId, player AS "playerName", team, "index"*8 AS seq, CASE type WHEN 'Goal' THEN 'g' WHEN 'SavedShot' THEN 't' ELSE 'o' END AS res, xg, xgot, dist, NULL AS cat, 0.0::double AS xtv, 0.0::double AS xa, false AS a FROM srd WHERE NOT own_goal
 UNION ALL SELECT l.matchId, l.player, s.team, s."index"*8+1, NULL, NULL, NULL, NULL, CASE WHEN l.type='Pass' THEN 'p' WHEN l.type='Carry' THEN 'c' WHEN l.type='TakeOn' THEN 'k' WHEN l.{SHOT} THEN 's' ELSE 'd' END, xtv, xa, is_assist FROM lead_ l JOIN srd s USING (shot_id)),
g AS (SELECT matchId, "playerName", min_by(team, seq) AS team, {n_sql("res='g'")} AS goals, {n_sql("res='t'")} AS on_target, {n_sql("res='o'")} AS off_target, CAST(0 AS BIGINT) AS woodwork, CAST(0 AS BIGINT) AS blocked_shots,
 {n_sql('res IS NOT NULL')} AS total_shots, {fsum_sql('xg')} AS total_xg, {fsum_sql('xgot')} AS total_xgot, coalesce({fmean_sql('dist')},0) AS avg_shot_distance, {n_sql('cat IS NOT NULL')} AS sca_count,
 {n_sql("cat='p'")} AS sca_passes, {n_sql("cat='c'")} AS sca_carries, {n_sql("cat='k'")} AS sca_takeons, {n_sql("cat='s'")} AS sca_shots, {n_sql("cat='d'")} AS sca_def_actions,
 {fsum_sql('xtv')} AS sca_xt, {n_sql('a')} AS assists, {fsum_sql('xa')} AS xa FROM u GROUP BY matchId, "playerName")
SELECT *, goals + on_target AS shots_on_target, {ratio_sql('total_xg','total_shots')} AS xg_per_shot, {ratio_sql('total_xgot','total_shots')} AS xgot_per_shot, {ratio_sql('sca_xt','sca_count')} AS xt_per_sca FROM g""")
def shot_player_summary(spark, sf_dir):
    return shots.shot_player_summary(shot_feed(spark, sf_dir))


def totals_sql(where: str) -> str:
    return DENSE + LEAD_SQL + f""",
lg AS (SELECT shot_id, count(*) AS n, {fsum_sql('xtv')} AS xt, {fsum_sql('xa')} AS xa, {n_sql('is_assist')} AS a FROM lead_ GROUP BY shot_id)
SELECT matchId, team, {n_sql('NOT own_goal')} AS shots, {n_sql("type='Goal'")} AS goals, {n_sql('NOT own_goal AND on_target')} AS shots_on_target, {fsum_sql('CASE WHEN NOT own_goal THEN xg END')} AS xg,
 {fsum_sql('CASE WHEN NOT own_goal THEN xgot END')} AS xgot, CAST(coalesce(sum(n),0) AS BIGINT) AS sca, {fsum_sql('xt')} AS sca_xt, CAST(coalesce(sum(a),0) AS BIGINT) AS assists, {fsum_sql('xa')} AS xa
FROM srd LEFT JOIN lg USING (shot_id) {where} GROUP BY matchId, team"""


@query("shot_team_totals", "A11", totals_sql(""))
def shot_team_totals(spark, sf_dir):
    return shots.shot_team_totals(shot_feed(spark, sf_dir))


@query("shot_team_totals_filtered", "A75", totals_sql('WHERE goal_diff_before < 0 AND "minute" >= 5 AND "minute" < 60'))
def shot_team_totals_filtered(spark, sf_dir):
    return shots.shot_team_totals(shot_feed(spark, sf_dir), "trailing", (5, 60))
