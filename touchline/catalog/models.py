"""Feature tables, splits, audits, metrics and prediction comparison."""

import uuid

from pyspark.sql import functions as F

from touchline.catalog.feed_checks import DENSE, FEED
from touchline.catalog.match_state import CARRY_SQL, SCORE_SQL, STATE_SQL
from touchline.catalog.registry import fmean_sql, fsum_sql, n_sql, query, ratio_sql
from touchline.functions.core import fixed, n_if
from touchline.models import evaluate as e, features as f
from touchline.operators import state
from touchline.schema import conform
from touchline.session import checkpoint_dir, materialise
from touchline.sources import store
from touchline.sources.feed import feed_sql, match_feed

MB = "CASE WHEN \"minute\" < 15 THEN '00-15' WHEN \"minute\" < 30 THEN '15-30' WHEN \"minute\" < 45 THEN '30-45' WHEN \"minute\" < 60 THEN '45-60' WHEN \"minute\" < 75 THEN '60-75' WHEN \"minute\" < 90 THEN '75-90' ELSE '90+' END"
SS = "CASE WHEN team_goal_diff_before > 0 THEN 'leading' WHEN team_goal_diff_before < 0 THEN 'trailing' ELSE 'level' END"
SD = "sqrt((105-x)*(105-x)+(34-y)*(34-y))"
FAM = "CASE WHEN situation='Penalty' THEN 'penalty' WHEN situation='DirectFreekick' THEN 'direct_free_kick' WHEN list_contains(qualifiers,'Head') THEN 'header' WHEN situation='OpenPlay' THEN 'open_play_foot' WHEN situation IN ('SetPiece','FromCorner') THEN 'other_set_piece' ELSE 'other' END"
SHOT_SQL = SCORE_SQL + f""",
a AS (SELECT *, "minute"*60+"second" AS t, CASE WHEN type <> 'Card' THEN "index" END AS ai FROM gamestate),
b AS (SELECT *, max(ai) OVER (PARTITION BY matchId ORDER BY "index" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pi FROM a),
sf AS (SELECT s.matchId, s.eventId, s.h_a, s.type, s."minute", CASE WHEN s.type='Goal' THEN 1 ELSE 0 END AS "isGoal", s.x, s.y, s.xG, s.goalMouthY AS goal_mouth_y, s.goalMouthZ AS goal_mouth_z, s.goalOwn, s.qualifiers, s."expandedMinute", sqrt((105-s.x)*(105-s.x)+(34-s.y)*(34-s.y)) AS shot_distance,
  CASE WHEN s.x >= 99 AND s.y BETWEEN 24.84 AND 43.16 THEN 'six_yard_box' WHEN s.x >= 88.5 AND s.y BETWEEN 13.84 AND 54.16 THEN 'penalty_area' WHEN s.x >= 88.5 THEN 'wide_box_channel' WHEN s.x >= 70 THEN 'outside_box_final_third' ELSE 'deep_shot' END AS shot_zone,
  {MB.replace('"minute"','s."minute"')} AS minute_bucket, {SS.replace('team_goal','s.team_goal')} AS score_state, {FAM.replace('situation','s.situation').replace('qualifiers','s.qualifiers')} AS shot_family,
  p.eventId AS pid, s.t - p.t AS age, p.type AS p_type, p.teamId = s.teamId AS p_same, p.outcomeType = 'Successful' AS p_ok, p.qualifiers AS pq, p.endX AS pex, p.endY AS pey, p.x AS px, p.y AS py
  FROM b s LEFT JOIN a p ON p.matchId = s.matchId AND p."index" = s.pi AND s.t - p.t <= 20 WHERE s."isShot"),
sg AS (SELECT *, CASE WHEN pid IS NULL THEN 'none' WHEN p_type='Carry' THEN 'carry' WHEN list_contains(pq,'Cross') THEN 'cross' WHEN list_contains(pq,'Throughball') THEN 'through_ball' WHEN list_has_any(pq,['CornerTaken','FromCorner']) THEN 'corner' WHEN list_has_any(pq,['FreekickTaken','DirectFreekick']) THEN 'free_kick'
   WHEN list_contains(pq,'Longball') THEN 'long_ball' WHEN p_type IN ('TakeOn','Challenge') THEN 'takeon' WHEN p_type IN ('BallRecovery','Interception') THEN 'recovery' WHEN p_type IN ('Aerial','Tackle') THEN 'duel' ELSE lower(p_type) END AS prev_action_subtype FROM sf)"""


def scored(spark, sf_dir, pace=4):
    return state.with_score(match_feed(spark, sf_dir, pace=pace))


SHOT_COLS = ["matchId", "eventId", "h_a", "isGoal", "shot_zone", "minute_bucket", "score_state", "shot_family", "prev_action_subtype", "prev_action_type", "prev_time_delta", "prev_action_same_team",
             "prev_action_success", "prev_action_into_box", "prev_action_distance", "shot_after_cross", "shot_angle_micro", "shot_distance", "prev_action_outcome", "is_counter",
             "is_direct_corner", "expanded_minute"]


@query("shot_features", "M1 P28 P31 P32 P34", DENSE + SHOT_SQL + f"""
SELECT matchId, eventId, h_a, "isGoal", shot_zone, minute_bucket, score_state, shot_family, prev_action_subtype, coalesce(p_type,'none') AS prev_action_type, coalesce(age,99)::double AS prev_time_delta, coalesce(p_same,false)::int AS prev_action_same_team,
 coalesce(p_ok,false)::int AS prev_action_success, coalesce(pex >= 88.5 AND pey BETWEEN 13.84 AND 54.16,false)::int AS prev_action_into_box, CASE WHEN pex IS NOT NULL THEN sqrt((pex-px)*(pex-px)+(pey-py)*(pey-py)) ELSE 0 END AS prev_action_distance,
 (prev_action_subtype='cross')::int AS shot_after_cross, shot_distance, CASE WHEN coalesce(p_ok,false) THEN 'successful' ELSE 'unsuccessful' END AS prev_action_outcome,
 list_contains(qualifiers, 'ShotCounter')::int AS is_counter, list_contains(qualifiers, 'ShotDirectCorner')::int AS is_direct_corner, "expandedMinute" AS expanded_minute,
 CAST(floor(acos(greatest(-1, least(1, ((105-x)*(105-x)+(34-3.66::double-y)*(34-3.66::double-y) + (105-x)*(105-x)+(34+3.66::double-y)*(34+3.66::double-y) - 7.32::double*7.32::double) / nullif(2*sqrt((105-x)*(105-x)+(34-3.66::double-y)*(34-3.66::double-y))*sqrt((105-x)*(105-x)+(34+3.66::double-y)*(34+3.66::double-y)),0))))*1e6+0.5) AS BIGINT) AS shot_angle_micro FROM sg""")
def shot_features(spark, sf_dir):
    out = f.shot_features(scored(spark, sf_dir))
    return out.withColumn("shot_angle_micro", fixed(F.col("shot_angle"))).select(*SHOT_COLS)


GZ = "CASE WHEN goal_mouth_z IS NULL THEN 'unknown' ELSE concat(CASE WHEN goal_mouth_z < 2.44::double/3 THEN 'low' WHEN goal_mouth_z < 2.44::double*2/3 THEN 'mid' ELSE 'high' END, '_', CASE WHEN goal_mouth_y < 34-7.32::double/6 THEN 'left' WHEN goal_mouth_y > 34+7.32::double/6 THEN 'right' ELSE 'center' END) END"


@query("xgot_features", "M2 P28 P54", DENSE + SHOT_SQL + f"""
SELECT eventId, type IN ('Goal','SavedShot') AS xgot_training_eligible, NOT (type IN ('Goal','SavedShot')) AS xgot_zero_value, {GZ} AS goal_mouth_zone, abs(goal_mouth_y-34) AS goal_mouth_y_centered, least(abs(goal_mouth_y-30.34::double), abs(goal_mouth_y-37.66::double)) AS goal_mouth_distance_to_nearest_post,
 abs(2.44::double-goal_mouth_z) AS goal_mouth_distance_to_crossbar, sqrt((goal_mouth_y-34)*(goal_mouth_y-34)+((goal_mouth_z-1.22::double)/4)*((goal_mouth_z-1.22::double)/4)) AS goal_mouth_distance_to_center FROM sg""")
def xgot_features(spark, sf_dir):
    out = f.xgot_features(f.shot_features(scored(spark, sf_dir)))
    return out.select("eventId", "xgot_training_eligible", "xgot_zero_value", "goal_mouth_zone", "goal_mouth_y_centered", "goal_mouth_distance_to_nearest_post",
                      "goal_mouth_distance_to_crossbar", "goal_mouth_distance_to_center")


PT = "CASE WHEN list_contains(qualifiers,'Throughball') THEN 'through_ball' WHEN list_contains(qualifiers,'Cross') THEN 'cross' WHEN list_contains(qualifiers,'Longball') THEN 'long_ball' WHEN list_contains(qualifiers,'Chipped') THEN 'chipped' WHEN list_contains(qualifiers,'HeadPass') THEN 'headed' ELSE 'ground_pass' END"
PP = "CASE WHEN list_contains(qualifiers,'CornerTaken') THEN 'corner' WHEN list_contains(qualifiers,'FreekickTaken') THEN 'free_kick' WHEN list_contains(qualifiers,'ThrowIn') THEN 'throw_in' ELSE 'open_play' END"
DIR = "CASE WHEN endX-x > 5 THEN 'forward' WHEN endX-x < -5 THEN 'backward' ELSE 'sideways' END"
LAN = lambda y: f"CASE WHEN {y} < 68.0::double/3 THEN 'left' WHEN {y} < 136.0::double/3 THEN 'center' ELSE 'right' END"
TH = lambda x: f"CASE WHEN {x} < 35 THEN 'defensive' WHEN {x} < 70 THEN 'middle' ELSE 'attacking' END"
PDIST = "sqrt((endX-x)*(endX-x)+(endY-y)*(endY-y))"
BOXE = "(endX >= 88.5 AND endY BETWEEN 13.84 AND 54.16)"


@query("assist_features", "M3 J4 P30", FEED + SCORE_SQL + f""",
lk AS (SELECT matchId, relatedEventId AS id, max_by(eventId, "index") AS tid, max_by(xG, "index") AS txg, max_by(isGoal::int, "index") AS tg FROM feed WHERE "isShot" AND relatedEventId IS NOT NULL GROUP BY ALL)
SELECT g.eventId, {PT} AS pass_type, {PP} AS play_pattern, {DIR} AS pass_direction, {LAN('y')} AS start_lane, {LAN('endY')} AS end_lane, {TH('x')} AS start_third, {PDIST} AS pass_distance, {SS} AS score_state, (x < 70 AND endX >= 70)::int AS enters_final_third,
 {BOXE}::int AS ends_in_penalty_area, (NOT (x >= 88.5 AND y BETWEEN 13.84 AND 54.16) AND {BOXE})::int AS enters_penalty_area, (x >= 88.5 AND (y BETWEEN 0 AND 16 OR y BETWEEN 52 AND 68) AND endX < x AND endY BETWEEN 20 AND 48)::int AS is_cutback_proxy,
 list_contains(qualifiers,'IntentionalGoalAssist')::int AS xa_target_assist, list_contains(qualifiers,'KeyPass')::int AS xa_is_direct_shot_assist, tid AS xa_target_event_id, txg AS xa_target_xg, tg AS xa_target_is_goal, CASE WHEN tid IS NULL THEN '' ELSE 'relatedEventId' END AS xa_link_method
FROM gamestate g LEFT JOIN lk ON lk.matchId=g.matchId AND lk.id=g.eventId WHERE type='Pass' AND outcomeType='Successful'""")
def assist_features(spark, sf_dir):
    out = f.assist_features(state.with_score(match_feed(spark, sf_dir)))
    return out.select("eventId", "pass_type", "play_pattern", "pass_direction", "start_lane", "end_lane", "start_third", "pass_distance", "score_state", "enters_final_third",
                      "ends_in_penalty_area", "enters_penalty_area", "is_cutback_proxy", "xa_target_assist", "xa_is_direct_shot_assist", "xa_target_event_id", "xa_target_xg",
                      "xa_target_is_goal", "xa_link_method")


COMPL_SQL = STATE_SQL + f""",
pv AS (SELECT *, lag(type) OVER w AS pt, lag(teamId) OVER w AS ptm, lag(playerId) OVER w AS pp, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(endX) OVER w AS pex, lag(endY) OVER w AS pey,
  CAST(sum((type='Pass')::int) OVER (PARTITION BY matchId, possession_id ORDER BY "index") AS BIGINT) AS cnt FROM st WINDOW w AS (PARTITION BY matchId ORDER BY "index")),
cf AS (SELECT *, (outcomeType='Successful')::int AS xpass_completed, {PT} AS pass_type, {PP} AS play_pattern, {DIR} AS pass_direction, {PDIST} AS pass_distance FROM pv WHERE type='Pass')"""


def completion(spark, sf_dir):
    return f.completion_features(state.with_possession(match_feed(spark, sf_dir), score=True))


@query("completion_features", "M4 W4 W5", FEED + COMPL_SQL + f"""
SELECT eventId, pass_type, play_pattern, coalesce(pt,'none') AS previous_action_type, coalesce(ptm=teamId,false)::int AS previous_action_team_same, CASE WHEN pt='Pass' THEN sqrt((pex-px)*(pex-px)+(pey-py)*(pey-py)) ELSE 0 END AS previous_pass_distance,
 CASE WHEN pt='Carry' AND pp=playerId THEN sqrt((pex-px)*(pex-px)+(pey-py)*(pey-py)) ELSE 0 END AS carry_distance_before_pass, cnt AS pass_count_in_possession, (pass_distance >= 30 AND ((y < 68.0::double/3 AND endY > 136.0::double/3) OR (y > 136.0::double/3 AND endY < 68.0::double/3)))::int AS is_switch, {SS} AS score_state, xpass_completed FROM cf""")
def completion_features(spark, sf_dir):
    return completion(spark, sf_dir).select("eventId", "pass_type", "play_pattern", "previous_action_type", "previous_action_team_same", "previous_pass_distance", "carry_distance_before_pass",
                                            "pass_count_in_possession", "is_switch", "score_state", "xpass_completed")


@query("training_row_counts", "P45 M5", DENSE + SHOT_SQL + f"""
SELECT {n_sql("shot_family <> 'penalty' AND x >= 52.5 AND shot_distance <= 60")} AS xg_rows, {n_sql("type IN ('Goal','SavedShot')")} AS xgot_rows,
 (SELECT count(*) FROM feed WHERE type='Pass' AND outcomeType='Successful' AND {PDIST} BETWEEN 0.1 AND 105) AS xa_rows, (SELECT count(*) FROM feed WHERE type='Pass' AND {PDIST} BETWEEN 0.1 AND 105) AS xpass_rows FROM sg""")
def training_row_counts(spark, sf_dir):
    ev = scored(spark, sf_dir)
    shots = f.xgot_features(f.shot_features(ev))
    kinds = (f.shot_training_rows(shots).select(F.lit("xg_rows").alias("k"))
             .unionByName(f.xgot_training_rows(shots).select(F.lit("xgot_rows").alias("k")))
             .unionByName(f.pass_training_rows(f.pass_geometry(ev.where("type = 'Pass'"))).select(
                 F.explode(F.array_compact(F.array(F.lit("xpass_rows"), F.when(F.col("outcomeType") == "Successful", "xa_rows")))).alias("k"))))
    return kinds.agg(*[n_if(F.col("k") == n).alias(n) for n in ("xg_rows", "xgot_rows", "xa_rows", "xpass_rows")])


@query("time_split", "W20", FEED + """,
m AS (SELECT DISTINCT matchId, startDate FROM feed), r AS (SELECT *, row_number() OVER (ORDER BY startDate, matchId) AS k, count(*) OVER () AS n FROM m)
SELECT matchId, startDate, CASE WHEN k <= greatest(1, floor(n*0.7)) THEN 'train' WHEN k <= greatest(greatest(1, floor(n*0.7))+1, floor(n*0.85)) THEN 'calibrate' ELSE 'test' END AS part FROM r""")
def time_split(spark, sf_dir):
    return f.time_split(match_feed(spark, sf_dir))


def xpass_rows(spark, sf_dir):
    ev = match_feed(spark, sf_dir).where("type = 'Pass'")
    return ev.withColumn("y", (F.col("outcomeType") == "Successful").cast("int"))


_Q = "greatest(1e-8, least(1-1e-8, xPass))"


@query("model_metrics", "A51", FEED + f""",
r AS (SELECT (outcomeType='Successful')::int AS y, {_Q} AS q, xPass AS b, least(14, floor({_Q}*15)) AS e FROM feed WHERE type='Pass'),
ba AS (SELECT count(*) AS "rows", CAST(sum(y) AS BIGINT) AS positives, {fsum_sql('q')} AS expected, {fsum_sql('-(y*ln(q)+(1-y)*ln(1-q))')}/count(*) AS log_loss, {fsum_sql('(q-y)*(q-y)')}/count(*) AS brier FROM r),
eb AS (SELECT e, count(*) AS n, sum(y) AS sy, {fsum_sql('q')} AS sq FROM r GROUP BY e), ec AS (SELECT {fsum_sql('abs(sy-sq)')}/sum(n) AS calibration_error FROM eb),
au AS (SELECT sum(CASE WHEN p.b > n.b THEN 2*p.c*n.c WHEN p.b = n.b THEN p.c*n.c ELSE 0 END)::double/(2*(SELECT sum(y) FROM r)*(SELECT sum(1-y) FROM r)) AS roc_auc FROM (SELECT b, sum(y) AS c FROM r GROUP BY b) p CROSS JOIN (SELECT b, sum(1-y) AS c FROM r GROUP BY b) n),
h AS (SELECT b, sum(y) AS p, count(*) AS k FROM r GROUP BY b), h2 AS (SELECT p, sum(p) OVER (ORDER BY b DESC) AS tp, sum(k) OVER (ORDER BY b DESC) AS al FROM h), ap AS (SELECT {fsum_sql('p*tp/al::double')}/sum(p) AS average_precision FROM h2)
SELECT ba.*, calibration_error, roc_auc, average_precision, positives - expected AS over_expected FROM ba, ec, au, ap""")
def model_metrics(spark, sf_dir):
    return e.model_metrics(xpass_rows(spark, sf_dir), "y", "xPass")


@query("calibration_buckets", "A51", FEED + f"""
SELECT CAST(least(9, floor(xPass*10)) AS INT) AS bucket, count(*) AS "rows", {fsum_sql('xPass')}/count(*) AS predicted, {ratio_sql("sum((outcomeType='Successful')::int)",'count(*)')} AS actual FROM feed WHERE type='Pass' GROUP BY bucket""")
def calibration_buckets(spark, sf_dir):
    return e.calibration_buckets(xpass_rows(spark, sf_dir), "y", "xPass")


@query("group_over_expected", "A52", FEED + f""",
l AS (SELECT (outcomeType='Successful')::int AS y, xPass AS q, 'period' AS "column", period AS value FROM feed WHERE type='Pass' UNION ALL SELECT (outcomeType='Successful')::int, xPass, 'h_a', h_a FROM feed WHERE type='Pass' UNION ALL SELECT (outcomeType='Successful')::int, xPass, 'teamName', teamName FROM feed WHERE type='Pass')
SELECT "column", value, count(*) AS attempts, CAST(sum(y) AS BIGINT) AS successes, {fsum_sql('q')} AS expected, sum(y) - {fsum_sql('q')} AS over_expected FROM l GROUP BY "column", value""")
def group_over_expected(spark, sf_dir):
    return e.group_over_expected(xpass_rows(spark, sf_dir), "y", "xPass", ["period", "h_a", "teamName"])


@query("player_over_expected", "A52 A73 T2", FEED + f""",
g AS (SELECT playerName, count(*) AS attempts, CAST(sum((outcomeType='Successful')::int) AS BIGINT) AS successes, {fsum_sql('xPass')} AS expected FROM feed WHERE type='Pass' GROUP BY playerName HAVING count(*) >= 20),
h AS (SELECT *, successes-expected AS over_expected, (successes-expected)*100/attempts AS per_100 FROM g)
SELECT * FROM (SELECT *, 'top' AS side FROM h ORDER BY per_100 DESC, playerName LIMIT 25) UNION ALL SELECT * FROM (SELECT *, 'bottom' AS side FROM h ORDER BY per_100, playerName LIMIT 25)""")
def player_over_expected(spark, sf_dir):
    return e.player_over_expected(xpass_rows(spark, sf_dir), "y", "xPass", 20)


@query("extreme_examples", "A52", FEED + """
SELECT * FROM (SELECT eventId, playerName, xPass AS "xPass", 'hardest_success' AS kind FROM feed WHERE type='Pass' AND outcomeType='Successful' ORDER BY xPass, eventId LIMIT 30)
UNION ALL SELECT * FROM (SELECT eventId, playerName, xPass, 'easiest_failure' FROM feed WHERE type='Pass' AND outcomeType<>'Successful' ORDER BY xPass DESC, eventId LIMIT 30)""")
def extreme_examples(spark, sf_dir):
    return e.extreme_examples(xpass_rows(spark, sf_dir), "y", "xPass").select("eventId", "playerName", "xPass", "kind")


def predictions(spark, sf_dir):
    """New predictions of the passes, every tenth event given twice; the first of a pair counts."""
    ev = match_feed(spark, sf_dir).where("type = 'Pass' and eventId % 50 <> 3")
    first = ev.select("matchId", "teamId", "eventId", F.lit(0).alias("seq"), ((F.col("v100") * 7 % 100) / F.lit(100.0)).alias("xPass"))
    again = ev.where("eventId % 10 = 0").select("matchId", "teamId", "eventId", F.lit(1).alias("seq"), F.lit(0.99).alias("xPass"))
    return first.unionByName(again)


NEW_SQL = """, nw AS (SELECT eventId, (v100*7 % 100)/100.0::double AS nx FROM feed WHERE type='Pass' AND eventId % 50 <> 3)"""
_CMP = f"""count(*) AS "rows", {n_sql("outcomeType='Successful'")} AS positives, {fsum_sql('xPass')} AS old_total, {fsum_sql('coalesce(nx,0)')} AS new_total, {fsum_sql('coalesce(nx,0)-xPass')} AS delta, {n_sql('xPass IS NULL')} AS old_missing, {n_sql('nx IS NULL')} AS new_missing, {n_sql('abs(coalesce(nx,0)-xPass) > 1e-9')} AS changed_rows"""


@query("prediction_diff_by_team", "J30 M13", FEED + NEW_SQL + f""", g AS (SELECT matchId, teamName, {_CMP} FROM feed LEFT JOIN nw USING (eventId) WHERE type='Pass' GROUP BY matchId, teamName) SELECT *, positives-new_total AS above_expected FROM g""")
def prediction_diff_by_team(spark, sf_dir):
    ev = match_feed(spark, sf_dir).where("type = 'Pass'")
    return e.compare_predictions(ev, predictions(spark, sf_dir), "xPass", F.col("outcomeType") == "Successful", ["matchId", "teamName"])


@query("backfill_report_by_league", "A46 S21", FEED + NEW_SQL + f""", g AS (SELECT league, matchId, {_CMP} FROM feed LEFT JOIN nw USING (eventId) WHERE type='Pass' GROUP BY league, matchId)
SELECT league, count(*) AS files, CAST(sum("rows") AS BIGINT) AS "rows", CAST(sum(new_missing) AS BIGINT) AS new_missing, CAST(sum(changed_rows) AS BIGINT) AS changed_rows, {fsum_sql('old_total')} AS old_total, {fsum_sql('new_total')} AS new_total, {fsum_sql('delta')} AS delta FROM g GROUP BY league""")
def backfill_report_by_league(spark, sf_dir):
    ev = match_feed(spark, sf_dir)
    per = e.compare_predictions(ev.where("type = 'Pass'"), predictions(spark, sf_dir), "xPass", F.col("outcomeType") == "Successful", ["matchId"])
    return e.backfill_report(per, ev)


@query("prediction_write_back", "J3 M10 M12", FEED + NEW_SQL + """
SELECT eventId, CASE WHEN nx IS NOT NULL AND eventId % 3 <> 0 THEN greatest(0, least(1, nx)) ELSE xPass END AS "xPass", CASE WHEN nx IS NOT NULL AND eventId % 3 <> 0 THEN 'v2' WHEN eventId % 3 = 0 THEN 'v2' ELSE 'v1' END AS xpass_model_version FROM feed LEFT JOIN nw USING (eventId) WHERE type='Pass'""")
def prediction_write_back(spark, sf_dir):
    ev = match_feed(spark, sf_dir).where("type = 'Pass'").withColumn("xpass_model_version", F.when(F.col("eventId") % 3 == 0, "v2").otherwise("v1"))
    new = e.apply_pass_rules(predictions(spark, sf_dir), "xPass", "xPass")
    return e.write_back(ev, new, "xPass", "xpass_model_version", "v2").select("eventId", "xPass", "xpass_model_version")


@query("backfill_completeness", "A45 M12", FEED + f""",
g AS (SELECT matchId, {n_sql("type='Pass'")} AS eligible, {n_sql("type='Pass' AND xPass IS NOT NULL")} AS scored, max(CASE WHEN type='Pass' AND CAST(matchId AS BIGINT) % 2 = 0 THEN 'v2' END) AS version, {n_sql("type='Pass' AND CAST(matchId AS BIGINT) % 2 <> 0")} AS unversioned FROM feed GROUP BY matchId)
SELECT *, eligible > 0 AND eligible = scored AND unversioned = 0 AS complete FROM g""")
def backfill_completeness(spark, sf_dir):
    ev = match_feed(spark, sf_dir).withColumn("ver", F.when(F.col("matchId").cast("bigint") % 2 == 0, "v2"))
    return e.completeness(ev, "xPass", "ver", F.col("type") == "Pass")


@query("training_audit", "A47", FEED + f""",
r AS (SELECT *, (outcomeType='Successful')::int AS yy FROM feed WHERE type='Pass')
SELECT 'period' AS "check", period AS value, count(*) AS "rows", CAST(sum(yy) AS BIGINT) AS positives FROM r GROUP BY period UNION ALL SELECT 'h_a', h_a, count(*), CAST(sum(yy) AS BIGINT) FROM r GROUP BY h_a
UNION ALL SELECT 'impossible_coordinates', NULL, {n_sql('NOT (x BETWEEN 0 AND 105 AND y BETWEEN 0 AND 68)')}, CAST(coalesce(sum(yy) FILTER (WHERE NOT (x BETWEEN 0 AND 105 AND y BETWEEN 0 AND 68)),0) AS BIGINT) FROM r UNION ALL SELECT 'duplicate_ids', NULL, 0, 0""")
def training_audit(spark, sf_dir):
    rows = match_feed(spark, sf_dir).where("type = 'Pass'").withColumn("yy", (F.col("outcomeType") == "Successful").cast("int"))
    return e.training_audit(rows, ["period", "h_a"], "yy")


@query("numeric_summary", "A47", FEED + "\n" + " UNION ALL ".join(f"""SELECT '{n}' AS "column", count("{n}") AS n, {fmean_sql(f'"{n}"::double')} AS mean, min("{n}")::double AS "min", max("{n}")::double AS "max" FROM feed WHERE type='Pass'""" for n in ("x", "y", "endX", "minute")))
def numeric_summary(spark, sf_dir):
    return e.numeric_summary(match_feed(spark, sf_dir).where("type = 'Pass'"), ["x", "y", "endX", "minute"])


@query("shot_value_rules", "M10", DENSE + SHOT_SQL + """
SELECT eventId, CASE WHEN goalOwn THEN 0 WHEN shot_family='penalty' THEN 0.78 ELSE greatest(0.003::double, least(0.95::double, xG)) END AS "xG", CASE WHEN type IN ('Goal','SavedShot') THEN greatest(0.001::double, least(0.995::double, xG)) ELSE 0 END AS "xGOT" FROM sg""")
def shot_value_rules(spark, sf_dir):
    ev = scored(spark, sf_dir)
    rows = f.xgot_features(f.shot_features(ev)).withColumn("raw", F.col("xG"))
    return e.apply_xgot_rules(e.apply_shot_rules(rows, "raw"), "raw").select("eventId", "xG", "xGOT")


def model_rows(spark, sf_dir, name):
    """Training rows of one model: its feature table over the feed, split by match time and dealt to folds."""
    from touchline.models import training as t
    ev = scored(spark, sf_dir)
    tables = {"xG": lambda: f.shot_features(ev), "xGOT": lambda: f.xgot_features(f.shot_features(ev)), "xA": lambda: f.assist_features(ev),
              "xPass": lambda: completion(spark, sf_dir)}
    return t.training_rows(tables[name](), f.time_split(match_feed(spark, sf_dir)), t.SPECS[name])


def model_store(spark):
    from touchline.models.artifacts import ModelStore
    return ModelStore(spark, f"{checkpoint_dir(spark).rstrip('/')}/models-{uuid.uuid4().hex}")


def ranking(spark, sf_dir, name, minimum=20):
    """Candidates of a model ranked on the test matches; the best one is saved, loaded and scored again."""
    from touchline.models import training as t
    rows = model_rows(spark, sf_dir, name)
    table, fitted = t.train_ranked(rows, t.SPECS[name], minimum=minimum)
    best = table.first()["model"]
    store = model_store(spark)
    store.save(fitted[best], "v1")
    test = rows.where("part = 'test'")
    again = store.load(name, "v1").score(fitted[best].score(test, "_first"), "_again")
    off = again.agg(F.coalesce(F.max(F.abs(F.col("_first") - F.col("_again"))), F.lit(0.0))).first()[0]
    return table.withColumn("selected", F.col("model") == best).withColumn("reload_difference", F.lit(float(off)))


@query("shot_model_ranking", "M6 M7 M8 M9")
def shot_model_ranking(spark, sf_dir):
    return ranking(spark, sf_dir, "xG")


@query("placement_model_ranking", "M6 M7 M8 M9")
def placement_model_ranking(spark, sf_dir):
    return ranking(spark, sf_dir, "xGOT")


@query("assist_model_ranking", "M6 M7 M8 M9")
def assist_model_ranking(spark, sf_dir):
    return ranking(spark, sf_dir, "xA")


@query("completion_model_ranking", "M6 M7 M8 M9")
def completion_model_ranking(spark, sf_dir):
    return ranking(spark, sf_dir, "xPass")


SPLIT_SQL = """,
sm AS (SELECT DISTINCT matchId, startDate FROM feed), sr AS (SELECT *, row_number() OVER (ORDER BY startDate, matchId) AS k, count(*) OVER () AS n FROM sm),
split AS (SELECT matchId, CASE WHEN k <= greatest(1, floor(n*0.7)) THEN 'train' WHEN k <= greatest(greatest(1, floor(n*0.7))+1, floor(n*0.85)) THEN 'calibrate' ELSE 'test' END AS part,
    (('0x' || substr(md5(matchId), 1, 8))::BIGINT % 3)::INT AS fold FROM sr)"""
_XG_ROWS = "shot_family <> 'penalty' AND x >= 52.5 AND shot_distance <= 60 AND NOT goalOwn"


@query("cross_fitted_scores", "M8", DENSE + SHOT_SQL + SPLIT_SQL + f"""
SELECT matchId, eventId, fold, "isGoal"::INT AS goal, false AS seen, true AS in_range, 3 AS members, 3 AS curves FROM sg JOIN split USING (matchId) WHERE {_XG_ROWS} AND part <> 'test'""")
def cross_fitted_scores(spark, sf_dir):
    """Each training shot scored by the member of its fold: whether that member's training rows held its match, and how many members
    and different curves there are."""
    from touchline.models import training as t
    spec = t.SPECS["xG"]
    rows = model_rows(spark, sf_dir, "xG").where("part <> 'test'")
    members = t.fold_members(rows, spec, "logistic", 20)
    seen = rows.select(F.explode(F.array_except(F.array(*[F.lit(k) for k in range(t.FOLDS)]), F.array("fold"))).alias("fold"), "matchId").distinct().withColumn("_seen", F.lit(True))
    out = t.out_of_fold(rows, members).join(seen, ["fold", "matchId"], "left")
    return out.select("matchId", "eventId", "fold", F.col("label").cast("int").alias("goal"), F.coalesce("_seen", F.lit(False)).alias("seen"),
                      ((F.col("score") > 0) & (F.col("score") < 1)).alias("in_range"), F.lit(len(members)).alias("members"),
                      F.lit(len({(m.slope, m.shift) for m in members})).alias("curves"))


@query("training_tables", "M5 M9", FEED + SPLIT_SQL + f""",
r AS (SELECT 'xPass' AS model, part, fold, (outcomeType = 'Successful')::INT AS y FROM feed JOIN split USING (matchId) WHERE type = 'Pass' AND {PDIST} BETWEEN 0.1 AND 105
    UNION ALL SELECT 'xA', part, fold, list_contains(qualifiers, 'IntentionalGoalAssist')::INT FROM feed JOIN split USING (matchId) WHERE type = 'Pass' AND outcomeType = 'Successful' AND {PDIST} BETWEEN 0.1 AND 105
    UNION ALL SELECT 'xGOT', part, fold, (type = 'Goal')::INT FROM feed JOIN split USING (matchId) WHERE type IN ('Goal', 'SavedShot') AND NOT goalOwn
    UNION ALL SELECT 'xG', part, fold, (type = 'Goal')::INT FROM feed JOIN split USING (matchId) WHERE isShot AND situation <> 'Penalty' AND NOT goalOwn AND x >= 52.5 AND sqrt((105-x)*(105-x)+(34-y)*(34-y)) <= 60)
SELECT model, part, fold, count(*) AS "rows", sum(y)::BIGINT AS positives FROM r GROUP BY ALL""")
def training_tables(spark, sf_dir):
    """The four training tables as they are written for fitting: rows and positives by part and fold."""
    out = None
    for name in ("xG", "xGOT", "xA", "xPass"):
        one = model_rows(spark, sf_dir, name).groupBy(F.lit(name).alias("model"), "part", "fold").agg(
            F.count("*").alias("rows"), F.sum("label").cast("bigint").alias("positives"))
        out = one if out is None else out.unionByName(one)
    return out


@query("scored_events", "M10 M11", DENSE + SHOT_SQL + """,
s AS (SELECT eventId, goalOwn AS own, shot_family = 'penalty' AS pen, type IN ('Goal', 'SavedShot') AS target FROM sg)
SELECT f.eventId, CASE WHEN own THEN 0.0::DOUBLE WHEN pen THEN 0.78::DOUBLE END AS fixed_xg, CASE WHEN NOT own AND NOT pen THEN true END AS xg_in_range,
    CASE WHEN own OR NOT target THEN 0.0::DOUBLE END AS fixed_xgot, CASE WHEN target AND NOT own THEN true END AS xgot_in_range,
    CASE WHEN f.type = 'Pass' AND f.outcomeType = 'Successful' THEN true END AS xa_in_range, CASE WHEN f.type = 'Pass' THEN true END AS xpass_in_range,
    CASE WHEN s.eventId IS NOT NULL THEN 'v1' END AS xg_model_version, CASE WHEN s.eventId IS NOT NULL THEN 'v1' END AS xgot_model_version,
    CASE WHEN f.type = 'Pass' AND f.outcomeType = 'Successful' THEN 'v1' END AS xa_model_version, CASE WHEN f.type = 'Pass' THEN 'v1' END AS xpass_model_version,
    '' AS failed FROM feed f LEFT JOIN s USING (eventId)""")
def scored_events(spark, sf_dir):
    """Four models fitted, stored, loaded and run in order on the feed without its own values; each reads what the ones before it wrote."""
    out = score_chain(spark, sf_dir)[0]
    shot, own = F.col("xg_model_version").isNotNull(), F.coalesce(F.col("xg_shot_family") == "own_goal", F.lit(False))
    fixed_xg = own | F.coalesce(F.col("xg_shot_family") == "penalty", F.lit(False))
    off = shot & (own | ~F.col("type").isin("Goal", "SavedShot"))
    inside = lambda n, low, high: F.col(n).between(low, high)
    return out.select(
        "eventId", F.when(fixed_xg, F.col("xG")).alias("fixed_xg"), F.when(shot & ~fixed_xg, inside("xG", 0.003, 0.95)).alias("xg_in_range"),
        F.when(off, F.col("xGOT")).alias("fixed_xgot"), F.when(shot & ~off, inside("xGOT", 0.001, 0.995)).alias("xgot_in_range"),
        F.when(F.col("xa_model_version").isNotNull(), inside("xA", 0.0, 1.0)).alias("xa_in_range"), F.when(F.col("xpass_model_version").isNotNull(), inside("xPass", 0.0, 1.0)).alias("xpass_in_range"),
        "xg_model_version", "xgot_model_version", "xa_model_version", "xpass_model_version", F.array_join("failed_models", ",").alias("failed"))


def score_chain(spark, sf_dir, candidate="logistic_calibrated", minimum=20):
    """The feed scored by four models of one version, and their store. The xGOT model learns on the xG that the first model gives.

    The split, the feed with its score and the feed with its xG are each written once and read by every step after them."""
    from touchline.models import scoring, training as t
    from touchline.plans.enrich import with_models
    store, split = model_store(spark), materialise(f.time_split(match_feed(spark, sf_dir)), "split")
    ev = scored(spark, sf_dir).drop("xG", "xGOT", "xA", "xPass").withColumns({n: F.lit(None).cast("double") for n in ("xG", "xGOT", "xA", "xPass")})
    ev = materialise(ev, "scored")

    def learn(name, features):
        store.save(t.fit(t.training_rows(features, split, t.SPECS[name]), t.SPECS[name], candidate, minimum), "v1")

    learn("xG", f.shot_features(ev))
    learn("xA", f.assist_features(ev))
    learn("xPass", completion(spark, sf_dir))
    steps = scoring.model_steps(store, dict.fromkeys(scoring.STEPS, "v1"))
    shots = with_models(ev, steps[:1], written=True)
    shots = materialise(shots.withColumnRenamed("failed_models", "_failed"), "shots")
    learn("xGOT", f.xgot_features(f.shot_features(shots)))
    out = with_models(shots, steps[1:], written=True)
    return out.withColumn("failed_models", F.concat("_failed", "failed_models")).drop("_failed"), store


@query("models_that_fail", "M16", FEED + """
SELECT eventId, v100 / 100.0::double AS "xG", NULL::double AS "xA", 0.5::double AS "xPass", 'assists,wrong,rows' AS failed FROM feed""")
def models_that_fail(spark, sf_dir):
    """Five steps of which three cannot run: a missing column, a step that does not add what it says, and one that fails on some rows."""
    from touchline.plans.enrich import ModelStep, with_models
    steps = [ModelStep("shots", {"xG": "double"}, lambda d: d.withColumn("xG", F.col("v100") / 100.0)),
             ModelStep("assists", {"xA": "double"}, lambda d: d.withColumn("xA", F.col("no such column"))),
             ModelStep("wrong", {"other": "double"}, lambda d: d),
             ModelStep("rows", {"xA": "double"}, lambda d: d.withColumn("xA", F.when(F.col("index") % 100 == 7, F.raise_error(F.lit("no score for this row"))).otherwise(0.1))),
             ModelStep("passes", {"xPass": "double"}, lambda d: d.withColumn("xPass", F.lit(0.5)))]
    out = with_models(match_feed(spark, sf_dir).drop("xG", "xA", "xPass"), steps)
    return out.select("eventId", "xG", "xA", "xPass", F.array_join("failed_models", ",").alias("failed"))


@query("enriched_events", "M11")
def enriched_events(spark, sf_dir):
    from touchline.plans.enrich import enrich
    out = enrich(match_feed(spark, sf_dir, pace=4))
    return out.select("matchId", "index", "event_ord", "type", "is_generated", "cumulative_mins", "xT", "epv_added", "prog_pass", "prog_carry", "pass_or_carry_angle")


_NX = "((eventId * 7) % 100) / 100.0::DOUBLE"


@query("backfill_run", "M12 S24 S21", feed_sql(teams=4) + f"""
SELECT league, season, 'applied' AS status, count(*) AS "rows", count(*) AS rows_before, count(DISTINCT CASE WHEN type = 'Pass' AND xPass <> {_NX} THEN matchId END) AS changed_matches,
    {n_sql(f"type = 'Pass' AND xPass <> {_NX}")} AS changed_rows, true AS equals_clean_run, true AS backup_is_old, 'skipped_complete' AS again, 'applied' AS forced FROM feed GROUP BY league, season""")
def backfill_run(spark, sf_dir):
    """Two archives of the feed get new xPass values: one in a clean run, one in a run that dies before each kind of step and is called again.
    A second run finds every unit complete; a forced one with other values writes again."""
    from touchline.sources.rewrite import Rewrite
    ev = match_feed(spark, sf_dir, teams=4).drop("k", "ts", "v100", "x10", "y10", "endX10", "endY10", "q")
    home = f"{checkpoint_dir(spark).rstrip('/')}/backfill-{uuid.uuid4().hex}"
    for name in ("clean", "killed"):
        store.publish(ev, f"{home}/{name}")

    def change(version, add=0, force=False):
        def put(rows):
            new = rows.where("type = 'Pass'").select("matchId", "teamId", "eventId", F.lit(0).alias("seq"), ((F.col("eventId") * 7 + add) % 100 / F.lit(100.0)).alias("xPass"))
            return e.write_back(rows, new, "xPass", "xpass_model_version", version, force=force).select(*rows.columns, *({"xpass_model_version"} - set(rows.columns)))
        return put

    def complete(rows):
        units = ["league", "season"]
        if "xpass_model_version" not in rows.columns:
            return rows.select(*units)
        return e.completeness(rows, "xPass", "xpass_model_version", F.col("type") == "Pass", [*units, "matchId"]).where("not complete or version <> 'v2'").select(*units)

    class Killed(RuntimeError):
        pass

    def dying(step):
        def before(now, folder):
            if now == step:
                raise Killed(step)
        return before

    clean = Rewrite(spark, f"{home}/clean", "first", change("v2"), complete)
    clean.plan()
    clean.apply()
    for step in ("stage", "compare", "backup", "swap", "ledger"):
        try:
            Rewrite(spark, f"{home}/killed", "first", change("v2"), complete, dying(step)).apply(parallel=1)
        except Killed:
            continue
    first = Rewrite(spark, f"{home}/killed", "first", change("v2"), complete)
    report = first.apply()
    again = Rewrite(spark, f"{home}/killed", "second", change("v2"), complete).apply(skip_complete=True)
    units = first.planned()
    hashed = lambda rows: store.fingerprint(rows, ["league", "season", "matchId"])
    a, b = hashed(first.read(units)), hashed(clean.read(units))
    backup = first.read(units, f"{first.home}/backup")
    source = hashed(conform(ev).select(*backup.columns))
    other = a.exceptAll(b).unionByName(b.exceptAll(a)).select("league", "season", F.lit("clean").alias("of")).unionByName(
        source.exceptAll(hashed(backup)).select("league", "season", F.lit("source").alias("of")))
    found = {(r.league, r.season): (r.clean, r.source) for r in other.groupBy("league", "season").agg(
        F.count_if(F.col("of") == "clean").alias("clean"), F.count_if(F.col("of") == "source").alias("source")).collect()}  # a row per unit at most
    facts = [(league, season, not found.get((league, season), (0, 0))[0], not found.get((league, season), (0, 0))[1]) for _, league, season in map(first._names, units)]
    forced = Rewrite(spark, f"{home}/killed", "forced", change("v2", add=50, force=True)).apply()
    facts = spark.createDataFrame(facts, "league string, season string, equals_clean_run boolean, backup_is_old boolean")
    return (report.join(facts, ["league", "season"]).join(again.select("league", "season", F.col("status").alias("again")), ["league", "season"])
            .join(forced.select("league", "season", F.col("status").alias("forced")), ["league", "season"]))


@query("carry_rebuild", "M15", DENSE + CARRY_SQL + """,
n AS (SELECT '' || (2000 + matchId::BIGINT % 3) AS season, count(*) AS made, count(*) FILTER (WHERE eventId % 3 = 0 AND matchId::BIGINT % 3 = 1) AS lost FROM carry GROUP BY 1),
m AS (SELECT '' || (2000 + matchId::BIGINT % 3) AS season, count(*) AS n FROM feed GROUP BY 1)
SELECT season, CASE WHEN coalesce(lost, 0) > 0 THEN 'applied' ELSE 'unchanged' END AS status, n + coalesce(made, 0) AS "rows", n + coalesce(made, 0) - coalesce(lost, 0) AS rows_before, 'unchanged' AS again FROM m LEFT JOIN n USING (season)""")
def carry_rebuild(spark, sf_dir):
    """An archive of enriched events that lost some generated carries in one season is rebuilt: carries dropped, found and scored again; only changed
    partitions are swapped, and a second run changes nothing."""
    from touchline.operators import carries, grids
    from touchline.plans.enrich import enrich, with_progress
    from touchline.sources.rewrite import Rewrite
    ev = enrich(match_feed(spark, sf_dir, pace=4).drop("k", "ts", "v100", "x10", "y10", "endX10", "endY10", "q")).drop("failed_models")
    ev = ev.withColumn("season", (2000 + F.col("matchId").cast("bigint") % 3).cast("string"))
    lost = F.col("is_generated") & (F.floor("event_ord") % 3 == 0) & (F.col("season") == "2001")
    root = f"{checkpoint_dir(spark).rstrip('/')}/carries-{uuid.uuid4().hex}/archive"
    store.by_folder(ev.where(~lost), "league", "season").write.partitionBy("league", "season").parquet(root)

    def rebuilt(rows):
        return with_progress(grids.with_epv(grids.with_xt(carries.rebuild_carries(rows)), None)).select(*rows.columns)

    first = Rewrite(spark, root, "first", rebuilt).apply()
    again = Rewrite(spark, root, "second", rebuilt).apply()
    return first.select("season", "status", "rows", "rows_before").join(again.select("season", F.col("status").alias("again")), "season")
