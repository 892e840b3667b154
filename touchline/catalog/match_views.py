"""Match summary, dynamics and breakdown views over every match of the feed."""

from pyspark.sql import functions as F

from touchline.catalog.feed_checks import DENSE, FEED
from touchline.catalog.match_state import CLOCK_SQL, EPV_SQL, SCORE_SQL, STATE_SQL, XT_SQL, state_feed
from touchline.catalog.registry import fsum_sql, n_sql, pct_sql, query, ratio_sql
from touchline.operators import grids, state
from touchline.plans import match_views as mv
from touchline.sources.feed import match_feed

OK = "outcomeType = 'Successful'"
PASS = "type = 'Pass'"
SHOT = "type IN ('Goal','SavedShot','MissedShots','ShotOnPost')"
PRESS = "type IN ('Interception','Tackle','Clearance','BlockedPass','BallRecovery','Challenge')"
THIRD = lambda x: f"CASE WHEN ({x}) >= 70 THEN 'final' WHEN ({x}) >= 35 THEN 'middle' ELSE 'defensive' END"
FLANK = "CASE WHEN y < 22.67 THEN 'Left' WHEN y < 45.33 THEN 'Center' ELSE 'Right' END"
TEAMS_SQL = """,
ft AS (SELECT matchId, greatest(90, max("minute")) AS full_time FROM feed GROUP BY matchId),
mt AS (SELECT DISTINCT f.matchId, teamName, full_time FROM feed f JOIN ft USING (matchId))"""


@query("match_context", "P42", FEED + f"""
SELECT matchId, min(league) AS league, min(season) AS season, min(startDate) AS date, max(CASE WHEN h_a='h' THEN teamName END) AS home_team,
 max(CASE WHEN h_a='a' THEN teamName END) AS away_team, {n_sql("type='Goal' AND (h_a='h') <> goalOwn")} AS home_goals,
 {n_sql("type='Goal' AND (h_a='h') = goalOwn")} AS away_goals, count(*) AS events FROM feed GROUP BY matchId""")
def match_context(spark, sf_dir):
    return mv.match_context(match_feed(spark, sf_dir))


@query("match_team_summaries", "A7", FEED + f"""
SELECT matchId, teamName, count(*) AS events, {n_sql('isGoal')} AS goals, {n_sql('isShot')} AS shots, {fsum_sql('xG')} AS xg, {fsum_sql('xGOT')} AS xgot,
 {n_sql(PASS + ' AND ' + OK)} AS completed_passes, {pct_sql(n_sql(PASS + ' AND ' + OK), n_sql(PASS))} AS pass_accuracy FROM feed GROUP BY matchId, teamName""")
def match_team_summaries(spark, sf_dir):
    return mv.team_summaries(match_feed(spark, sf_dir))


@query("match_period_summary", "A7", FEED + f"""
SELECT matchId, period, count(*) AS events, {n_sql('isShot')} AS shots, {n_sql('isGoal')} AS goals FROM feed GROUP BY ALL""")
def match_period_summary(spark, sf_dir):
    return mv.period_summary(match_feed(spark, sf_dir))


@query("match_summary_cards", "A7", FEED + f"""
SELECT matchId, count(*) AS events, {n_sql('isShot')} AS shots, {n_sql('isGoal')} AS goals, {fsum_sql('xG')} AS xg_total, {fsum_sql('xGOT')} AS xgot_total FROM feed GROUP BY matchId""")
def match_summary_cards(spark, sf_dir):
    return mv.summary_cards(match_feed(spark, sf_dir))


@query("match_filter_values", "A7 U4", FEED + """
SELECT DISTINCT matchId, filter, value FROM (SELECT matchId, 'teamName' AS filter, teamName AS value FROM feed UNION ALL SELECT matchId, 'playerName', playerName FROM feed
 UNION ALL SELECT matchId, 'period', period FROM feed UNION ALL SELECT matchId, 'situation', situation FROM feed UNION ALL SELECT matchId, 'type', type FROM feed) WHERE value IS NOT NULL""")
def match_filter_values(spark, sf_dir):
    return mv.available_filters(match_feed(spark, sf_dir))


PT = f"""SELECT *, row_number() OVER (PARTITION BY matchId ORDER BY goals DESC, xg DESC, events DESC, playerName) AS "rank" FROM (
 SELECT matchId, playerName, min_by(teamName, "index") AS "teamName", count(*) AS events, {n_sql('isShot')} AS shots, {n_sql('isGoal')} AS goals, {fsum_sql('xG')} AS xg FROM feed GROUP BY matchId, playerName)"""


@query("match_player_table", "A8 T3", FEED + f""" SELECT * FROM ({PT}) WHERE "rank" <= 25""")
def match_player_table(spark, sf_dir):
    return mv.player_table(match_feed(spark, sf_dir))


@query("match_player_comparison", "A8", FEED + f""" SELECT * FROM ({PT}) WHERE "rank" <= 12""")
def match_player_comparison(spark, sf_dir):
    return mv.player_table(match_feed(spark, sf_dir), 12)


@query("event_timeline", "A66 T1 T2", FEED + """
SELECT matchId, "index", "minute", teamName, playerName, type, outcomeType, isShot AS is_shot, isGoal AS is_goal FROM feed""")
def event_timeline(spark, sf_dir):
    return mv.event_timeline(match_feed(spark, sf_dir))


@query("attack_direction", "A67", FEED + f"""
SELECT matchId, teamName, median(v) AS median_x, median(v) >= 52.5 AS attacks_right FROM (SELECT matchId, teamName, x AS v FROM feed WHERE {SHOT}
 UNION ALL SELECT matchId, teamName, endX FROM feed WHERE {PASS}) WHERE v IS NOT NULL GROUP BY matchId, teamName""")
def attack_direction(spark, sf_dir):
    return mv.attack_direction(match_feed(spark, sf_dir))


@query("filtered_shots", "P12 P13 P14", FEED + f"""
SELECT eventId, teamName, situation, coalesce(xG, 0.05) AS "xG", coalesce(xGOT, 0) AS "xGOT" FROM feed WHERE {SHOT} AND situation = 'OpenPlay'""")
def filtered_shots(spark, sf_dir):
    return mv.filter_shots(match_feed(spark, sf_dir), situation="OpenPlay").select("eventId", "teamName", "situation", "xG", "xGOT")


@query("xg_flow", "W6", FEED + TEAMS_SQL + f""",
per AS (SELECT matchId, teamName, "minute", CAST(sum(v100*10000) AS BIGINT) AS v FROM feed WHERE {SHOT} GROUP BY matchId, teamName, "minute"),
sp AS (SELECT matchId, teamName, unnest(generate_series(0, full_time)) AS m FROM mt)
SELECT s.matchId, s.teamName, CAST(s.m AS INT) AS "minute", coalesce(sum(p.v) OVER (PARTITION BY s.matchId, s.teamName ORDER BY s.m), 0)::double / 1e6 AS cumulative_xg
FROM sp s LEFT JOIN per p ON p.matchId = s.matchId AND p.teamName = s.teamName AND p."minute" = s.m""")
def xg_flow(spark, sf_dir):
    return mv.xg_flow(match_feed(spark, sf_dir))


def momentum_sql(val: str, cap: float, extra: str) -> str:
    d1, d2 = mv.DECAY[1], mv.DECAY[2]
    return FEED + extra + TEAMS_SQL + f""",
b AS (SELECT f.matchId, f.teamName, f."minute", max(greatest(0.0::double, least({cap}::double, {val}))) AS v FROM feed f JOIN src USING (eventId) GROUP BY ALL),
t2 AS (SELECT matchId, min(teamName) AS a, max(teamName) AS z, max(full_time) AS ft FROM mt GROUP BY matchId),
sp AS (SELECT matchId, a, z, unnest(generate_series(0, ft)) AS m FROM t2),
j AS (SELECT sp.matchId, sp.m, coalesce(x.v, 0) AS v1, coalesce(y.v, 0) AS v2 FROM sp LEFT JOIN b x ON x.matchId = sp.matchId AND x.teamName = sp.a AND x."minute" = sp.m
  LEFT JOIN b y ON y.matchId = sp.matchId AND y.teamName = sp.z AND y."minute" = sp.m),
k AS (SELECT matchId, m, v1 + {d1!r}::double*coalesce(lag(v1,1) OVER w,0) + {d2!r}::double*coalesce(lag(v1,2) OVER w,0) AS a,
  v2 + {d1!r}::double*coalesce(lag(v2,1) OVER w,0) + {d2!r}::double*coalesce(lag(v2,2) OVER w,0) AS b FROM j WINDOW w AS (PARTITION BY matchId ORDER BY m))
SELECT matchId, CAST(m AS INT) AS "minute", CAST(floor(a*1e6+0.5) AS BIGINT) AS first_team, CAST(floor(-b*1e6+0.5) AS BIGINT) AS second_team, CAST(floor((a-b)*1e6+0.5) AS BIGINT) AS momentum FROM k"""


def _micro(df):
    from touchline.functions.core import fixed
    return df.select("matchId", "minute", *[fixed(F.col(n)).alias(n) for n in ("first_team", "second_team", "momentum")])


@query("xt_momentum", "W7 A78", momentum_sql("xt", 0.1, XT_SQL + ", src AS (SELECT eventId, xt FROM xt)"))
def xt_momentum(spark, sf_dir):
    return _micro(mv.momentum(grids.with_xt(match_feed(spark, sf_dir)), "xT", 0.1))


@query("epv_momentum", "W7", momentum_sql("epv_added", 0.18, EPV_SQL + ", src AS (SELECT eventId, epv_added FROM epv)"))
def epv_momentum(spark, sf_dir):
    return _micro(mv.momentum(grids.with_epv(match_feed(spark, sf_dir)), "epv_added", 0.18))


# Clocked state rows ("cs") for windowed views.
CS_SQL = STATE_SQL + CLOCK_SQL + """, cs AS (SELECT s.*, ck.c FROM st s JOIN ck USING (eventId))"""


@query("possession_by_duration", "A12", FEED + STATE_SQL + f""",
pf AS (SELECT * FROM st WHERE possession_id IS NOT NULL),
spans AS (SELECT matchId, period, min(t) lo, max(t) hi FROM pf GROUP BY ALL),
po AS (SELECT a.matchId, possession_id, min_by(teamName, "index") AS "teamName", min(t + CASE WHEN a.period='FirstHalf' THEN 0 ELSE p.hi - s.lo END) AS s, max(t + CASE WHEN a.period='FirstHalf' THEN 0 ELSE p.hi - s.lo END) AS e
  FROM pf a JOIN spans s ON s.matchId=a.matchId AND s.period=a.period LEFT JOIN spans p ON p.matchId=a.matchId AND p.period='FirstHalf' GROUP BY a.matchId, possession_id),
w AS (SELECT matchId, CAST(s // 900 * 15 AS INT) AS "window", "teamName", CAST(sum(e - s) AS BIGINT) AS seconds FROM po GROUP BY ALL)
SELECT *, {pct_sql('seconds', 'sum(seconds) OVER (PARTITION BY matchId, "window")')} AS possession_pct FROM w""")
def possession_by_duration(spark, sf_dir):
    return mv.possession_by_duration(state_feed(spark, sf_dir))


WIN_SQL = CS_SQL + TEAMS_SQL + f""",
sp AS (SELECT matchId, teamName, full_time, unnest(generate_series(0, full_time, 15)) AS w FROM mt),
pw AS (SELECT matchId, teamName, c // 900 * 15 AS w, {n_sql(PASS)} AS passes, {n_sql(PASS + ' AND ' + OK)} AS completed,
  CAST(sum(turnover::int + (type = 'Dispossessed')::int) AS BIGINT) AS turnovers FROM cs GROUP BY ALL),
po AS (SELECT matchId, possession_id, min_by(opponentName, "index") AS tn, min_by(t // 900 * 15, "index") AS w, {n_sql(PASS)} AS p, {n_sql(PRESS + ' AND ' + OK)} AS d
  FROM st WHERE possession_id IS NOT NULL GROUP BY ALL),
pp AS (SELECT matchId, tn, w, {ratio_sql('sum(p)', 'sum(d)')} AS ppda FROM po GROUP BY matchId, tn, w),
wj AS (SELECT sp.matchId, sp.teamName, CAST(sp.w AS INT) AS "window", coalesce(passes,0) AS passes, coalesce(completed,0) AS completed, coalesce(turnovers,0) AS turnovers, coalesce(ppda,0) AS ppda
  FROM sp LEFT JOIN pw ON pw.matchId=sp.matchId AND pw.teamName=sp.teamName AND pw.w=sp.w LEFT JOIN pp ON pp.matchId=sp.matchId AND pp.tn=sp.teamName AND pp.w=sp.w),
wd AS (SELECT matchId, teamName, "window", {pct_sql('passes', 'sum(passes) OVER (PARTITION BY matchId, "window")')} AS possession_pct, {pct_sql('completed','passes')} AS pass_accuracy_pct, turnovers, ppda FROM wj)"""


@query("windowed_dynamics", "A12 A13 A15", FEED + WIN_SQL + " SELECT * FROM wd")
def windowed_dynamics(spark, sf_dir):
    return mv.windowed_dynamics(state_feed(spark, sf_dir))


FLANK_SQL = f""",
fp AS (SELECT matchId, teamName, possession_id, min_by(y, "index") AS y, {fsum_sql(f'CASE WHEN {SHOT} THEN coalesce(xG,0) END')} AS xg FROM st
  WHERE type IN ('Pass','Carry','SavedShot','MissedShots','Goal','ShotOnPost') AND x > 70.12 AND possession_id IS NOT NULL GROUP BY matchId, teamName, possession_id),
fg AS (SELECT matchId, teamName, {FLANK} AS flank, count(*) AS n, {fsum_sql('xg')} AS xg FROM fp GROUP BY ALL),
fl AS (SELECT m.matchId, m.teamName, k.flank, coalesce(n,0) AS num_attacks, coalesce(xg,0) AS total_xg FROM (SELECT DISTINCT matchId, teamName FROM feed) m
  CROSS JOIN (VALUES ('Left'),('Center'),('Right')) k(flank) LEFT JOIN fg ON fg.matchId=m.matchId AND fg.teamName=m.teamName AND fg.flank=k.flank)"""


@query("attack_flanks", "A14", FEED + STATE_SQL + FLANK_SQL + " SELECT * FROM fl")
def attack_flanks(spark, sf_dir):
    return mv.attack_flanks(state_feed(spark, sf_dir))


@query("attack_flanks_by_event", "A14", FEED + f"""
SELECT matchId, teamName, {FLANK} AS flank, count(*) AS num_attacks, {fsum_sql(f'CASE WHEN {SHOT} THEN coalesce(xG,0) END')} AS total_xg FROM feed
WHERE type IN ('Pass','Carry','SavedShot','MissedShots','Goal','ShotOnPost') AND x > 70.12 GROUP BY ALL""")
def attack_flanks_by_event(spark, sf_dir):
    return mv.attack_flanks_by_event(match_feed(spark, sf_dir))


@query("dynamics_team_summary", "A16", FEED + WIN_SQL + FLANK_SQL + XT_SQL + EPV_SQL + f""",
b AS (SELECT matchId, teamName, count(*) AS events, {n_sql('isGoal')} AS goals, {n_sql('isShot')} AS shots, {fsum_sql('xG')} AS xg, {fsum_sql('xGOT')} AS xgot,
  {n_sql("type IN ('Goal','SavedShot')")} AS shots_on_target, {n_sql(PASS + ' AND ' + OK)} AS completed_passes, {pct_sql(n_sql(PASS + ' AND ' + OK), n_sql(PASS))} AS pass_accuracy,
  {n_sql(PASS + ' AND ' + OK + ' AND endX > 75')} AS final_third_entries, {n_sql("list_contains(qualifiers,'BigChance') AND type <> 'Goal'")} AS big_chances_missed,
  {n_sql("list_contains(qualifiers,'CornerTaken')")} AS tk, {n_sql("type = 'CornerAwarded'")} AS aw, {n_sql(PASS)} AS np, {fsum_sql('CASE WHEN xt.xt > 0 THEN xt.xt END')} AS xt, {fsum_sql('epv_added')} AS epv_added
  FROM feed LEFT JOIN xt USING (eventId) LEFT JOIN epv USING (eventId) GROUP BY matchId, teamName),
w2 AS (SELECT matchId, teamName, CAST(sum(turnovers) AS BIGINT) AS turnovers, {ratio_sql(fsum_sql('CASE WHEN ppda > 0 THEN ppda END'), n_sql('ppda > 0'))} AS ppda FROM wd GROUP BY ALL),
f2 AS (SELECT matchId, teamName, CAST(sum(num_attacks) AS BIGINT) AS attacks, {fsum_sql('total_xg')} AS flank_xg FROM fl GROUP BY ALL)
SELECT b.* EXCLUDE (tk, aw, np), CASE WHEN tk > 0 THEN tk ELSE aw END AS corners_taken, {pct_sql('events','sum(events) OVER (PARTITION BY b.matchId)')} AS event_share,
 {pct_sql('np','sum(np) OVER (PARTITION BY b.matchId)')} AS possession_pct, turnovers, ppda, attacks, flank_xg
FROM b JOIN w2 USING (matchId, teamName) JOIN f2 USING (matchId, teamName)""")
def dynamics_team_summary(spark, sf_dir):
    return mv.dynamics_summary(grids.with_epv(grids.with_xt(state_feed(spark, sf_dir))))


@query("event_markers", "A16 P46", FEED + TEAMS_SQL + """
SELECT f.matchId, eventId, teamName, playerName, least("minute", 95, full_time) AS "minute",
 CASE WHEN type = 'Goal' THEN 'goal' WHEN cardType = 'Yellow' THEN 'yellow_card' ELSE 'red_card' END AS event_type,
 CASE WHEN type = 'Card' THEN CASE cardType WHEN 'Yellow' THEN 'yellow' WHEN 'SecondYellow' THEN 'second_yellow_red' ELSE 'straight_red' END END AS card_kind
FROM feed f JOIN ft USING (matchId) WHERE type IN ('Goal','Card')""")
def event_markers(spark, sf_dir):
    return mv.event_markers(match_feed(spark, sf_dir))


def _sb_sql():
    pen = f"{SHOT} AND list_contains(qualifiers,'Penalty')"
    sp = f"{SHOT} AND NOT list_contains(qualifiers,'Penalty') AND situation IN ('FromCorner','SetPiece','DirectFreekick')"
    op = f"{SHOT} AND NOT list_contains(qualifiers,'Penalty') AND situation NOT IN ('FromCorner','SetPiece','DirectFreekick')"
    h1, h2 = "period = 'FirstHalf'", "period = 'SecondHalf'"
    lost = "(turnover OR type = 'Dispossessed')"
    cor = "list_contains(qualifiers,'CornerTaken')"
    xg = lambda cond: fsum_sql(f"CASE WHEN {cond} THEN xG END")
    gain = lambda cond: fsum_sql(f"CASE WHEN {cond} THEN greatest(xt.xt,0) END")
    cols = [f"{xg(op)} AS xg_open_play", f"{xg(sp)} AS xg_set_piece", f"{xg(pen)} AS xg_penalty", f"{xg(SHOT + ' AND NOT (' + pen + ')')} AS xg_non_penalty",
            f"{xg(SHOT + ' AND ' + h1)} AS xg_first_half", f"{xg(SHOT + ' AND ' + h2)} AS xg_second_half",
            n_sql("type IN ('Goal','SavedShot')") + " AS shots_on_target", n_sql("type = 'MissedShots'") + " AS shots_off_target",
            "CAST(0 AS BIGINT) AS shots_blocked", "CAST(0 AS BIGINT) AS shots_woodwork",
            n_sql(f"{SHOT} AND {h1}") + " AS shots_first_half", n_sql(f"{SHOT} AND {h2}") + " AS shots_second_half",
            n_sql(f"{cor} AND y < 34") + " AS corners_right", n_sql(f"{cor} AND y >= 34") + " AS corners_left",
            n_sql(f"{cor} AND {h1}") + " AS corners_first_half", n_sql(f"{cor} AND {h2}") + " AS corners_second_half",
            n_sql(f"{lost} AND {h1}") + " AS turnovers_first_half", n_sql(f"{lost} AND {h2}") + " AS turnovers_second_half",
            gain(PASS) + " AS xt_passes", gain("type = 'Carry'") + " AS xt_carries"]
    for t in ("defensive", "middle", "final"):
        here = f"{THIRD('x')} = '{t}'"
        cols += [n_sql(f"isTouch AND {here}") + f" AS o_{t}", n_sql(f"isTouch AND {THIRD('105-x')} = '{t}'") + f" AS m_{t}",
                 n_sql(f"{PASS} AND {here}") + f" AS passes_{t}", n_sql(f"{PASS} AND {here} AND {OK}") + f" AS completed_{t}",
                 n_sql(f"{lost} AND {here}") + f" AS turnovers_{t}", gain(here) + f" AS xt_{t}"]
    for h, cond in (("first_half", h1), ("second_half", h2)):
        cols += [n_sql(f"{PASS} AND {cond}") + f" AS p_{h}", n_sql(f"{PRESS} AND {cond}") + f" AS d_{h}"]
    extra = []
    drop = []
    for t in ("defensive", "middle", "final"):
        extra += [ratio_sql(f"a.o_{t}", f"greatest(1, a.o_{t} + b.m_{t})", 100) + f" AS possession_pct_{t}", pct_sql(f"a.completed_{t}", f"a.passes_{t}") + f" AS pass_accuracy_{t}"]
        drop += [f"o_{t}", f"m_{t}"]
    for h in ("first_half", "second_half"):
        extra.append(ratio_sql(f"b.p_{h}", f"a.d_{h}") + f" AS ppda_{h}")
        drop += [f"p_{h}", f"d_{h}"]
    return FEED + XT_SQL + f""", s AS (SELECT f.matchId, f.teamName, {', '.join(cols)} FROM feed f LEFT JOIN xt USING (eventId) GROUP BY f.matchId, f.teamName)
SELECT a.* EXCLUDE ({', '.join(drop)}), {', '.join(extra)} FROM s a JOIN s b ON a.matchId = b.matchId AND a.teamName <> b.teamName"""


@query("stat_breakdowns", "A17 P24 P26", _sb_sql())
def stat_breakdowns(spark, sf_dir):
    return mv.stat_breakdowns(grids.with_xt(match_feed(spark, sf_dir)))


@query("goal_list", "A17", FEED + """
SELECT matchId, eventId, CASE WHEN goalOwn THEN opponentName ELSE teamName END AS team, playerName AS player, "minute", "second", CASE WHEN goalOwn THEN 0 ELSE xG END AS xg,
 list_contains(qualifiers,'Penalty') AND NOT goalOwn AS penalty, goalOwn AS own_goal FROM feed WHERE type = 'Goal'""")
def goal_list(spark, sf_dir):
    return mv.goal_list(match_feed(spark, sf_dir))


@query("thirds_series", "A18", FEED + CLOCK_SQL + TEAMS_SQL + f""",
sd AS (SELECT matchId, c // 900 * 15 AS w, teamName AS team, {THIRD('x')} AS third, true AS own, type, outcomeType, isTouch, turnover FROM ck
  UNION ALL SELECT matchId, c // 900 * 15, opponentName, {THIRD('105-x')}, false, type, outcomeType, isTouch, turnover FROM ck),
g AS (SELECT matchId, w, team, third, {n_sql('own AND isTouch')} AS ot, {n_sql('NOT own AND isTouch')} AS pt, {n_sql('own AND ' + PASS)} AS att, {n_sql('own AND ' + PASS + ' AND ' + OK)} AS ok,
  {n_sql('NOT own AND ' + PASS)} AS op, {n_sql('own AND ' + PRESS)} AS da, {n_sql("own AND (turnover OR type = 'Dispossessed')")} AS tv FROM sd GROUP BY ALL),
sp AS (SELECT matchId, teamName, w, third FROM (SELECT matchId, teamName, unnest(generate_series(0, full_time, 15)) AS w FROM mt) CROSS JOIN (VALUES ('defensive'),('middle'),('final')) k(third))
SELECT sp.matchId, sp.teamName, CAST(sp.w AS INT) AS "window", sp.third, {ratio_sql('coalesce(ot,0)', 'greatest(1, coalesce(ot,0)+coalesce(pt,0))', 100)} AS possession_pct,
 {pct_sql('coalesce(ok,0)','coalesce(att,0)')} AS pass_accuracy_pct, {ratio_sql('coalesce(op,0)','coalesce(da,0)')} AS ppda, coalesce(tv,0) AS turnovers
FROM sp LEFT JOIN g ON g.matchId=sp.matchId AND g.team=sp.teamName AND g.w=sp.w AND g.third=sp.third""")
def thirds_series(spark, sf_dir):
    return mv.thirds_series(match_feed(spark, sf_dir))


PROG = """CASE WHEN x < 52.5 AND endX < 52.5 THEN 30 WHEN x >= 52.5 AND endX >= 52.5 THEN 10 ELSE 15 END"""
GAIN = "(sqrt((105-x)*(105-x)+(34-y)*(34-y)) - sqrt((105-endX)*(105-endX)+(34-endY)*(34-endY)))"


@query("third_kpis", "A21 P7", FEED + XT_SQL + f"""
SELECT f.matchId, f.teamName, {THIRD('x')} AS third, count(*) AS passes, {n_sql(OK)} AS completed, {pct_sql(n_sql(OK), 'count(*)')} AS completion_pct, {fsum_sql('xt.xt')} AS xt,
 {n_sql(f'{GAIN} >= {PROG} AND {OK}')} AS progressive FROM feed f LEFT JOIN xt USING (eventId) WHERE {PASS} GROUP BY ALL""")
def third_kpis(spark, sf_dir):
    return mv.third_kpis(grids.with_xt(match_feed(spark, sf_dir)))


@query("scoped_team_counts", "P20 P21 P22 P24", FEED + SCORE_SQL + f"""
SELECT matchId, teamName, count(*) AS events, {n_sql(PASS)} AS passes, {fsum_sql('xG')} AS xg FROM gamestate
WHERE team_goal_diff_before > 0 AND "minute" >= 15 AND "minute" < 75 AND {THIRD('x')} = 'final' GROUP BY ALL""")
def scoped_team_counts(spark, sf_dir):
    ev = state.with_score(match_feed(spark, sf_dir))
    ev = mv.filter_third(mv.filter_time_range(mv.filter_score_state(ev, "leading"), "15-75"), "final")
    from touchline.functions.core import fsum, n_if
    return ev.groupBy("matchId", "teamName").agg(F.count("*").alias("events"), n_if(F.col("type") == "Pass").alias("passes"),
                                                 fsum(F.col("xG")).alias("xg"))


@query("game_state_options", "P23 P56 A11", FEED + SCORE_SQL + TEAMS_SQL + """,
x AS (SELECT matchId, teamName, "minute", 'all' AS value FROM gamestate UNION ALL SELECT matchId, teamName, "minute", team_score_state FROM gamestate
 UNION ALL SELECT matchId, teamName, "minute", CASE WHEN team_goal_diff_before > 0 THEN 'leading' ELSE 'trailing' END FROM gamestate WHERE team_goal_diff_before <> 0),
g AS (SELECT matchId, teamName, value, min("minute") AS lo, max("minute") AS hi FROM x GROUP BY ALL)
SELECT g.matchId, g.teamName, value, CASE value WHEN 'all' THEN 'All states' WHEN 'level' THEN 'Level' WHEN 'leading' THEN 'Leading' WHEN 'trailing' THEN 'Trailing'
  WHEN 'leading_by_1' THEN 'Leading by 1' WHEN 'leading_by_2_plus' THEN 'Leading by 2+' WHEN 'trailing_by_1' THEN 'Trailing by 1' ELSE 'Trailing by 2+' END AS label,
 CASE WHEN value = 'all' THEN 0 ELSE lo END AS minute_start, CASE WHEN value = 'all' THEN full_time ELSE greatest(lo + 1, least(full_time, hi)) END AS minute_end
FROM g JOIN ft USING (matchId)""")
def game_state_options(spark, sf_dir):
    return mv.game_state_options(state.with_score(match_feed(spark, sf_dir)))


@query("time_range_options", "P56", FEED + TEAMS_SQL + """,
s AS (SELECT matchId, full_time, CAST(unnest(generate_series(0, full_time, 15)) AS INT) AS a FROM ft)
SELECT matchId, 'all' AS value, 'Full match' AS label, 0 AS minute_start, full_time AS minute_end FROM ft
UNION ALL SELECT matchId, concat(a, '-', least(a+15, full_time)), CASE WHEN a >= 90 THEN 'Stoppage' ELSE concat(a, '''-', least(a+15, full_time), '''') END, a, least(a+15, full_time)
FROM s WHERE a < least(a+15, full_time)""")
def time_range_options(spark, sf_dir):
    return mv.time_range_options(match_feed(spark, sf_dir))
