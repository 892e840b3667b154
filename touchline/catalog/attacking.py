"""Territory entries and set pieces."""

from touchline.catalog.defending import DEF
from touchline.catalog.feed_checks import feed_sql
from touchline.catalog.match_state import possession_sql
from touchline.catalog.registry import fsum_sql, n_sql, pct_sql, query, ratio_sql
from touchline.operators import state
from touchline.plans import attacking as a
from touchline.sources.feed import match_feed

FEED = feed_sql(20, 4, 14)
OK = "outcomeType = 'Successful'"
RESTART = "list_has_any(qualifiers, ['CornerTaken','FreekickTaken','ThrowIn','GoalKick'])"
LANE = lambda y: f"CASE WHEN {y} >= 54.16 THEN 'left' WHEN {y} >= 43.16 THEN 'left_hs' WHEN {y} >= 24.84 THEN 'center' WHEN {y} >= 13.84 THEN 'right_hs' ELSE 'right' END"
BOX = lambda x, y: f"({x} >= 88.5 AND {y} >= 13.84 AND {y} <= 54.16)"
DEFT = "('Tackle','Interception','BallRecovery','Clearance','BlockedPass','Aerial')"
ENTRY_SQL = possession_sql(True) + f""",
ps AS (SELECT f.*, p.possession_id, "minute"*60+"second" AS t FROM feed f LEFT JOIN poss p USING (matchId, "index")),
ld AS (SELECT a.eventId AS id, max(b."index") AS i FROM ps a JOIN ps b ON a.matchId=b.matchId AND b."index" < a."index" AND b.teamName<>a.teamName AND b.type IN {DEFT} AND b.possession_id=a.possession_id GROUP BY a.eventId),
sh AS (SELECT a.eventId AS id, min_by(b."isGoal", b."index") AS g FROM ps a JOIN ps b ON a.matchId=b.matchId AND a.possession_id=b.possession_id AND a.teamName=b.teamName AND b."isShot" AND b.t >= a.t GROUP BY a.eventId),
rc AS (SELECT a.eventId AS id, min(b."index") AS i FROM ps a JOIN ps b ON a.matchId=b.matchId AND b."index" BETWEEN a."index"+1 AND a."index"+4 AND b.type<>'Card' GROUP BY a.eventId),
bs AS (SELECT ps.*, d.playerName AS ldn, sh.g, CASE WHEN r.teamName=ps.teamName THEN r.playerName END AS rcv FROM ps LEFT JOIN ld ON ld.id=ps.eventId LEFT JOIN ps d ON d.matchId=ps.matchId AND d."index"=ld.i
  LEFT JOIN sh ON sh.id=ps.eventId LEFT JOIN rc ON rc.id=ps.eventId LEFT JOIN ps r ON r.matchId=ps.matchId AND r."index"=rc.i WHERE ps.type IN ('Pass','Carry') AND ps.{OK} AND NOT {RESTART.replace('qualifiers','ps.qualifiers')}),
kk AS (SELECT *, 'final_third' AS kind FROM bs WHERE x < 70 AND endX >= 70 UNION ALL SELECT *, 'box' FROM bs WHERE NOT {BOX('x','y')} AND {BOX('endX','endY')} UNION ALL SELECT *, 'exit' FROM bs WHERE x < 35 AND endX >= 35
  UNION ALL SELECT *, 'reception' FROM bs WHERE type='Pass' AND endX >= 70),
en AS (SELECT matchId, eventId, teamName, opponentName, kind, "minute", CASE WHEN kind='reception' THEN coalesce(rcv, playerName) ELSE playerName END AS player, CASE WHEN kind='reception' THEN playerName END AS passer, x, y, endX AS end_x, endY AS end_y,
  CASE WHEN kind='reception' THEN 'reception' WHEN kind='exit' THEN CASE WHEN type='Carry' THEN 'carry' WHEN list_has_any(qualifiers,['Longball','Chipped']) THEN 'long_ball' ELSE 'ground_pass' END
   WHEN type='Carry' THEN 'carry' WHEN kind='box' AND x >= 94 AND (y < 13.84+4 OR y > 54.16-4) AND endX <= x-1.5::double THEN 'cutback' WHEN list_contains(qualifiers,'Cross') THEN 'cross'
   WHEN list_contains(qualifiers,'Longball') OR (list_contains(qualifiers,'Chipped') AND endX-x >= 30) THEN 'long_ball' ELSE 'ground_pass' END AS method,
  CASE WHEN kind='exit' THEN CASE WHEN y < 22.67 THEN 'right' WHEN y > 45.33 THEN 'left' ELSE 'center' END ELSE {LANE('endY')} END AS channel, CASE WHEN kind='reception' THEN {BOX('endX','endY')} END AS in_box,
  g IS NOT NULL AS led_to_shot, coalesce(g,false) AS led_to_goal, CASE WHEN kind IN ('final_third','box') THEN ldn END AS last_defender, CASE WHEN kind IN ('final_third','box') THEN ldn IS NULL END AS uncontested FROM kk)"""


def feed(spark, sf_dir):
    return state.with_possession(match_feed(spark, sf_dir, 20, 4, 14))


@query("territory_entries", "A28 J13 J14 J15 P11 P36 P37", FEED + ENTRY_SQL + " SELECT * FROM en")
def territory_entries(spark, sf_dir):
    return a.territory_entries(feed(spark, sf_dir))


@query("entry_method_shares", "A77", FEED + ENTRY_SQL + f""",
g AS (SELECT matchId, teamName, kind, method, count(*) AS entries, {n_sql('led_to_shot')} AS to_shot FROM en GROUP BY ALL) SELECT *, {pct_sql('entries','sum(entries) OVER (PARTITION BY matchId, teamName, kind)')} AS share FROM g""")
def entry_method_shares(spark, sf_dir):
    return a.entry_method_shares(a.territory_entries(feed(spark, sf_dir)))


@query("entry_players", "A77", FEED + ENTRY_SQL + f""",
g AS (SELECT matchId, teamName, player, method, count(*) AS n, {n_sql('led_to_shot')} AS s FROM en WHERE kind<>'reception' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY matchId, teamName, player ORDER BY n DESC, method) AS rn FROM g)
SELECT matchId, teamName, player, CAST(sum(n) AS BIGINT) AS entries, CAST(sum(s) AS BIGINT) AS to_shot, max(CASE WHEN rn=1 THEN method END) AS top_method FROM r GROUP BY ALL""")
def entry_players(spark, sf_dir):
    return a.entry_players(a.territory_entries(feed(spark, sf_dir)))


@query("entry_style", "A77", FEED + ENTRY_SQL + f""",
g AS (SELECT matchId, teamName, count(*) AS entries, {pct_sql(n_sql("channel IN ('right','left')"),'count(*)')} AS wide_share, {pct_sql(n_sql("channel='center'"),'count(*)')} AS central_share FROM en WHERE kind='final_third' GROUP BY ALL)
SELECT *, CASE WHEN wide_share >= 55 THEN 'wide' WHEN central_share >= 45 THEN 'central' ELSE 'mixed' END AS style FROM g""")
def entry_style(spark, sf_dir):
    return a.entry_style(a.territory_entries(feed(spark, sf_dir)))


@query("defender_accountability", "A62", FEED + ENTRY_SQL + f"""
SELECT matchId, opponentName AS defending_team, coalesce(last_defender,'(uncontested)') AS defender, {LANE('(68-end_y)')} AS own_lane, count(*) AS beaten, {n_sql('led_to_shot')} AS to_shot, {n_sql('led_to_goal')} AS to_goal FROM en
WHERE kind IN ('final_third','box') GROUP BY ALL""")
def defender_accountability(spark, sf_dir):
    return a.defender_accountability(a.territory_entries(feed(spark, sf_dir)))


LEDGER_SQL = ENTRY_SQL + f""",
be AS (SELECT matchId, opponentName AS tm, last_defender AS d, player, led_to_shot, led_to_goal, "minute" FROM en WHERE kind IN ('final_third','box') AND last_defender IS NOT NULL),
bg AS (SELECT matchId, tm, d, count(*) AS beaten, {n_sql('led_to_shot')} AS to_shot, {n_sql('led_to_goal')} AS to_goal, {n_sql('"minute" >= 60')} AS late FROM be GROUP BY ALL),
bt AS (SELECT * FROM (SELECT matchId, tm, d, player, count(*) AS n FROM be GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY matchId, tm, d ORDER BY n DESC, player) = 1),
sg AS (SELECT matchId, teamName AS tm, playerName AS d, count(*) AS stops, {n_sql('x <= 35')} AS deep, sum(CASE WHEN x <= 35 THEN CAST(floor(y*1e6+0.5) AS BIGINT) END) AS sy FROM feed WHERE {DEF} AND playerName IS NOT NULL GROUP BY ALL),
lg AS MATERIALIZED (SELECT matchId, tm AS defending_team, d AS defender, coalesce(beaten,0) AS beaten, coalesce(to_shot,0) AS to_shot, coalesce(to_goal,0) AS to_goal, coalesce(late,0) AS late, coalesce(stops,0) AS stops,
  {pct_sql('coalesce(stops,0)', 'coalesce(stops,0)+coalesce(beaten,0)')} AS stop_rate_pct, CASE WHEN deep >= 2 THEN {LANE('(sy::double/1e6::double/deep::double)')} END AS home_lane, bt.player AS top_attacker, bt.n AS top_attacker_times
  FROM bg FULL JOIN sg USING (matchId, tm, d) LEFT JOIN bt USING (matchId, tm, d))"""


def _ledger(spark, sf_dir):
    ev = feed(spark, sf_dir)
    entries = a.territory_entries(ev)
    return entries, a.defender_ledger(entries, ev)


@query("defender_ledger", "A62", FEED + LEDGER_SQL + " SELECT * FROM lg")
def defender_ledger(spark, sf_dir):
    return _ledger(spark, sf_dir)[1]


@query("uncontested_lanes", "A62", FEED + LEDGER_SQL + f""",
fr AS (SELECT matchId, opponentName AS defending_team, {LANE('(68-end_y)')} AS own_lane, count(*) AS entries, {n_sql('led_to_shot')} AS to_shot FROM en WHERE kind IN ('final_third','box') AND uncontested GROUP BY ALL),
ow AS (SELECT matchId, defending_team, home_lane AS own_lane, string_agg(defender, ', ' ORDER BY defender) AS owners FROM lg WHERE home_lane IS NOT NULL GROUP BY ALL)
SELECT fr.*, ow.owners FROM fr LEFT JOIN ow ON ow.matchId=fr.matchId AND ow.defending_team=fr.defending_team AND ow.own_lane=fr.own_lane""")
def uncontested_lanes(spark, sf_dir):
    return a.uncontested_lanes(*_ledger(spark, sf_dir))


@query("defensive_vulnerability", "A62", FEED + ENTRY_SQL + f"""
SELECT matchId, opponentName AS defending_team, {LANE('(68-end_y)')} AS own_lane, method, count(*) AS entries, {n_sql('led_to_shot')} AS to_shot, {pct_sql(n_sql('uncontested'),'count(*)')} AS uncontested_pct FROM en
WHERE kind IN ('final_third','box') GROUP BY ALL""")
def defensive_vulnerability(spark, sf_dir):
    return a.vulnerability(a.territory_entries(feed(spark, sf_dir)))


@query("sequence_style", "A29", FEED + possession_sql(True) + f""",
g AS (SELECT f.matchId, f.teamName, p.possession_id, {n_sql("type='Pass'")} AS n, bool_or("isShot") AS s FROM feed f JOIN poss p USING (matchId, "index") GROUP BY ALL)
SELECT matchId, teamName, {n_sql('s')} AS shot_possessions, {ratio_sql('coalesce(sum(n) FILTER (WHERE s),0)', n_sql('s'))} AS avg_passes_to_shot, {ratio_sql('sum(n)','count(*)')} AS avg_passes_all, {pct_sql(n_sql('s AND n <= 4'), n_sql('s'))} AS direct_share FROM g GROUP BY ALL""")
def sequence_style(spark, sf_dir):
    return a.sequence_style(feed(spark, sf_dir))


def _sp_sql() -> str:
    parts = []
    for key, (token, situation, window) in a.SET_PIECES.items():
        sit = f"AND regexp_matches(s.situation, '{situation}')" if situation else ""
        parts.append(f"""SELECT s.*, '{key}' AS piece, 'delivery' AS kind, s.eventId AS did FROM spn s WHERE list_contains(qualifiers,'{token}')
 UNION ALL SELECT s.*, '{key}', 'shot', (SELECT max_by(d.eventId, d."index") FROM spn d WHERE d.matchId=s.matchId AND d.teamName=s.teamName AND d."index" < s."index" AND list_contains(d.qualifiers,'{token}')) AS did FROM spn s WHERE s."isShot" {sit}
  AND s.t - (SELECT max_by(d.t, d."index") FROM spn d WHERE d.matchId=s.matchId AND d.teamName=s.teamName AND d."index" < s."index" AND list_contains(d.qualifiers,'{token}')) <= {window}""")
    return f""",
spn AS (SELECT *, "minute"*60+"second" AS t, lead(teamName) OVER w AS nt, lead(playerName) OVER w AS np, lead(outcomeType) OVER w AS no_, lead("minute"*60+"second") OVER w AS ntt FROM feed WINDOW w AS (PARTITION BY matchId ORDER BY "index")),
spa AS ({' UNION ALL '.join(parts)}),
spr AS (SELECT matchId, eventId, teamName, playerName, piece, kind, did AS delivery_id, "minute", x, y, coalesce(endX,0) AS end_x, coalesce(endY,0) AS end_y, {OK} AS successful, coalesce(ntt-t <= 20 AND nt=teamName AND no_<>'Unsuccessful', false) AS retained,
 CASE WHEN ntt-t <= 20 AND nt=teamName THEN np END AS receiver, CASE WHEN piece='corner' THEN CASE WHEN list_contains(qualifiers,'RightFoot') OR list_contains(qualifiers,'LeftFoot') THEN CASE WHEN (y >= 34) = list_contains(qualifiers,'RightFoot') THEN 'inswinger' ELSE 'outswinger' END ELSE 'unknown' END END AS swing,
 coalesce(xG,0) AS "xG", isGoal AS is_goal FROM spa)"""


SP_SQL = _sp_sql()


def plain(spark, sf_dir):
    return match_feed(spark, sf_dir, 20, 4, 14)


@query("set_piece_deliveries", "J16 A30 P36", FEED + SP_SQL + " SELECT * FROM spr")
def set_piece_deliveries(spark, sf_dir):
    return a.set_piece_deliveries(plain(spark, sf_dir))


@query("set_piece_summary", "A30", FEED + SP_SQL + f""",
g AS (SELECT matchId, teamName, piece, {n_sql("kind='delivery'")} AS "count", {n_sql("kind='delivery' AND successful")} AS completed, {n_sql("kind='delivery' AND " + BOX('end_x','end_y'))} AS into_box, {n_sql("kind='delivery' AND retained")} AS retained,
 {n_sql("kind='shot'")} AS shots_generated, {n_sql("kind='shot' AND is_goal")} AS goals_generated, {fsum_sql('''CASE WHEN kind='shot' THEN "xG" END''')} AS xg_generated FROM spr GROUP BY matchId, teamName, piece)
SELECT *, {pct_sql('completed','"count"')} AS completion_pct, {pct_sql('retained','"count"')} AS retention_pct FROM g""")
def set_piece_summary(spark, sf_dir):
    return a.set_piece_summary(a.set_piece_deliveries(plain(spark, sf_dir)))


@query("corners_won", "A30", FEED + f""" SELECT matchId, eventId, teamName, playerName, "minute", x, y FROM feed WHERE type='CornerAwarded' AND {OK}""")
def corners_won(spark, sf_dir):
    return a.corners_won(plain(spark, sf_dir))


@query("corner_breakdown", "A74", FEED + SP_SQL + f"""
SELECT matchId, teamName, CASE WHEN y >= 34 THEN 'left' ELSE 'right' END AS side, CASE WHEN NOT (end_x >= 88.5) THEN 'outside' WHEN ey >= 43.16 THEN 'near' WHEN ey >= 24.84 THEN 'central' ELSE 'far' END AS end_zone, count(*) AS corners, {n_sql('successful')} AS completed
FROM (SELECT *, CASE WHEN y < 34 THEN 68-end_y ELSE end_y END AS ey FROM spr WHERE kind='delivery' AND piece='corner') GROUP BY ALL""")
def corner_breakdown(spark, sf_dir):
    return a.corner_breakdown(a.set_piece_deliveries(plain(spark, sf_dir)))


@query("set_piece_takers", "A74", FEED + SP_SQL + f"""
SELECT matchId, teamName, piece, playerName, count(*) AS taken, {n_sql('successful')} AS completed, {n_sql('receiver IS NOT NULL')} AS found_team_mate FROM spr WHERE kind='delivery' GROUP BY ALL""")
def set_piece_takers(spark, sf_dir):
    return a.set_piece_takers(a.set_piece_deliveries(plain(spark, sf_dir)))
