"""Pass network, player metrics, channels, combinations."""

from pyspark.sql import functions as F

from touchline.catalog.feed_checks import feed_sql
from touchline.catalog.match_state import SCORE_SQL, XT_SQL
from touchline.catalog.registry import fmean_sql, fsum_sql, n_sql, pct_sql, query, ratio_sql
from touchline.functions.core import fixed
from touchline.operators import grids, state
from touchline.plans import possession_views as v
from touchline.sources.feed import match_feed

SQUAD = feed_sql(20, 4, 14)
SMALL_SQUAD = feed_sql(20, 12, 4)
OK = "outcomeType = 'Successful'"
GAIN = "(sqrt((105-x)*(105-x)+(34-y)*(34-y)) - sqrt((105-coalesce(endX,x))*(105-coalesce(endX,x))+(34-coalesce(endY,y))*(34-coalesce(endY,y))))"
NEED = "(CASE WHEN x < 52.5 AND coalesce(endX,x) < 52.5 THEN 30 WHEN x >= 52.5 AND coalesce(endX,x) >= 52.5 THEN 10 ELSE 15 END)"
PROG = f"({GAIN} >= {NEED})"
LEN = "sqrt((endX-x)*(endX-x)+(endY-y)*(endY-y))"
XF_SQL = XT_SQL + """,
xf AS (SELECT f.*, coalesce(xt.xt,0) AS xtv FROM feed f LEFT JOIN xt USING (eventId))"""
NP_SQL = XF_SQL + f""",
rr AS (SELECT *, lead(teamName) OVER w AS nt, lead(playerId) OVER w AS nid, lead(playerName) OVER w AS nn FROM xf WHERE type <> 'Card' WINDOW w AS (PARTITION BY matchId ORDER BY "index")),
np AS MATERIALIZED (SELECT *, nid AS receiver, nn AS rname, {PROG} AS prog FROM rr WHERE type='Pass' AND {OK} AND nt = teamName AND playerId > 0 AND nid > 0)"""


def feed(spark, sf_dir):
    return grids.with_xt(match_feed(spark, sf_dir, 20, 4, 14))


NODE_SQL = NP_SQL + f""",
rl AS (SELECT matchId, teamName, playerId, playerName AS pl, 'm' AS role, x, y, prog, {LEN} AS len FROM np UNION ALL SELECT matchId, teamName, receiver, rname, 'r', endX, endY, prog, NULL FROM np
  UNION ALL SELECT matchId, teamName, playerId, playerName, CASE WHEN type='Carry' THEN 'c' ELSE 't' END, NULL, NULL, type='Carry' AND {PROG}, NULL FROM xf WHERE type='Carry' OR (type='TakeOn' AND {OK})),
nd0 AS (SELECT matchId, teamName, playerId, min(pl) AS player, median(x) FILTER (WHERE role='m') AS play_x, median(y) FILTER (WHERE role='m') AS play_y, median(x) FILTER (WHERE role='r') AS receive_x,
  median(y) FILTER (WHERE role='r') AS receive_y, {n_sql("role='m'")} AS passes_made, {n_sql("role='r'")} AS passes_received, {n_sql("role='m' AND prog")} AS progressive_passes_made, {n_sql("role='r' AND prog")} AS progressive_passes_received,
  {n_sql("role='c'")} AS carries, {n_sql("role='c' AND prog")} AS progressive_carries, {n_sql("role='t'")} AS take_ons, coalesce({fmean_sql('len')},0) AS avg_pass_distance FROM rl GROUP BY matchId, teamName, playerId),
nd1 AS (SELECT *, (coalesce(play_x,receive_x)+coalesce(receive_x,play_x))/2 AS x, (coalesce(play_y,receive_y)+coalesce(receive_y,play_y))/2 AS y, passes_made+passes_received AS "count" FROM nd0 WHERE passes_made+passes_received > 0),
nodes AS MATERIALIZED (SELECT *, 18 + {ratio_sql('"count"', 'greatest(1, max("count") OVER (PARTITION BY matchId, teamName))', 38)} AS size, {ratio_sql('progressive_passes_made','greatest(1, max(progressive_passes_made) OVER (PARTITION BY matchId, teamName))')} AS progressive_intensity FROM nd1)"""


@query("pass_network_nodes", "A20 J17", SQUAD + NODE_SQL + " SELECT * FROM nodes")
def pass_network_nodes(spark, sf_dir):
    ev = feed(spark, sf_dir)
    return v.network_nodes(ev, v.network_passes(ev))


@query("pass_network_edges", "A20 J17", SQUAD + NODE_SQL + f""",
pe AS (SELECT matchId, teamName, playerId, receiver, count(*) AS pass_count, median(x) AS source_x, median(y) AS source_y, median(endX) AS target_x, median(endY) AS target_y, {fsum_sql('xtv')} AS total_xt, {n_sql('prog')} AS progressive_count
  FROM np WHERE playerId <> receiver GROUP BY matchId, teamName, playerId, receiver)
SELECT e.*, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, total_xt/pass_count AS avg_xt, greatest(0,total_xt)/greatest(0.001::double, max(greatest(0,total_xt)) OVER w) AS xt_intensity,
 {ratio_sql('progressive_count','greatest(1, max(progressive_count) OVER w)')} AS progressive_intensity, 0.8::double + {ratio_sql('pass_count','greatest(1, max(pass_count) OVER w)',4.6)} AS width
FROM pe e JOIN nodes a ON a.matchId=e.matchId AND a.teamName=e.teamName AND a.playerId=e.playerId JOIN nodes b ON b.matchId=e.matchId AND b.teamName=e.teamName AND b.playerId=e.receiver WINDOW w AS (PARTITION BY e.matchId, e.teamName)""")
def pass_network_edges(spark, sf_dir):
    ev = feed(spark, sf_dir)
    passes = v.network_passes(ev)
    return v.network_edges(passes, v.network_nodes(ev, passes))


@query("pass_network_heat", "A20", SQUAD + NP_SQL + """,
g AS (SELECT * FROM np WHERE xtv > 0), s AS (SELECT matchId, teamName, min(x) lx, max(x) hx, min(y) ly, max(y) hy FROM g GROUP BY ALL)
SELECT g.matchId, g.teamName, CAST(CASE WHEN hx > lx THEN greatest(0, least(13, ceil((x-lx)/((hx-lx)/14))-1)) ELSE 0 END AS INT) AS x_bin,
 CAST(CASE WHEN hy > ly THEN greatest(0, least(9, ceil((y-ly)/((hy-ly)/10))-1)) ELSE 0 END AS INT) AS y_bin, count(*) AS "count" FROM g JOIN s ON s.matchId=g.matchId AND s.teamName=g.teamName GROUP BY ALL""")
def pass_network_heat(spark, sf_dir):
    return v.network_heat(v.network_passes(feed(spark, sf_dir)))


@query("pass_network_centralization", "A20", SQUAD + NP_SQL + f""",
n AS (SELECT matchId, teamName, playerId, count(*) AS n FROM np GROUP BY ALL)
SELECT matchId, teamName, CAST(sum(n) AS BIGINT) AS total_passes, {ratio_sql('max(n)*count(*) - sum(n)','sum(n)*10')} AS centralization_index FROM n GROUP BY ALL""")
def pass_network_centralization(spark, sf_dir):
    return v.centralization(v.network_passes(feed(spark, sf_dir)))


UN_SQL = NP_SQL + f""",
un AS (SELECT matchId, teamName, least(playerId,receiver) AS a, greatest(playerId,receiver) AS b, count(*) AS n, {fsum_sql('xtv')} AS xt FROM np WHERE playerId<>receiver GROUP BY ALL)"""


@query("mutual_pass_pairs", "A69", SQUAD + UN_SQL + """
SELECT * FROM (SELECT matchId, teamName, a, b, n AS passes, xt, row_number() OVER (PARTITION BY matchId, teamName ORDER BY n DESC, a, b) AS "rank" FROM un) WHERE "rank" <= 5""")
def mutual_pass_pairs(spark, sf_dir):
    return v.mutual_pairs(v.network_passes(feed(spark, sf_dir)))


@query("network_triangles", "A69", SQUAD + UN_SQL + """,
t AS (SELECT x.matchId, x.teamName, x.a, x.b, y.b AS c, least(x.n,y.n,z.n) AS wk, x.n+y.n+z.n AS weight FROM un x JOIN un y ON y.matchId=x.matchId AND y.teamName=x.teamName AND y.a=x.b
  JOIN un z ON z.matchId=x.matchId AND z.teamName=x.teamName AND z.a=x.a AND z.b=y.b),
u AS (SELECT *, bool_or(wk>=3) OVER (PARTITION BY matchId, teamName) AS st FROM t)
SELECT matchId, teamName, a, b, c, weight, "rank" FROM (SELECT *, row_number() OVER (PARTITION BY matchId, teamName ORDER BY weight DESC, a, b, c) AS "rank" FROM u WHERE NOT st OR wk>=3) WHERE "rank" <= 3""")
def network_triangles(spark, sf_dir):
    return v.network_triangles(v.network_passes(feed(spark, sf_dir)))


@query("player_network_share", "A70", SQUAD + NP_SQL + f""",
e AS (SELECT matchId, teamName, playerId AS p, receiver AS r, count(*) AS n, {fsum_sql('xtv')} AS xt FROM np WHERE playerId<>receiver GROUP BY matchId, teamName, playerId, receiver),
b AS (SELECT matchId, teamName, p AS player, r AS other, n AS o, 0 AS i, xt AS xo, 0.0::double AS xi FROM e UNION ALL SELECT matchId, teamName, r, p, 0, n, 0, xt FROM e),
q AS (SELECT matchId, teamName, player, other, sum(o) AS o, sum(i) AS i, {fsum_sql('xo')} AS xo, {fsum_sql('xi')} AS xi FROM b GROUP BY matchId, teamName, player, other),
g AS (SELECT matchId, teamName, player, CAST(sum(o) AS BIGINT) AS passes_out, CAST(sum(i) AS BIGINT) AS passes_in, {fsum_sql('xo')} AS xt_out, {fsum_sql('xi')} AS xt_in, CAST(max(o+i) AS BIGINT) AS top_connection_passes FROM q GROUP BY ALL),
k AS (SELECT matchId, teamName, player, other FROM (SELECT *, row_number() OVER (PARTITION BY matchId, teamName, player ORDER BY o+i DESC, other) rn FROM q) WHERE rn=1)
SELECT g.*, k.other AS top_connection, {pct_sql('passes_out+passes_in','sum(passes_out) OVER (PARTITION BY g.matchId, g.teamName)')} AS network_share FROM g JOIN k USING (matchId, teamName, player)""")
def player_network_share(spark, sf_dir):
    return v.player_network(v.network_passes(feed(spark, sf_dir)))


@query("in_possession_actions", "A22 W17", SQUAD + SCORE_SQL + f""",
nx AS (SELECT *, lead(teamName) OVER w AS t1, lead(type,1) OVER w AS y1, lead(type,2) OVER w AS y2, lead(type,3) OVER w AS y3 FROM gamestate WINDOW w AS (PARTITION BY matchId ORDER BY "index"))
SELECT matchId, eventId, teamName, playerName, "minute", "second", type, type='Carry' OR {OK} AS is_successful, x, y, coalesce(endX,x) AS end_x, coalesce(endY,y) AS end_y, coalesce(xA,0) AS "xA", {PROG} AS is_progressive, team_score_state,
 y1 AS next_1_type, y2 AS next_2_type, y3 AS next_3_type, coalesce(t1=teamName,false) AS next_team_retained FROM nx WHERE type IN ('Pass','Carry','TakeOn')""")
def in_possession_actions(spark, sf_dir):
    return v.in_possession_actions(state.with_score(match_feed(spark, sf_dir, 20, 4, 14)))


@query("in_possession_player_metrics", "A23", SQUAD + NP_SQL + f""",
rc AS (SELECT matchId, rname AS pl, count(*) AS n, {n_sql('prog')} AS np FROM np GROUP BY ALL)
SELECT f.matchId, f.playerName, min(f.teamName) AS "teamName", {n_sql('isTouch')} AS touches, {n_sql("type='Pass'")} AS passes_attempted, {n_sql("type='Pass' AND " + OK)} AS passes_completed, coalesce(max(rc.n),0) AS passes_received,
 coalesce({fmean_sql(f"CASE WHEN type='Pass' AND {OK} THEN {LEN} END")},0) AS avg_pass_distance, {n_sql(f"type='Pass' AND {OK} AND {PROG}")} AS progressive_passes, coalesce(max(rc.np),0) AS progressive_passes_received,
 {n_sql(f"type='Pass' AND {OK} AND endX > 75")} AS final_third_passes, {n_sql(f"type='Pass' AND {OK} AND endX >= 88.5 AND endY BETWEEN 13.6 AND 54.4")} AS box_passes, {n_sql("list_contains(qualifiers,'KeyPass')")} AS key_passes,
 {fsum_sql("CASE WHEN type='Pass' THEN xA END")} AS "xA", {fsum_sql("CASE WHEN type IN ('Pass','Carry') THEN xtv END")} AS "xT", {n_sql("type='Carry'")} AS carries, {n_sql("type='Carry' AND " + PROG)} AS progressive_carries,
 {n_sql("type='TakeOn' AND " + OK)} AS take_ons_won, CAST(sum(turnover::int + (type='Dispossessed')::int) AS BIGINT) AS turnovers, {pct_sql(n_sql("type='Pass' AND " + OK), n_sql("type='Pass'"))} AS pass_accuracy
FROM xf f LEFT JOIN rc ON rc.matchId=f.matchId AND rc.pl=f.playerName GROUP BY f.matchId, f.playerName""")
def in_possession_player_metrics(spark, sf_dir):
    return v.in_possession_metrics(feed(spark, sf_dir))


CH = lambda y: f"CASE WHEN {y} >= 54.4 THEN 'left_wing' WHEN {y} >= 40.8 THEN 'left_half_space' WHEN {y} >= 27.2 THEN 'central' WHEN {y} >= 13.6 THEN 'right_half_space' WHEN {y} >= 0 THEN 'right_wing' END"
LANE = lambda y: f"CASE WHEN {y} >= 54.16 THEN 'left_wing' WHEN {y} >= 43.16 THEN 'left_half_space' WHEN {y} >= 24.84 THEN 'central' WHEN {y} >= 13.84 THEN 'right_half_space' ELSE 'right_wing' END"
ZONE = lambda x, y: (f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} >= 88.5 AND {y} >= 13.84 AND {y} < 54.16 THEN concat({LANE(y)}, CASE WHEN {x} >= 99.5 THEN '_box_6yd' ELSE '_box_entry' END) "  # noqa: E731
                     f"ELSE concat({LANE(y)}, '_z', CASE WHEN {x} >= 88.5 THEN 6 WHEN {x} >= 70.5 THEN 5 WHEN {x} >= 52.5 THEN 4 WHEN {x} >= 34.5 THEN 3 WHEN {x} >= 16.5 THEN 2 ELSE 1 END) END")


def area_sql(origin: str, dest: str, entries: bool) -> str:
    restart = "list_has_any(qualifiers, ['CornerTaken','FreekickTaken','ThrowIn','GoalKick'])"
    base = XF_SQL + f""",
ob AS (SELECT *, {OK} AS ok, {PROG} AS prog FROM xf WHERE type IN ('Pass','Carry','TakeOn') AND NOT {restart}),
aa AS (SELECT *, 'origin' AS "view", {origin} AS area FROM ob UNION ALL SELECT *, 'destination', {dest} FROM ob),
ap AS (SELECT matchId, teamName, "view", area, playerName, {fsum_sql('CASE WHEN ok THEN greatest(xtv,0) END')} AS g FROM aa WHERE area IS NOT NULL GROUP BY matchId, teamName, "view", area, playerName),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY matchId, teamName, "view", area ORDER BY g DESC, playerName) rn FROM ap WHERE g > 0) WHERE rn=1),
ar AS (SELECT matchId, teamName, "view", area, count(*) AS touches, {n_sql("type='Pass'")} AS passes, {n_sql("type='Pass' AND ok")} AS passes_completed, {n_sql('ok AND prog')} AS progressive_actions,
 {fsum_sql('CASE WHEN ok THEN greatest(xtv,0) END')} AS xt_gained, {fsum_sql('CASE WHEN ok THEN least(xtv,0) END')} AS xt_lost,
 {ratio_sql(fsum_sql('CASE WHEN ok AND prog THEN endX-x END'), n_sql('ok AND prog'))} AS flow_dx, {ratio_sql(fsum_sql('CASE WHEN ok AND prog THEN endY-y END'), n_sql('ok AND prog'))} AS flow_dy
 FROM aa WHERE area IS NOT NULL GROUP BY matchId, teamName, "view", area)
"""
    e_cte = f""", en AS (SELECT matchId, teamName, {dest} AS area, count(*) AS n FROM ob WHERE ok AND endX >= 70 GROUP BY ALL)""" if entries else ""
    e_col = ", coalesce(en.n,0) AS final_third_entries" if entries else ""
    e_join = "LEFT JOIN en ON en.matchId=a.matchId AND en.teamName=a.teamName AND en.area=a.area" if entries else ""
    return base + e_cte + f"""
SELECT a.*, CAST(floor((xt_gained+xt_lost)*1e6+0.5) AS BIGINT) AS xt_micro, t.playerName AS top_player, coalesce(t.g,0) AS top_player_xt,
 CASE WHEN sum(xt_gained) OVER w > 0 THEN CAST(floor(xt_gained/sum(xt_gained) OVER w*1e6+0.5) AS BIGINT) ELSE 0 END AS share_micro {e_col}
FROM ar a LEFT JOIN tp t ON t.matchId=a.matchId AND t.teamName=a.teamName AND t."view"=a."view" AND t.area=a.area {e_join} WINDOW w AS (PARTITION BY a.matchId, a.teamName, a."view")"""


def _area(df):
    return df.withColumn("xt_micro", fixed(F.col("xt"))).withColumn("share_micro", fixed(F.col("xt_share"))).drop("xt", "xt_share")


@query("channel_profile", "A24 P27", SQUAD + area_sql(CH("y"), CH("endY"), True))
def channel_profile(spark, sf_dir):
    return _area(v.area_profile(feed(spark, sf_dir), "channel"))


@query("zone_profile", "A24 P27", SQUAD + area_sql(ZONE("x", "y"), ZONE("endX", "endY"), False))
def zone_profile(spark, sf_dir):
    return _area(v.area_profile(feed(spark, sf_dir), "zone"))


@query("pass_pairs", "A25", SQUAD + NP_SQL + f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY matchId, teamName ORDER BY "count" DESC, playerId, receiver) AS "rank" FROM (
 SELECT matchId, teamName, playerId, receiver, count(*) AS "count", {fsum_sql('xtv')} AS xt, median(x) AS avg_x, median(y) AS avg_y, median(endX) AS avg_end_x, median(endY) AS avg_end_y FROM np WHERE playerId<>receiver GROUP BY matchId, teamName, playerId, receiver)) WHERE "rank" <= 12""")
def pass_pairs(spark, sf_dir):
    return v.pass_pairs(v.network_passes(feed(spark, sf_dir)))


CHAIN_SQL = NP_SQL + """,
kp AS (SELECT *, "minute"*60+"second" AS t FROM np WHERE playerId<>receiver),
kc AS (SELECT *, lag(playerId,1) OVER w AS p1, lag(receiver,1) OVER w AS r1, lag(x,1) OVER w AS x1, lag(y,1) OVER w AS y1, lag(t,1) OVER w AS t1, lag(playerId,2) OVER w AS p2, lag(receiver,2) OVER w AS r2, lag(t,2) OVER w AS t2
  FROM kp WINDOW w AS (PARTITION BY matchId, teamName ORDER BY "index"))"""


@query("one_twos", "A25 W18", SQUAD + CHAIN_SQL + """
SELECT * FROM (SELECT matchId, teamName, eventId, p1 AS player_a, r1 AS player_b, CAST(t1 // 60 AS INT) AS "minute", x1 AS x, y1 AS y, endX AS end_x, endY AS end_y, endX - x1 AS gain,
 row_number() OVER (PARTITION BY matchId, teamName ORDER BY endX - x1 DESC, eventId) AS "rank" FROM kc WHERE r1 = playerId AND p1 = receiver AND t - t1 <= 8 AND endX > x1 + 5.0::double) WHERE "rank" <= 15""")
def one_twos(spark, sf_dir):
    return v.one_twos(v.pass_chains(v.network_passes(feed(spark, sf_dir))))


@query("passing_triangles", "A25 W18", SMALL_SQUAD + CHAIN_SQL + """,
h AS (SELECT matchId, teamName, array_to_string(list_sort([p2, p1, playerId]), ',') AS players FROM kc WHERE r2 = p1 AND r1 = playerId AND t - t2 <= 20 AND p2 <> playerId AND p2 <> p1 AND p1 <> playerId),
g AS (SELECT matchId, teamName, players, count(*) AS "count" FROM h GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY matchId, teamName ORDER BY "count" DESC, players) AS "rank" FROM g) WHERE "rank" <= 6 AND "count" >= 2""")
def passing_triangles(spark, sf_dir):
    return v.passing_triangles(v.pass_chains(v.network_passes(grids.with_xt(match_feed(spark, sf_dir, 20, 12, 4)))))


_HALF = lambda x, y: f"({x} >= 52.5 AND ({y} BETWEEN 18 AND 30 OR {y} BETWEEN 38 AND 50))"
_REACH = lambda e, per, top: f"least({float(top)}::double, ({e})/greatest(1.0::double, n*{float(per)}::double)*{float(top)}::double)"
_THREAT = lambda top, w: f"least({float(top)}::double, greatest(0, xt)*{float(w)}::double)"
_POINTS = {
    "Build-up Control": f"{_REACH('passes', 8, 42)} + {_REACH('links', 2.4, 28)} + {_THREAT(14, 42)}",
    "Progressive Passing": f"{_REACH('prog+pc', 3.4, 58)} + {_THREAT(16, 42)} + {_REACH('wide+direct', 1.4, 12)}",
    "Wide Progression": f"{_REACH('wide', 1.35, 58)} + {_REACH('prog+pc', 4.5, 16)} + {_REACH('tk', 1.6, 10)}",
    "Central Access": f"{_REACH('central_passes', 7, 58)} + {_REACH('central', 1.8, 22)} + {_THREAT(10, 28)}",
    "Final Third Threat": f"{_REACH('final', 1.25, 56)} + {_THREAT(24, 58)}",
    "Directness": f"{_REACH('direct', 1.45, 68)} + {_REACH('prog+pc', 5.5, 14)}"}
EDGE_SQL = NODE_SQL + f""",
pe AS (SELECT matchId, teamName, playerId, receiver, count(*) AS pass_count, median(x) AS source_x, median(y) AS source_y, median(endX) AS target_x, median(endY) AS target_y, {fsum_sql('xtv')} AS total_xt, {n_sql('prog')} AS progressive_count
  FROM np WHERE playerId <> receiver GROUP BY matchId, teamName, playerId, receiver),
ed AS (SELECT e.*, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, greatest(b.x, target_x) - least(a.x, source_x) AS gain FROM pe e JOIN nodes a ON a.matchId=e.matchId AND a.teamName=e.teamName AND a.playerId=e.playerId JOIN nodes b ON b.matchId=e.matchId AND b.teamName=e.teamName AND b.playerId=e.receiver),
fl AS MATERIALIZED (SELECT *, (y1 <= 18 OR y1 >= 50 OR target_y <= 18 OR target_y >= 50) AND (progressive_count >= 1 OR gain >= 10) AND pass_count >= 2 AS wd, {_HALF('x0','y0')} OR {_HALF('x1','y1')} OR {_HALF('source_x','source_y')} OR {_HALF('target_x','target_y')} AS ce,
  sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) >= 34 OR (progressive_count >= 2 AND gain >= 15) AS dr, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS far, x1 >= 70 OR target_x >= 70 AS fin,
  total_xt >= 0.03::double OR total_xt/pass_count >= 0.01::double AS th FROM ed)"""
PROFILE_SQL = EDGE_SQL + f""",
es AS (SELECT matchId, teamName, sum(pass_count) AS passes, count(*) AS links, sum(progressive_count) AS prog, {fsum_sql('total_xt')} AS xt, {n_sql('x1 >= 70 OR target_x >= 70')} AS final, {n_sql('wd')} AS wide, {n_sql('ce')} AS central, sum(CASE WHEN ce THEN pass_count ELSE 0 END) AS central_passes, {n_sql('dr')} AS direct FROM fl GROUP BY ALL),
ns AS (SELECT matchId, teamName, count(*) AS n, sum(progressive_carries) AS pc, sum(take_ons) AS tk FROM nodes GROUP BY ALL),
sc AS MATERIALIZED (SELECT * FROM es JOIN ns USING (matchId, teamName)),
lg AS MATERIALIZED (""" + " UNION ALL ".join(f"SELECT matchId, teamName, '{k}' AS profile, CAST(floor(greatest(0, least(100, {e}))+0.5) AS INT) AS score FROM sc" for k, e in _POINTS.items()) + """)
SELECT a.*, CAST(CASE WHEN b.score IS NULL THEN a.score ELSE floor(greatest(0, least(100, 50 + (a.score-b.score)*0.65::double))+0.5) END AS INT) AS matchup_score FROM lg a LEFT JOIN lg b ON a.matchId=b.matchId AND a.profile=b.profile AND a.teamName<>b.teamName"""


@query("team_possession_profiles", "A60", SQUAD + PROFILE_SQL)
def team_possession_profiles(spark, sf_dir):
    return v.team_possession_profiles(*_network(spark, sf_dir))


def _network(spark, sf_dir):
    ev = feed(spark, sf_dir)
    passes = v.network_passes(ev)
    nodes = v.network_nodes(ev, passes)
    return nodes, v.network_edges(passes, nodes)


_ONWARD, _REPEAT = ("progressive_count > 0", "progressive_count"), ("pass_count >= 3", "pass_count")
_WIDE = ("wd", "progressive_count*2 + greatest(0, gain/10) + pass_count*0.35::double")
_FINAL = ("fin AND th", "pass_count + greatest(0, total_xt*35)")
_EDGES = {
    "Build-up Control": _REPEAT, "Progressive Passing": _ONWARD, "Wide Progression": _WIDE, "Central Access": ("ce", "pass_count + greatest(0, total_xt*20)"),
    "Final Third Threat": _FINAL, "Directness": ("dr", "greatest(1, far/18) + progressive_count*1.5::double"), "Progressor": _ONWARD, "Connector": _REPEAT,
    "Final Third Creator": _FINAL, "Outlet Receiver": ("progressive_count > 0 OR fin", "pass_count + progressive_count*2"), "Build-up Anchor": ("x0 <= 45 AND pass_count >= 2", "pass_count"),
    "Advanced Link Player": ("x1 >= 62 AND (th OR progressive_count > 0)", "pass_count + greatest(0, total_xt*30)"), "Wide Outlet": _WIDE}


@query("profile_edges", "A60", SQUAD + EDGE_SQL + " " + " UNION ALL ".join(
    f"SELECT matchId, teamName, playerId, receiver, '{k}' AS profile, CAST(floor(({w})::double*1e6+0.5) AS BIGINT) AS weight_micro FROM fl WHERE {on}" for k, (on, w) in _EDGES.items()))
def profile_edges(spark, sf_dir):
    return v.profile_edges(_network(spark, sf_dir)[1]).withColumn("weight_micro", fixed(F.col("weight"))).drop("weight")


_SHARE = lambda n, top, w: f"({n})::double/greatest(1.0::double, max({top}) OVER side)*{float(w)}::double"
_GOAL = lambda n, goal, w: f"least({float(w)}::double, ({n})::double/{float(goal)}::double*{float(w)}::double)"
_XT, _TAKE = "greatest(0, xo)", "take_ons"
_ACTS = "progressive_passes_made+progressive_carries"
_ROLES = [
    ("Progressor", "true", _SHARE("po+progressive_carries", _ACTS, 46) + " + " + _SHARE(_XT, "xo", 26) + " + " + _SHARE(_TAKE, _TAKE, 8)),
    ("Connector", "true", _SHARE('"count"', '"count"', 46) + " + " + _SHARE("links", "links", 28) + " + " + _GOAL('"count"', 30, 10)),
    ("Final Third Creator", "true", _SHARE("fo", "fo", 42) + " + " + _SHARE(_XT, "xo", 28) + " + " + _SHARE(_TAKE, _TAKE, 8)),
    ("Outlet Receiver", "true", _SHARE("progressive_passes_received", "progressive_passes_received", 42) + " + " + _SHARE("passes_received", "passes_received", 34) + " + " + _GOAL("passes_received", 18, 8)),
    ("Build-up Anchor", "x <= 45", _SHARE("passes_made", '"count"', 34) + " + " + _SHARE("de", "de", 44) + " + " + _GOAL("de", 8, 8)),
    ("Advanced Link Player", "x >= 60", _SHARE("hi", "hi", 40) + " + " + _SHARE(_XT, "xo", 26) + " + " + _SHARE(_TAKE, _TAKE, 10)),
    ("Wide Outlet", "(y <= 20 OR y >= 48)", _SHARE("wi", "wi", 42) + " + " + _SHARE("pi", "progressive_passes_received", 22)
     + f" + (progressive_carries+take_ons)::double/(greatest(1.0::double, max({_ACTS}) OVER side)+greatest(1.0::double, max(take_ons) OVER side))*12.0::double")]


@query("player_roles", "A60", SQUAD + EDGE_SQL + f""",
en AS (SELECT matchId, teamName, playerId AS pid, true AS o, * EXCLUDE (matchId, teamName, playerId) FROM fl UNION ALL SELECT matchId, teamName, receiver, false, * EXCLUDE (matchId, teamName, playerId) FROM fl),
ow AS (SELECT matchId, teamName, pid, count(*) AS links, sum(CASE WHEN o THEN progressive_count ELSE 0 END) AS po, sum(CASE WHEN o THEN 0 ELSE progressive_count END) AS pi, {fsum_sql('CASE WHEN o THEN total_xt END')} AS xo,
  {n_sql('o AND x1 >= 70')} AS fo, {n_sql('x0 <= 45')} AS de, {n_sql('x1 >= 62')} AS hi, {n_sql('wd')} AS wi FROM en GROUP BY ALL),
pl AS (SELECT n.*, coalesce(links,0) AS links, coalesce(po,0) AS po, coalesce(pi,0) AS pi, coalesce(xo,0) AS xo, coalesce(fo,0) AS fo, coalesce(de,0) AS de, coalesce(hi,0) AS hi, coalesce(wi,0) AS wi
  FROM nodes n LEFT JOIN ow ON ow.matchId=n.matchId AND ow.teamName=n.teamName AND ow.pid=n.playerId),
sc AS MATERIALIZED (SELECT matchId, teamName, playerId, player, x, y, """ + ", ".join(f"CAST(floor(greatest(0, least(100, {e}))+0.5) AS INT) AS s{i}" for i, (_, _, e) in enumerate(_ROLES)) + """ FROM pl WINDOW side AS (PARTITION BY matchId, teamName)),
lg AS (""" + " UNION ALL ".join(f"SELECT matchId, teamName, playerId, player, '{k}' AS role, s{i} AS score, {i} AS place FROM sc WHERE {on}" for i, (k, on, _) in enumerate(_ROLES)) + """)
SELECT matchId, teamName, playerId, player, role, score, CAST(row_number() OVER (PARTITION BY matchId, teamName, playerId ORDER BY score DESC, place) AS INT) AS "rank" FROM lg""")
def player_roles(spark, sf_dir):
    return v.player_roles(*_network(spark, sf_dir))
