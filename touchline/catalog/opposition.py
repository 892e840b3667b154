"""Season comparison and opposition scouting."""

from pyspark.sql import functions as F

from touchline.catalog.feed_checks import FEED4
from touchline.catalog.match_state import SCORE_SQL
from touchline.catalog.registry import fmean_sql, fsum_sql, n_sql, query, ratio_sql
from touchline.catalog.season import PLAYER_SQL, TEAM_SQL, team_rows
from touchline.operators import state
from touchline.plans import comparison as cmp, opposition as o, season
from touchline.sources.feed import match_feed

LOW = "('" + "','".join(cmp.LOWER_IS_BETTER) + "')"


def light_players(spark, sf_dir):
    ev = match_feed(spark, sf_dir, 4).withColumn("xT", F.lit(None).cast("double")).withColumn("epv_added", F.lit(None).cast("double"))
    return season.player_match_stats(ev)


def long_sql(rel: str, keys: str, metrics, name: str) -> str:
    parts = " UNION ALL ".join(f"""SELECT {keys}, '{m}' AS metric, "{m}"::double AS value FROM {rel}""" for m in metrics)
    return f"{name} AS (SELECT * FROM ({parts}) WHERE value IS NOT NULL)"


BASE_SQL = TEAM_SQL + ",\n" + long_sql("tm", 'league, season, matchId, date, teamName, "opponentName"', cmp.TEAM_METRICS, "lv") + f""",
ow AS (SELECT a.matchId, a.teamName, a.metric, count(*) AS n, {fmean_sql('b.value')} AS mean, median(b.value) AS median, quantile_cont(b.value, 0.25) AS p25, quantile_cont(b.value, 0.75) AS p75, min(b.value) AS "min", max(b.value) AS "max",
  stddev_pop(b.value) AS sd, {n_sql('b.value < a.value')} AS lt, {n_sql('b.value > a.value')} AS gt FROM lv a JOIN lv b ON a.league=b.league AND a.season=b.season AND a.teamName=b.teamName AND a.metric=b.metric AND a.matchId<>b.matchId GROUP BY a.matchId, a.teamName, a.metric),
lg AS (SELECT a.matchId, a.teamName, a.metric, {n_sql('b.value < a.value')} AS lt, count(*) AS n FROM lv a JOIN lv b ON a.league=b.league AND a.season=b.season AND a.metric=b.metric AND a.matchId<>b.matchId GROUP BY a.matchId, a.teamName, a.metric),
l5 AS (SELECT matchId, teamName, metric, {fmean_sql('bv')} AS m FROM (SELECT a.matchId, a.teamName, a.metric, b.value AS bv, row_number() OVER (PARTITION BY a.matchId, a.teamName, a.metric ORDER BY b.date DESC, b.matchId DESC) AS rn
  FROM lv a JOIN lv b ON a.league=b.league AND a.season=b.season AND a.teamName=b.teamName AND a.metric=b.metric AND a.matchId<>b.matchId) WHERE rn <= 5 GROUP BY matchId, teamName, metric),
vo AS (SELECT a.matchId, a.teamName, a.metric, count(*) AS n, {fmean_sql('b.value')} AS mean, median(b.value) AS median, quantile_cont(b.value, 0.25) AS p25, quantile_cont(b.value, 0.75) AS p75, min(b.value) AS mn, max(b.value) AS mx
  FROM lv a JOIN lv b ON a.league=b.league AND a.season=b.season AND a."opponentName"=b."opponentName" AND a.metric=b.metric AND a.matchId<>b.matchId GROUP BY a.matchId, a.teamName, a.metric),
bl AS (SELECT lv.*, ow.n, ow.mean, ow.median, ow.p25, ow.p75, ow."min", ow."max", value-ow.mean AS delta, CASE WHEN sd > 1e-9 THEN (value-ow.mean)/sd ELSE 0 END AS z, CASE WHEN lv.metric IN {LOW} THEN ow.lt ELSE ow.gt END + 1 AS game_rank,
  CASE WHEN lv.metric IN {LOW} THEN 100 - ow.lt*100.0::double/ow.n ELSE ow.lt*100.0::double/ow.n END AS own_percentile, CASE WHEN lv.metric IN {LOW} THEN 100 - lg.lt*100.0::double/lg.n ELSE lg.lt*100.0::double/lg.n END AS league_percentile, l5.m AS last5_mean,
  CASE WHEN vo.n >= 4 THEN vo.n END AS vn, CASE WHEN vo.n >= 4 THEN vo.mean END AS vmean, CASE WHEN vo.n >= 4 THEN vo.median END AS vmed, CASE WHEN vo.n >= 4 THEN vo.p25 END AS vp25, CASE WHEN vo.n >= 4 THEN vo.p75 END AS vp75, CASE WHEN vo.n >= 4 THEN vo.mn END AS vmin, CASE WHEN vo.n >= 4 THEN vo.mx END AS vmax
  FROM lv JOIN ow USING (matchId, teamName, metric) JOIN lg USING (matchId, teamName, metric) JOIN l5 USING (matchId, teamName, metric) LEFT JOIN vo USING (matchId, teamName, metric) WHERE ow.n >= 4)"""
_MIC = ["median", "p25", "p75", "delta", "z_score", "own_percentile", "league_percentile", "last5_mean", "vs_opponent_mean", "vs_opponent_median", "vs_opponent_p25", "vs_opponent_p75"]
_SQLN = {"z_score": "z", "vs_opponent_mean": "vmean", "vs_opponent_median": "vmed", "vs_opponent_p25": "vp25", "vs_opponent_p75": "vp75"}


@query("team_season_baseline", "A36 J23 J24 W12 W13", BASE_SQL + """
SELECT league, season, matchId, date, teamName, "opponentName", metric, value, CAST(n AS INT) AS n, mean, "min", "max", game_rank, CAST(vn AS INT) AS vs_opponent_n, vmin AS vs_opponent_min, vmax AS vs_opponent_max, """ + ", ".join(
    f"CAST(floor({_SQLN.get(m, m)}*1e4+0.5) AS BIGINT) AS {m}" for m in _MIC) + " FROM bl")
def team_season_baseline(spark, sf_dir):
    out = cmp.team_baseline(team_rows(spark, sf_dir))
    return out.withColumns({m: F.floor(F.col(m) * 1e4 + 0.5).cast("bigint") for m in _MIC})


@query("season_delta_pct", "A65", BASE_SQL + """
SELECT matchId, teamName, metric, value, mean, CAST(floor((value-mean)*100/greatest(abs(mean), 0.5)*1e4+0.5) AS BIGINT) AS delta_pct FROM bl""")
def season_delta_pct(spark, sf_dir):
    out = cmp.season_delta(cmp.team_baseline(team_rows(spark, sf_dir)))
    return out.withColumn("delta_pct", F.floor(F.col("delta_pct") * 1e4 + 0.5).cast("bigint"))


@query("player_season_baseline", "A36", PLAYER_SQL + ",\n" + long_sql("pm", 'league, season, matchId, playerName, mins_played', cmp.PLAYER_METRICS, "lv") + f""",
pa AS (SELECT *, count(*) OVER w - 1 AS n, (sum(cast(floor(value*1e6+0.5) as bigint)) OVER w - cast(floor(value*1e6+0.5) as bigint))::double/1e6 AS s, CAST(sum(mins_played) OVER w - mins_played AS BIGINT) AS m, rank() OVER (PARTITION BY league, season, playerName, metric ORDER BY value DESC) AS game_rank
  FROM lv WINDOW w AS (PARTITION BY league, season, playerName, metric))
SELECT league, season, matchId, playerName, metric, value, n, s/n AS mean, game_rank, {ratio_sql('s','greatest(1,m)',90)} AS season_per90, {ratio_sql('value','greatest(1,mins_played)',90)} AS match_per90, m < 450 AS low_sample FROM pa WHERE n >= 1""")
def player_season_baseline(spark, sf_dir):
    return cmp.player_baseline(light_players(spark, sf_dir))


HIST = [m for m in cmp.HISTORY_METRICS if m != "xT"]


@query("player_history", "A32 W12", PLAYER_SQL + f""",
pt AS (SELECT league, season, playerName, count(*) AS matches, CAST(sum(mins_played) AS BIGINT) AS minutes, {", ".join(fsum_sql(chr(34) + m + chr(34)) + f' AS "{m}"' for m in HIST)} FROM pm GROUP BY league, season, playerName HAVING sum(mins_played) >= 300),
{long_sql('pt', 'league, season, playerName, matches, minutes', HIST, 'lv')},
rt AS (SELECT *, value*90.0::double/minutes AS per90 FROM lv)
SELECT league, season, playerName, matches, minutes, metric, value AS total, per90, (rank() OVER (PARTITION BY league, season, metric ORDER BY per90) - 1)*100.0::double/count(*) OVER (PARTITION BY league, season, metric) AS percentile FROM rt""")
def player_history(spark, sf_dir):
    return cmp.player_history(light_players(spark, sf_dir), metrics=HIST)


REP_SQL = TEAM_SQL + ",\n" + long_sql("tm", "league, season, teamName", o.REPORT_METRICS, "lv") + f""",
mn AS (SELECT league, season, teamName, metric, {fmean_sql('value')} AS value FROM lv GROUP BY ALL),
pc0 AS (SELECT m.*, (SELECT count(*) FILTER (WHERE v.value < m.value)*100.0::double/count(*) FROM lv v WHERE v.league=m.league AND v.season=m.season AND v.metric=m.metric) AS p FROM mn m),
pc1 AS (SELECT league, season, teamName, metric, value, CASE WHEN metric IN {LOW} THEN 100-p ELSE p END AS percentile FROM pc0),
pc AS (SELECT *, CASE WHEN percentile >= 70 THEN 'strength' WHEN percentile <= 30 THEN 'weakness' END AS tag FROM pc1)"""


@query("opposition_percentiles", "A37 A38 W12", REP_SQL + " SELECT * FROM pc")
def opposition_percentiles(spark, sf_dir):
    return o.report_percentiles(team_rows(spark, sf_dir))


@query("opposition_strengths", "A37 A38", REP_SQL + f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY league, season, teamName, tag ORDER BY CASE WHEN tag='strength' THEN -percentile ELSE percentile END, metric) AS "rank" FROM pc WHERE tag IS NOT NULL AND metric NOT IN ('possession_pct','long_balls')) WHERE "rank" <= 6""")
def opposition_strengths(spark, sf_dir):
    return o.strengths_and_weaknesses(o.report_percentiles(team_rows(spark, sf_dir)))


KEY_SQL = PLAYER_SQL + f""",
kp AS (SELECT league, season, teamName, playerName, CAST(sum(goals) AS BIGINT) AS goals, {fsum_sql('"xG"')} AS xg, {fsum_sql('"xA"')} AS xa, CAST(sum(shots) AS BIGINT) AS shots, CAST(sum(mins_played) AS BIGINT) AS mins FROM pm GROUP BY league, season, teamName, playerName),
kt AS (SELECT *, CAST(floor(xg*1e6+0.5) AS BIGINT) + CAST(floor(xa*1e6+0.5) AS BIGINT) + shots*30000 AS threat_micro FROM kp)"""


@query("key_players", "A37 A41", KEY_SQL + """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY league, season, teamName ORDER BY threat_micro DESC, mins DESC, playerName) AS "rank" FROM kt) WHERE "rank" <= 6""")
def key_players(spark, sf_dir):
    return o.key_players(light_players(spark, sf_dir))


@query("role_rankings", "A41", PLAYER_SQL + ",\n" + """rr AS (SELECT league, season, teamName, playerName, CAST(sum(mins_played) AS BIGINT) AS mins, """ + ", ".join(
    f"""CAST(sum(CAST(floor("{m}"*1e6+0.5) AS BIGINT)) AS BIGINT) AS "{r}" """ for r, m in o.ROLES.items()) + """ FROM pm GROUP BY league, season, teamName, playerName),
ru AS (""" + " UNION ALL ".join(f"SELECT league, season, teamName, playerName, mins, '{r}' AS role, \"{r}\" AS micro FROM rr" for r in o.ROLES) + """)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY league, season, teamName, role ORDER BY micro DESC, mins DESC, playerName) AS "rank" FROM ru) WHERE "rank" <= 5""")
def role_rankings(spark, sf_dir):
    return o.role_rankings(light_players(spark, sf_dir))


_RES = "CASE WHEN goals > goals_against THEN 'W' WHEN goals = goals_against THEN 'D' ELSE 'L' END"
_AVG = lambda names: ", ".join(fmean_sql(chr(34) + m + chr(34) + "::double") + f' AS "avg_{m}"' for m in names)


@query("recent_form", "A38", TEAM_SQL + f"""
SELECT league, season, teamName, {n_sql(_RES + "='W'")} AS wins, {n_sql(_RES + "='D'")} AS draws, {n_sql(_RES + "='L'")} AS losses, {_AVG(('goals','goals_against','xG','xG_against','shots','shots_against'))}
FROM (SELECT *, row_number() OVER (PARTITION BY league, season, teamName ORDER BY date DESC, matchId DESC) AS n FROM tm) WHERE n <= 5 GROUP BY league, season, teamName""")
def recent_form(spark, sf_dir):
    return o.recent_form(team_rows(spark, sf_dir))


@query("home_away_split", "A38", TEAM_SQL + f"""
SELECT league, season, teamName, "homeAway", count(*) AS matches, {n_sql(_RES + "='W'")} AS wins, {n_sql(_RES + "='D'")} AS draws, {n_sql(_RES + "='L'")} AS losses, {_AVG(('goals','goals_against','xG','xG_against','shots','shots_against','possession_pct','ppda'))}
FROM tm GROUP BY league, season, teamName, "homeAway" """)
def home_away_split(spark, sf_dir):
    return o.home_away_split(team_rows(spark, sf_dir))


STYLE_SQL = TEAM_SQL + ",\n" + long_sql("tm", "league, season, teamName", o.PROFILE, "lv") + f""",
mn AS (SELECT league, season, teamName, metric, {fmean_sql('value')} AS value FROM lv GROUP BY ALL),
zs AS (SELECT *, (value - avg(value) OVER w) / CASE WHEN coalesce(stddev_samp(value) OVER w, 0) = 0 THEN 1 ELSE stddev_samp(value) OVER w END AS z FROM mn WINDOW w AS (PARTITION BY league, season, metric)),
ds AS (SELECT a.league, a.season, b.teamName AS reference, a.teamName, round(sqrt(sum((a.z-b.z)*(a.z-b.z))), 4) AS distance FROM zs a JOIN zs b ON a.league=b.league AND a.season=b.season AND a.metric=b.metric AND a.teamName<>b.teamName GROUP BY ALL),
dr AS (SELECT *, round(100/(1+distance), 1) AS similarity, row_number() OVER (PARTITION BY league, season, reference ORDER BY distance, teamName) AS "rank" FROM ds)"""


@query("style_profiles", "A43", STYLE_SQL + " SELECT league, season, teamName, metric, value AS mean FROM mn")
def style_profiles(spark, sf_dir):
    return o.style_profiles(team_rows(spark, sf_dir))


@query("style_distance", "J25", STYLE_SQL + " SELECT * FROM dr")
def style_distance(spark, sf_dir):
    return o.style_distance(team_rows(spark, sf_dir))


@query("comparable_matches", "J26 A43", STYLE_SQL + f""",
pr AS (SELECT league, season, reference, teamName AS opponent FROM dr),
nb AS (SELECT p.league, p.season, p.reference, p.opponent, d.teamName AS peer, row_number() OVER (PARTITION BY p.league, p.season, p.reference, p.opponent ORDER BY d."rank") AS k FROM pr p JOIN dr d ON d.league=p.league AND d.season=p.season AND d.reference=p.reference AND d.teamName<>p.opponent),
ok AS (SELECT league, season, reference, opponent, peer FROM nb WHERE k <= 8 UNION SELECT league, season, reference, opponent, reference FROM pr),
gm AS (SELECT p.*, t.matchId, t.date, t."opponentName", t."homeAway", {_RES} AS result, t."xG", t."xG_against", ok.peer IS NOT NULL AS sim FROM pr p JOIN tm t ON t.league=p.league AND t.season=p.season AND t.teamName=p.opponent
  LEFT JOIN ok ON ok.league=p.league AND ok.season=p.season AND ok.reference=p.reference AND ok.opponent=p.opponent AND ok.peer=t."opponentName")
SELECT league, season, reference, opponent, matchId, date, "opponentName", "homeAway", result, "xG", "xG_against", CASE WHEN sim THEN 'similar_opponent' ELSE 'recent_fallback' END AS sample_reason, CAST(n AS INT) AS place
FROM (SELECT *, row_number() OVER (PARTITION BY league, season, reference, opponent ORDER BY sim DESC, date DESC, matchId DESC) AS n FROM gm) WHERE n <= 5""")
def comparable_matches(spark, sf_dir):
    return o.comparable_matches(team_rows(spark, sf_dir))


@query("analysis_pool", "A43", TEAM_SQL + """,
n AS (SELECT league, season, teamName, count(*) AS n FROM tm GROUP BY ALL), s AS (SELECT league, season AS ps, count(*) AS pool_rows FROM tm GROUP BY ALL),
r AS (SELECT n.*, EXISTS (SELECT 1 FROM s WHERE s.league=n.league AND s.ps=CAST(CAST(n.season AS INT)-1 AS VARCHAR)) AS prev FROM n),
x AS (SELECT league, season, teamName, CASE WHEN n >= 4 THEN 'current_plus_previous' WHEN prev THEN 'previous_season' ELSE 'current_season' END AS strategy, unnest([0,1]) AS back, n, prev FROM r)
SELECT x.league, x.season, x.teamName, strategy, s.ps AS pool_season, pool_rows FROM x JOIN s ON s.league=x.league AND s.ps=CAST(CAST(x.season AS INT)-back AS VARCHAR)
WHERE CASE WHEN n >= 4 THEN true WHEN prev THEN back=1 ELSE back=0 END""")
def analysis_pool(spark, sf_dir):
    return o.analysis_pool(team_rows(spark, sf_dir))


PP = "sqrt((105-x)*(105-x)+(34-y)*(34-y)) - sqrt((105-endX)*(105-endX)+(34-endY)*(34-endY))"
PITCH_SQL = SCORE_SQL + f""",
pe AS (SELECT *, lag(eventId) OVER (PARTITION BY matchId, teamName ORDER BY "index") AS sid, coalesce(endX,0)-x AS dx, type IN ('Pass','Carry') AND outcomeType='Successful' AS ok FROM gamestate),
pk AS (SELECT *, 'build_up' AS kind FROM pe WHERE ok AND x < 70 AND dx BETWEEN -8 AND 18 UNION ALL SELECT *, 'direct' FROM pe WHERE ok AND (dx >= 28 OR (endX >= 88.5 AND dx >= 18))
 UNION ALL SELECT *, 'progressive' FROM pe WHERE ok AND dx >= CASE WHEN x < 35 THEN 30 WHEN x < 70 THEN 15 ELSE 10 END UNION ALL SELECT *, 'box_entry' FROM pe WHERE ok AND x < 88.5 AND endX >= 88.5 AND endY BETWEEN 13.84 AND 54.16
 UNION ALL SELECT *, 'shot' FROM pe WHERE "isShot" UNION ALL SELECT *, 'chance_source' FROM pe WHERE "isShot" AND sid IS NOT NULL),
pf AS (SELECT k.league, k.season, k.matchId, k.teamName, k.kind, CASE WHEN k.kind='chance_source' THEN s.eventId ELSE k.eventId END AS eventId, k.eventId AS at_event, s.type, s.playerName AS player, s.x, s.y, s.endX AS end_x, s.endY AS end_y,
  CASE WHEN k.kind='shot' THEN k.xG WHEN k.kind='chance_source' THEN s.xA END AS value, CASE WHEN s.team_goal_diff_before > 0 THEN 'leading' WHEN s.team_goal_diff_before < 0 THEN 'trailing' ELSE 'level' END AS game_state,
  CASE WHEN regexp_matches(lower(concat_ws(' ', s.situation, array_to_string(s.qualifiers,' '))), 'corner|free ?kick|set ?piece|throw ?in') THEN 'set_piece' WHEN list_contains(s.qualifiers,'Longball') THEN 'direct' ELSE 'open_play' END AS event_situation
  FROM pk k JOIN gamestate s ON s.eventId = CASE WHEN k.kind='chance_source' THEN k.sid ELSE k.eventId END)"""


def scored(spark, sf_dir):
    ev = state.with_score(match_feed(spark, sf_dir, 4))
    return ev.withColumn("prog_pass", F.lit(None).cast("double")).withColumn("prog_carry", F.lit(None).cast("double"))


@query("pitch_profile", "A39 P8 P9 P10 P11 P47", FEED4 + PITCH_SQL + " SELECT * FROM pf")
def pitch_profile(spark, sf_dir):
    return o.pitch_profile(scored(spark, sf_dir))


@query("channel_shares", "A39 P27", FEED4 + PITCH_SQL + f""",
g AS (SELECT league, season, teamName, kind, CASE WHEN y < 22.67 THEN 'left' WHEN y > 45.33 THEN 'right' ELSE 'central' END AS channel, count(*) AS "count" FROM pf WHERE kind IN ('progressive','box_entry','shot') GROUP BY ALL)
SELECT *, {ratio_sql('"count"','sum("count") OVER (PARTITION BY league, season, teamName, kind)',100)} AS pct FROM g""")
def channel_shares(spark, sf_dir):
    return o.channel_shares(o.pitch_profile(scored(spark, sf_dir)))


@query("pitch_bins", "A64", FEED4 + PITCH_SQL + f"""
SELECT league, season, teamName, kind, CAST(least(5, greatest(0, floor(x/17.5))) AS INT) AS x_bin, CAST(least(4, greatest(0, floor(y/13.6))) AS INT) AS y_bin, count(*) AS "count", {fmean_sql('x')} AS mean_x, {fmean_sql('y')} AS mean_y, {fmean_sql('end_x')} AS mean_end_x, {fmean_sql('end_y')} AS mean_end_y
FROM pf GROUP BY league, season, teamName, kind, x_bin, y_bin""")
def pitch_bins(spark, sf_dir):
    return o.pitch_bins(o.pitch_profile(scored(spark, sf_dir)))


@query("game_state_profile", "A40", FEED4 + SCORE_SQL + f""",
s AS (SELECT league, season, matchId, teamName AS tn, sign(team_goal_diff_before) AS d, true AS own, xG FROM gamestate WHERE "isShot" UNION ALL SELECT league, season, matchId, opponentName, -sign(team_goal_diff_before), false, xG FROM gamestate WHERE "isShot"),
g AS (SELECT league, season, tn AS "teamName", CASE WHEN d > 0 THEN 'leading' WHEN d < 0 THEN 'trailing' ELSE 'level' END AS state, count(DISTINCT matchId) AS matches, {n_sql('own')} AS shots, {n_sql('NOT own')} AS shots_against, {fsum_sql('CASE WHEN own THEN xG END')} AS "xG", {fsum_sql('CASE WHEN NOT own THEN xG END')} AS "xGA" FROM s GROUP BY ALL)
SELECT *, "xG"/matches AS "xG_per_match", "xGA"/matches AS "xGA_per_match" FROM g""")
def game_state_profile(spark, sf_dir):
    return o.game_state_profile(state.with_score(match_feed(spark, sf_dir, 4)))


def _b(v, lo, hi, inv=False):
    s = f"greatest(0.0::double, least(100.0::double, ({v} - {float(lo)}::double)/({float(hi)}::double - {float(lo)}::double)*100.0::double))"
    return f"(100.0::double - {s})" if inv else s


_ID = {"control": [_b("possession_pct", 35, 65), _b("pass_accuracy", 68, 90), _b("ppp", 2.5, 6.5)],
       "directness": [_b("long_balls", 25, 80), _b("pp", 1.5, 5), _b("ppp", 2.5, 6.5, True)],
       "territory": [_b("field_tilt_pct", 35, 65), _b("box_entries", 5, 18), _b("prog", 160, 420)],
       "tempo": [_b("possessions", 70, 130), _b("pp", 1.5, 5), _b("ppp", 2.5, 6.5, True)]}
IDENT_SQL = TEAM_SQL + ",\nia AS (SELECT league, season, teamName, " + ", ".join(fmean_sql(f"{n}::double") + f" AS {n}" for n in (
    "possession_pct", "pass_accuracy", "field_tilt_pct", "box_entries", "long_balls", "possessions", "passes", "prog_passes", "prog_carries")) + """ FROM tm GROUP BY league, season, teamName),
ib AS (SELECT *, passes/greatest(possessions,0.01::double) AS ppp, prog_passes+prog_carries AS prog, (prog_passes+prog_carries)/greatest(possessions,0.01::double) AS pp FROM ia),
ic AS (SELECT *, """ + ", ".join(f"({' + '.join(v)})/3.0::double AS {k}" for k, v in _ID.items()) + " FROM ib)"


@query("possession_identity", "A41", IDENT_SQL + """
SELECT league, season, teamName, ppp AS passes_per_possession, pp AS progressive_per_possession, control, directness, territory, tempo, CASE greatest(control, directness, territory, tempo) WHEN control THEN 'Control-first possession' WHEN directness THEN 'Direct forward possession'
 WHEN territory THEN 'Territory pressure' ELSE 'High-tempo possession' END AS label FROM ic""")
def possession_identity(spark, sf_dir):
    return o.possession_identity(team_rows(spark, sf_dir))


@query("dossier_rows", "A42")
def dossier_rows(spark, sf_dir):
    return o.dossier(team_rows(spark, sf_dir), light_players(spark, sf_dir))


