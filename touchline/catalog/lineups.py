"""Line-ups, phases, positions and minutes."""

from pyspark.sql import functions as F

from touchline.catalog.feed_checks import feed_sql
from touchline.catalog.registry import fmean_sql, n_sql, pct_sql, query
from touchline.plans import lineups as l, season
from touchline.plans.possession_views import network_passes
from touchline.sources.feed import match_feed
from touchline.sources.lineups import lineup_events

SQUAD, SQUAD4 = feed_sql(20, 1, 14), feed_sql(4, 1, 14)


def lineup_sql() -> str:
    pos = " ".join(f"WHEN formation_id = {f} THEN list_extract({names}, slot)" for f, names in l.SLOT_POSITIONS.items())
    return f""",
sd AS (SELECT DISTINCT league, season, matchId, startDate, teamId, teamName, opponentName, h_a, CAST(matchId AS BIGINT) AS m, (teamId+1)*100 AS base FROM feed),
fs AS (SELECT *, CASE (m+teamId) % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 8 END AS formation_id FROM sd),
pl AS (SELECT fs.*, base+n AS "playerId", CASE WHEN n < 11 THEN n+1 ELSE 0 END AS slot FROM fs CROSS JOIN range(14) t(n)),
su AS (SELECT sd.*, i, CAST(50 + 10*i + (m*7+teamId*3+i) % 9 AS INT) AS "minute", base+3+2*i AS off_id, base+11+i AS on_id, 4+2*i AS slot FROM sd CROSS JOIN range(3) t(i)),
ch AS (SELECT *, 70 AS "minute" FROM sd WHERE (m+teamId) % 4 = 0),
bd AS (SELECT matchId, teamName, "minute" FROM su UNION SELECT matchId, teamName, "minute" FROM ch),
asg AS (SELECT matchId, teamName, 0 AS mi, 0 AS k, "playerId", slot FROM pl UNION ALL SELECT matchId, teamName, "minute", 1, off_id, 0 FROM su UNION ALL SELECT matchId, teamName, "minute", 2, on_id, slot FROM su
  UNION ALL SELECT matchId, teamName, "minute", 3, base+n, CASE WHEN n=4 THEN 11 ELSE 5 END FROM ch CROSS JOIN (VALUES (4),(10)) t(n))""", f"coalesce(CASE {pos} END, 'UNK')"


LINEUP_SQL, POS = lineup_sql()
FNAME = "CASE formation_id WHEN 2 THEN '4-4-2' WHEN 4 THEN '4-3-3' WHEN 5 THEN '4-5-1' WHEN 8 THEN '4-2-3-1' END"
FULL_TIME = ', ft AS (SELECT matchId, greatest(90, max("minute")) AS f FROM feed GROUP BY matchId)'
# Boundaries closer than two minutes to the last kept one are dropped (recursive walk over a side's few changes).
PHASE_SQL = LINEUP_SQL + FULL_TIME + f""",
bo AS (SELECT matchId, teamName, "minute", row_number() OVER (PARTITION BY matchId, teamName ORDER BY "minute") AS n FROM bd),
wk AS (SELECT matchId, teamName, n, "minute", "minute" AS lastk, true AS keep FROM bo WHERE n=1
  UNION ALL SELECT b.matchId, b.teamName, b.n, b."minute", CASE WHEN b."minute"-w.lastk >= 2 THEN b."minute" ELSE w.lastk END, b."minute"-w.lastk >= 2 FROM wk w JOIN bo b ON b.matchId=w.matchId AND b.teamName=w.teamName AND b.n=w.n+1),
st AS (SELECT matchId, teamName, 0 AS s FROM sd UNION ALL SELECT matchId, teamName, "minute" FROM wk WHERE keep),
ph AS (SELECT matchId, teamName, s, coalesce(lead(s) OVER w, f) AS e, CAST(row_number() OVER w - 1 AS INT) AS phase, lead(s) OVER w IS NULL AS z FROM st JOIN ft USING (matchId) WINDOW w AS (PARTITION BY matchId, teamName ORDER BY s)),
la AS (SELECT ph.*, a."playerId", a.slot, row_number() OVER (PARTITION BY ph.matchId, ph.teamName, ph.s, a."playerId" ORDER BY a.mi DESC, a.k DESC) AS rn FROM ph JOIN asg a ON a.matchId=ph.matchId AND a.teamName=ph.teamName AND a.mi < ph.s+1),
p0 AS (SELECT la.*, CASE WHEN ch.matchId IS NOT NULL AND s >= 70 THEN 5 ELSE fs.formation_id END AS formation_id FROM la JOIN fs ON fs.matchId=la.matchId AND fs.teamName=la.teamName LEFT JOIN ch ON ch.matchId=la.matchId AND ch.teamName=la.teamName WHERE rn=1 AND slot > 0),
phs AS (SELECT matchId, teamName, phase, s AS "start", e AS "end", formation_id, "playerId", slot, {POS} AS "position", {FNAME} AS formation FROM p0)"""
PHASE_REC = lambda head: head.replace("WITH ", "WITH RECURSIVE ", 1)


def both(spark, sf_dir, teams=20):
    f = match_feed(spark, sf_dir, teams, 1, 14)
    return f, lineup_events(f)


@query("substitution_pairs", "J31 P57", SQUAD + LINEUP_SQL + """ SELECT matchId, teamName, "minute", on_id AS player_on, off_id AS player_off, slot FROM su""")
def substitution_pairs(spark, sf_dir):
    return l.substitution_pairs(both(spark, sf_dir)[1])


@query("substitution_markers", "A16", SQUAD + LINEUP_SQL + """, fm AS (SELECT matchId, greatest(90, max("minute")) AS full_time FROM feed GROUP BY matchId)
SELECT su.matchId, teamName, CAST(least(su."minute", 95, full_time) AS INT) AS "minute", 'substitution' AS event_type, on_id AS player_on, off_id AS player_off FROM su JOIN fm ON fm.matchId=su.matchId""")
def substitution_markers(spark, sf_dir):
    f, li = both(spark, sf_dir)
    return l.substitution_markers(li, f)


@query("lineup_phases", "W15 UD5 P40", PHASE_REC(SQUAD) + PHASE_SQL + " SELECT * FROM phs")
def lineup_phases(spark, sf_dir):
    f, li = both(spark, sf_dir)
    return l.lineup_phases(li, f).drop("position_group")


TIME_SQL = PHASE_SQL + """,
g0 AS (SELECT *, CASE WHEN lag("position") OVER w = "position" AND lag("end") OVER w >= "start" THEN 0 ELSE 1 END AS nw FROM phs WINDOW w AS (PARTITION BY matchId, teamName, "playerId" ORDER BY "start")),
g1 AS (SELECT *, sum(nw) OVER (PARTITION BY matchId, teamName, "playerId" ORDER BY "start") AS island FROM g0),
tl AS (SELECT matchId, teamName, "playerId", CAST(island AS BIGINT) AS island, "position", min("start") AS "start", max("end") AS "end" FROM g1 GROUP BY ALL)"""


@query("position_timeline", "W16", PHASE_REC(SQUAD) + TIME_SQL + " SELECT * FROM tl")
def position_timeline(spark, sf_dir):
    f, li = both(spark, sf_dir)
    return l.position_timeline(l.lineup_phases(li, f)).drop("position_group")


@query("primary_positions", "W16", PHASE_REC(SQUAD) + TIME_SQL + """,
m AS (SELECT matchId, teamName, "playerId", "position", sum("end"-"start") AS mins, min("start") AS f FROM tl GROUP BY ALL)
SELECT matchId, teamName, "playerId", max(CASE WHEN rn=1 THEN "position" END) AS primary_position, string_agg("position", ',' ORDER BY f, "position") AS positions FROM
 (SELECT *, row_number() OVER (PARTITION BY matchId, teamName, "playerId" ORDER BY mins DESC, f) AS rn FROM m) GROUP BY ALL""")
def primary_positions(spark, sf_dir):
    f, li = both(spark, sf_dir)
    return l.primary_positions(l.position_timeline(l.lineup_phases(li, f))).drop("position_group")


@query("event_positions", "W16", PHASE_REC(SQUAD) + TIME_SQL + """,
fr AS (SELECT matchId, teamName, "playerId", min_by("position", "start") AS f, max_by("position", "end") AS z, min("start") AS s, max("end") AS e FROM tl GROUP BY ALL)
SELECT v.eventId, coalesce(t."position", CASE WHEN v."minute" >= fr.e THEN fr.z WHEN v."minute" < fr.s THEN fr.f END) AS "position"
FROM feed v LEFT JOIN tl t ON t.matchId=v.matchId AND t.teamName=v.teamName AND t."playerId"=v.playerId AND v."minute" >= t."start" AND v."minute" < t."end"
LEFT JOIN fr ON fr.matchId=v.matchId AND fr.teamName=v.teamName AND fr."playerId"=v.playerId""")
def event_positions(spark, sf_dir):
    f, li = both(spark, sf_dir)
    return l.position_at(f, l.position_timeline(l.lineup_phases(li, f))).select("eventId", "position")


@query("substitution_windows", "W8")
def substitution_windows(spark, sf_dir):
    f, li = both(spark, sf_dir)
    return l.merged_windows(li, events=f)


WIN_SQL = LINEUP_SQL + FULL_TIME + """,
ed AS (SELECT matchId, teamName, 0 AS s FROM sd UNION SELECT matchId, teamName, "minute" FROM su),
wi AS (SELECT matchId, teamName, s, coalesce(lead(s) OVER w, f) AS e, lead(s) OVER w IS NULL AS z, row_number() OVER w - 1 AS "window" FROM ed JOIN ft USING (matchId) WINDOW w AS (PARTITION BY matchId, teamName ORDER BY s)),
lf AS (SELECT p.matchId, p.teamName, p."playerId", CASE WHEN p.slot > 0 THEN -1 ELSE o."minute" END AS on_at, f."minute" AS off_at FROM pl p LEFT JOIN su o ON o.matchId=p.matchId AND o.teamName=p.teamName AND o.on_id=p."playerId"
  LEFT JOIN su f ON f.matchId=p.matchId AND f.teamName=p.teamName AND f.off_id=p."playerId"),
pw AS (SELECT wi.matchId, wi.teamName, wi."window", lf."playerId" FROM wi JOIN lf ON lf.matchId=wi.matchId AND lf.teamName=wi.teamName AND on_at < e AND (off_at IS NULL OR off_at >= s))"""


@query("players_in_windows", "J36 W8", SQUAD + WIN_SQL + """ SELECT matchId, teamName, "window", "playerId" FROM pw""")
def players_in_windows(spark, sf_dir):
    f, li = both(spark, sf_dir)
    return l.players_in_windows(li, l.raw_windows(li, f)).select("matchId", "teamName", "window", "playerId")


@query("window_pass_counts", "J36", SQUAD + WIN_SQL + """,
rr AS (SELECT *, lead(teamName) OVER w AS nt, lead(playerId) OVER w AS rid FROM feed WHERE type <> 'Card' WINDOW w AS (PARTITION BY matchId ORDER BY "index"))
SELECT r.matchId, r.teamName, wi."window", count(*) AS passes FROM rr r JOIN wi ON wi.matchId=r.matchId AND wi.teamName=r.teamName AND r."minute" >= wi.s AND (r."minute" < wi.e OR wi.z AND r."minute" = wi.e)
WHERE r.type='Pass' AND r.outcomeType='Successful' AND nt=r.teamName AND EXISTS (SELECT 1 FROM pw WHERE pw.matchId=r.matchId AND pw.teamName=r.teamName AND pw."window"=wi."window" AND pw."playerId"=r.playerId)
 AND EXISTS (SELECT 1 FROM pw WHERE pw.matchId=r.matchId AND pw.teamName=r.teamName AND pw."window"=wi."window" AND pw."playerId"=r.rid) GROUP BY ALL""")
def window_pass_counts(spark, sf_dir):
    f, li = both(spark, sf_dir)
    return l.window_passes(network_passes(f), li, l.raw_windows(li, f)).groupBy("matchId", "teamName", "window").agg(F.count("*").alias("passes"))


@query("minutes_from_substitutions", "W9", SQUAD + LINEUP_SQL + """,
w AS (SELECT DISTINCT matchId, teamName, playerId FROM feed), ft AS (SELECT matchId, greatest(90, max("minute")) AS f FROM feed GROUP BY matchId)
SELECT w.matchId, w.teamName, w.playerId, o.on_id IS NOT NULL AS is_substitute, greatest(0, least(f, coalesce(x."minute", f)) - least(f, coalesce(o."minute",0))) AS minutes_played FROM w JOIN ft USING (matchId)
LEFT JOIN su o ON o.matchId=w.matchId AND o.teamName=w.teamName AND o.on_id=w.playerId LEFT JOIN su x ON x.matchId=w.matchId AND x.teamName=w.teamName AND x.off_id=w.playerId""")
def minutes_from_substitutions(spark, sf_dir):
    return l.minutes_from_substitutions(*both(spark, sf_dir))


@query("touch_positions", "A19", SQUAD + f" SELECT matchId, teamName, playerName, {fmean_sql('x')} AS avg_x, {fmean_sql('y')} AS avg_y, count(*) AS touches FROM feed WHERE isTouch GROUP BY matchId, teamName, playerName")
def touch_positions(spark, sf_dir):
    return l.touch_positions(both(spark, sf_dir)[0])


@query("phase_touch_positions", "A19", PHASE_REC(SQUAD) + PHASE_SQL + f"""
SELECT f.matchId, f.teamName, phase, playerName, {fmean_sql('x')} AS avg_x, {fmean_sql('y')} AS avg_y, count(*) AS touches FROM feed f JOIN ph ON ph.matchId=f.matchId AND ph.teamName=f.teamName AND f."minute" >= ph.s AND (f."minute" < ph.e OR ph.z AND f."minute" = ph.e) WHERE isTouch
GROUP BY f.matchId, f.teamName, phase, playerName""")
def phase_touch_positions(spark, sf_dir):
    f, li = both(spark, sf_dir)
    return l.phase_touch_positions(f, l.lineup_phases(li, f))


@query("formation_usage", "A44", SQUAD4 + LINEUP_SQL + f""",
g AS (SELECT league, season, teamName, {FNAME} AS formation, count(*) AS matches FROM fs GROUP BY ALL) SELECT *, {pct_sql('matches','sum(matches) OVER (PARTITION BY league, season, teamName)')} AS share FROM g""")
def formation_usage(spark, sf_dir):
    return l.formation_usage(both(spark, sf_dir, 4)[1])


@query("player_usage", "A44", SQUAD4 + LINEUP_SQL + f""",
g AS (SELECT league, season, teamName, "playerId", {POS} AS ps, {n_sql('slot > 0')} AS s, {n_sql('slot = 0')} AS b FROM pl GROUP BY ALL)
SELECT league, season, teamName, "playerId", CAST(sum(s) AS BIGINT) AS starts, CAST(sum(b) AS BIGINT) AS bench, max(CASE WHEN rn=1 AND s > 0 THEN ps END) AS primary_position FROM
 (SELECT *, row_number() OVER (PARTITION BY league, season, teamName, "playerId" ORDER BY s DESC, ps) AS rn FROM g) GROUP BY ALL""")
def player_usage(spark, sf_dir):
    return l.player_usage(both(spark, sf_dir, 4)[1])


@query("lineup_changes", "A63", SQUAD4 + LINEUP_SQL + """,
e AS (SELECT league, season, teamName, matchId, startDate, list("playerId" ORDER BY "playerId") AS xi FROM pl WHERE slot > 0 GROUP BY ALL),
g AS (SELECT *, lag(xi) OVER (PARTITION BY league, season, teamName ORDER BY startDate, matchId) AS p FROM e)
SELECT league, season, teamName, matchId, CASE WHEN p IS NOT NULL THEN CAST(len(list_intersect(xi, p)) AS INT) END AS kept, CASE WHEN p IS NOT NULL THEN CAST(len(xi)-len(list_intersect(xi, p)) AS INT) END AS changes, CASE WHEN p IS NOT NULL THEN len(list_intersect(xi, p))::double*100/len(xi) END AS stability FROM g""")
def lineup_changes(spark, sf_dir):
    return l.lineup_changes(both(spark, sf_dir, 4)[1])


@query("team_history", "A4", SQUAD4 + LINEUP_SQL + """,
gg AS (SELECT matchId, teamName, opponentName, count(*) FILTER (WHERE type='Goal') AS g, count(*) FILTER (WHERE type='Goal' AND goalOwn) AS o FROM feed GROUP BY ALL),
sc AS (SELECT a.matchId, a.teamName, a.g-a.o+b.o AS goals, b.g-b.o+a.o AS goals_against FROM gg a JOIN gg b ON a.matchId=b.matchId AND a.teamName<>b.teamName)
SELECT sc.matchId, sc.teamName, goals, goals_against, CASE WHEN goals > goals_against THEN 'W' WHEN goals = goals_against THEN 'D' ELSE 'L' END AS result, """ + FNAME + """ AS formation,
 (SELECT string_agg("playerId", ',' ORDER BY "playerId") FROM pl WHERE pl.matchId=sc.matchId AND pl.teamName=sc.teamName AND slot > 0) AS starters, (SELECT string_agg(concat("minute", ':', on_id, ':', off_id), ',' ORDER BY "minute") FROM su WHERE su.matchId=sc.matchId AND su.teamName=sc.teamName) AS subs, true AS lineup_available
FROM sc JOIN fs ON fs.matchId=sc.matchId AND fs.teamName=sc.teamName""")
def team_history(spark, sf_dir):
    f, li = both(spark, sf_dir, 4)
    rows = season.team_match_stats(f.withColumn("xT", F.lit(None).cast("double")).withColumn("epv_added", F.lit(None).cast("double")))
    subs = F.array_join(F.transform("substitutions", lambda s: F.concat_ws(":", s["minute"].cast("string"), s["player_on"].cast("string"), s["player_off"].cast("string"))), ",")
    return l.team_history(rows, li).select("matchId", "teamName", "goals", "goals_against", "result", "formation",
                                           F.array_join(F.col("starter_ids").cast("array<string>"), ",").alias("starters"), subs.alias("subs"), "lineup_available")
