"""Research tables and squad context."""

from pyspark.sql import functions as F

from touchline.catalog.feed_checks import FEED, FEED4, feed_sql
from touchline.catalog.match_state import EPV_SQL, possession_sql
from touchline.catalog.models import PT
from touchline.catalog.registry import fmean_sql, fsum_sql, n_sql, pct_sql, query, ratio_sql
from touchline.catalog.season import TEAM_SQL, team_rows
from touchline.operators import grids, state
from touchline.plans import research as r, squads as q
from touchline.sources.feed import match_feed

SQUAD = feed_sql(20, 1, 14)
OK = "outcomeType = 'Successful'"
OOP = "type IN ('" + "','".join(r.OUT_OF_POSSESSION) + "')"


def _in(names):
    return "('" + "','".join(names) + "')"


@query("control_sequences", "W2c UD6", FEED.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
g AS MATERIALIZED (SELECT matchId, "index" AS i, eventId, teamName AS tn, type IN {_in(state.CONTROL)} AND {OK} AS gr, type IN {_in(state.STOPPAGE)} OR type='Goal' AS st, type IN {_in(state.DEFENCE)} AS df, type IN {_in(state.CONTROL)} AND NOT {OK} AS fa FROM feed),
w AS (SELECT matchId, -1::bigint AS i, NULL::bigint AS eventId, NULL::varchar AS side, false AS op, -1 AS po, -1 AS sq FROM (SELECT DISTINCT matchId FROM g)
 UNION ALL SELECT matchId, i, eventId, CASE WHEN NOT o2 AND gr THEN tn ELSE s2 END, o2 OR gr, CASE WHEN NOT o2 AND gr AND tn IS DISTINCT FROM s2 THEN p1+1 ELSE p1 END, CASE WHEN NOT o2 AND gr THEN q1+1 ELSE q1 END FROM (
  SELECT *, o1 AND NOT (st OR bt OR fa) AS o2, CASE WHEN o1 AND (st OR bt OR fa) AND bt THEN NULL ELSE s1 END AS s2 FROM (
   SELECT *, tn IS DISTINCT FROM s1 AND df AS bt FROM (
    SELECT g.*, w.side IS NOT NULL AND gr AND tn <> w.side AS sw, CASE WHEN w.side IS NOT NULL AND gr AND tn <> w.side THEN tn ELSE w.side END AS s1, CASE WHEN w.side IS NOT NULL AND gr AND tn <> w.side THEN true ELSE w.op END AS o1,
     CASE WHEN w.side IS NOT NULL AND gr AND tn <> w.side THEN w.po+1 ELSE w.po END AS p1, CASE WHEN w.side IS NOT NULL AND gr AND tn <> w.side THEN w.sq+1 ELSE w.sq END AS q1 FROM w JOIN g ON g.matchId=w.matchId AND g.i=w.i+1))))
SELECT matchId, eventId, CASE WHEN op THEN sq::bigint END AS sequence_id, CASE WHEN side IS NOT NULL THEN po::bigint END AS possession_id FROM w WHERE eventId IS NOT NULL""")
def control_sequences(spark, sf_dir):
    return r.control_sequences(match_feed(spark, sf_dir))


_LEN = "(CASE WHEN type='Pass' THEN sqrt((endX-x)*(endX-x)+(endY-y)*(endY-y)) END)"
_SPREAD = f"CASE WHEN count({_LEN}) > 1 THEN sqrt(greatest(0, ({fsum_sql(_LEN + '*' + _LEN)} - {fsum_sql(_LEN)}*{fsum_sql(_LEN)}/count({_LEN})::double)/(count({_LEN})-1)::double)) ELSE 0 END"


@query("possession_vectors", "A54 T5", FEED + possession_sql(True) + f""",
e AS (SELECT f.*, p.possession_id FROM feed f JOIN poss p USING (matchId, "index"))
SELECT matchId, teamName, possession_id, count(*) AS "events", coalesce({fmean_sql("CASE WHEN type='Pass' THEN sqrt((endX-x)*(endX-x)+(endY-y)*(endY-y)) END")},0) AS length_mean, coalesce(max(CASE WHEN type='Pass' THEN sqrt((endX-x)*(endX-x)+(endY-y)*(endY-y)) END),0) AS length_max, {_SPREAD} AS length_std,
 min_by(x, "index") AS first_x, min_by(y, "index") AS first_y, max_by(coalesce(endX,x), "index") AS last_x, max_by(coalesce(endY,y), "index") AS last_y, min_by(type, "index") AS first_type, max_by(type, "index") AS last_type,
 {n_sql("list_contains(qualifiers,'KeyPass')")} AS key_passes, {n_sql('"isShot"')} AS shots, {n_sql("type='Goal'")} AS goals, {n_sql('turnover')} AS turnovers, {n_sql("type='TakeOn' AND " + OK)} AS dribbles_won, {n_sql("type='Interception'")} AS interceptions,
 {fsum_sql("CASE WHEN type='Pass' THEN sqrt((105-x)*(105-x)+(34-y)*(34-y)) - sqrt((105-endX)*(105-endX)+(34-endY)*(34-endY)) ELSE 0 END")} AS prog_pass, {fsum_sql("CASE WHEN type='Carry' THEN sqrt((105-x)*(105-x)+(34-y)*(34-y)) - sqrt((105-endX)*(105-endX)+(34-endY)*(34-endY)) ELSE 0 END")} AS prog_carry,
 max_by(coalesce(endX,x), "index") - min_by(x, "index") AS net_x, max_by(coalesce(endY,y), "index") - min_by(y, "index") AS net_y FROM e GROUP BY matchId, teamName, possession_id""")
def possession_vectors(spark, sf_dir):
    return r.possession_vectors(state.with_possession(match_feed(spark, sf_dir)))


@query("possession_patterns", "M14 A54")
def possession_patterns(spark, sf_dir):
    from touchline.models.training import cluster_patterns
    from touchline.session import materialise
    rows = materialise(r.possession_vectors(state.with_possession(match_feed(spark, sf_dir))), "vectors")
    out, _ = cluster_patterns(rows, ["length_mean", "length_max", "key_passes", "shots", "turnovers", "prog_pass", "prog_carry", "net_x", "net_y"])
    return r.pattern_summary(out)


@query("dynamic_value_per90", "A53 W22")
def dynamic_value_per90(spark, sf_dir):
    from touchline.plans.season import player_match_stats
    ev = grids.with_epv(grids.with_xt(state.with_possession(match_feed(spark, sf_dir, 4))))
    return r.dynamic_value_per90(ev, player_match_stats(ev))


@query("pass_difficulty", "A56 T2", FEED + f""",
g AS (SELECT playerName, count(*) AS passes, {fsum_sql('xPass')} AS "xPass_total" FROM feed WHERE type='Pass' GROUP BY playerName HAVING count(*) >= 20), h AS (SELECT *, "xPass_total"/passes AS "mean_xPass" FROM g)
SELECT * FROM (SELECT *, 'easiest' AS side FROM h ORDER BY "mean_xPass" DESC, playerName LIMIT 5) UNION ALL SELECT * FROM (SELECT *, 'hardest' FROM h ORDER BY "mean_xPass", playerName LIMIT 5)""")
def pass_difficulty(spark, sf_dir):
    return r.pass_difficulty(match_feed(spark, sf_dir).where("type = 'Pass'"))


@query("passes_above_expected", "A56 A73", FEED4 + f""",
g AS (SELECT league, season, teamName, {PT} AS pass_type, count(*) AS passes, {n_sql(OK)} AS completed, {fsum_sql('xPass')} AS expected FROM feed WHERE type='Pass' GROUP BY ALL) SELECT *, completed-expected AS above, (completed-expected)*100/passes AS above_per_100 FROM g""")
def passes_above_expected(spark, sf_dir):
    from touchline.models.features import pass_type
    return r.passes_above_expected(match_feed(spark, sf_dir, 4).where("type = 'Pass'").withColumn("pass_type", pass_type()))


_SHARES = f""", m AS (SELECT league, season, matchId, teamName, count(*) AS n FROM feed WHERE type='Pass' GROUP BY ALL),
sh AS (SELECT league, season, teamName, {fmean_sql('s')} AS avg_possession_pct FROM (SELECT *, {pct_sql('n', 'sum(n) OVER (PARTITION BY league, season, matchId)')} AS s FROM m) GROUP BY ALL)"""


@query("adjusted_pass_leaders", "A56", FEED4 + _SHARES + f""",
g AS (SELECT league, season, teamName, playerName, {PT} AS pass_type, count(*) AS passes, {n_sql(OK)} AS completed, {fsum_sql('xPass')} AS expected FROM feed WHERE type='Pass' AND playerName IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
a AS (SELECT *, {ratio_sql('completed-expected', 'avg_possession_pct', 100)} AS above_per_100_possession FROM g JOIN sh USING (league, season, teamName))
SELECT *, row_number() OVER (PARTITION BY pass_type ORDER BY above_per_100_possession DESC, league, season, teamName, playerName) AS "rank" FROM a QUALIFY "rank" <= 5""")
def adjusted_pass_leaders(spark, sf_dir):
    from touchline.models.features import pass_type
    return r.adjusted_pass_leaders(match_feed(spark, sf_dir, 4).where("type = 'Pass'").withColumn("pass_type", pass_type()), 2)


@query("adjusted_creators", "A56", FEED4 + _SHARES + f""",
g AS (SELECT league, season, teamName, playerName, count(*) AS key_passes, {fmean_sql('xPass')} AS "avg_xPass", {pct_sql(n_sql(OK), 'count(*)')} AS accuracy_pct FROM feed WHERE type='Pass' AND playerName IS NOT NULL AND list_contains(qualifiers,'KeyPass') GROUP BY ALL HAVING count(*) >= 2)
SELECT *, {ratio_sql('key_passes', 'avg_possession_pct', 100)} AS key_passes_per_100_possession FROM g JOIN sh USING (league, season, teamName)""")
def adjusted_creators(spark, sf_dir):
    return r.adjusted_creators(match_feed(spark, sf_dir, 4).where("type = 'Pass'"), 2)


@query("chance_extremes", "A57", FEED + """
SELECT * FROM (SELECT eventId, matchId, playerName, xG AS "xG", 'missed' AS kind FROM feed WHERE "isShot" AND type<>'Goal' ORDER BY xG DESC, eventId LIMIT 10) UNION ALL SELECT * FROM (SELECT eventId, matchId, playerName, xG, 'scored' FROM feed WHERE type='Goal' AND NOT goalOwn ORDER BY xG, eventId LIMIT 10)""")
def chance_extremes(spark, sf_dir):
    return r.chance_extremes(match_feed(spark, sf_dir).where("isShot"))


@query("assist_leaders", "A57", FEED + f"""
SELECT *, assists - "xA" AS difference FROM (SELECT playerName, {fsum_sql('xA')} AS "xA", {n_sql("list_contains(qualifiers,'IntentionalGoalAssist')")} AS assists FROM feed WHERE type='Pass' GROUP BY playerName) ORDER BY "xA" DESC, playerName LIMIT 15""")
def assist_leaders(spark, sf_dir):
    return r.assist_leaders(match_feed(spark, sf_dir))


def _w(n):
    return "(VALUES " + ",".join(f"({s},{t},{w!r}::double)" for s, t, w in r.smoothing_weights(n)) + ")"


@query("assist_heat", "A58", FEED + f""",
c AS (SELECT teamName, CAST(least(5, floor(x/(105.0::double/6))) AS INT) AS bx, CAST(least(4, floor(y/(68.0::double/5))) AS INT) AS by_, {fsum_sql('xA')} AS v FROM feed WHERE xA > 0 GROUP BY teamName, bx, by_)
SELECT teamName, a.t AS x_bin, b.t AS y_bin, {fsum_sql('v*a.w*b.w')} AS value FROM c JOIN {_w(6)} a(s,t,w) ON a.s=bx JOIN {_w(5)} b(s,t,w) ON b.s=by_ GROUP BY teamName, a.t, b.t""")
def assist_heat(spark, sf_dir):
    return r.value_heat(match_feed(spark, sf_dir), "xA")


@query("best_value_chain", "A50 W11", FEED + EPV_SQL + """,
s AS (SELECT f.matchId, f."index" AS i, sum(cast(floor(coalesce(epv_added,0)*1e6+0.5) as bigint)) OVER (PARTITION BY f.matchId ORDER BY f."index" ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS s FROM feed f LEFT JOIN epv USING (eventId)),
k AS (SELECT *, row_number() OVER (PARTITION BY matchId ORDER BY s DESC, i) AS rn FROM s WHERE i >= 7)
SELECT matchId, i-7 AS first_index, i AS last_index, s::double/1e6 AS epv FROM k WHERE rn=1""")
def best_value_chain(spark, sf_dir):
    return r.best_chain(grids.with_epv(match_feed(spark, sf_dir)))


@query("duel_cluster", "A50 W11", FEED + """,
d AS (SELECT matchId, "minute"*60+"second" AS t, count(*) AS n FROM feed WHERE type IN ('AerialDuel','Tackle','TakeOn','BallRecovery','Challenge') GROUP BY ALL),
k AS (SELECT a.matchId, a.t, CAST(sum(b.n) AS BIGINT) AS k FROM d a JOIN d b ON a.matchId=b.matchId AND b.t BETWEEN a.t AND a.t+29 GROUP BY ALL)
SELECT matchId, CAST(min_by(t, (-k, t)) AS BIGINT) AS "start", max(k) AS duels FROM k GROUP BY matchId""")
def duel_cluster(spark, sf_dir):
    return r.duel_cluster(match_feed(spark, sf_dir))


@query("progression_speed", "W21", FEED + """,
w AS (SELECT a.eventId, min_by(b.y, b."index") AS y0, min_by(b."minute"*60+b."second", b."index") AS t0, count(*) AS n FROM feed a JOIN feed b ON a.matchId=b.matchId AND b."index" BETWEEN a."index"-3 AND a."index"-1 AND a.teamId=b.teamId GROUP BY a.eventId)
SELECT f.eventId, CASE WHEN n >= 2 AND f."minute"*60+f."second" <> t0 THEN (f.y-y0)/(f."minute"*60+f."second"-t0) ELSE 0 END AS vertical_progression_speed FROM feed f LEFT JOIN w USING (eventId)""")
def progression_speed(spark, sf_dir):
    return r.progression_speed(match_feed(spark, sf_dir)).select("eventId", "vertical_progression_speed")


@query("last_carry_before_pass", "W21", SQUAD + """,
w AS (SELECT a.eventId, max_by(sqrt((b.endX-b.x)*(b.endX-b.x)+(b.endY-b.y)*(b.endY-b.y)), b."index") AS d FROM feed a JOIN feed b ON a.matchId=b.matchId AND b.playerId=a.playerId AND b."index" < a."index" AND b.type='Carry' WHERE a.type='Pass' GROUP BY a.eventId)
SELECT f.eventId, coalesce(d,0) AS carry_distance_before_pass FROM feed f LEFT JOIN w USING (eventId) WHERE type='Pass'""")
def last_carry_before_pass(spark, sf_dir):
    return r.last_carry_before(match_feed(spark, sf_dir, 20, 1, 14)).select("eventId", "carry_distance_before_pass")


ACT_SQL = f""",
rr AS (SELECT *, lead(teamName) OVER w AS nt, lead(playerName) OVER w AS nn FROM feed WHERE type<>'Card' WINDOW w AS (PARTITION BY matchId ORDER BY "index")),
ac AS (SELECT matchId, teamName, playerName AS player, eventId, type, CASE WHEN type IN ('TakeOn','GoodSkill','ShieldBallOpp','Foul','Tackle','Challenge','Aerial') THEN 'duel' WHEN type IN {_in(r.IN_POSSESSION)} THEN 'in_possession' WHEN {OOP} THEN 'out_of_possession' WHEN type='Dispossessed' THEN 'transition' ELSE 'other' END AS phase, x, y FROM feed WHERE type<>'Card'
 UNION ALL SELECT matchId, teamName, nn, eventId, 'PassReceived', 'touches', endX, endY FROM rr WHERE type='Pass' AND {OK} AND nt=teamName)"""


@query("player_actions", "P50 A31", SQUAD + ACT_SQL + " SELECT * FROM ac")
def player_actions(spark, sf_dir):
    return r.player_actions(match_feed(spark, sf_dir, 20, 1, 14)).select("matchId", "teamName", "player", "eventId", "type", "phase", "x", "y")


@query("player_action_summary", "A31", SQUAD + ACT_SQL + f"""
SELECT matchId, teamName, player, {n_sql("type<>'PassReceived'")} AS actions, {n_sql('type IN ' + _in(r.IN_POSSESSION))} AS in_possession, {n_sql(OOP)} AS out_of_possession, {n_sql("phase='duel'")} AS duels, {n_sql("type IN ('Goal','SavedShot','MissedShots','ShotOnPost')")} AS shots, {n_sql("type='PassReceived'")} AS received FROM ac GROUP BY ALL""")
def player_action_summary(spark, sf_dir):
    return r.player_action_summary(r.player_actions(match_feed(spark, sf_dir, 20, 1, 14)))


@query("sparse_actions", "P53")
def sparse_actions(spark, sf_dir):
    return r.sparse_json(r.player_actions(match_feed(spark, sf_dir, 20, 1, 14)))


@query("defensive_area", "A72", SQUAD + f"""
SELECT matchId, playerName, count(*) AS actions, quantile_cont(x, 0.25) AS x0, quantile_cont(x, 0.75) AS x1, quantile_cont(y, 0.25) AS y0, quantile_cont(y, 0.75) AS y1 FROM feed WHERE {OOP} GROUP BY matchId, playerName""")
def defensive_area(spark, sf_dir):
    return r.defensive_area(match_feed(spark, sf_dir, 20, 1, 14))


@query("movement_labels", "A71", FEED + """
SELECT eventId, CASE WHEN endX-x > 5 THEN 'forward' WHEN endX-x < -5 THEN 'backward' ELSE 'sideways' END AS direction, CASE WHEN sqrt((endX-x)*(endX-x)+(endY-y)*(endY-y)) >= 32 THEN 'long' WHEN sqrt((endX-x)*(endX-x)+(endY-y)*(endY-y)) >= 15 THEN 'medium' ELSE 'short' END AS "length",
 CASE WHEN list_has_any(qualifiers,['Chipped','Longball','Cross']) THEN 'high' ELSE 'ground' END AS height FROM feed WHERE type IN ('Pass','Carry')""")
def movement_labels(spark, sf_dir):
    return r.movement_labels(match_feed(spark, sf_dir))


_FM = ("xG", "shots", "possession_pct", "field_tilt_pct", "box_entries", "prog_passes")


@query("match_facts", "A49 T5", TEAM_SQL + ", v AS (" + " UNION ALL ".join(f"SELECT matchId, teamName, '{m}' AS metric, \"{m}\"::double AS value FROM tm" for m in _FM) + """)
SELECT matchId, metric, min_by(teamName, (-value, teamName)) AS leader, max(value) AS best, min(value) AS other, round(max(value)-min(value), 6) AS gap FROM v GROUP BY matchId, metric""")
def match_facts(spark, sf_dir):
    return r.match_facts(team_rows(spark, sf_dir))


@query("action_hulls", "UD4")
def action_hulls(spark, sf_dir):
    return r.action_hulls(match_feed(spark, sf_dir, 20, 1, 14))


@query("squad_changes", "J28 U2", FEED4 + """,
s AS (SELECT DISTINCT league, CAST(season AS INT) AS y, teamName, playerName FROM feed), a AS (SELECT * FROM s WHERE y % 2 = 1), b AS (SELECT * FROM s WHERE y % 2 = 0)
SELECT DISTINCT league, teamName, playerName, 'in' AS change FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.league=a.league AND b.teamName=a.teamName AND b.playerName=a.playerName)
UNION ALL SELECT DISTINCT league, teamName, playerName, 'out' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.league=a.league AND b.teamName=a.teamName AND b.playerName=a.playerName)""")
def squad_changes(spark, sf_dir):
    s = q.squads(match_feed(spark, sf_dir, 4))
    odd = F.col("season").cast("int") % 2 == 1
    drop = lambda d: d.drop("season").distinct()
    return q.squad_changes(drop(s.where(odd)), drop(s.where(~odd)))


MOVE_SQL = """,
pd AS (SELECT league, season, playerName, startDate, min(teamName) AS tn FROM feed GROUP BY ALL), mv AS (SELECT *, lag(tn) OVER (PARTITION BY league, season, playerName ORDER BY startDate) AS ft FROM pd),
tr AS (SELECT league, season, playerName, startDate AS date, ft AS from_team, tn AS to_team, CASE WHEN hash_ % 3 = 0 THEN 'return from loan' ELSE 'transfer' END AS type FROM (SELECT *, length(playerName) + day(startDate) AS hash_ FROM mv WHERE ft <> tn)),
uq AS (SELECT league, season, playerName, type, from_team, to_team, max(date) AS date FROM tr GROUP BY ALL), nr AS (SELECT league, season, playerName, max(date) AS d FROM uq WHERE type <> 'return from loan' GROUP BY ALL),
u2 AS (SELECT u.* FROM uq u LEFT JOIN nr USING (league, season, playerName) WHERE NOT (type = 'return from loan' AND coalesce(d >= date, false))),
sd AS (SELECT *, to_team AS "teamName", 'in' AS direction FROM u2 UNION ALL SELECT *, from_team, 'out' FROM u2), ou AS (SELECT league, season, playerName, "teamName", max(date) AS o FROM sd WHERE direction='out' GROUP BY ALL),
tt AS (SELECT s.* FROM sd s LEFT JOIN ou USING (league, season, playerName, "teamName") WHERE NOT (direction='in' AND coalesce(o >= date, false)))"""


def transfers(spark, sf_dir):
    mv = q.moves(match_feed(spark, sf_dir, 4))
    kind = F.when((F.length("playerName") + F.dayofmonth("date")) % 3 == 0, "return from loan").otherwise("transfer")
    return q.team_transfers(mv.withColumn("type", kind))


@query("team_transfers", "J29", FEED4 + MOVE_SQL + " SELECT * FROM tt")
def team_transfers(spark, sf_dir):
    return transfers(spark, sf_dir)


COACH_SQL = """,
st AS (SELECT 'League One' AS league, concat('Team ', s_suppkey % 4) AS "teamName", s_name AS coach, DATE '2023-08-01' + CAST(s_suppkey*7 % 30 AS INT) AS a, DATE '2023-08-01' + CAST(s_suppkey*7 % 30 + s_nationkey AS INT) AS z FROM supplier),
se AS (SELECT league, season, min(startDate) AS ss, max(startDate) AS sz FROM feed GROUP BY ALL), hc AS (SELECT se.league, se.season, st."teamName", coach, a FROM st JOIN se ON a <= sz AND z >= ss),
co AS (SELECT league, season, "teamName", max_by(coach, (a, coach)) AS coach, count(*) AS stints FROM hc GROUP BY ALL)"""


def coaches(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    start = F.date_add(F.lit("2023-08-01").cast("date"), (F.col("s_suppkey") * 7 % 30).cast("int"))
    stints = s.select(F.lit("League One").alias("league"), F.concat(F.lit("Team "), (F.col("s_suppkey") % 4).cast("string")).alias("teamName"), F.col("s_name").alias("coach"), start.alias("start"),
                      F.date_add(start, F.col("s_nationkey")).alias("end"))
    seasons = match_feed(spark, sf_dir, 4).groupBy("league", "season").agg(F.min("startDate").alias("season_start"), F.max("startDate").alias("season_end"))
    return q.season_coaches(stints, seasons)


@query("season_coaches", "J33", FEED4 + COACH_SQL + """ SELECT *, lag(coach) OVER w AS previous_coach, CASE WHEN lag(coach) OVER w IS NULL THEN 'unknown' WHEN lag(coach) OVER w = coach THEN 'same' ELSE 'changed' END AS status FROM co WINDOW w AS (PARTITION BY league, "teamName" ORDER BY season)""")
def season_coaches(spark, sf_dir):
    return q.coach_changes(coaches(spark, sf_dir))


@query("team_context", "J37", FEED4 + MOVE_SQL + COACH_SQL + f""",
n AS (SELECT league, season, teamName, count(DISTINCT playerName) AS squad FROM feed GROUP BY ALL), t AS (SELECT league, season, "teamName", {n_sql("direction='in'")} AS arrivals, {n_sql("direction='out'")} AS departures FROM tt GROUP BY ALL)
SELECT n.*, coach, coalesce(arrivals,0) AS arrivals, coalesce(departures,0) AS departures FROM n LEFT JOIN co ON co.league=n.league AND co.season=n.season AND co."teamName"=n.teamName LEFT JOIN t ON t.league=n.league AND t.season=n.season AND t."teamName"=n.teamName""")
def team_context(spark, sf_dir):
    return q.team_context(coaches(spark, sf_dir), transfers(spark, sf_dir), q.squads(match_feed(spark, sf_dir, 4)))


@query("resolved_names", "J34 J35")
def resolved_names(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").distinct()
    flipped = F.array_join(F.reverse(F.split("p_name", " ")), " ")
    return q.resolve_people(n.select(flipped.alias("name")), n.select(F.col("p_name").alias("person")))


@query("repaired_team_names", "P4", FEED + """ SELECT eventId, teamName FROM feed""")
def repaired_team_names(spark, sf_dir):
    f = match_feed(spark, sf_dir)
    teams = f.select("teamId", F.col("teamName").alias("name")).distinct()
    broken = f.select("eventId", "teamId", F.when(F.col("eventId") % 3 == 0, "None").when(F.col("eventId") % 3 == 1, F.col("teamId").cast("string")).otherwise(F.col("teamName")).alias("teamName"))
    return q.repair_team_names(broken, teams).select("eventId", "teamName")


@query("lineup_context", "J27", feed_sql(4, 1, 14) + """
SELECT matchId, teamName, CASE (CAST(matchId AS BIGINT)+teamId) % 3 WHEN 0 THEN '4-4-2' WHEN 1 THEN '4-3-3' ELSE '4-2-3-1' END AS formation, CASE WHEN CAST(matchId AS BIGINT) % 2 = 0 THEN 'history' ELSE 'events' END AS source FROM (SELECT DISTINCT matchId, teamName, teamId FROM feed)""")
def lineup_context(spark, sf_dir):
    from touchline.plans.lineups import FORMATION_NAMES, lookup
    from touchline.sources.lineups import lineup_events
    li = lineup_events(match_feed(spark, sf_dir, 4, 1, 14)).where("type = 'FormationSet'")
    h = li.select("matchId", "teamName", F.try_element_at(lookup(FORMATION_NAMES), F.col("formation_id")).alias("formation"))
    return q.lineup_context(h.select("matchId", "teamName"), h.where("cast(matchId as bigint) % 2 = 0"), h)


@query("defensive_value_per90", "A55")
def defensive_value_per90(spark, sf_dir):
    from touchline.plans.season import player_match_stats
    ev = match_feed(spark, sf_dir, 4).withColumn("xT", F.lit(None).cast("double")).withColumn("epv_added", F.lit(None).cast("double"))
    return r.defensive_value_per90(ev, player_match_stats(ev))


@query("literal_qualifier_names", "UD3 P29", FEED + """ SELECT eventId, array_to_string(qualifiers, ',') AS names FROM feed WHERE len(qualifiers) > 0""")
def literal_qualifier_names(spark, sf_dir):
    from touchline.functions.names import qualifier_names
    f = match_feed(spark, sf_dir).where("size(qualifiers) > 0")
    as_json = F.to_json(F.transform("qualifiers", lambda v: F.struct(v.alias("type"), F.lit("1").alias("value"))))
    as_literal = F.concat(F.lit("[{'type': {'displayName': '"), F.array_join("qualifiers", "'}}, {'type': {'displayName': '"), F.lit("'}}]"))
    text = F.when(F.col("eventId") % 2 == 0, as_json).otherwise(as_literal)
    return f.select("eventId", F.array_join(qualifier_names(text), ",").alias("names"))
