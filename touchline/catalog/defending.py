"""Defensive actions and loss-to-regain transitions."""

from pyspark.sql import functions as F

from touchline.catalog.feed_checks import DENSE
from touchline.catalog.match_state import SCORE_SQL
from touchline.catalog.registry import n_sql, query, ratio_sql
from touchline.operators import state
from touchline.plans import defending as d
from touchline.sources.feed import match_feed

OK = "outcomeType = 'Successful'"
DEF = ("type IN ('Aerial','BallRecovery','BlockedPass','Challenge','Clearance','Error','Foul','Interception','Tackle') "
       f"AND (type <> 'Aerial' OR list_contains(qualifiers,'Defensive')) AND {OK}")
REG = f"type IN ('BallRecovery','Interception','Tackle','Challenge','Aerial') AND {OK}"
CTRL = (f"({REG} OR (type IN ('Pass','Carry','TakeOn','GoodSkill','KeeperPickup','KeeperSweeper','Claim','Goal','SavedShot','MissedShots','ShotOnPost') AND {OK}))")
CP = "type IN ('BallRecovery','Interception','Tackle','Challenge')"
CTRL_R = CTRL.replace("type IN", "r.type IN").replace("outcomeType", "r.outcomeType")
SEQ_SQL = f""",
dt AS (SELECT *, "minute"*60+"second" AS t FROM feed),
lo AS (SELECT * FROM dt WHERE type = 'Dispossessed' OR turnover),
rg AS (SELECT l.eventId AS id, min(r."index") AS ri FROM lo l JOIN dt r ON r.matchId = l.matchId AND r.teamName = l.teamName AND r.period = l.period
  AND r."index" > l."index" AND r.t - l.t BETWEEN 0 AND 60 WHERE {CTRL_R} GROUP BY l.eventId),
cpp AS (SELECT l.eventId AS id, c.eventId AS cid, c.playerName AS cpl FROM lo l JOIN dt c ON c.matchId = l.matchId AND c.teamName = l.teamName AND c.period = l.period AND c."index" > l."index"
  AND c.t - l.t BETWEEN 0 AND 5 AND c.{CP} LEFT JOIN rg ON rg.id = l.eventId WHERE rg.ri IS NULL OR c."index" <= rg.ri),
cpn AS (SELECT id, count(*) AS n FROM cpp GROUP BY id),
seq AS (SELECT l.matchId, l.teamName, l.eventId, l."index", l.playerName AS loss_player, l.type AS loss_type, r.t - l.t AS recovery_seconds, r.eventId AS regain_id, r.playerName AS regain_player,
  r.type AS regain_type, (r.type IN ('BallRecovery','Interception','Tackle','Challenge','Aerial') AND r.outcomeType = 'Successful') AS regain_is_action, coalesce(n,0) AS counterpress_actions, coalesce(r.t - l.t <= 5 AND coalesce(n,0) > 0, false) AS counterpress_success
  FROM lo l LEFT JOIN rg ON rg.id = l.eventId LEFT JOIN dt r ON r.matchId = l.matchId AND r."index" = rg.ri LEFT JOIN cpn ON cpn.id = l.eventId)"""


def feed(spark, sf_dir):
    return match_feed(spark, sf_dir, pace=4)


@query("loss_regain_sequences", "J9 P52", DENSE + SEQ_SQL + """
SELECT matchId, teamName, eventId, loss_player, loss_type, CAST(recovery_seconds AS BIGINT) AS recovery_seconds, regain_id, regain_player, regain_type, counterpress_actions, counterpress_success FROM seq""")
def loss_regain_sequences(spark, sf_dir):
    return d.loss_sequences(feed(spark, sf_dir)).select("matchId", "teamName", "eventId", "loss_player", "loss_type", "recovery_seconds", "regain_id",
                                                        "regain_player", "regain_type", "counterpress_actions", "counterpress_success")


@query("transition_summary", "A26", DENSE + SEQ_SQL + f"""
SELECT matchId, teamName, count(*) AS opportunities, CAST(sum(counterpress_actions) AS BIGINT) AS counterpress_actions, {n_sql('counterpress_success')} AS counterpress_regains,
 {ratio_sql(n_sql('counterpress_success'), 'count(*)', 100)} AS counterpress_success_pct, count(recovery_seconds) AS confirmed_recoveries, sum(recovery_seconds)::double/count(recovery_seconds) AS avg_recovery_seconds,
 median(recovery_seconds) AS median_recovery_seconds, CAST(min(recovery_seconds) AS BIGINT) AS fastest_recovery_seconds, {n_sql('recovery_seconds <= 5')} AS within_5_seconds, {n_sql('recovery_seconds <= 10')} AS within_10_seconds,
 {n_sql('recovery_seconds <= 15')} AS within_15_seconds FROM seq GROUP BY ALL""")
def transition_summary(spark, sf_dir):
    return d.transition_summary(d.loss_sequences(feed(spark, sf_dir)))


@query("defensive_actions", "A26 W17 P15 P52", DENSE + SCORE_SQL + f""",
nx AS (SELECT *, lead(teamName,1) OVER w AS t1, lead(playerName,1) OVER w AS p1, lead(type,1) OVER w AS y1, lead(teamName,2) OVER w AS t2, lead(playerName,2) OVER w AS p2, lead(type,2) OVER w AS y2,
  lead(teamName,3) OVER w AS t3, lead(playerName,3) OVER w AS p3, lead(type,3) OVER w AS y3 FROM gamestate WINDOW w AS (PARTITION BY matchId ORDER BY "index"))
SELECT matchId, eventId, teamName, playerName, "minute", "second", type, x, y, CASE WHEN x >= 70 THEN 'Attacking Third' WHEN x >= 35 THEN 'Middle Third' ELSE 'Defensive Third' END AS zone, team_score_state,
 t1 AS "next_1_teamName", p1 AS "next_1_playerName", y1 AS next_1_type, t2 AS "next_2_teamName", p2 AS "next_2_playerName", y2 AS next_2_type, t3 AS "next_3_teamName", p3 AS "next_3_playerName", y3 AS next_3_type,
 coalesce(t1 = teamName, false) AS next_team_retained FROM nx WHERE {DEF}""")
def defensive_actions(spark, sf_dir):
    return d.defensive_actions(state.with_score(feed(spark, sf_dir)))


_CNT = ", ".join(n_sql(f"type = '{t}'") + f" AS {n}" for n, t in d.ACTION_COUNTS.items())


@query("defensive_team_totals", "A26", DENSE + f" SELECT matchId, teamName, count(*) AS total, {_CNT} FROM feed WHERE {DEF} GROUP BY ALL")
def defensive_team_totals(spark, sf_dir):
    return d.defensive_team_totals(feed(spark, sf_dir))


@query("defensive_player_summary", "A26", DENSE + SEQ_SQL + f""",
b AS (SELECT matchId, playerName, count(*) AS total, {_CNT}, {n_sql('x < 35')} AS defensive_third, {n_sql('x >= 35 AND x < 70')} AS middle_third, {n_sql('x >= 70')} AS attacking_third FROM feed WHERE {DEF} GROUP BY ALL),
c1 AS (SELECT l.matchId, cpl AS pl, count(*) AS n FROM cpp JOIN lo l ON l.eventId = cpp.id GROUP BY ALL),
c2 AS (SELECT matchId, regain_player AS pl, count(*) AS n FROM seq WHERE counterpress_success GROUP BY ALL),
tk AS (SELECT matchId, regain_id, max_by(recovery_seconds, "index") AS s, any_value(regain_player) AS pl FROM seq WHERE regain_is_action GROUP BY ALL),
c3 AS (SELECT tk.matchId, pl, sum(s)::double/count(s) AS a FROM tk JOIN feed f ON f.eventId = tk.regain_id WHERE {DEF} GROUP BY ALL)
SELECT b.*, coalesce(c1.n,0) AS counterpress_actions, coalesce(c2.n,0) AS counterpress_regains, a AS avg_time_to_player_regain, {ratio_sql('coalesce(c2.n,0)','greatest(1,coalesce(c1.n,0))',100)} AS counterpress_success_pct
FROM b LEFT JOIN c1 ON c1.matchId=b.matchId AND c1.pl=b.playerName LEFT JOIN c2 ON c2.matchId=b.matchId AND c2.pl=b.playerName LEFT JOIN c3 ON c3.matchId=b.matchId AND c3.pl=b.playerName""")
def defensive_player_summary(spark, sf_dir):
    return d.defensive_player_summary(feed(spark, sf_dir))


_PROF = []
for _n in d.TEAM_PROFILES:
    if _n == "Counterpress Control":
        _e = ratio_sql("counterpress_regains", "greatest(1, counterpress)", 56) + " + counterpress::double/total*28 + retained::double/total*16"
    else:
        _e = " + ".join(f"{k}::double/total*{w}" for k, w in d.PROFILE_WEIGHTS[_n].items())
    _PROF.append(f"SELECT matchId, teamName, total, '{_n}' AS profile, CAST(floor(greatest(0, least(100, {_e})) + 0.5) AS INT) AS score FROM g")


@query("defensive_profiles", "A59", DENSE + SEQ_SQL + f""",
nx AS (SELECT *, lead(teamName,1) OVER w AS t1, lead(type,1) OVER w AS y1 FROM feed WINDOW w AS (PARTITION BY matchId ORDER BY "index")),
cs AS (SELECT DISTINCT cid FROM cpp), rs AS (SELECT DISTINCT regain_id FROM seq WHERE counterpress_success),
a AS (SELECT *, coalesce(t1 = teamName, false) AS kept, type IN ('BallRecovery','Interception','Tackle') AS rg_, type IN ('Clearance','BlockedPass','Aerial') AS em, type IN ('Foul','Error') AS ri, eventId IN (SELECT cid FROM cs) AS cp, eventId IN (SELECT cid FROM cs) AND eventId IN (SELECT regain_id FROM rs WHERE regain_id IS NOT NULL) AS cr FROM nx WHERE {DEF}),
g AS (SELECT matchId, teamName, count(*) AS total, {n_sql('x >= 70 AND rg_')} AS high_regains, {n_sql('kept')} AS retained, {n_sql('x >= 70')} AS attacking_third, {n_sql('x < 35')} AS defensive_third, {n_sql('x < 35 AND em')} AS deep_emergency, {n_sql('em')} AS emergency,
 {n_sql("kept AND y1 IN ('Pass','Carry','TakeOn','Shot','Goal','MissedShots','SavedShot')")} AS transition_next, {n_sql('rg_')} AS regains, {n_sql('ri')} AS risk, {n_sql('x < 35 AND ri')} AS deep_risk, {n_sql('cr')} AS counterpress_regains, {n_sql('cp')} AS counterpress FROM a GROUP BY ALL)
""" + " UNION ALL ".join(_PROF))
def defensive_profiles(spark, sf_dir):
    return d.defensive_profiles(state.with_score(feed(spark, sf_dir)))
