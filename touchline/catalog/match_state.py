"""Match state: clock, score, possession, receivers, previous action, carries, value grids."""

import uuid

from pyspark.sql import functions as F

from touchline.catalog.feed_checks import DENSE, FEED
from touchline.catalog.registry import fsum_sql, query
from touchline.functions.core import fsum, n_if
from touchline.functions.predicates import is_shot
from touchline.operators import carries, grids, state
from touchline.session import checkpoint_dir
from touchline.sources import store
from touchline.sources.feed import match_feed

OUT_OF_PLAY = ("('SubstitutionOn','SubstitutionOff','FormationChange','FormationSet','End','OffsideProvoked','Start',"
               "'GoodSkill','PenaltyFaced','ChanceMissed','CrossNotClaimed')")
TAKES = "('Tackle','Interception','Clearance','BallRecovery','Aerial','BlockedPass','Challenge','KeeperPickup','KeeperSweeper','Claim')"
ENDS = "('Goal','SavedShot','MissedShots','ShotOnPost','OffsideGiven','Dispossessed','CornerAwarded')"


def possession_sql(view: bool) -> str:
    now = " OR turnover" if view else ""
    return f""",
kept AS (SELECT matchId, "index", teamName, type, outcomeType, turnover,
   lag(teamName) OVER w AS p_team, lag(type) OVER w AS p_type, lag(outcomeType) OVER w AS p_out, lag(turnover) OVER w AS p_to
   FROM feed WHERE type NOT IN {OUT_OF_PLAY} WINDOW w AS (PARTITION BY matchId ORDER BY "index")),
flagged AS (SELECT *, CASE WHEN p_team IS NULL THEN 0 WHEN p_type = 'Goal' THEN 1
   WHEN teamName <> p_team AND (p_to{now} OR (type IN {TAKES} AND outcomeType = 'Successful') OR p_type IN {ENDS}
     OR p_out = 'Unsuccessful') THEN 1 ELSE 0 END AS chg FROM kept),
numbered AS (SELECT *, 1 + CAST(sum(chg) OVER (PARTITION BY matchId ORDER BY "index") AS BIGINT) AS possession_id FROM flagged),
poss AS (SELECT matchId, "index", possession_id,
   first_value(teamName) OVER (PARTITION BY matchId, possession_id ORDER BY "index") AS possession_team FROM numbered)"""


SCORE_SQL = """,
scored AS (SELECT *,
   CAST(coalesce(sum(CASE WHEN type = 'Goal' AND (h_a = 'h') <> goalOwn THEN 1 ELSE 0 END) OVER b, 0) AS BIGINT) AS home_score_before,
   CAST(coalesce(sum(CASE WHEN type = 'Goal' AND (h_a = 'h') = goalOwn THEN 1 ELSE 0 END) OVER b, 0) AS BIGINT) AS away_score_before
   FROM feed WINDOW b AS (PARTITION BY matchId ORDER BY "index" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
game AS (SELECT *, CASE WHEN h_a = 'h' THEN home_score_before - away_score_before ELSE away_score_before - home_score_before END
   AS team_goal_diff_before FROM scored),
gamestate AS (SELECT *, CASE WHEN team_goal_diff_before = 0 THEN 'level' WHEN team_goal_diff_before = 1 THEN 'leading_by_1'
   WHEN team_goal_diff_before > 1 THEN 'leading_by_2_plus' WHEN team_goal_diff_before = -1 THEN 'trailing_by_1'
   ELSE 'trailing_by_2_plus' END AS team_score_state FROM game)"""

# Feed with possession (view rule) and score state in one relation named "st".
STATE_SQL = possession_sql(True) + SCORE_SQL + """,
st AS (SELECT g.*, p.possession_id, p.possession_team, CAST("minute" * 60 + "second" AS BIGINT) AS t
   FROM gamestate g LEFT JOIN poss p USING (matchId, "index"))"""


def state_feed(spark, sf_dir, teams: int = 20):
    """Feed with possession (view rule) and score state."""
    return state.with_possession(match_feed(spark, sf_dir, teams), score=True)


@query("match_clock", "W1", DENSE + """,
spans AS (SELECT matchId, period, min("minute"*60+"second") lo, max("minute"*60+"second") hi FROM feed GROUP BY ALL),
shift AS (SELECT s.matchId, s.period, CASE WHEN s.period = 'FirstHalf' THEN 0 ELSE p.hi - s.lo END sh
  FROM spans s LEFT JOIN spans p ON p.matchId = s.matchId AND s.period = 'SecondHalf' AND p.period = 'FirstHalf')
SELECT f.eventId, CAST(f."minute"*60+f."second" + sh AS BIGINT) AS clock_s, (f."minute"*60+f."second" + sh)::double / 60.0::double AS cumulative_mins
FROM feed f JOIN shift USING (matchId, period)""")
def match_clock(spark, sf_dir):
    return state.with_match_clock(match_feed(spark, sf_dir, pace=4)).select("eventId", "clock_s", "cumulative_mins")


@query("score_state", "W3 P25 P33", FEED + SCORE_SQL + """
SELECT eventId, home_score_before, away_score_before, team_goal_diff_before, team_score_state,
 CASE team_score_state WHEN 'level' THEN 'Level' WHEN 'leading_by_1' THEN 'Leading by 1' WHEN 'leading_by_2_plus' THEN 'Leading by 2+'
  WHEN 'trailing_by_1' THEN 'Trailing by 1' ELSE 'Trailing by 2+' END AS team_score_state_label,
 concat(home_score_before, '-', away_score_before) AS score_before FROM gamestate""")
def score_state(spark, sf_dir):
    return state.with_score(match_feed(spark, sf_dir)).select(
        "eventId", "home_score_before", "away_score_before", "team_goal_diff_before", "team_score_state",
        "team_score_state_label", "score_before")


@query("possession_ingest_rule", "W2a", FEED + possession_sql(False) + """
SELECT f.eventId, p.possession_id, p.possession_team FROM feed f LEFT JOIN poss p USING (matchId, "index")""")
def possession_ingest_rule(spark, sf_dir):
    return state.with_possession(match_feed(spark, sf_dir), "ingest").select("eventId", "possession_id", "possession_team")


@query("possession_view_rule", "W2b", FEED + possession_sql(True) + """
SELECT f.eventId, p.possession_id, p.possession_team FROM feed f LEFT JOIN poss p USING (matchId, "index")""")
def possession_view_rule(spark, sf_dir):
    return state.with_possession(match_feed(spark, sf_dir)).select("eventId", "possession_id", "possession_team")


def archived(spark, sf_dir):
    """The feed, published to an archive in the shared folder and read from there; the source's bound does not travel with it."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/archive-{uuid.uuid4().hex}"
    store.publish(match_feed(spark, sf_dir).drop("k", "ts", "v100"), root)
    return store.read_events(spark, root)


@query("archive_possessions", "S1 S8 W2b", FEED + possession_sql(True) + """
SELECT f.eventId, p.possession_id, p.possession_team FROM feed f LEFT JOIN poss p USING (matchId, "index")""")
def archive_possessions(spark, sf_dir):
    """Published events under the plan for matches of any length: scans in segments."""
    return state.with_possession(archived(spark, sf_dir)).select("eventId", "possession_id", "possession_team")


@query("archive_scores", "S1 W3", FEED + SCORE_SQL + """
SELECT eventId, home_score_before, away_score_before, team_score_state FROM gamestate""")
def archive_scores(spark, sf_dir):
    """Published events with the bound that a pass over their positions proves."""
    return state.with_score(store.with_bound(archived(spark, sf_dir))).select("eventId", "home_score_before", "away_score_before", "team_score_state")


@query("pass_receivers_network", "J15", FEED + """,
k AS (SELECT eventId, type, teamName, playerName, lead(teamName) OVER w nt, lead(playerId) OVER w np, lead(playerName) OVER w nn
  FROM feed WHERE type <> 'Card' WINDOW w AS (PARTITION BY matchId ORDER BY "index"))
SELECT eventId, CASE WHEN nt = teamName THEN np END AS receiver, CASE WHEN nt = teamName THEN nn END AS "receiverName"
FROM k WHERE type = 'Pass'""")
def pass_receivers_network(spark, sf_dir):
    out = state.with_receiver(match_feed(spark, sf_dir))
    return out.where("type = 'Pass'").select("eventId", "receiver", "receiverName")


@query("pass_receivers_season", "J15", FEED + """,
k AS (SELECT eventId, type, outcomeType, teamName, lead(teamName) OVER w nt, lead(playerName) OVER w nn
  FROM feed WINDOW w AS (PARTITION BY matchId ORDER BY "index"))
SELECT eventId, nn AS "receiverName" FROM k WHERE type = 'Pass' AND outcomeType = 'Successful' AND nt = teamName""")
def pass_receivers_season(spark, sf_dir):
    out = state.with_receiver(match_feed(spark, sf_dir), "season")
    return out.where("receiverName is not null").select("eventId", "receiverName")


@query("shot_previous_action", "J7", DENSE + """,
a AS (SELECT *, "minute"*60+"second" AS t, CASE WHEN type NOT IN ('SubstitutionOn','SubstitutionOff','FormationChange','Card','Start','End','Save')
   THEN "index" END AS ai FROM feed),
b AS (SELECT *, max(ai) OVER (PARTITION BY matchId ORDER BY "index" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pi FROM a)
SELECT s.eventId, CASE WHEN s.t - p.t <= 20 THEN p.eventId END AS prev_event, CASE WHEN s.t - p.t <= 20 THEN p.type END AS prev_type,
  CAST(CASE WHEN s.t - p.t <= 20 THEN s.t - p.t END AS BIGINT) AS prev_age
FROM b s LEFT JOIN a p ON p.matchId = s.matchId AND p."index" = s.pi WHERE s."isShot" """)
def shot_previous_action(spark, sf_dir):
    out = state.with_previous_action(match_feed(spark, sf_dir, pace=4)).where(is_shot())
    return out.select("eventId", F.col("prev.eventId").alias("prev_event"), F.col("prev.type").alias("prev_type"),
                      (state.clock_seconds() - F.col("prev.t")).alias("prev_age"))


CLOCK_SQL = """,
spans AS (SELECT matchId, period, min("minute"*60+"second") lo, max("minute"*60+"second") hi FROM feed GROUP BY ALL),
shift AS (SELECT s.matchId, s.period, CASE WHEN s.period = 'FirstHalf' THEN 0 ELSE p.hi - s.lo END sh
  FROM spans s LEFT JOIN spans p ON p.matchId = s.matchId AND s.period = 'SecondHalf' AND p.period = 'FirstHalf'),
ck AS (SELECT f.*, "minute"*60+"second" + sh AS c FROM feed f JOIN shift USING (matchId, period))"""

CARRY_SQL = CLOCK_SQL + """,
nx AS (SELECT a.eventId AS id, min(b."index") AS ni FROM ck a JOIN ck b ON b.matchId = a.matchId AND b."index" > a."index" AND b."index" <= a."index" + 400
  AND NOT (b.type IN ('TakeOn','Foul') OR (b.type = 'Challenge' AND b.outcomeType = 'Unsuccessful' AND b.teamId <> a.teamId))
  GROUP BY a.eventId),
pr AS (SELECT a.*, n."index" AS n_i, n.eventId AS n_e, n.teamId AS n_team, n.playerId AS n_pl, n.type AS n_type, n.outcomeType AS n_out, n.x AS n_x, n.y AS n_y,
   n.c AS n_c, n.period AS n_per, i."minute" AS i_m, i."second" AS i_s, i.c AS i_c
  FROM ck a JOIN nx ON nx.id = a.eventId JOIN ck n ON n.matchId = a.matchId AND n."index" = nx.ni
  JOIN ck i ON i.matchId = a.matchId AND i."index" = a."index" + 1),
cl AS (SELECT *, teamId = n_team AS same, (teamId <> n_team AND type IN ('Pass','Carry','TakeOn','GoodSkill','Clearance') AND outcomeType = 'Unsuccessful'
    AND n_type IN ('Pass','Carry','TakeOn','GoodSkill') AND n_out = 'Successful') AS turned,
   (endX IS NULL OR endY IS NULL OR (endX = 0 AND endY = 0 AND type IN ('Tackle','Challenge','BallRecovery','Interception','Aerial','Foul'))) AS noend FROM pr),
st0 AS (SELECT *, CASE WHEN same AND noend THEN x WHEN turned THEN 105.0::double - endX ELSE endX END AS sx,
   CASE WHEN same AND noend THEN y WHEN turned THEN 68.0::double - endY ELSE endY END AS sy FROM cl),
carry AS (SELECT *, ("minute"*60+"second") + (i_m*60+i_s) AS t2 FROM st0 WHERE (same OR turned)
   AND (sx-n_x)*(sx-n_x)+(sy-n_y)*(sy-n_y) BETWEEN 9 AND 3600 AND n_c - c >= 1 AND n_c - c < 10 AND period = n_per)"""


@query("synthetic_carries", "J8 P6", DENSE + CARRY_SQL + """
SELECT c.matchId, c.eventId::double + 0.5 AS event_ord, n_team AS "teamId", n_pl AS "playerId", sx AS x, sy AS y, n_x AS "endX", n_y AS "endY",
  CAST(t2 // 120 AS INT) AS "minute", t2::double/2 - (t2 // 120)*60 AS "second", (c + i_c)::double/2/60 AS cumulative_mins, n_e AS "relatedEventId",
  (SELECT count(*) FROM feed f WHERE f.matchId = c.matchId AND f."index" > c."index" AND f."index" < c.n_i AND f.type = 'TakeOn' AND f.outcomeType = 'Successful') AS "takeOns"
FROM carry c""")
def synthetic_carries(spark, sf_dir):
    ev = state.with_match_clock(match_feed(spark, sf_dir, pace=4))
    found = carries.find_carries(ev).where("carry is not null")
    return found.select("matchId", (F.col("eventId") + 0.5).alias("event_ord"), "carry.teamId", "carry.playerId", "carry.x", "carry.y",
                        "carry.endX", "carry.endY", "carry.minute", "carry.second", "carry.cumulative_mins",
                        "carry.relatedEventId", "carry.takeOns")


@query("events_with_carries", "M15 J8 U1", DENSE + CARRY_SQL + """,
al AS (SELECT matchId, "index" AS i, 0 AS g, eventId::double AS event_ord FROM feed UNION ALL SELECT matchId, "index", 1, eventId::double + 0.5 FROM carry)
SELECT matchId, event_ord, row_number() OVER (PARTITION BY matchId ORDER BY i, g) - 1 AS "index", g = 1 AS is_generated FROM al""")
def events_with_carries(spark, sf_dir):
    ev = state.with_match_clock(match_feed(spark, sf_dir, pace=4))
    return carries.with_carries(ev).select("matchId", "event_ord", "index", "is_generated")


GRID_SQL = """,
cells AS (SELECT CAST(i // 32 AS INT) AS r, CAST(i % 32 AS INT) AS c, (i % 32 + 0.5::double)/32 AS gx, (i // 32 + 0.5::double)/22 AS gy FROM range(704) t(i)),
g1 AS (SELECT *, 1.0::double - least(1.0::double, abs(gy-0.5)/0.5) AS ce, greatest(0.0::double, least(1.0::double, 1.0 - sqrt((1.0-gx)*(1.0-gx) + ((gy-0.5)*0.72)*((gy-0.5)*0.72))/1.24)) AS nr,
   greatest(0.0::double, least(1.0::double, (gx-0.66)/0.34)) AS fin, CASE WHEN gx >= 88.5::double/105 AND abs(gy-0.5) <= 20.16::double/68 THEN 1.0::double ELSE 0 END AS bx,
   CASE WHEN gx >= 99.5::double/105 AND abs(gy-0.5) <= 9.16::double/68 THEN 1.0::double ELSE 0 END AS sy FROM cells),
g2 AS (SELECT r, c, 0.004::double + 0.018::double*pow(gx,1.6) + 0.065::double*nr*nr*nr + 0.030::double*fin*pow(ce,1.3) + 0.055::double*bx*ce + 0.050::double*sy*ce AS v FROM g1),
grid AS (SELECT r, c, least(0.32::double, max(v) OVER (PARTITION BY r ORDER BY c)) AS v FROM g2)"""

EPV_SQL = GRID_SQL + """,
epv AS (SELECT f.eventId, a.v AS epv_start, b.v AS epv_end, b.v - a.v AS epv_added, a.c AS sc, a.r AS sr, b.c AS ec, b.r AS er FROM feed f
 JOIN grid a ON a.c = least(31, floor(f.x/105.0::double*32)) AND a.r = least(21, floor(f.y/68.0::double*22))
 JOIN grid b ON b.c = least(31, floor(f.endX/105.0::double*32)) AND b.r = least(21, floor(f.endY/68.0::double*22))
 WHERE f.type IN ('Pass','Carry') AND f.outcomeType = 'Successful' AND f.x BETWEEN 0 AND 105 AND f.y BETWEEN 0 AND 68
   AND f.endX BETWEEN 0 AND 105 AND f.endY BETWEEN 0 AND 68)"""


@query("epv_grid_lookup", "J1 S19 P48", FEED + EPV_SQL + f"""
SELECT eventId, sc AS epv_start_zone_x, sr AS epv_start_zone_y, ec AS epv_end_zone_x, er AS epv_end_zone_y,
  CAST(floor(epv_added*1e6 + 0.5) AS BIGINT) AS epv_added_micro FROM epv""")
def epv_grid_lookup(spark, sf_dir):
    from touchline.functions.core import fixed
    out = grids.with_epv(match_feed(spark, sf_dir)).where("epv_added is not null")
    return out.select("eventId", "epv_start_zone_x", "epv_start_zone_y", "epv_end_zone_x", "epv_end_zone_y",
                      fixed(F.col("epv_added")).alias("epv_added_micro"))


@query("epv_quality_summary", "A45", FEED + EPV_SQL + f"""
SELECT f.matchId, f.type, count(*) AS actions, count(e.eventId) AS scored, count(*) - count(e.eventId) AS missing,
 {fsum_sql('e.epv_added')} AS epv_added_total, {fsum_sql('CASE WHEN e.epv_added > 0 THEN e.epv_added END')} AS epv_added_positive,
 {fsum_sql('CASE WHEN e.epv_added < 0 THEN e.epv_added END')} AS epv_added_negative
FROM feed f LEFT JOIN epv e USING (eventId) WHERE f.type IN ('Pass','Carry') AND f.outcomeType = 'Successful' GROUP BY f.matchId, f.type""")
def epv_quality_summary(spark, sf_dir):
    return epv_quality(grids.with_epv(match_feed(spark, sf_dir)), "matchId")


def epv_quality(events, *keys):
    e = F.col("epv_added")
    return (events.where(F.col("epv_action_eligible")).groupBy(*keys, "type")
            .agg(F.count("*").alias("actions"), F.count(e).alias("scored"), n_if(e.isNull()).alias("missing"),
                 fsum(e).alias("epv_added_total"), fsum(F.when(e > 0, e)).alias("epv_added_positive"),
                 fsum(F.when(e < 0, e)).alias("epv_added_negative")))


@query("xt_grid_observed_bins", "J1", FEED + GRID_SQL + """,
e AS (SELECT * FROM feed WHERE type IN ('Pass','Carry') AND outcomeType = 'Successful' AND NOT list_contains(qualifiers, 'CornerTaken')),
s AS (SELECT matchId, min(x) lx, max(x) hx, min(y) ly, max(y) hy, min(endX) lex, max(endX) hex_, min(endY) ley, max(endY) hey FROM e GROUP BY matchId),
b AS (SELECT eventId, greatest(0, least(31, ceil((x-lx)/((hx-lx)/32))-1)) c1, greatest(0, least(21, ceil((y-ly)/((hy-ly)/22))-1)) r1,
  greatest(0, least(31, ceil((endX-lex)/((hex_-lex)/32))-1)) c2, greatest(0, least(21, ceil((endY-ley)/((hey-ley)/22))-1)) r2 FROM e JOIN s USING (matchId))
SELECT eventId, CAST(c1 AS INT) AS xt_start_zone_x, CAST(r1 AS INT) AS xt_start_zone_y, CAST(c2 AS INT) AS xt_end_zone_x, CAST(r2 AS INT) AS xt_end_zone_y,
  CAST(floor((h.v-g.v)*1e6+0.5) AS BIGINT) AS xt_micro
FROM b JOIN grid g ON g.c = c1 AND g.r = r1 JOIN grid h ON h.c = c2 AND h.r = r2""")
def xt_grid_observed_bins(spark, sf_dir):
    from touchline.functions.core import fixed
    out = grids.with_xt_grid(match_feed(spark, sf_dir), grids.default_epv_grid(spark), 22, 32, "observed")
    return out.where("xT is not null").select("eventId", "xt_start_zone_x", "xt_start_zone_y", "xt_end_zone_x",
                                              "xt_end_zone_y", fixed(F.col("xT")).alias("xt_micro"))


XT_SQL = """,
xt AS (SELECT eventId, greatest(-0.25::double, least(0.5::double, pow(endX/105.0::double,1.7)*(0.72::double+0.28::double*(1.0::double-abs(endY-34)/34.0::double))
  - pow(x/105.0::double,1.7)*(0.72::double+0.28::double*(1.0::double-abs(y-34)/34.0::double)))) AS xt FROM feed WHERE type IN ('Pass','Carry') AND outcomeType = 'Successful')"""


@query("xt_closed_form", "P49", FEED + XT_SQL + f"""
SELECT f.matchId, f.teamName, {fsum_sql('xt')} AS xt_total, {fsum_sql('CASE WHEN xt > 0 THEN xt END')} AS xt_positive, count(xt) AS scored
FROM feed f LEFT JOIN xt USING (eventId) GROUP BY f.matchId, f.teamName""")
def xt_closed_form(spark, sf_dir):
    ev = grids.with_xt(match_feed(spark, sf_dir))
    x = F.col("xT")
    return ev.groupBy("matchId", "teamName").agg(
        fsum(x).alias("xt_total"), fsum(F.when(x > 0, x)).alias("xt_positive"),
        n_if(F.col("type").isin("Pass", "Carry") & (F.col("outcomeType") == "Successful")).alias("scored"))


@query("centred_epv_lookup", "J2", FEED + GRID_SQL + """,
d AS (SELECT *, CASE WHEN h_a = 'h' THEN 1 ELSE -1 END AS dir, x/105.0::double*106.0::double-53.0::double AS mx, y-34.0::double AS my,
  endX/105.0::double*106.0::double-53.0::double AS nx, endY-34.0::double AS ny FROM feed WHERE type = 'Pass' AND outcomeType = 'Successful'),
c AS (SELECT *, floor((mx+53.0::double-0.0001::double)/(106.0::double/32)) AS a, floor((my+34.0::double-0.0001::double)/(68.0::double/22)) AS b,
  floor((nx+53.0::double-0.0001::double)/(106.0::double/32)) AS a2, floor((ny+34.0::double-0.0001::double)/(68.0::double/22)) AS b2 FROM d),
k AS (SELECT eventId, greatest(0, least(31, CASE WHEN dir = -1 THEN 31 - a ELSE a END)) AS a, greatest(0, least(21, b)) AS b,
  greatest(0, least(31, CASE WHEN dir = -1 THEN 31 - a2 ELSE a2 END)) AS a2, greatest(0, least(21, b2)) AS b2 FROM c)
SELECT eventId, CAST(floor((h.v-g.v)*1e6+0.5) AS BIGINT) AS epv_micro FROM k JOIN grid g ON g.c = a AND g.r = b JOIN grid h ON h.c = a2 AND h.r = b2""")
def centred_epv_lookup(spark, sf_dir):
    from touchline.functions.core import fixed
    ev = match_feed(spark, sf_dir).withColumn("attack_direction", F.when(F.col("h_a") == "h", 1).otherwise(-1))
    out = grids.with_centred_epv(ev, grids.default_epv_grid(spark), 22, 32).where("EPV is not null")
    return out.select("eventId", fixed(F.col("EPV")).alias("epv_micro"))
