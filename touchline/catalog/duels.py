"""Duels and transitions."""

from touchline.catalog.feed_checks import DENSE
from touchline.catalog.registry import n_sql, pct_sql, query
from touchline.plans import duels as d
from touchline.sources.feed import match_feed

MOVES, SHOTS, SAVES = d.MOVES, d.SHOTS, d.SAVES
EX = "CASE WHEN coalesce(endX,0)=0 AND coalesce(endY,0)=0 THEN x ELSE endX END"
EY = "CASE WHEN coalesce(endX,0)=0 AND coalesce(endY,0)=0 THEN y ELSE endY END"
BASE_SQL = f""",
du AS (SELECT *, "minute"*60+"second" AS t, CASE WHEN type='Aerial' THEN 'Aerial' WHEN type IN {d.GROUND} THEN 'Ground' ELSE 'Total' END AS category, outcomeType='Successful' AS ok,
  (type='Aerial' OR type IN {d.GROUND}) AS is_duel, type IN {MOVES} AS moves, type NOT IN ('Card','CornerAwarded') AS valid,
  (type IN {SHOTS} OR type='CornerAwarded' OR (type IN {MOVES} AND outcomeType='Successful' AND {EX} >= 88.5 AND {EY} BETWEEN 13.84 AND 54.16)) AS led,
  CASE type WHEN 'TakeOn' THEN 'Take-on' WHEN 'SavedShot' THEN 'Saved Shot' WHEN 'MissedShots' THEN 'Shot' WHEN 'KeeperPickup' THEN 'Save' WHEN 'Claim' THEN 'Save' WHEN 'KeeperSweeper' THEN 'Save' ELSE type END AS label FROM feed),
pr AS (SELECT a.eventId AS id, b.* FROM du a JOIN du b ON a.matchId=b.matchId AND b."index" BETWEEN a."index"-3 AND a."index"+3 AND a.is_duel AND b.is_duel AND abs(a.t-b.t) <= 1 AND a.category=b.category
  AND abs(CASE WHEN a.teamName<>b.teamName THEN 105-b.x ELSE b.x END - a.x) <= 3.5 AND abs(CASE WHEN a.teamName<>b.teamName THEN 68-b.y ELSE b.y END - a.y) <= 3.5),
wn AS (SELECT id, coalesce(min_by(playerName, "index") FILTER (WHERE ok), min_by(playerName, "index")) AS w, coalesce(min_by(teamName, "index") FILTER (WHERE ok), min_by(teamName, "index")) AS wt, bool_or(NOT ok) AS anylost FROM pr GROUP BY id),
ls AS (SELECT pr.id, min_by(pr.playerName, pr."index") AS l FROM pr JOIN wn USING (id) WHERE (NOT anylost OR NOT ok) AND (playerName <> w OR teamName <> wt) GROUP BY pr.id),
dp AS (SELECT du.*, wn.w AS duel_winner, ls.l AS duel_loser FROM du LEFT JOIN wn ON wn.id=du.eventId LEFT JOIN ls ON ls.id=du.eventId)"""
DUEL_SQL = BASE_SQL + f""",
nb AS (SELECT a.eventId AS id, a."index" AS ai, a.t AS at_, a.teamName AS atn, b.*, EXISTS (SELECT 1 FROM pr WHERE pr.id=a.eventId AND pr.eventId=b.eventId) AS near_pair,
   (b.is_duel AND abs(a.t-b.t) <= 1 AND a.category=b.category AND abs(CASE WHEN a.teamName<>b.teamName THEN 105-b.x ELSE b.x END - a.x) <= 3.5
     AND abs(CASE WHEN a.teamName<>b.teamName THEN 68-b.y ELSE b.y END - a.y) <= 3.5) AS samep
   FROM dp a JOIN dp b ON a.matchId=b.matchId AND a.is_duel AND b."index" BETWEEN a."index"-10 AND a."index"+23 AND b."index" <> a."index"),
pv AS (SELECT id, max_by(CASE WHEN duel_loser IS NOT NULL THEN eventId ELSE -1 END, "index") AS v FROM nb WHERE "index" < ai AND is_duel AND NOT samep AND at_-t BETWEEN 0 AND 2 GROUP BY id),
nd AS (SELECT id, min_by(CASE WHEN duel_loser IS NOT NULL THEN eventId ELSE -1 END, "index") AS v FROM nb WHERE "index" > ai AND "index" <= ai+10 AND is_duel AND NOT samep AND t-at_ BETWEEN 0 AND 2 GROUP BY id),
pm AS (SELECT id, max("index") AS i FROM nb WHERE "index" < ai AND "index" >= ai-8 AND moves GROUP BY id),
fo AS (SELECT * FROM nb WHERE "index" > ai AND t-at_ BETWEEN 0 AND 15),
fl AS (SELECT id, bool_or(teamName=atn AND led) AS led, min("index") FILTER (WHERE valid AND moves) AS m1, bool_or(valid) AS anyv, min("index") FILTER (WHERE valid AND moves AND ok AND teamName<>atn) AS m2,
  min("index") FILTER (WHERE valid AND type IN {SAVES}) AS sv, min("index") FILTER (WHERE valid AND teamName=atn) AS own, min("index") FILTER (WHERE valid AND teamName<>atn) AS opp FROM fo GROUP BY id),
f2 AS (SELECT fl.*, (SELECT max(s."index") FROM fo s WHERE s.id=fl.id AND s.type IN {SHOTS} AND s.t <= (SELECT z.t FROM fo z WHERE z.id=fl.id AND z."index"=fl.sv)) AS sb,
  (SELECT ok FROM fo z WHERE z.id=fl.id AND z."index"=fl.m1) AS m1ok FROM fl),
f3 AS (SELECT *, CASE WHEN m1 IS NOT NULL THEN CASE WHEN NOT m1ok THEN coalesce(m2, m1) ELSE m1 END WHEN sv IS NOT NULL THEN coalesce(sb, sv) ELSE coalesce(own, opp) END AS ni FROM f2),
dctx AS (SELECT a.matchId, a.eventId, a."index", a."minute", a."second", a.teamName, a.playerName, a.type, a.category, CASE WHEN a.type='Foul' THEN CASE WHEN a.ok THEN 'foul won' ELSE 'foul committed' END WHEN a.type='TakeOn' THEN 'takeon'
   WHEN a.type IN ('Tackle','Challenge') THEN 'tackle' ELSE lower(a.type) END AS classification, a.ok AS won, a.x, a.y,
   CASE WHEN a.x < 35 THEN 'Defensive Third' WHEN a.x < 70 THEN 'Middle Third' ELSE 'Attacking Third' END AS zone, a.duel_winner, a.duel_loser, nullif(pv.v, -1) AS previous_duel_id,
   CASE WHEN nullif(pv.v,-1) IS NULL THEN p.type END AS previous_event, CASE WHEN nullif(pv.v,-1) IS NULL THEN p.playerName END AS previous_player,
   CASE WHEN n.eventId IS NULL THEN 'unknown' WHEN f3.led AND NOT (NOT a.ok AND a.x < 35) THEN 'led_to_attack' WHEN n.teamName=a.teamName AND n.ok THEN 'retained' ELSE 'turnover' END AS duel_context,
   CASE WHEN n.eventId IS NULL THEN 'No follow-up' WHEN f3.led AND NOT (NOT a.ok AND a.x < 35) THEN 'Led to attack' WHEN n.teamName=a.teamName AND n.ok THEN CASE WHEN a.category='Aerial' AND p.teamName<>a.teamName THEN 'Second ball recovered' ELSE 'Ball retained' END
     WHEN a.category='Aerial' AND n.teamName<>a.teamName THEN 'Second ball lost' WHEN n.type='Dispossessed' THEN concat('Possession lost by ', n.playerName) ELSE 'Turnover' END AS duel_context_label,
   n.type AS next_event, n.playerName AS next_player, n.teamName AS next_team, CASE WHEN n.type IN {MOVES} OR n.type IN {SAVES} THEN n.label WHEN n.type IN {d.DEFENDING} THEN 'Defensive action' ELSE n.type END AS next_event_label,
   CASE WHEN f3.m1 IS NULL THEN nullif(nd.v, -1) END AS next_duel_id
  FROM dp a LEFT JOIN pv ON pv.id=a.eventId LEFT JOIN nd ON nd.id=a.eventId LEFT JOIN pm ON pm.id=a.eventId LEFT JOIN du p ON p.matchId=a.matchId AND p."index"=pm.i
  LEFT JOIN f3 ON f3.id=a.eventId LEFT JOIN du n ON n.matchId=a.matchId AND n."index"=f3.ni WHERE a.is_duel)"""


def feed(spark, sf_dir):
    return match_feed(spark, sf_dir, pace=4)


@query("duels_with_context", "J10 J11 A27 P16 P18 P35", DENSE + DUEL_SQL + " SELECT * FROM dctx")
def duels_with_context(spark, sf_dir):
    return d.duels_with_context(feed(spark, sf_dir))


LOSS = "(turnover OR type='Dispossessed')"
PROD = (f"CASE type WHEN 'Goal' THEN concat('Goal by ',playerName) WHEN 'SavedShot' THEN concat('Saved shot by ',playerName) WHEN 'MissedShots' THEN concat('Shot by ',playerName) WHEN 'CornerAwarded' THEN 'Corner won' "
        f"ELSE CASE WHEN type IN {MOVES} AND {EX} >= 88.5 AND {EY} BETWEEN 13.84 AND 54.16 THEN concat(label,' into box by ',playerName) WHEN type IN {MOVES} THEN concat('Advanced ',lower(label),' by ',playerName) ELSE concat(label,' by ',playerName) END END")
ENDED = f"CASE WHEN type IN {MOVES} AND NOT ok THEN concat('Unsuccessful ',lower(label),' by ',playerName) WHEN {LOSS} THEN concat('Possession lost by ',playerName) END"


def trans_sql(mode: str) -> str:
    start = "l" if mode == "Defensive" else "f"
    return BASE_SQL + f""",
tl AS (SELECT *, coalesce({ENDED}, {PROD}) AS ch0, {ENDED} AS ended, {PROD} AS prod, concat(label,' by ',playerName,' (',teamName,')') AS oth,
  (type IN {SHOTS} OR type='CornerAwarded' OR (type IN {MOVES} AND ok AND greatest(x, coalesce(endX,0)) >= 70)) AS att FROM du),
t1 AS (SELECT *, CASE WHEN type IN {d.DEFENDING} THEN NULL ELSE ch0 END AS chain, CASE WHEN type IN {SHOTS} OR type='CornerAwarded' THEN prod ELSE ended END AS term FROM tl),
fi AS (SELECT l.eventId AS id, min(b."index") AS i FROM t1 l JOIN t1 b ON l.matchId=b.matchId AND b."index" > l."index" AND b."index" <= l."index"+18 AND b.teamName=l.opponentName WHERE {LOSS.replace('turnover','l.turnover').replace('type','l.type')} GROUP BY l.eventId),
s0 AS (SELECT l.eventId AS loss_id, l.opponentName AS fol, {start}.* FROM fi JOIN t1 l ON l.eventId=fi.id JOIN t1 f ON f.matchId=l.matchId AND f."index"=fi.i),
ca AS (SELECT s.loss_id, s.fol, b.* FROM s0 s JOIN t1 b ON b.matchId=s.matchId AND b."index" > s."index" AND b."index" <= s."index"+23 AND b.t-s.t BETWEEN 0 AND 14),
at1 AS (SELECT loss_id, min("index") FILTER (WHERE teamName=fol AND att) AS a, max("index") FILTER (WHERE teamName=fol) AS lastown FROM ca GROUP BY loss_id),
te AS (SELECT ca.loss_id, min("index") AS x_ FROM ca JOIN at1 USING (loss_id) WHERE "index" >= a AND (teamName<>fol OR term IS NOT NULL) GROUP BY ca.loss_id),
lb AS (SELECT ca.loss_id, ca."index", CASE WHEN teamName<>fol THEN oth ELSE chain END AS lab FROM ca JOIN at1 USING (loss_id) LEFT JOIN te USING (loss_id) WHERE CASE WHEN a IS NOT NULL THEN "index" <= coalesce(x_, a) ELSE teamName=fol END),
l2 AS (SELECT *, lag(lab) OVER (PARTITION BY loss_id ORDER BY "index") AS pl FROM lb WHERE lab IS NOT NULL),
l3 AS (SELECT *, row_number() OVER (PARTITION BY loss_id ORDER BY "index") AS rn FROM l2 WHERE lab IS DISTINCT FROM pl),
l4 AS (SELECT loss_id, string_agg(lab, ', ' ORDER BY rn) AS fu FROM l3 WHERE rn <= 3 GROUP BY loss_id),
tr AS (SELECT s.matchId, s.loss_id, s.eventId AS start_id, s.teamName AS team, s.playerName AS player, s.type AS start_type, '{mode}' AS transition_type, a IS NOT NULL AS led_to_attack, s.x, s.y,
  coalesce(e.x, s.x) AS end_x, coalesce(e.y, s.y) AS end_y, CASE WHEN s.x < 35 THEN 'Defensive Third' WHEN s.x < 70 THEN 'Middle Third' ELSE 'Attacking Third' END AS third, coalesce(fu, '') AS followup,
  CASE WHEN a IS NULL THEN 'No attacking follow-up' WHEN x_ IS NULL THEN 'Attack developed; no terminal event in window' ELSE CASE WHEN e.teamName<>s.fol THEN e.oth ELSE e.term END END AS end_product
  FROM s0 s LEFT JOIN at1 USING (loss_id) LEFT JOIN te USING (loss_id) LEFT JOIN l4 USING (loss_id) LEFT JOIN t1 e ON e.matchId=s.matchId AND e."index"=coalesce(x_, a, lastown))"""


@query("transitions_offensive", "J12 A27 P51", DENSE + trans_sql("Offensive") + " SELECT * FROM tr")
def transitions_offensive(spark, sf_dir):
    return d.transitions(feed(spark, sf_dir), "Offensive")


@query("transitions_defensive", "J12 A27 P51", DENSE + trans_sql("Defensive") + " SELECT * FROM tr")
def transitions_defensive(spark, sf_dir):
    return d.transitions(feed(spark, sf_dir), "Defensive")


SUM_SQL = trans_sql("Offensive") + f""",
dd AS (SELECT matchId, playerName AS player, teamName AS team, true AS d, ok AS won, category, false AS a FROM du WHERE is_duel UNION ALL SELECT matchId, player, team, false, false, '', led_to_attack FROM tr)"""


@query("duel_player_summary", "A27 A61", DENSE + SUM_SQL + f""",
g AS (SELECT matchId, player, {n_sql('d')} AS duels, {n_sql('won')} AS duels_won, {n_sql("category='Ground'")} AS ground, {n_sql("category='Aerial'")} AS aerial, {n_sql('NOT d')} AS transitions, {n_sql('a')} AS transitions_to_attack FROM dd GROUP BY ALL)
SELECT *, {pct_sql('duels_won','duels')} AS duel_win_pct, {pct_sql('transitions_to_attack','transitions')} AS transition_hit_pct FROM g""")
def duel_player_summary(spark, sf_dir):
    ev = feed(spark, sf_dir)
    return d.duel_player_summary(d.with_duel_columns(ev).where("is_duel"), d.transitions(ev))


@query("duel_team_summary", "A27", DENSE + SUM_SQL + f""",
g AS (SELECT matchId, team, {n_sql('d')} AS duels, {n_sql('won')} AS duels_won, {n_sql('NOT d')} AS transitions, {n_sql('a')} AS transitions_to_attack FROM dd GROUP BY ALL) SELECT *, {pct_sql('duels_won','duels')} AS duel_win_pct FROM g""")
def duel_team_summary(spark, sf_dir):
    ev = feed(spark, sf_dir)
    return d.duel_team_summary(d.with_duel_columns(ev).where("is_duel"), d.transitions(ev))


_PROFILES = [("Ground Duel Edge", "category='Ground' AND won", "category='Ground'"), ("Aerial Control", "category='Aerial' AND won", "category='Aerial'"),
             ("Attack Starter", "won AND duel_context='led_to_attack'", "won"), ("Risk Zone Losses", "zone <> 'Attacking Third' AND NOT won", "zone <> 'Attacking Third'")]


@query("duel_profiles", "A61", DENSE + DUEL_SQL.replace("dctx AS (", "dctx AS MATERIALIZED (") + ", pf AS (" + " UNION ALL ".join(
    f"SELECT matchId, teamName, '{k}' AS profile, {n_sql(x)} AS hits, {n_sql(y)} AS \"rows\" FROM dctx GROUP BY matchId, teamName" for k, x, y in _PROFILES)
       + f""") SELECT *, CAST(floor({pct_sql('hits', '"rows"')}+0.5) AS INT) AS score FROM pf""")
def duel_profiles(spark, sf_dir):
    return d.duel_profiles(d.duels_with_context(feed(spark, sf_dir)))


@query("transition_player_rows", "A61", DENSE + trans_sql("Offensive") + f""",
g AS (SELECT matchId, team, player, count(*) AS transitions, {n_sql('led_to_attack')} AS to_attack, {n_sql('NOT led_to_attack')} AS stalled, {n_sql("third='Defensive Third'")} AS defensive_third, {n_sql("third='Middle Third'")} AS middle_third,
 {n_sql("third='Attacking Third'")} AS attacking_third FROM tr WHERE player IS NOT NULL GROUP BY ALL)
SELECT *, CAST(floor({pct_sql('to_attack','transitions')}+0.5) AS INT) AS hit_pct FROM g""")
def transition_player_rows(spark, sf_dir):
    return d.transition_player_rows(d.transitions(feed(spark, sf_dir)))


@query("duel_zone_map", "A76", DENSE + BASE_SQL + f"""
SELECT matchId, teamName, CAST(least(5, floor(x/17.5)) AS INT) AS zone_x, CAST(least(4, floor(y/13.6)) AS INT) AS zone_y, count(*) AS duels, {n_sql('ok')} AS won, {n_sql('NOT ok')} AS lost FROM du WHERE is_duel GROUP BY ALL""")
def duel_zone_map(spark, sf_dir):
    return d.duel_zone_map(d.with_duel_columns(feed(spark, sf_dir)).where("is_duel"))


@query("transition_zone_map", "A76", DENSE + trans_sql("Offensive") + f"""
SELECT matchId, team, CAST(least(2, floor(x/35)) AS INT) AS zone_x, CAST(least(2, floor(y/(68.0::double/3))) AS INT) AS zone_y, count(*) AS transitions, {n_sql('led_to_attack')} AS to_attack FROM tr GROUP BY ALL""")
def transition_zone_map(spark, sf_dir):
    return d.transition_zone_map(d.transitions(feed(spark, sf_dir)))
