"""Facts of each analysis view. The SQL twins write the rules out over the views' own SQL."""

from pyspark.sql import functions as F

from touchline.catalog import defending, duels, match_state, match_views, possession_views, research, shots
from touchline.catalog.feed_checks import DENSE
from touchline.catalog.registry import QUERIES, query
from touchline.functions.core import fixed
from touchline.operators import grids, state
from touchline.plans import facts as f
from touchline.sources.feed import match_feed


def _views(**names) -> str:
    return "WITH " + ", ".join(f"{k} AS MATERIALIZED ({QUERIES[n].sql if n in QUERIES else n})" for k, n in names.items())


def _first(table: str, keys: str, order: str, where: str = "true") -> str:
    return f"(SELECT * FROM {table} WHERE {where} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1)"


def _facts(view: str, parts: list[tuple]) -> str:
    """Rows of (place, text, team, subject, other, value, other value, source)."""
    whole = lambda v: f"CAST(floor(({v})::double*1e6+0.5) AS BIGINT)"
    return " " + " UNION ALL ".join(
        f"SELECT matchId, '{view}' AS \"view\", {team} AS team, {place} AS place, {text} AS \"text\", CAST({subject} AS VARCHAR) AS subject, CAST({other} AS VARCHAR) AS other, "
        f"{whole(value)} AS value_micro, {whole(value2)} AS other_micro FROM {source}" for place, text, team, subject, other, value, value2, source in parts)


def _shown(view, tables):
    out = f.view_facts(view, tables)
    return out.withColumn("value_micro", fixed(F.col("value"))).withColumn("other_micro", fixed(F.col("other_value"))).drop("value", "other_value")


@query("facts_match_dynamics", "A49", _views(tm="dynamics_team_summary", fl="attack_flanks") + """,
p AS (SELECT a.matchId, a.teamName AS t, b.teamName AS o, a.xg, b.xg AS oxg, a.possession_pct AS pp, b.possession_pct AS opp, a.ppda AS pd, b.ppda AS opd FROM tm a JOIN tm b ON a.matchId=b.matchId AND a.teamName<>b.teamName)"""
       + _facts("match-dynamics", [
           (1, "CASE WHEN xg-oxg >= 0.75 THEN 'better_chances' ELSE 'even_chances' END", "t", "t", "o", "xg", "oxg", "p WHERE xg > oxg OR (xg = oxg AND t < o)"),
           (2, "CASE WHEN goals < xg THEN 'below_chances' ELSE 'above_chances' END", "teamName", "teamName", "NULL", "goals", "xg", _first("tm", "matchId", "teamName", "abs(goals - xg) >= 1")),
           (3, "CASE WHEN xg < oxg THEN 'ball_without_threat' ELSE 'ball_and_threat' END", "t", "t", "CASE WHEN xg < oxg THEN o END", "pp", "greatest(xg, oxg)", "p WHERE (pp > opp OR (pp = opp AND t < o)) AND pp >= 58"),
           (4, "'harder_press'", "t", "t", "o", "pd", "opd", "p WHERE (pd < opd OR (pd = opd AND t < o)) AND opd - pd >= 2"),
           (5, "'best_route'", "teamName", "flank", "teamName", "total_xg", "num_attacks", _first("fl", "matchId", "total_xg DESC, teamName, flank", "total_xg > 0"))]))
def facts_match_dynamics(spark, sf_dir):
    return _shown("match-dynamics", f.dynamics_tables(grids.with_epv(grids.with_xt(match_state.state_feed(spark, sf_dir)))))


@query("facts_shots", "A49", _views(tm="shot_team_totals", pl="shot_player_summary", sr=DENSE + shots.LEAD_SQL + " SELECT * FROM srd WHERE NOT own_goal") + ", bs AS MATERIALIZED " + _first("sr", "matchId", 'xg DESC, "index"')
       + """, bg AS (SELECT matchId, team, player, n, g FROM (SELECT *, count(*) OVER (PARTITION BY matchId) AS n, count(*) FILTER (WHERE type='Goal') OVER (PARTITION BY matchId) AS g FROM sr WHERE xg > 0.35) QUALIFY row_number() OVER (PARTITION BY matchId ORDER BY "index") = 1),
 ot AS (SELECT p.* FROM pl p LEFT JOIN bs b ON b.matchId=p.matchId WHERE p."playerName" IS DISTINCT FROM b.player)"""
       + _facts("shots", [
           (1, "CASE WHEN xg/shots >= 0.12 THEN 'good_looks' ELSE 'low_value_shots' END", "team", "team", "NULL", "shots", "xg", "tm WHERE shots > 0"),
           (2, "CASE WHEN type='Goal' THEN 'biggest_chance_scored' ELSE 'biggest_chance_missed' END", "team", "player", "NULL", "xg", '"minute"', "bs"),
           (3, "'big_chances'", "team", "player", "NULL", "n", "g", "bg"),
           (4, "'other_threat'", "team", '"playerName"', "NULL", "total_xg", "total_shots", _first("ot", "matchId", 'total_xg DESC, total_shots DESC, "playerName"') + " WHERE total_xg > 0")]))
def facts_shots(spark, sf_dir):
    return _shown("shots", f.shot_tables(shots.shot_feed(spark, sf_dir)))


_KPI = possession_views.SQUAD + possession_views.XF_SQL + f""" SELECT matchId, teamName, {match_views.THIRD('x')} AS third, CASE WHEN count(*) = 0 THEN 0 ELSE count(*) FILTER (WHERE {match_views.OK})::double*100/count(*) END AS completion_pct,
 coalesce(sum(CASE WHEN {match_views.OK} THEN cast(floor(xtv*1e6+0.5) as bigint) END), 0)::double/1e6 AS xt, count(*) FILTER (WHERE {match_views.OK} AND {possession_views.PROG}) AS progressive FROM xf WHERE {match_views.PASS} GROUP BY ALL"""


@query("facts_in_possession", "A49", _views(th=_KPI, ch="channel_profile", pr="pass_pairs", ce="pass_network_centralization") + _facts("in-possession", [
    (1, "'final_third_passing'", "teamName", "third", "NULL", "completion_pct", "xt", "th WHERE third = 'final'"),
    (2, "'threat_from_deeper'", "teamName", "third", "NULL", "xt", "progressive", _first("th", "matchId, teamName", "xt DESC, third") + " WHERE third <> 'final'"),
    (3, "'main_channel'", "teamName", "area", "NULL", "xt_micro/1e6::double", "final_third_entries", _first("ch", "matchId, teamName", "xt_micro DESC, area", "\"view\" = 'origin'")),
    (4, "'top_pair'", "teamName", "playerId", "receiver", '"count"', "NULL", 'pr WHERE "rank" = 1'),
    (5, "CASE WHEN centralization_index >= 0.15 THEN 'one_hub' ELSE 'spread_build_up' END", "teamName", "teamName", "NULL", "centralization_index", "NULL", "ce WHERE centralization_index > 0")]))
def facts_in_possession(spark, sf_dir):
    return _shown("in-possession", f.in_possession_tables(possession_views.feed(spark, sf_dir)))


_ACTS = DENSE + f" SELECT matchId, teamName, playerName, type, CASE WHEN coalesce(x,0) >= 70 THEN 'Attacking Third' WHEN coalesce(x,0) >= 35 THEN 'Middle Third' ELSE 'Defensive Third' END AS third FROM feed WHERE {defending.DEF} AND playerName IS NOT NULL"


@query("facts_out_of_possession", "A49", _views(tm="defensive_team_totals", ac=_ACTS) + """,
p AS (SELECT a.matchId, a.teamName AS t, b.teamName AS o, a.total AS n, b.total AS m FROM tm a JOIN tm b ON a.matchId=b.matchId AND a.teamName<>b.teamName),
w AS (SELECT matchId, teamName, playerName, count(*) AS n, count(*) FILTER (WHERE type='Tackle') AS k FROM ac GROUP BY ALL), h AS (SELECT matchId, teamName, third, count(*) AS n FROM ac GROUP BY ALL),
h2 AS (SELECT *, sum(n) OVER (PARTITION BY matchId, teamName) AS whole FROM h)""" + _facts("out-of-possession", [
    (1, "'defensive_actions'", "teamName", "teamName", "NULL", "total", "tackles", "tm"),
    (2, "'more_defending'", "t", "t", "o", "n", "m", "p WHERE n - m >= 15"),
    (3, "'defensive_workhorse'", "teamName", "playerName", "NULL", "n", "k", _first("w", "matchId, teamName", "n DESC, playerName")),
    (4, "'defending_third'", "teamName", "third", "NULL", "n", "whole", _first("h2", "matchId, teamName", "n DESC, third"))]))
def facts_out_of_possession(spark, sf_dir):
    return _shown("out-of-possession", f.out_of_possession_tables(state.with_score(defending.feed(spark, sf_dir))))


@query("facts_duels", "A49", _views(tm="duel_team_summary", pl="duel_player_summary") + """,
p AS (SELECT a.matchId, a.team AS t, b.team AS o, a.duel_win_pct AS w, b.duel_win_pct AS v FROM tm a JOIN tm b ON a.matchId=b.matchId AND a.team<>b.team)""" + _facts("duels-transitions", [
    (1, "'duels_edge'", "t", "t", "o", "w", "v", "p WHERE w > v OR (w = v AND t < o)"),
    (2, "'transitions_used'", "team", "team", "NULL", "transitions_to_attack", "transitions", "tm WHERE transitions > 0"),
    (3, "'top_duelist'", "NULL", "player", "NULL", "duels_won", "duel_win_pct", _first("pl", "matchId", "duels_won DESC, transitions_to_attack DESC, duels DESC, player"))]))
def facts_duels(spark, sf_dir):
    return _shown("duels-transitions", f.duel_tables(duels.feed(spark, sf_dir)))


@query("facts_player_analysis", "A49", _views(ac="player_action_summary", tc=research.SQUAD + " SELECT matchId, teamName, playerName AS player, count(*) FILTER (WHERE isTouch) AS touches FROM feed GROUP BY ALL") + """,
pl AS MATERIALIZED (SELECT * FROM ac JOIN tc USING (matchId, teamName, player)),
b AS MATERIALIZED (SELECT matchId, teamName, arg_min(player, (-touches, player)) AS t, max(touches) AS tn, arg_min(player, (-in_possession, player)) AS i, max(in_possession) AS "in", arg_min(player, (-out_of_possession, player)) AS o, max(out_of_possession) AS "on",
 arg_min(player, (-shots, player)) AS s, max(shots) AS sn, arg_min(player, (-duels, player)) AS d, max(duels) AS dn FROM pl GROUP BY ALL)""" + _facts("player-analysis", [
    (1, "'most_touches'", "teamName", "t", "NULL", "tn", "NULL", "b"), (2, "'most_on_the_ball'", "teamName", "i", "NULL", '"in"', "NULL", "b WHERE i <> t"),
    (3, "'most_off_the_ball'", "teamName", "o", "NULL", '"on"', "NULL", "b"), (4, "'most_shots'", "teamName", "s", "NULL", "sn", "NULL", "b WHERE sn > 0"),
    (5, "'most_duels'", "teamName", "d", "NULL", "dn", "NULL", "b WHERE dn > 0 AND d <> o")]))
def facts_player_analysis(spark, sf_dir):
    return _shown("player-analysis", f.player_tables(match_feed(spark, sf_dir, 20, 1, 14)))
