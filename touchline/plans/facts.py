"""Facts of the analysis views: rules as data, compiled into one aggregate for each view table and scope.

A view table has ``matchId``, ``team``, ``name`` (team, player, lane ...) and its measures. A `Leader` names the rows that
are compared and by what; a `Rule` says when a leader is worth a fact and which numbers it carries. Missing measures come
last, equal ones by name. A rule whose place is shared stands for one of several wordings of the same fact.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from touchline.functions import predicates as p, zones as z
from touchline.functions.core import fsum, n_if
from touchline.plans import defending, duels as du, match_views as mv, possession_views as pv, research, shots as sh

MATCH, SIDE, ROW = ("matchId",), ("matchId", "team"), ("matchId", "team", "name")


@dataclass(frozen=True)
class Leader:
    """First (``best``) and last (``rest``) row of a scope, the number of rows ``n`` and the sum ``total``, over rows that meet ``among``."""
    name: str
    table: str
    per: tuple[str, ...]
    by: tuple[str, ...] = ("0",)
    among: str = "true"
    tie: str = "name"
    total: str = "0"


@dataclass(frozen=True)
class Rule:
    """A fact ``text`` where ``when`` holds; expressions read leaders of the same table and scope by name."""
    view: str
    place: int
    text: str
    leader: str
    when: str
    value: str
    other_value: str = "null"
    second: str = "null"


LEADERS = [
    Leader("chances", "teams", MATCH, ("xg",)),
    Leader("finishing", "teams", MATCH, among="abs(goals - xg) >= 1"),
    Leader("ball", "teams", MATCH, ("possession_pct",)),
    Leader("press", "teams", MATCH, ("-ppda",)),
    Leader("route", "flanks", MATCH, ("total_xg",), tie="place"),
    Leader("volume", "shot_teams", ROW),
    Leader("biggest", "shots", MATCH, ("xg",), tie="place"),
    Leader("big", "shots", MATCH, among="xg > 0.35", tie="place", total="scored"),
    Leader("threat", "shot_players", MATCH, ("total_xg", "total_shots"), among="not holds_biggest"),
    Leader("final", "thirds", SIDE, among="name = 'final'"),
    Leader("zone", "thirds", SIDE, ("xt",)),
    Leader("channel", "channels", SIDE, ("xt",)),
    Leader("pair", "pairs", SIDE, ("-rank",)),
    Leader("hub", "centre", SIDE),
    Leader("defence", "defence", ROW),
    Leader("busier", "defence", MATCH, ("actions",)),
    Leader("worker", "defenders", SIDE, ("actions",)),
    Leader("third", "defence_thirds", SIDE, ("actions",), total="actions"),
    Leader("duelling", "duel_teams", MATCH, ("duel_win_pct",)),
    Leader("moves", "duel_teams", ROW),
    Leader("duelist", "duel_players", MATCH, ("duels_won", "transitions_to_attack", "duels")),
    Leader("toucher", "players", SIDE, ("touches",)),
    Leader("attacker", "players", SIDE, ("in_possession",)),
    Leader("defender", "players", SIDE, ("out_of_possession",)),
    Leader("shooter", "players", SIDE, ("shots",)),
    Leader("fighter", "players", SIDE, ("duels",)),
]

# The limits from which a difference, share or count is a fact.
RULES = [
    Rule("match-dynamics", 1, "better_chances", "chances", "chances.n = 2 and chances.best.xg - chances.rest.xg >= 0.75", "chances.best.xg", "chances.rest.xg", "chances.rest.name"),
    Rule("match-dynamics", 1, "even_chances", "chances", "chances.n = 2 and chances.best.xg - chances.rest.xg < 0.75", "chances.best.xg", "chances.rest.xg", "chances.rest.name"),
    Rule("match-dynamics", 2, "below_chances", "finishing", "finishing.best.goals < finishing.best.xg", "finishing.best.goals", "finishing.best.xg"),
    Rule("match-dynamics", 2, "above_chances", "finishing", "finishing.best.goals > finishing.best.xg", "finishing.best.goals", "finishing.best.xg"),
    Rule("match-dynamics", 3, "ball_without_threat", "ball", "ball.n = 2 and ball.best.possession_pct >= 58 and ball.best.xg < ball.rest.xg", "ball.best.possession_pct", "ball.rest.xg", "ball.rest.name"),
    Rule("match-dynamics", 3, "ball_and_threat", "ball", "ball.n = 2 and ball.best.possession_pct >= 58 and ball.best.xg >= ball.rest.xg", "ball.best.possession_pct", "ball.best.xg"),
    Rule("match-dynamics", 4, "harder_press", "press", "press.n = 2 and press.rest.ppda - press.best.ppda >= 2", "press.best.ppda", "press.rest.ppda", "press.rest.name"),
    Rule("match-dynamics", 5, "best_route", "route", "route.best.total_xg > 0", "route.best.total_xg", "route.best.num_attacks", "route.best.team"),
    Rule("shots", 1, "good_looks", "volume", "volume.best.shots > 0 and volume.best.xg / volume.best.shots >= 0.12", "volume.best.shots", "volume.best.xg"),
    Rule("shots", 1, "low_value_shots", "volume", "volume.best.shots > 0 and volume.best.xg / volume.best.shots < 0.12", "volume.best.shots", "volume.best.xg"),
    Rule("shots", 2, "biggest_chance_scored", "biggest", "biggest.n > 0 and biggest.best.scored = 1", "biggest.best.xg", "biggest.best.minute"),
    Rule("shots", 2, "biggest_chance_missed", "biggest", "biggest.n > 0 and biggest.best.scored = 0", "biggest.best.xg", "biggest.best.minute"),
    Rule("shots", 3, "big_chances", "big", "big.n > 0", "big.n", "big.total"),
    Rule("shots", 4, "other_threat", "threat", "threat.best.total_xg > 0", "threat.best.total_xg", "threat.best.total_shots"),
    Rule("in-possession", 1, "final_third_passing", "final", "final.n > 0", "final.best.completion_pct", "final.best.xt"),
    Rule("in-possession", 2, "threat_from_deeper", "zone", "zone.best.name <> 'final'", "zone.best.xt", "zone.best.progressive"),
    Rule("in-possession", 3, "main_channel", "channel", "channel.n > 0", "channel.best.xt", "channel.best.final_third_entries"),
    Rule("in-possession", 4, "top_pair", "pair", "pair.n > 0", "pair.best.passes", second="pair.best.receiver"),
    Rule("in-possession", 5, "one_hub", "hub", "hub.best.index >= 0.15", "hub.best.index"),
    Rule("in-possession", 5, "spread_build_up", "hub", "hub.best.index > 0 and hub.best.index < 0.15", "hub.best.index"),
    Rule("out-of-possession", 1, "defensive_actions", "defence", "defence.n > 0", "defence.best.actions", "defence.best.tackles"),
    Rule("out-of-possession", 2, "more_defending", "busier", "busier.n = 2 and busier.best.actions - busier.rest.actions >= 15", "busier.best.actions", "busier.rest.actions", "busier.rest.name"),
    Rule("out-of-possession", 3, "defensive_workhorse", "worker", "worker.n > 0", "worker.best.actions", "worker.best.tackles"),
    Rule("out-of-possession", 4, "defending_third", "third", "third.total > 0", "third.best.actions", "third.total"),
    Rule("duels-transitions", 1, "duels_edge", "duelling", "duelling.n = 2", "duelling.best.duel_win_pct", "duelling.rest.duel_win_pct", "duelling.rest.name"),
    Rule("duels-transitions", 2, "transitions_used", "moves", "moves.best.transitions > 0", "moves.best.transitions_to_attack", "moves.best.transitions"),
    Rule("duels-transitions", 3, "top_duelist", "duelist", "duelist.n > 0", "duelist.best.duels_won", "duelist.best.duel_win_pct"),
    Rule("player-analysis", 1, "most_touches", "toucher", "toucher.n > 0", "toucher.best.touches"),
    Rule("player-analysis", 2, "most_on_the_ball", "attacker", "attacker.best.name <> toucher.best.name", "attacker.best.in_possession"),
    Rule("player-analysis", 3, "most_off_the_ball", "defender", "defender.n > 0", "defender.best.out_of_possession"),
    Rule("player-analysis", 4, "most_shots", "shooter", "shooter.best.shots > 0", "shooter.best.shots"),
    Rule("player-analysis", 5, "most_duels", "fighter", "fighter.best.duels > 0 and fighter.best.name <> defender.best.name", "fighter.best.duels"),
]


def c(name):
    return F.col(name)


def _leading(leader: Leader, columns: Iterable[str]):
    """Both ends of a leader's order as one column; min_by and max_by fold rows inside map tasks."""
    keep, row = F.expr(leader.among), F.struct(*columns)
    last = F.lit(float("-inf"))
    order = F.struct(*[(-F.coalesce(F.expr(b).cast("double"), last)).alias(f"b{i}") for i, b in enumerate(leader.by)], c(leader.tie).alias("tie"))
    rows, at = F.when(keep, row), F.when(keep, order)
    return F.struct(F.min_by(rows, at).alias("best"), F.max_by(rows, at).alias("rest"), n_if(keep).alias("n"),
                    fsum(F.when(keep, F.expr(leader.total).cast("double"))).alias("total")).alias(leader.name)


def view_facts(view: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Facts of one view: ``matchId, view, team, place, text, subject, other, value, other_value``.

    Each (table, scope) is grouped once for all its leaders; a rule without its rows or table gives nothing. ``team`` is the side
    of the leading row. Rows without a name or side take part like any other.
    """
    used = {l.name: l for l in LEADERS if l.table in tables}
    wanted = [r for r in RULES if r.view == view and r.leader in used]
    parts = []
    for table, per in dict.fromkeys((l.table, l.per) for l in used.values()):
        rows = tables[table]
        measures = [n for n in rows.columns if n != "matchId"]
        made = rows.groupBy(*per).agg(*[_leading(l, measures) for l in used.values() if (l.table, l.per) == (table, per)])
        text = lambda e: F.expr(e).cast("string")
        found = [F.when(F.expr(r.when), F.struct(
            F.expr(f"{r.leader}.best.team").alias("team"), F.lit(r.place).alias("place"), F.lit(r.text).alias("text"), text(f"{r.leader}.best.name").alias("subject"),
            text(r.second).alias("other"), F.expr(r.value).cast("double").alias("value"), F.expr(r.other_value).cast("double").alias("other_value")))
            for r in wanted if (used[r.leader].table, used[r.leader].per) == (table, per)]
        if found:
            parts.append(made.select("matchId", F.explode(F.array_compact(F.array(*found))).alias("f")).select("matchId", F.lit(view).alias("view"), "f.*"))
    return reduce(DataFrame.unionByName, parts)


def dynamics_tables(events: DataFrame) -> dict[str, DataFrame]:
    """Tables of the match dynamics page; ``events`` carry possession, score state and pitch values."""
    teams = mv.dynamics_summary(events).select("matchId", c("teamName").alias("team"), c("teamName").alias("name"), "goals", "xg", "possession_pct", "ppda")
    flanks = mv.attack_flanks(events).select("matchId", c("teamName").alias("team"), c("flank").alias("name"), "num_attacks", "total_xg",
                                             F.struct("teamName", "flank").alias("place"))
    return {"teams": teams, "flanks": flanks}


def shot_tables(events: DataFrame) -> dict[str, DataFrame]:
    """Tables of the shots page. The player with the match's biggest chance is marked by one small row per match."""
    totals = sh.shot_team_totals(events).select("matchId", "team", c("team").alias("name"), "shots", "xg")
    rows = sh.shot_rows(events).where(~c("own_goal")).select(
        "matchId", "team", c("player").alias("name"), "xg", "minute", (c("type") == "Goal").cast("int").alias("scored"), c("index").alias("place"))
    holder = rows.groupBy("matchId").agg(F.min_by("name", F.struct(-c("xg"), "place")).alias("holder"))
    players = sh.shot_player_summary(events).join(holder, "matchId", "left").select(
        "matchId", "team", c("playerName").alias("name"), "total_xg", "total_shots", c("playerName").eqNullSafe(c("holder")).alias("holds_biggest"))
    return {"shot_teams": totals, "shots": rows, "shot_players": players}


def in_possession_tables(events: DataFrame) -> dict[str, DataFrame]:
    passes = pv.network_passes(events)
    side = ["matchId", c("teamName").alias("team")]
    return {
        "thirds": mv.third_kpis(events).select(*side, c("third").alias("name"), "completion_pct", "xt", "progressive"),
        "channels": pv.area_profile(events, "channel").where(c("view") == "origin").select(*side, c("area").alias("name"), "xt", "final_third_entries"),
        "pairs": pv.pass_pairs(passes, 1).select(*side, c("playerId").cast("string").alias("name"), c("receiver").cast("string").alias("receiver"), c("count").alias("passes"), "rank"),
        "centre": pv.centralization(passes).select(*side, c("teamName").alias("name"), c("centralization_index").alias("index"))}


def out_of_possession_tables(events: DataFrame) -> dict[str, DataFrame]:
    side = ["matchId", c("teamName").alias("team")]
    acts = events.where(p.defensive_action() & c("playerName").isNotNull()).select(*side, "playerName", z.third_name(c("x")).alias("third"), (c("type") == "Tackle").alias("tackle"))
    counted = [F.count("*").alias("actions"), n_if(c("tackle")).alias("tackles")]
    return {"defence": defending.defensive_team_totals(events).select(*side, c("teamName").alias("name"), c("total").alias("actions"), "tackles"),
            "defenders": acts.groupBy("matchId", "team", c("playerName").alias("name")).agg(*counted),
            "defence_thirds": acts.groupBy("matchId", "team", c("third").alias("name")).agg(*counted)}


def duel_tables(events: DataFrame) -> dict[str, DataFrame]:
    """Tables of duels and transitions; players have no side there, so theirs is left open."""
    rows, moves = du.with_duel_columns(events).where("is_duel"), du.transitions(events)
    none = F.lit(None).cast("string").alias("team")
    return {"duel_teams": du.duel_team_summary(rows, moves).select("matchId", "team", c("team").alias("name"), "duel_win_pct", "transitions", "transitions_to_attack"),
            "duel_players": du.duel_player_summary(rows, moves).select("matchId", none, c("player").alias("name"), "duels", "duels_won", "duel_win_pct", "transitions_to_attack")}


def player_tables(events: DataFrame) -> dict[str, DataFrame]:
    touches = events.groupBy("matchId", c("teamName").alias("team"), c("playerName").alias("name")).agg(n_if(c("isTouch")).alias("touches"))
    acts = research.player_action_summary(research.player_actions(events)).withColumnsRenamed({"teamName": "team", "player": "name"})
    return {"players": acts.join(touches, ["matchId", "team", "name"]).select("matchId", "team", "name", "touches", "in_possession", "out_of_possession", "shots", "duels")}
