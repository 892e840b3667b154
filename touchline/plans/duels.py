"""Duels with their before and after, and transitions with their follow-up chain.

Rows near an event are collected as small fixed-length arrays (at most 23 rows ahead, 10 back) over the
dense match position, in segments with copied edges; the rules then work on the arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from touchline.functions.core import n_if, pct
from touchline.operators.scan import with_halo

# Limits of the rules (rows, seconds, metres) and type groups.
PAIR_ROWS, PAIR_SECONDS, PAIR_METRES = 3, 1, 3.5
PREV_ROWS, NEXT_ROWS, DUEL_SECONDS, FOLLOW_SECONDS, FOLLOW_ROWS = 10, 10, 2, 15, 23
MOVE_BACK, TRANSITION_SECONDS = 8, 14
MOVES = "('Pass','Carry','TakeOn','GoodSkill')"
SHOTS = "('Goal','SavedShot','MissedShots','ShotOnPost')"
SAVES = "('Save','KeeperSave','KeeperPickup','Claim')"
IGNORED = ("('Start','End','FormationChange','FormationSet','SubstitutionOff','SubstitutionOn','Card','Pause','Resume',"
           "'CornerAwarded','BallTouch')")
DEFENDING = "('Tackle','Interception','BallRecovery','Challenge')"
GROUND = "('TakeOn','GoodSkill','ShieldBallOpp','Foul','Tackle','Challenge')"


def with_duel_columns(events: DataFrame) -> DataFrame:
    """Category, result and label of duels, and per-event facts the context rules read."""
    ev = events.selectExpr(
        "*", "cast(minute * 60 + second as bigint) as t",
        f"case when type = 'Aerial' then 'Aerial' when type in {GROUND} then 'Ground' else 'Total' end as category",
        "coalesce(lower(trim(outcomeType)), '') in ('successful', 'nan', '') as ok",
        "coalesce(exists(satisfiedTypes, s -> lower(s) = 'foulgiven'), false) as _given"
        if "satisfiedTypes" in events.columns else "false as _given",
        "coalesce(exists(satisfiedTypes, s -> lower(s) = 'foulcommitted'), false) as _committed"
        if "satisfiedTypes" in events.columns else "false as _committed")
    won = "coalesce(case when type = 'Foul' and _given then true when type = 'Foul' and _committed then false else lower(trim(outcomeType)) = 'successful' end, false)"
    ex = "if(coalesce(endX, 0.0) = 0 and coalesce(endY, 0.0) = 0, x, endX)"
    ey = "if(coalesce(endX, 0.0) = 0 and coalesce(endY, 0.0) = 0, y, endY)"
    return ev.selectExpr(
        "*", f"{won} as won", f"(type = 'Aerial' or type in {GROUND}) as is_duel",
        f"(type in {MOVES} and x is not null and y is not null) as moves",
        f"(type not in {IGNORED} and trim(type) <> '' and x is not null and y is not null) as valid",
        f"(type in {SHOTS} or type = 'CornerAwarded' or (type in {MOVES} and ok and coalesce({ex} >= 88.5 and {ey} between 13.84 and 54.16, false))) as leads_attack",
        f"case when type = 'Foul' then if({won}, 'foul won', 'foul committed') when type = 'TakeOn' then 'takeon' "
        "when type in ('Tackle','Challenge') then 'tackle' when type = 'GoodSkill' then 'skill' else lower(type) end as classification",
        f"case when type = 'TakeOn' then 'Take-on' when type = 'GoodSkill' then 'Skill' "
        "when type = 'SavedShot' and exists(qualifiers, q -> q = 'Blocked') then 'Blocked Shot' when type = 'SavedShot' then 'Saved Shot' "
        "when type = 'MissedShots' then 'Shot' when type = 'ShotOnPost' then 'Shot on Post' "
        f"when type in {SAVES} or lower(type) like 'save%' or lower(type) like 'keeper%' then 'Save' else type end as label").drop("_given", "_committed")


def _mirror(team_a: str, team_b: str, v: str, span: float) -> str:
    return f"if({team_a} <> {team_b}, {span} - {v}, {v})"


def _same_pair(o: str) -> str:
    """Whether event struct ``o`` is part of the current row's duel."""
    return (f"({o}.is_duel and abs({o}.t - t) <= {PAIR_SECONDS} and {o}.category = category "
            f"and abs({_mirror(o + '.teamName', 'teamName', o + '.x', 105.0)} - x) <= {PAIR_METRES} "
            f"and abs({_mirror(o + '.teamName', 'teamName', o + '.y', 68.0)} - y) <= {PAIR_METRES})")


def with_duel_pairs(events: DataFrame) -> DataFrame:
    """Winner and loser of the duel each duel row belongs to (rows within 3 places, 1 s and 3.5 m)."""
    ev = with_halo(with_duel_columns(events), back=PAIR_ROWS, ahead=PAIR_ROWS)
    w = W.partitionBy("matchId", "_seg").orderBy("index").rowsBetween(-PAIR_ROWS, PAIR_ROWS)
    near = F.collect_list(F.struct("index", "t", "teamName", "playerName", "category", "is_duel", "won", "x", "y")).over(w)
    ev = ev.withColumn("_near", F.when(F.col("is_duel"), near)).where("_own").drop("_seg", "_own")
    ev = ev.selectExpr("*", f"filter(_near, o -> {_same_pair('o')}) as _pair").drop("_near")
    ev = ev.selectExpr("*", "coalesce(get(filter(_pair, o -> o.won), 0), get(_pair, 0)) as _w",
                       "if(exists(_pair, o -> not o.won), filter(_pair, o -> not o.won), _pair) as _rest").drop("_pair")
    return ev.selectExpr("*", "get(filter(_rest, o -> o.playerName <> _w.playerName or o.teamName <> _w.teamName), 0) as _l").drop("_rest").selectExpr(
        "*", "_w.playerName as duel_winner", "_l.playerName as duel_loser").drop("_w", "_l")


def duels_with_context(events: DataFrame) -> DataFrame:
    """Every duel with the duel or movement before it and its outcome class.

    Before: a different duel within 10 rows and 2.5 s that has a loser, else the last movement within 8
    rows. After (23 rows, 15 s): ``led_to_attack``, ``retained``, ``turnover`` or ``unknown``, from the
    first movement, else save, else own, else opponent event. Positions are in match order.
    """
    ev = with_halo(with_duel_pairs(events), back=PREV_ROWS, ahead=FOLLOW_ROWS)
    w = W.partitionBy("matchId", "_seg").orderBy("index")
    body = F.struct("index", "eventId", "t", "type", "teamName", "playerName", "category", "is_duel", "won", "ok", "moves", "valid",
                    "leads_attack", "label", "x", "y", "duel_loser")
    prev = F.collect_list(body).over(w.rowsBetween(-PREV_ROWS, -1))
    ahead = F.collect_list(body).over(w.rowsBetween(1, FOLLOW_ROWS))
    ev = ev.withColumns({"_prev": F.when(F.col("is_duel"), prev), "_next": F.when(F.col("is_duel"), ahead)})
    ev = ev.where("_own and is_duel").drop("_seg", "_own")
    other = f"o.is_duel and not {_same_pair('o')}"
    ev = ev.selectExpr(
        "*", f"try_element_at(filter(_prev, o -> {other} and t - o.t between 0 and {DUEL_SECONDS}), -1) as _pd",
        f"try_element_at(filter(_prev, o -> o.moves and o.index >= index - {MOVE_BACK}), -1) as _pm",
        f"get(filter(_next, o -> {other} and o.index <= index + {NEXT_ROWS} and o.t - t between 0 and {DUEL_SECONDS}), 0) as _nd",
        f"filter(_next, o -> o.t - t between 0 and {FOLLOW_SECONDS}) as _f").drop("_prev", "_next")
    ev = ev.selectExpr("*", "filter(_f, o -> o.valid) as _v", "exists(_f, o -> o.teamName = teamName and o.leads_attack) as _led",
                       "if(_pd.duel_loser is not null, _pd, null) as _pduel", "if(_nd.duel_loser is not null, _nd, null) as _nduel")
    ev = ev.selectExpr("*", "filter(_v, o -> o.moves) as _m", f"filter(_v, o -> o.type in {SHOTS}) as _s", f"get(filter(_v, o -> o.type in {SAVES}), 0) as _save")
    ev = ev.selectExpr("*", """case when size(_m) > 0 then if(not get(_m, 0).ok, coalesce(get(filter(_m, o -> o.teamName <> teamName and o.ok), 0), get(_m, 0)), get(_m, 0))
        when _save is not null then coalesce(try_element_at(filter(_s, o -> o.t <= _save.t), -1), _save)
        else coalesce(get(filter(_v, o -> o.teamName = teamName), 0), get(_v, 0)) end as _n""")
    ev = ev.selectExpr("*", "(_led and not (not won and coalesce(x, 0.0) < 35)) as _attack", "(_n.teamName = teamName and _n.ok) as _kept")
    return ev.selectExpr(
        "matchId", "eventId", "index", "minute", "second", "teamName", "playerName", "type", "category", "classification", "won", "x", "y",
        "case when coalesce(x, 0.0) < 35 then 'Defensive Third' when x < 70 then 'Middle Third' else 'Attacking Third' end as zone",
        "duel_winner", "duel_loser", "_pduel.eventId as previous_duel_id",
        "if(_pduel is null, _pm.type, null) as previous_event", "if(_pduel is null, _pm.playerName, null) as previous_player",
        """case when _n is null then 'unknown' when _attack then 'led_to_attack' when _kept then 'retained' else 'turnover' end as duel_context""",
        """case when _n is null then 'No follow-up' when _attack then 'Led to attack'
            when _kept then if(category = 'Aerial' and _pm.teamName <> teamName, 'Second ball recovered', 'Ball retained')
            when category = 'Aerial' and _n.teamName <> teamName then 'Second ball lost'
            when _n.type = 'Dispossessed' then concat('Possession lost by ', _n.playerName) else 'Turnover' end as duel_context_label""",
        "_n.type as next_event", "_n.playerName as next_player", "_n.teamName as next_team",
        f"case when _n.type in {MOVES} or _n.type in {SAVES} then _n.label when _n.type in {DEFENDING} then 'Defensive action' else _n.type end as next_event_label",
        "if(size(_m) = 0, _nduel.eventId, null) as next_duel_id",
        *[n for n in ("team_score_state", "score_before") if n in events.columns])


def transitions(events: DataFrame, mode: str = "Offensive", seconds: int = TRANSITION_SECONDS) -> DataFrame:
    """Possession losses seen as transitions.

    ``Defensive``: the loser's view, followed from the loss. ``Offensive``: the winner's view, followed
    from its first event within 18 rows of the loss. The chain holds what the attacking side did within
    ``seconds`` up to the event that ended it.
    """
    ev = with_duel_columns(events)
    by = "if(coalesce(trim(playerName), '') <> '', concat(' by ', playerName), '')"
    ex = "if(coalesce(endX, 0.0) = 0 and coalesce(endY, 0.0) = 0, x, endX)"
    ey = "if(coalesce(endX, 0.0) = 0 and coalesce(endY, 0.0) = 0, y, endY)"
    lost = "(coalesce(turnover, false) or type = 'Dispossessed')"
    ev = ev.selectExpr("*", f"{by} as _by", f"{lost} as _lost",
                       f"(type in {SHOTS} or type = 'CornerAwarded' or (type in {MOVES} and ok and greatest(coalesce(x, 0.0), coalesce(endX, 0.0)) >= 70)) as attacks",
                       f"coalesce({ex} >= 88.5 and {ey} between 13.84 and 54.16, false) as _boxed")
    product = (f"case when type = 'Goal' then concat('Goal', _by) when type = 'SavedShot' and label = 'Blocked Shot' then concat('Blocked shot', _by) "
               "when type = 'SavedShot' then concat('Saved shot', _by) when type = 'MissedShots' then concat('Shot', _by) "
               "when type = 'ShotOnPost' then concat('Shot on post', _by) when type = 'CornerAwarded' then 'Corner won' "
               f"when type in {MOVES} and _boxed then concat(label, ' into box', _by) when type in {MOVES} then concat('Advanced ', lower(label), _by) "
               "else concat(label, _by) end")
    ended = (f"case when type in {MOVES} and not ok then concat('Unsuccessful ', lower(label), _by) when _lost then concat('Possession lost', _by) end")
    ev = ev.selectExpr("*", f"{product} as _product", f"{ended} as _ended", "concat(label, _by, ' (', teamName, ')') as _other")
    ev = ev.selectExpr("*", f"case when type in {DEFENDING} then null else coalesce(_ended, _product) end as _chain",
                       f"case when type in {SHOTS} or type = 'CornerAwarded' then _product else _ended end as _end")
    ev = with_halo(ev, back=0, ahead=18 + FOLLOW_ROWS + 1)
    w = W.partitionBy("matchId", "_seg").orderBy("index")
    body = F.struct("index", "eventId", "t", "type", "teamName", "playerName", "attacks", "_chain", "_end", "_other", "x", "y")
    reach = 18 + FOLLOW_ROWS
    ev = ev.withColumn("_next", F.when(F.col("_lost"), F.collect_list(body).over(w.rowsBetween(1, reach)))).where("_own and _lost").drop("_seg", "_own")
    # Defensive: the chain starts at the loss. Offensive: at the other side's first event within 18 rows.
    ev = ev.selectExpr("*", "opponentName as follow", "get(filter(_next, o -> o.index <= index + 18 and o.teamName = opponentName), 0) as _first").where("_first is not null")
    if mode == "Defensive":
        ev = ev.selectExpr("*", "index as _i", "t as _t", "eventId as start_id", "teamName as team", "playerName as player", "type as start_type", "x as sx", "y as sy")
    else:
        ev = ev.selectExpr("*", "_first.index as _i", "_first.t as _t", "_first.eventId as start_id", "_first.teamName as team", "_first.playerName as player",
                           "_first.type as start_type", "_first.x as sx", "_first.y as sy")
    ev = ev.selectExpr("*", f"filter(_next, o -> o.index > _i and o.index <= _i + {FOLLOW_ROWS} and o.t - _t between 0 and {seconds}) as _c")
    ev = ev.selectExpr("*", "filter(_c, o -> o.teamName = follow) as _own_c", "get(filter(_c, o -> o.teamName = follow and o.attacks), 0) as _a")
    ev = ev.selectExpr("*", "get(filter(_c, o -> o.index >= _a.index and if(o.teamName <> follow, o._other, o._end) is not null), 0) as _x")
    ev = ev.selectExpr("*", "coalesce(_x, _a, try_element_at(_own_c, -1)) as _last",
                       "if(_a is not null, filter(_c, o -> o.index <= coalesce(_x.index, _a.index)), _own_c) as _window")
    ev = ev.selectExpr("*", "filter(transform(_window, o -> if(o.teamName <> follow, o._other, o._chain)), l -> l is not null) as _labels")
    ev = ev.selectExpr("*", "slice(filter(_labels, (l, i) -> i = 0 or l <> get(_labels, i - 1)), 1, 3) as _top")
    return ev.selectExpr(
        "matchId", "eventId as loss_id", "start_id", "team", "player", "start_type", f"'{mode}' as transition_type", "(_a is not null) as led_to_attack", "sx as x", "sy as y",
        "coalesce(_last.x, sx) as end_x", "coalesce(_last.y, sy) as end_y",
        "case when sx < 35 then 'Defensive Third' when sx < 70 then 'Middle Third' else 'Attacking Third' end as third",
        "array_join(_top, ', ') as followup",
        """case when _a is null then 'No attacking follow-up' when _x is null then 'Attack developed; no terminal event in window'
           else if(_x.teamName <> follow, _x._other, _x._end) end as end_product""")


def duel_player_summary(duels: DataFrame, moves: DataFrame) -> DataFrame:
    """Players' duels and transitions in one grouping over both row kinds."""
    c = F.col
    a = duels.select("matchId", c("playerName").alias("player"), F.lit(True).alias("d"), "won", "category", F.lit(False).alias("a"))
    b = moves.select("matchId", "player", F.lit(False).alias("d"), F.lit(False).alias("won"), F.lit("").alias("category"), c("led_to_attack").alias("a"))
    out = a.unionByName(b).groupBy("matchId", "player").agg(
        n_if(c("d")).alias("duels"), n_if(c("won")).alias("duels_won"), n_if(c("category") == "Ground").alias("ground"),
        n_if(c("category") == "Aerial").alias("aerial"), n_if(~c("d")).alias("transitions"), n_if(c("a")).alias("transitions_to_attack"))
    return (out.withColumn("duel_win_pct", pct(c("duels_won"), c("duels")))
            .withColumn("transition_hit_pct", pct(c("transitions_to_attack"), c("transitions"))))


def duel_team_summary(duels: DataFrame, moves: DataFrame) -> DataFrame:
    c = F.col
    a = duels.select("matchId", c("teamName").alias("team"), F.lit(True).alias("d"), "won", F.lit(False).alias("a"))
    b = moves.select("matchId", "team", F.lit(False).alias("d"), F.lit(False).alias("won"), c("led_to_attack").alias("a"))
    out = a.unionByName(b).groupBy("matchId", "team").agg(
        n_if(c("d")).alias("duels"), n_if(c("won")).alias("duels_won"), n_if(~c("d")).alias("transitions"), n_if(c("a")).alias("transitions_to_attack"))
    return out.withColumn("duel_win_pct", pct(c("duels_won"), c("duels")))


def duel_profiles(duels: DataFrame) -> DataFrame:
    """Four scores (0-100) of a side's duels: won on the ground, won in the air, wins that start attacks, losses before the last third."""
    c = F.col
    ground, aerial, deep = c("category") == "Ground", c("category") == "Aerial", c("zone").isin("Defensive Third", "Middle Third")
    won = F.coalesce(c("won"), F.lit(False))
    n = duels.groupBy("matchId", "teamName").agg(
        n_if(ground).alias("g"), n_if(ground & won).alias("gw"), n_if(aerial).alias("a"), n_if(aerial & won).alias("aw"), n_if(won).alias("w"),
        n_if(won & (c("duel_context") == "led_to_attack")).alias("s"), n_if(deep).alias("d"), n_if(deep & ~won).alias("dl"))
    parts = [("Ground Duel Edge", "gw", "g"), ("Aerial Control", "aw", "a"), ("Attack Starter", "s", "w"), ("Risk Zone Losses", "dl", "d")]
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("profile"), c(x).alias("hits"), c(y).alias("rows")) for k, x, y in parts]))
    return n.select("matchId", "teamName", rows.alias("r")).select("matchId", "teamName", "r.*").withColumn(
        "score", F.floor(pct(c("hits"), c("rows")) + 0.5).cast("int"))


def transition_player_rows(moves: DataFrame) -> DataFrame:
    """Players' transitions by third, led to an attack or stalled."""
    c = F.col
    out = moves.where(c("player").isNotNull()).groupBy("matchId", "team", "player").agg(
        F.count("*").alias("transitions"), n_if(c("led_to_attack")).alias("to_attack"), n_if(~c("led_to_attack")).alias("stalled"),
        *[n_if(c("third") == f"{t} Third").alias(f"{t.lower()}_third") for t in ("Defensive", "Middle", "Attacking")])
    return out.withColumn("hit_pct", F.floor(pct(c("to_attack"), c("transitions")) + 0.5).cast("int"))


def duel_zone_map(duels: DataFrame) -> DataFrame:
    """Duels won and lost on a 6 x 5 grid per match and team."""
    c = F.col
    zx = F.least(F.lit(5), F.greatest(F.lit(0), F.floor(c("x") / 17.5))).cast("int")
    zy = F.least(F.lit(4), F.greatest(F.lit(0), F.floor(c("y") / 13.6))).cast("int")
    return duels.groupBy("matchId", "teamName", zx.alias("zone_x"), zy.alias("zone_y")).agg(
        F.count("*").alias("duels"), n_if(c("won")).alias("won"), n_if(~c("won")).alias("lost"))


def transition_zone_map(moves: DataFrame) -> DataFrame:
    """Transitions on a 3 x 3 grid by starting place."""
    c = F.col
    zx = F.least(F.lit(2), F.floor(c("x") / 35.0)).cast("int")
    zy = F.least(F.lit(2), F.floor(c("y") / (68.0 / 3))).cast("int")
    return moves.groupBy("matchId", "team", zx.alias("zone_x"), zy.alias("zone_y")).agg(
        F.count("*").alias("transitions"), n_if(c("led_to_attack")).alias("to_attack"))


__all__ = ["with_duel_columns", "with_duel_pairs", "duels_with_context", "transitions", "duel_player_summary", "duel_team_summary",
           "duel_zone_map", "transition_zone_map"]
