"""Research tables: control sequences, value chains, possession vectors, difficulty, heat maps, areas."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from touchline.functions import predicates as p
from touchline.functions.core import dist, fixed, fmean, fsum, has, n_if, pct, ratio
from touchline.operators.scan import LastBefore, scan, with_halo
from touchline.operators.state import CONTROL, DEFENCE, STOPPAGE

OUT_OF_POSSESSION = ["Tackle", "Interception", "BallRecovery", "Clearance", "BlockedPass", "Challenge", "Aerial"]
IN_POSSESSION = ["Pass", "Carry", "BallTouch", "TakeOn", "GoodSkill", "Goal", "SavedShot", "MissedShots", "ShotOnPost"]
DUEL_CLUSTER = ["AerialDuel", "Tackle", "TakeOn", "BallRecovery", "Challenge"]


def c(name):
    return F.col(name)


def zero(name):
    return F.coalesce(F.col(name), F.lit(0.0))


# Control states: side in control (0 none, 1 home, 2 away) * 2 + open sequence. An event is a map of all six states.
STATES = range(6)
STEP_TYPE = "array<struct<to:int,poss:bigint,seq:bigint>>"
RUN = 64          # events that are walked one by one
SPAN = 65_536     # events whose maps are joined into one


def _control_map(team: int, grants: bool, stops: bool, defends: bool, fails: bool) -> list[tuple[int, int, int]]:
    """Where an event takes each state, and how many possessions and sequences begin with it."""
    out = []
    for before in STATES:
        side, is_open = divmod(before, 2)
        taken = grants and side not in (0, team)        # control passes straight from the other side
        held, live = (team, 1) if taken else (side, is_open)
        lost = defends and held != team
        ends = live and (stops or fails or lost)
        held, live = (0 if ends and lost else held), (0 if ends else live)
        begins = grants and not live
        out.append(((team if begins else held) * 2 + (1 if begins else live), int(taken) + int(begins and held != team), int(taken) + int(begins)))
    return out


def _event_maps() -> str:
    """SQL array of the maps of all event kinds, six entries each; kind = away * 16 + grants * 8 + stops * 4 + defends * 2 + fails."""
    kinds = [_control_map(1 + k // 16, *(bool(k // n % 2) for n in (8, 4, 2, 1))) for k in range(32)]
    return "array(" + ",".join(f"struct({to} as to,{p}L as poss,{q}L as seq)" for m in kinds for to, p, q in m) + ")"


def _joined(maps: str, state: str, append: str | None = None) -> str:
    """Fold of an array of maps. From one state (a struct); with `append`, the states after (1) or before (0) each map."""
    step = ("named_struct('to', m[{0}.to].to, 'poss', {0}.poss + m[{0}.to].poss, 'seq', {0}.seq + m[{0}.to].seq)")
    if append is None:  # all six states at once
        return f"aggregate({maps}, {state}, (a, m) -> transform(a, s -> {step.format('s')}))"
    kept = {"1": step.format("a.now"), "0": "a.now"}[append]
    return (f"aggregate({maps}, named_struct('now', {state}, 'all', cast(array() as {STEP_TYPE})), "
            f"(a, m) -> named_struct('now', {step.format('a.now')}, 'all', array_append(a.all, {kept})), a -> a.all)")


SAME = "transform(sequence(0, 5), i -> named_struct('to', i, 'poss', 0L, 'seq', 0L))"


def control_sequences(events: DataFrame) -> DataFrame:
    """Sequence and possession numbers by control, stoppage and turnover.

    The state does not reduce to a lag, but events are maps of six states and maps compose: each span of a match gives
    one map, the maps of a match give the state in front of every span, and spans are walked on their own. What meets in one
    row is a span of events, or one map per span of a match.
    """
    f = lambda x: F.coalesce(x, F.lit(False))
    ok = f(c("outcomeType") == "Successful")
    bit = lambda x, n: f(x).cast("int") * n
    first = F.min_by("teamName", "index")
    # the two sides of a match, by the first event's team; a missing team is no side and takes no control
    sides = events.where(c("teamName").isNotNull()).groupBy("matchId").agg(first.alias("_side"))
    kind = (f(c("teamName") != c("_side")).cast("int") * 16 + bit(c("type").isin(CONTROL) & ok, 8) + bit(c("type").isin(STOPPAGE) | (c("type") == "Goal"), 4)
            + bit(c("type").isin(DEFENCE), 2) + bit(c("type").isin(CONTROL) & ~ok, 1))
    rows = events.join(sides, "matchId", "left").select("matchId", "index", "eventId", F.floor(c("index") / SPAN).alias("span"), kind.cast("int").alias("kind"))
    spans = rows.groupBy("matchId", "span").agg(F.array_sort(F.collect_list(F.struct("index", "eventId", "kind"))).alias("events"))
    runs = spans.selectExpr("matchId", "span", f"transform(sequence(0, size(events) - 1, {RUN}), i -> slice(events, i + 1, {RUN})) as runs", f"{_event_maps()} as table")
    maps = runs.selectExpr("matchId", "span", "runs", "table", f"transform(runs, r -> {_joined('transform(r, e -> slice(table, e.kind * 6 + 1, 6))', SAME)}) as maps")
    whole = maps.selectExpr("matchId", "span", f"{_joined('maps', SAME)} as map")
    chain = whole.groupBy("matchId").agg(F.array_sort(F.collect_list(F.struct("span", "map"))).alias("spans"))
    start = "named_struct('to', 0, 'poss', -1L, 'seq', -1L)"
    entry = chain.selectExpr("matchId", "spans", _joined("transform(spans, s -> s.map)", start, "0") + " as states").selectExpr(
        "matchId", "inline(zip_with(spans, states, (s, e) -> struct(s.span as span, e as entry)))")
    walked = maps.join(entry, ["matchId", "span"]).selectExpr("runs", "table", "matchId", _joined("maps", "entry", "0") + " as entries")
    states = _joined("transform(r, e -> slice(table, e.kind * 6 + 1, 6))", "entries[i]", "1")
    out = walked.selectExpr("matchId", f"explode(flatten(transform(runs, (r, i) -> zip_with(r, {states}, (e, at) -> struct(e.eventId as id, at as at))))) as e")
    return out.selectExpr("matchId", "e.id as eventId", "if(e.at.to % 2 = 1, e.at.seq, null) as sequence_id", "if(e.at.to >= 2, e.at.poss, null) as possession_id")


def dynamic_value(events: DataFrame) -> DataFrame:
    """Blend of EPV, xT, xA and the possession's best xG per event."""
    chain = events.where(c("possession_id").isNotNull()).groupBy("matchId", "possession_id").agg(F.max("xG").alias("xg_chain"))
    out = events.join(chain, ["matchId", "possession_id"], "left").withColumn("xg_chain", zero("xg_chain"))
    return out.withColumn("dynamic_epv", 0.5 * zero("epv_added") + 0.3 * zero("xT") + 0.1 * zero("xA") + 0.1 * c("xg_chain"))


def dynamic_value_per90(events: DataFrame, minutes: DataFrame) -> DataFrame:
    """Season value per 90 minutes of each player."""
    g = dynamic_value(events).groupBy("league", "season", "playerName").agg(fsum(c("dynamic_epv")).alias("value"))
    m = minutes.groupBy("league", "season", "playerName").agg(F.sum("mins_played").alias("minutes"))
    return g.join(m, ["league", "season", "playerName"]).withColumn("per90", ratio(c("value"), c("minutes"), 90.0))


def possession_vectors(events: DataFrame) -> DataFrame:
    """One feature row per team possession: pass lengths (mean, longest, sample deviation), counts, progress, first and last place and kind."""
    passed = p.is_pass()
    ln = F.when(passed, dist(c("endX"), c("endY"), c("x"), c("y")))
    n, total = F.count(ln), fsum(ln)
    spread = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (fsum(ln * ln) - total * total / n) / (n - 1)))).otherwise(0.0)
    end = lambda v: F.max_by(F.coalesce(f"end{v.upper()}", v), "index")
    return events.where(c("possession_id").isNotNull()).groupBy("matchId", "teamName", "possession_id").agg(
        F.count("*").alias("events"), F.coalesce(fmean(ln), F.lit(0.0)).alias("length_mean"), F.coalesce(F.max(ln), F.lit(0.0)).alias("length_max"), spread.alias("length_std"),
        n_if(has("KeyPass")).alias("key_passes"), n_if(p.is_shot()).alias("shots"), n_if(c("type") == "Goal").alias("goals"), n_if(c("turnover")).alias("turnovers"),
        n_if((c("type") == "TakeOn") & p.completed()).alias("dribbles_won"), n_if(c("type") == "Interception").alias("interceptions"),
        fsum(p.prog_pass()).alias("prog_pass"), fsum(p.prog_carry()).alias("prog_carry"),
        F.min_by("x", "index").alias("first_x"), F.min_by("y", "index").alias("first_y"), end("x").alias("last_x"), end("y").alias("last_y"),
        F.min_by("type", "index").alias("first_type"), F.max_by("type", "index").alias("last_type"),
        (end("x") - F.min_by("x", "index")).alias("net_x"), (end("y") - F.min_by("y", "index")).alias("net_y"))


def pattern_summary(clustered: DataFrame) -> DataFrame:
    """Size and outcome of each pattern, with the side that uses it most."""
    per = clustered.groupBy("pattern", "teamName").agg(F.count("*").alias("n"), F.sum("shots").alias("s"), F.sum("goals").alias("g"))
    return per.groupBy("pattern").agg(F.sum("n").alias("possessions"), F.sum("s").alias("shots"), F.sum("g").alias("goals"), F.min_by("teamName", F.struct(-c("n"), "teamName")).alias("top_team"))


def pass_difficulty(passes: DataFrame, minimum: int = 20, top: int = 5) -> DataFrame:
    """Players with the easiest and hardest passes on average."""
    g = passes.where(c("playerName").isNotNull()).groupBy("playerName").agg(F.count("*").alias("passes"), fsum(c("xPass")).alias("xPass_total")).where(c("passes") >= minimum)
    g = g.withColumn("mean_xPass", c("xPass_total") / c("passes"))
    return g.orderBy(F.desc("mean_xPass"), "playerName").limit(top).withColumn("side", F.lit("easiest")).unionByName(
        g.orderBy("mean_xPass", "playerName").limit(top).withColumn("side", F.lit("hardest")))


def passes_above_expected(passes: DataFrame) -> DataFrame:
    """Completions over expectation per team and pass type."""
    g = passes.groupBy("league", "season", "teamName", "pass_type").agg(F.count("*").alias("passes"), n_if(p.completed()).alias("completed"), fsum(c("xPass")).alias("expected"))
    return g.withColumn("above", c("completed") - c("expected")).withColumn("above_per_100", c("above") * 100.0 / c("passes"))


def pass_shares(passes: DataFrame) -> DataFrame:
    """Mean share of a match's passes, per side and season; sums come before the window over a match's two sides."""
    per = passes.groupBy("league", "season", "matchId", "teamName").agg(F.count("*").alias("n"))
    per = per.withColumn("share", pct(c("n"), F.sum("n").over(W.partitionBy("league", "season", "matchId"))))
    return per.groupBy("league", "season", "teamName").agg(fmean(c("share")).alias("avg_possession_pct"))


def adjusted_pass_leaders(passes: DataFrame, minimum: int = 10, top: int = 5) -> DataFrame:
    """Players of a side by completions over expectation for each hundredth of the side's ball, best ``top`` of each pass type."""
    keys = ["league", "season", "teamName"]
    g = passes.where(c("playerName").isNotNull()).groupBy(*keys, "playerName", "pass_type").agg(
        F.count("*").alias("passes"), n_if(p.completed()).alias("completed"), fsum(c("xPass")).alias("expected")).where(c("passes") >= minimum)
    out = g.join(pass_shares(passes), keys).withColumn("above_per_100_possession", ratio(c("completed") - c("expected"), c("avg_possession_pct"), 100.0))
    w = W.partitionBy("pass_type").orderBy(F.desc("above_per_100_possession"), *keys, "playerName")
    return out.withColumn("rank", F.row_number().over(w)).where(c("rank") <= top)


def adjusted_creators(passes: DataFrame, minimum: int = 30) -> DataFrame:
    """Key passes of players for each hundredth of their side's ball, with their mean difficulty and accuracy."""
    keys = ["league", "season", "teamName"]
    g = passes.where(c("playerName").isNotNull() & has("KeyPass")).groupBy(*keys, "playerName").agg(
        F.count("*").alias("key_passes"), fmean(c("xPass")).alias("avg_xPass"), pct(n_if(p.completed()), F.count("*")).alias("accuracy_pct")).where(c("key_passes") >= minimum)
    return g.join(pass_shares(passes), keys).withColumn("key_passes_per_100_possession", ratio(c("key_passes"), c("avg_possession_pct"), 100.0))


def chance_extremes(shots: DataFrame, top: int = 10) -> DataFrame:
    """Best chances missed and least likely goals."""
    cols = ["eventId", "matchId", "playerName", "xG"]
    miss = shots.where(c("type") != "Goal").orderBy(F.desc("xG"), "eventId").limit(top).select(*cols, F.lit("missed").alias("kind"))
    return miss.unionByName(shots.where((c("type") == "Goal") & ~p.own_goal()).orderBy("xG", "eventId").limit(top).select(*cols, F.lit("scored").alias("kind")))


def assist_leaders(events: DataFrame, top: int = 15) -> DataFrame:
    g = events.where(p.is_pass()).groupBy("playerName").agg(fsum(c("xA")).alias("xA"), n_if(has("IntentionalGoalAssist")).alias("assists"))
    return g.orderBy(F.desc("xA"), "playerName").limit(top).withColumn("difference", c("assists") - c("xA"))


def smoothing_weights(n: int, sigma: float = 1.0, reach: int = 4) -> list:
    """(source, target, weight) of a normal kernel on n cells, mirrored at both ends."""
    k = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    total = sum(k)
    out = {}
    for target in range(n):
        for d in range(-reach, reach + 1):
            s = (target + d) % (2 * n)
            s = s if s < n else 2 * n - 1 - s
            out[(s, target)] = out.get((s, target), 0.0) + k[d + reach] / total
    return [(s, t, w) for (s, t), w in sorted(out.items())]


def value_heat(events: DataFrame, value: str, nx: int = 6, ny: int = 5) -> DataFrame:
    """Summed value per pitch cell and team, smoothed along both axes (weights are nx*nx and ny*ny rows)."""
    bx, by = F.least(F.floor(c("x") / (105.0 / nx)), F.lit(nx - 1)).cast("int"), F.least(F.floor(c("y") / (68.0 / ny)), F.lit(ny - 1)).cast("int")
    cells = events.where(zero(value) > 0).groupBy("teamName", bx.alias("bx"), by.alias("by")).agg(fsum(c(value)).alias("v"))
    spark = events.sparkSession
    wx = spark.createDataFrame(smoothing_weights(nx), "bx int, x_bin int, wx double")
    wy = spark.createDataFrame(smoothing_weights(ny), "by int, y_bin int, wy double")
    out = cells.join(F.broadcast(wx), "bx").join(F.broadcast(wy), "by")
    return out.groupBy("teamName", "x_bin", "y_bin").agg(fsum(c("v") * c("wx") * c("wy")).alias("value"))


def best_chain(events: DataFrame, length: int = 8) -> DataFrame:
    """The run of eight events with the highest EPV sum in each match (earliest on ties)."""
    ev = with_halo(events, back=length - 1)
    w = W.partitionBy("matchId", "_seg").orderBy("index").rowsBetween(-(length - 1), 0)
    run = ev.withColumn("_s", F.sum(fixed(zero("epv_added"))).over(w)).where(c("_own") & (c("index") >= length - 1))
    best = run.groupBy("matchId").agg(F.max_by(F.struct("index", "_s"), F.struct("_s", -c("index"))).alias("b"))
    return best.select("matchId", (c("b.index") - (length - 1)).alias("first_index"), c("b.index").alias("last_index"), (c("b._s") / 1e6).alias("epv"))


def duel_cluster(events: DataFrame, seconds: int = 30) -> DataFrame:
    """Start and size of the densest half minute of duels. Counts per second come first, so the range
    window sees the seconds of a match, not its events."""
    t = (c("minute") * 60 + c("second")).cast("bigint")
    per = events.where(c("type").isin(DUEL_CLUSTER)).groupBy("matchId", t.alias("t")).agg(F.count("*").alias("n"))
    w = W.partitionBy("matchId").orderBy("t").rangeBetween(0, seconds - 1)
    per = per.withColumn("k", F.sum("n").over(w))
    return per.groupBy("matchId").agg(F.min_by("t", F.struct(-c("k"), "t")).alias("start"), F.max("k").alias("duels"))


def progression_speed(events: DataFrame) -> DataFrame:
    """Sideways metres per second since the earliest of the last three events by the same team (two at least), and the
    length of the player's last carry before a pass."""
    ev = with_halo(events, back=3)
    w = W.partitionBy("matchId", "_seg").orderBy("index").rowsBetween(-3, -1)
    prev = F.collect_list(F.struct("teamId", "y", (c("minute") * 60 + c("second")).alias("t"))).over(w)
    ev = ev.withColumn("_w", F.filter(prev, lambda e: e["teamId"] == c("teamId"))).where("_own").drop("_seg", "_own")
    f = F.get("_w", F.lit(0))
    dt = (c("minute") * 60 + c("second")) - f["t"]
    speed = F.when((F.size("_w") >= 2) & (dt != 0), (c("y") - f["y"]) / dt).otherwise(0.0)
    return ev.withColumn("vertical_progression_speed", speed).drop("_w")


def last_carry_before(events: DataFrame) -> DataFrame:
    """Length of the acting player's latest carry, for passes."""
    ln = dist(c("endX"), c("endY"), c("x"), c("y"))
    out = scan(events, [LastBefore("_c", ln, c("type") == "Carry")], ("matchId", "playerId"))
    return out.where(p.is_pass()).withColumn("carry_distance_before_pass", F.coalesce("_c", F.lit(0.0))).drop("_c")


def player_actions(events: DataFrame) -> DataFrame:
    """Actions on the pitch with phase, and a PassReceived row at the end of each completed pass."""
    from touchline.operators.state import with_receiver
    phase = (F.when(p.duel(), "duel").when(c("type").isin(IN_POSSESSION), "in_possession").when(c("type").isin(OUT_OF_POSSESSION), "out_of_possession")
             .when(c("type").isin("Dispossessed", "Turnover"), "transition").otherwise("other"))
    on_pitch = c("x").between(0, 105) & c("y").between(0, 68) & ~c("type").isin("Card", "SubstitutionOn", "SubstitutionOff", "FormationSet", "FormationChange", "Start", "End")
    acts = events.where(on_pitch & c("playerName").isNotNull()).select("matchId", "teamName", c("playerName").alias("player"), "eventId", "minute", "type", phase.alias("phase"), "x", "y",
                                                                       p.not_failed().alias("is_successful"), (p.kind("Pass", "Carry") & p.progressive()).alias("is_progressive"))
    got = with_receiver(events).where(p.is_pass() & p.not_failed() & c("receiverName").isNotNull()).select(
        "matchId", "teamName", c("receiverName").alias("player"), "eventId", "minute", F.lit("PassReceived").alias("type"), F.lit("touches").alias("phase"), c("endX").alias("x"), c("endY").alias("y"),
        F.lit(True).alias("is_successful"), p.progressive().alias("is_progressive"))
    return acts.unionByName(got)


def sparse_json(actions: DataFrame) -> DataFrame:
    """Actions as JSON without default values (false, zero, empty)."""
    keep = {"matchId", "eventId", "player", "type", "phase", "x", "y", "is_successful"}
    cols = []
    for f in actions.schema:
        v = c(f.name)
        if f.name not in keep:
            kind = f.dataType.typeName()
            v = F.when(v, v) if kind == "boolean" else F.nullif(v, F.lit("")) if kind == "string" else F.nullif(v, F.lit(0).cast(f.dataType))
        cols.append(v.alias(f.name))
    return actions.select("eventId", "type", F.to_json(F.struct(*cols)).alias("action"))


def player_action_summary(actions: DataFrame) -> DataFrame:
    real = c("type") != "PassReceived"
    return actions.groupBy("matchId", "teamName", "player").agg(
        n_if(real).alias("actions"), n_if(c("type").isin(IN_POSSESSION)).alias("in_possession"), n_if(c("type").isin(OUT_OF_POSSESSION)).alias("out_of_possession"),
        n_if(c("phase") == "duel").alias("duels"), n_if(c("type").isin(p.SHOT_TYPES)).alias("shots"), n_if(~real).alias("received"))


def defensive_area(events: DataFrame) -> DataFrame:
    """Interquartile box of a player's defending actions (coordinates are tenths: one counter per value)."""
    d = events.where(c("type").isin(OUT_OF_POSSESSION) & c("playerName").isNotNull())
    q = d.groupBy("matchId", "playerName").agg(F.count("*").alias("actions"), F.percentile("x", F.array(F.lit(0.25), F.lit(0.75))).alias("qx"), F.percentile("y", F.array(F.lit(0.25), F.lit(0.75))).alias("qy"))
    return q.select("matchId", "playerName", "actions", c("qx")[0].alias("x0"), c("qx")[1].alias("x1"), c("qy")[0].alias("y0"), c("qy")[1].alias("y1"))


def movement_labels(events: DataFrame) -> DataFrame:
    """Direction, length class and height of passes and carries."""
    dx, ln = c("endX") - c("x"), dist(c("endX"), c("endY"), c("x"), c("y"))
    return events.where(p.kind("Pass", "Carry")).select(
        "eventId", F.when(dx > 5, "forward").when(dx < -5, "backward").otherwise("sideways").alias("direction"),
        F.when(ln >= 32, "long").when(ln >= 15, "medium").otherwise("short").alias("length"), F.when(has("Chipped") | has("Longball") | has("Cross"), "high").otherwise("ground").alias("height"))


def match_facts(team_rows: DataFrame) -> DataFrame:
    """Leader and gap of each headline metric in each match."""
    metrics = ["xG", "shots", "possession_pct", "field_tilt_pct", "box_entries", "prog_passes"]
    v = team_rows.select("matchId", "teamName", *[c(m).cast("double").alias(m) for m in metrics]).unpivot(["matchId", "teamName"], metrics, "metric", "value")
    g = v.groupBy("matchId", "metric").agg(F.min_by("teamName", F.struct(-c("value"), "teamName")).alias("leader"), F.max("value").alias("best"), F.min("value").alias("other"))
    return g.withColumn("gap", F.round(c("best") - c("other"), 6))


def _hull(points) -> tuple[int, float]:
    """Corners and area of the convex outline of one player's points."""
    pts = sorted(points)
    def half(points):
        out = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]
    ring = half(pts) + half(pts[::-1]) if len(pts) > 2 else pts
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2 if len(ring) > 2 else 0.0
    return len(ring), area


@F.pandas_udf(T.StructType([T.StructField("corners", T.IntegerType()), T.StructField("area", T.DoubleType())]))
def _outline(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_hull(set(zip(x.tolist(), y.tolist()))) for x, y in zip(xs, ys)], columns=["corners", "area"])


def action_hulls(events: DataFrame) -> DataFrame:
    """Hull of each player's defending actions in a match. Points are folded to distinct tenths first, so a
    group has no more rows than the pitch has tenth-metre places, and usually a few dozen; a batch of
    groups goes to Python at once."""
    pts = events.where(c("type").isin(OUT_OF_POSSESSION) & c("playerName").isNotNull()).select("matchId", "playerName", F.round("x", 1).alias("x"), F.round("y", 1).alias("y")).distinct()
    known = lambda v: F.coalesce(v, F.lit(float("nan")))
    g = pts.groupBy("matchId", "playerName").agg(F.collect_list(F.struct(known(c("x")).alias("x"), known(c("y")).alias("y"))).alias("p"))
    return g.withColumn("o", _outline("p.x", "p.y")).select("matchId", "playerName", F.size("p").alias("points"), "o.corners", "o.area")


def defensive_value_per90(events: DataFrame, minutes: DataFrame, minimum: int = 90) -> DataFrame:
    """Pitch value at the place of each successful defending action, per 90 minutes of a season."""
    from touchline.operators.grids import default_epv_grid, with_grid_values
    d = events.where(c("type").isin("BallRecovery", "Interception", "Tackle", "Clearance", "BlockedPass") & c("outcomeType").isin("Won", "Successful"))
    v = with_grid_values(d, default_epv_grid(events.sparkSession), "epv")
    g = v.groupBy("league", "season", "playerName").agg(fsum(c("epv_start")).alias("defensive_epv"), F.count("*").alias("def_actions"))
    m = minutes.groupBy("league", "season", "playerName").agg(F.sum("mins_played").alias("minutes")).where(c("minutes") > minimum)
    out = g.join(m, ["league", "season", "playerName"])
    return out.withColumn("def_epv_per90", ratio(c("defensive_epv"), c("minutes"), 90.0)).withColumn("def_actions_per90", ratio(c("def_actions"), c("minutes"), 90.0))
