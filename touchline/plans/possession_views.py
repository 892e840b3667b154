"""In-possession views: pass network, player metrics, channels and zones, combinations, action list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from touchline.functions import predicates as p, zones as z
from touchline.functions.core import dist, fixed, fmean, fsum, has_like, n_if, pct, ratio, sum_if
from touchline.operators.grids import observed_cell
from touchline.operators.scan import dense_position, with_halo
from touchline.operators.state import with_receiver
from touchline.plans.defending import with_next_events


def c(name):
    return F.col(name)


def whole(points):
    """Points as a whole score between 0 and 100."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), points)) + 0.5).cast("int")


def zero(name):
    return F.coalesce(F.col(name), F.lit(0.0))


def network_passes(events: DataFrame) -> DataFrame:
    """Completed passes with a known passer and receiver."""
    ev = with_receiver(events).where(p.is_pass() & p.completed())
    return ev.where((c("playerId") > 0) & (c("receiver") > 0)).withColumn("is_progressive", p.progressive())


def network_nodes(events: DataFrame, passes: DataFrame) -> DataFrame:
    """Players of the passing network: median place, counts, progressive work, carries, take-ons.

    Passer, receiver and on-ball rows are stacked and grouped once, instead of joining three tables.
    """
    keys = ["matchId", "teamName"]
    none = F.lit(None).cast("double")
    made = passes.select(*keys, "playerId", c("playerName").alias("player"), F.lit("made").alias("role"), "x", "y", "is_progressive",
                         dist(c("endX"), c("endY"), c("x"), c("y")).alias("length"))
    got = passes.select(*keys, c("receiver").alias("playerId"), c("receiverName").alias("player"), F.lit("received").alias("role"),
                        c("endX").alias("x"), c("endY").alias("y"), "is_progressive", none.alias("length"))
    acts = events.where(p.kind("Carry", "TakeOn", "GoodSkill") & ((c("type") == "Carry") | p.not_failed())).select(
        *keys, "playerId", c("playerName").alias("player"), F.when(c("type") == "Carry", "carry").otherwise("takeon").alias("role"),
        none.alias("x"), none.alias("y"), ((c("type") == "Carry") & p.progressive()).alias("is_progressive"), none.alias("length"))
    role = lambda r: c("role") == r
    # Coordinates are tenths of a metre: an exact median keeps one counter per distinct value.
    med = lambda r, v: F.median(F.when(role(r), c(v)))
    out = made.unionByName(got).unionByName(acts).groupBy(*keys, "playerId").agg(
        F.min("player").alias("player"), med("made", "x").alias("play_x"), med("made", "y").alias("play_y"),
        med("received", "x").alias("receive_x"), med("received", "y").alias("receive_y"),
        n_if(role("made")).alias("passes_made"), n_if(role("received")).alias("passes_received"),
        n_if(role("made") & c("is_progressive")).alias("progressive_passes_made"),
        n_if(role("received") & c("is_progressive")).alias("progressive_passes_received"),
        n_if(role("carry")).alias("carries"), n_if(role("carry") & c("is_progressive")).alias("progressive_carries"),
        n_if(role("takeon")).alias("take_ons"), F.coalesce(fmean(c("length")), F.lit(0.0)).alias("avg_pass_distance"))
    out = out.where(c("passes_made") + c("passes_received") > 0)
    mid = lambda a, b: (F.coalesce(a, b) + F.coalesce(b, a)) / 2.0
    out = (out.withColumn("x", mid(c("play_x"), c("receive_x"))).withColumn("y", mid(c("play_y"), c("receive_y")))
           .withColumn("count", c("passes_made") + c("passes_received")))
    # One row per player of one match side reaches this window.
    t = W.partitionBy(*keys)
    return (out.withColumn("size", 18 + ratio(c("count"), F.greatest(F.lit(1), F.max("count").over(t)), 38.0))
            .withColumn("progressive_intensity", ratio(c("progressive_passes_made"), F.greatest(F.lit(1), F.max("progressive_passes_made").over(t)))))


def network_edges(passes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Directed passer-receiver edges with medians, xT and relative weights."""
    keys = ["matchId", "teamName"]
    pair = passes.groupBy(*keys, "playerId", "receiver").agg(
        F.count("*").alias("pass_count"), F.median("x").alias("source_x"), F.median("y").alias("source_y"), F.median("endX").alias("target_x"),
        F.median("endY").alias("target_y"), fsum(zero("xT")).alias("total_xt"), n_if(c("is_progressive")).alias("progressive_count"))
    pair = pair.where(c("playerId") != c("receiver"))
    at = nodes.select(*keys, "playerId", c("x").alias("x0"), c("y").alias("y0"))
    to = nodes.select(*keys, c("playerId").alias("receiver"), c("x").alias("x1"), c("y").alias("y1"))
    out = pair.join(at, keys + ["playerId"]).join(to, keys + ["receiver"])
    t = W.partitionBy(*keys)
    top = lambda v, low: F.greatest(F.lit(low), F.max(v).over(t))
    return (out.withColumn("avg_xt", c("total_xt") / c("pass_count"))
            .withColumn("xt_intensity", F.greatest(F.lit(0.0), c("total_xt")) / top(F.greatest(F.lit(0.0), c("total_xt")), 0.001))
            .withColumn("progressive_intensity", ratio(c("progressive_count"), top("progressive_count", 1)))
            .withColumn("width", 0.8 + ratio(c("pass_count"), top("pass_count", 1), 4.6)))


def network_heat(passes: DataFrame, nx: int = 14, ny: int = 10) -> DataFrame:
    """Starts of passes that gained xT, binned over the range seen for the side (right-closed bins)."""
    keys = ["matchId", "teamName"]
    good = passes.where(zero("xT") > 0)
    span = good.groupBy(*keys).agg(F.min("x").alias("lx"), F.max("x").alias("hx"), F.min("y").alias("ly"), F.max("y").alias("hy"))
    b = good.join(span, keys)
    bx = F.coalesce(observed_cell(c("x"), c("lx"), c("hx"), nx), F.lit(0))
    by = F.coalesce(observed_cell(c("y"), c("ly"), c("hy"), ny), F.lit(0))
    return b.groupBy(*keys, bx.alias("x_bin"), by.alias("y_bin")).agg(F.count("*").alias("count"))


def centralization(passes: DataFrame) -> DataFrame:
    """Sum of (busiest passer - passer) over ten times the passes."""
    per = passes.groupBy("matchId", "teamName", "playerId").agg(F.count("*").alias("n"))
    return per.groupBy("matchId", "teamName").agg(
        F.sum("n").alias("total_passes"),
        ratio(F.max("n") * F.count("*") - F.sum("n"), F.sum("n") * 10).alias("centralization_index"))


def mutual_pairs(passes: DataFrame, top: int = 5) -> DataFrame:
    """Undirected pairs by passes either way."""
    a, b = F.least("playerId", "receiver"), F.greatest("playerId", "receiver")
    n = passes.where(c("playerId") != c("receiver")).groupBy("matchId", "teamName", a.alias("a"), b.alias("b")).agg(
        F.count("*").alias("passes"), fsum(zero("xT")).alias("xt"))
    w = W.partitionBy("matchId", "teamName").orderBy(F.desc("passes"), "a", "b")
    return n.withColumn("rank", F.row_number().over(w)).where(c("rank") <= top)


def network_triangles(passes: DataFrame, top: int = 3) -> DataFrame:
    """Trios whose three undirected edges all have at least three passes, else at least one, by total weight.

    Three-way self-join of the edge table with a < b < c; a side's edges are pairs of its players.
    """
    a, b = F.least("playerId", "receiver"), F.greatest("playerId", "receiver")
    e = passes.where(c("playerId") != c("receiver")).groupBy("matchId", "teamName", a.alias("a"), b.alias("b")).agg(F.count("*").alias("n"))
    keys = ["matchId", "teamName"]
    ab = e.withColumnsRenamed({"n": "n1"})
    bc = e.select(*keys, c("a").alias("b"), c("b").alias("c"), c("n").alias("n2"))
    ac = e.select(*keys, "a", c("b").alias("c"), c("n").alias("n3"))
    tri = ab.join(bc, keys + ["b"]).join(ac, keys + ["a", "c"])
    tri = tri.withColumn("weakest", F.least("n1", "n2", "n3")).withColumn("weight", c("n1") + c("n2") + c("n3"))
    strong = F.max((c("weakest") >= 3).cast("int")).over(W.partitionBy(*keys)) == 1
    tri = tri.withColumn("_strong", strong).where(~c("_strong") | (c("weakest") >= 3))
    w = W.partitionBy(*keys).orderBy(F.desc("weight"), "a", "b", "c")
    return tri.withColumn("rank", F.row_number().over(w)).where(c("rank") <= top).select(*keys, "a", "b", "c", "weight", "rank")


def player_network(passes: DataFrame) -> DataFrame:
    """Each player's share of the side's passing and their in/out xT, with their main connection."""
    keys = ["matchId", "teamName"]
    e = passes.where(c("playerId") != c("receiver")).groupBy(*keys, "playerId", "receiver").agg(F.count("*").alias("n"), fsum(zero("xT")).alias("xt"))
    out = e.select(*keys, c("playerId").alias("player"), c("receiver").alias("other"), "n", "xt", F.lit(True).alias("out"))
    inc = e.select(*keys, c("receiver").alias("player"), c("playerId").alias("other"), "n", "xt", F.lit(False).alias("out"))
    both = out.unionByName(inc)
    by_pair = both.groupBy(*keys, "player", "other").agg(
        F.sum(F.when(c("out"), c("n")).otherwise(0)).alias("n_out"), F.sum(F.when(~c("out"), c("n")).otherwise(0)).alias("n_in"),
        sum_if(c("out"), c("xt")).alias("xt_out"), sum_if(~c("out"), c("xt")).alias("xt_in"))
    per = by_pair.groupBy(*keys, "player").agg(
        F.sum("n_out").alias("passes_out"), F.sum("n_in").alias("passes_in"), fsum(c("xt_out")).alias("xt_out"), fsum(c("xt_in")).alias("xt_in"),
        F.min_by("other", F.struct(-(c("n_out") + c("n_in")), "other")).alias("top_connection"), F.max(c("n_out") + c("n_in")).alias("top_connection_passes"))
    total = F.sum("passes_out").over(W.partitionBy(*keys))
    return per.withColumn("network_share", pct(c("passes_out") + c("passes_in"), total))


def in_possession_actions(events: DataFrame) -> DataFrame:
    """Passes, carries and take-ons with result, value and the next three events."""
    ev = with_next_events(events, 3, 11).where(p.kind("Pass", "Carry", "TakeOn", "GoodSkill"))
    return ev.select(
        "matchId", "eventId", "teamName", "playerName", "minute", "second", F.when(c("type") == "GoodSkill", "TakeOn").otherwise(c("type")).alias("type"),
        ((c("type") == "Carry") | p.not_failed()).alias("is_successful"), "x", "y", F.coalesce("endX", "x").alias("end_x"), F.coalesce("endY", "y").alias("end_y"),
        zero("xA").alias("xA"), p.progressive().alias("is_progressive"), "team_score_state",
        c("next_1.type").alias("next_1_type"), c("next_2.type").alias("next_2_type"), c("next_3.type").alias("next_3_type"),
        F.coalesce(c("next_1.teamName") == c("teamName"), F.lit(False)).alias("next_team_retained"))


def in_possession_metrics(events: DataFrame) -> DataFrame:
    """Twenty on-ball columns per match and player, received passes stacked into the same grouping."""
    done, passed = p.is_pass() & p.completed(), p.is_pass()
    keys = ["matchId", "playerName"]
    rec = (with_receiver(events).where(done & c("receiverName").isNotNull())
           .select("matchId", c("receiverName").alias("playerName"), "teamName", p.progressive().alias("prog"), F.lit(True).alias("_rec")))
    own = events.where(c("playerName").isNotNull()).withColumn("_rec", F.lit(False)).withColumn("prog", p.progressive())
    ev = own.unionByName(rec, allowMissingColumns=True)
    length = dist(c("endX"), c("endY"), c("x"), c("y"))
    mine = ~c("_rec")
    lost = F.coalesce(c("turnover"), F.lit(False)).cast("int") + (c("type") == "Dispossessed").cast("int")
    out = ev.groupBy(*keys).agg(
        F.min("teamName").alias("teamName"), n_if(c("isTouch")).alias("touches"), n_if(passed).alias("passes_attempted"), n_if(done).alias("passes_completed"),
        n_if(c("_rec")).alias("passes_received"), F.coalesce(fmean(F.when(done, length)), F.lit(0.0)).alias("avg_pass_distance"),
        n_if(mine & done & c("prog")).alias("progressive_passes"), n_if(c("_rec") & c("prog")).alias("progressive_passes_received"),
        n_if(done & (c("endX") > 75)).alias("final_third_passes"), n_if(done & (c("endX") >= 88.5) & c("endY").between(13.6, 54.4)).alias("box_passes"),
        n_if(passed & has_like("(?i)KeyPass|ShotAssist|BigChanceCreated")).alias("key_passes"), sum_if(passed, c("xA")).alias("xA"),
        sum_if(p.kind("Pass", "Carry"), c("xT")).alias("xT"), n_if(c("type") == "Carry").alias("carries"),
        n_if((c("type") == "Carry") & c("prog")).alias("progressive_carries"), n_if(p.kind("TakeOn", "GoodSkill") & p.not_failed()).alias("take_ons_won"),
        F.coalesce(F.sum(lost), F.lit(0)).alias("turnovers"))
    return out.withColumn("pass_accuracy", pct(c("passes_completed"), c("passes_attempted")))


def area_profile(events: DataFrame, area: str) -> DataFrame:
    """Channel or zone profile by where actions start (origin) and end (destination).

    Player sums come first, so the busiest area of a match is already folded to one row per player.
    """
    locate = z.equal_channel if area == "channel" else None
    place = (lambda x, y: locate(y)) if locate else z.positional_zone
    on_ball = p.kind("Pass", "Carry", "TakeOn", "GoodSkill") & p.open_play()
    ev = events.where(on_ball).select("matchId", "teamName", "playerName", "type", p.not_failed().alias("ok"), p.progressive().alias("prog"),
                                      zero("xT").alias("xT"), (c("endX") - c("x")).alias("dx"), (c("endY") - c("y")).alias("dy"),
                                      F.explode(F.array(F.struct(F.lit("origin").alias("view"), place(c("x"), c("y")).alias("area")),
                                                        F.struct(F.lit("destination").alias("view"), place(c("endX"), c("endY")).alias("area")))).alias("v"),
                                      F.when(c("endX") >= 70, place(c("endX"), c("endY"))).alias("entry"))
    ev = ev.select("*", "v.*").where(c("area").isNotNull())
    ok, is_pass = c("ok"), c("type") == "Pass"
    keys = ["matchId", "teamName", "view", "area"]
    gain, loss = F.greatest(c("xT"), F.lit(0.0)), F.least(c("xT"), F.lit(0.0))
    per = ev.groupBy(*keys, "playerName").agg(
        F.count("*").alias("touches"), n_if(is_pass).alias("passes"), n_if(is_pass & ok).alias("passes_completed"), n_if(ok & c("prog")).alias("progressive_actions"),
        F.sum(F.when(ok, fixed(gain)).otherwise(0)).alias("g"), F.sum(F.when(ok, fixed(loss)).otherwise(0)).alias("l"),
        F.sum(F.when(ok & c("prog"), fixed(c("dx")))).alias("sx"), F.sum(F.when(ok & c("prog"), fixed(c("dy")))).alias("sy"))
    out = per.groupBy(*keys).agg(
        *[F.sum(n).alias(n) for n in ("touches", "passes", "passes_completed", "progressive_actions")],
        (F.sum("g") / 1e6).alias("xt_gained"), (F.sum("l") / 1e6).alias("xt_lost"), ((F.sum("g") + F.sum("l")) / 1e6).alias("xt"),
        ratio(F.sum("sx") / 1e6, F.sum("progressive_actions")).alias("flow_dx"), ratio(F.sum("sy") / 1e6, F.sum("progressive_actions")).alias("flow_dy"),
        F.min(F.when(c("g") > 0, F.struct((-c("g")).alias("n"), "playerName"))).alias("_top"))
    total = F.sum("xt_gained").over(W.partitionBy("matchId", "teamName", "view"))
    out = (out.withColumn("top_player", c("_top.playerName")).withColumn("top_player_xt", F.coalesce(-c("_top.n") / 1e6, F.lit(0.0)))
           .withColumn("xt_share", F.when(total > 0, c("xt_gained") / total).otherwise(0.0)).drop("_top"))
    if area != "channel":
        return out
    entries = (ev.where((c("view") == "origin") & ok & c("entry").isNotNull()).groupBy("matchId", "teamName", c("entry").alias("area"))
               .agg(F.count("*").alias("final_third_entries")))
    return out.join(entries, ["matchId", "teamName", "area"], "left").fillna(0, ["final_third_entries"])


def pass_pairs(passes: DataFrame, top: int = 12) -> DataFrame:
    """Most frequent directed pairs of each side."""
    n = passes.where(c("playerId") != c("receiver")).groupBy("matchId", "teamName", "playerId", "receiver").agg(
        F.count("*").alias("count"), fsum(zero("xT")).alias("xt"), F.median("x").alias("avg_x"), F.median("y").alias("avg_y"),
        F.median("endX").alias("avg_end_x"), F.median("endY").alias("avg_end_y"))
    w = W.partitionBy("matchId", "teamName").orderBy(F.desc("count"), "playerId", "receiver")
    return n.withColumn("rank", F.row_number().over(w)).where(c("rank") <= top)


def pass_chains(passes: DataFrame) -> DataFrame:
    """Completed passes of a side with the two before, in match order.

    Chains may span possessions; only the time limits of the rules bound them.
    """
    ok = passes.where(c("playerId") != c("receiver")).withColumn("t", (c("minute") * 60 + c("second")).cast("bigint"))
    ok = dense_position(ok, "pos", ("matchId", "teamName"))
    ev = with_halo(ok, back=2, pos="pos")
    w = W.partitionBy("matchId", "teamName", "_seg").orderBy("pos")
    step = F.struct("eventId", "playerId", "receiver", "x", "y", "endX", "endY", "t")
    return ev.withColumns({"p1": F.lag(step, 1).over(w), "p2": F.lag(step, 2).over(w)}).where("_own").drop("_seg", "_own", "pos")


def one_twos(chains: DataFrame, top: int = 15) -> DataFrame:
    """A to B and back to A within 8 s with more than 5 m gained; the largest gains of each side."""
    hit = chains.where((c("p1.receiver") == c("playerId")) & (c("p1.playerId") == c("receiver")) & (c("t") - c("p1.t") <= 8) & (c("endX") > c("p1.x") + 5.0))
    out = hit.select("matchId", "teamName", "eventId", c("p1.playerId").alias("player_a"), c("p1.receiver").alias("player_b"),
                     F.floor(c("p1.t") / 60).cast("int").alias("minute"), c("p1.x").alias("x"), c("p1.y").alias("y"), c("endX").alias("end_x"), c("endY").alias("end_y"),
                     (c("endX") - c("p1.x")).alias("gain"))
    w = W.partitionBy("matchId", "teamName").orderBy(F.desc("gain"), "eventId")
    return out.withColumn("rank", F.row_number().over(w)).where(c("rank") <= top)


def passing_triangles(chains: DataFrame, top: int = 6) -> DataFrame:
    """Three-player chains within 20 s, counted by unordered trio; those seen at least twice."""
    hit = chains.where((c("p2.receiver") == c("p1.playerId")) & (c("p1.receiver") == c("playerId")) & (c("t") - c("p2.t") <= 20)
                       & (c("p2.playerId") != c("playerId")) & (c("p2.playerId") != c("p1.playerId")) & (c("p1.playerId") != c("playerId")))
    trio = F.array_sort(F.array(c("p2.playerId"), c("p1.playerId"), c("playerId")))
    n = hit.groupBy("matchId", "teamName", F.array_join(trio.cast("array<string>"), ",").alias("players")).agg(F.count("*").alias("count"))
    w = W.partitionBy("matchId", "teamName").orderBy(F.desc("count"), "players")
    return n.withColumn("rank", F.row_number().over(w)).where((c("rank") <= top) & (c("count") >= 2))


def edge_flags():
    """What an edge says about the profiles it counts for; lines between places of nodes and of the passes themselves."""
    gain = F.greatest("x1", "target_x") - F.least("x0", "source_x")
    wide_y = lambda v: (v <= 18) | (v >= 50)
    half = lambda x, y: (x >= 52.5) & (y.between(18, 30) | y.between(38, 50))
    reach = dist(c("x1"), c("y1"), c("x0"), c("y0"))
    return {
        "gain": gain, "reach": reach, "progressive": c("progressive_count") > 0,
        "wide": (wide_y(c("y1")) | wide_y(c("target_y"))) & ((c("progressive_count") >= 1) | (gain >= 10)) & (c("pass_count") >= 2),
        "central": half(c("x0"), c("y0")) | half(c("x1"), c("y1")) | half(c("source_x"), c("source_y")) | half(c("target_x"), c("target_y")),
        "direct": (reach >= 34) | ((c("progressive_count") >= 2) & (gain >= 15)),
        "final": (c("x1") >= 70) | (c("target_x") >= 70), "threat": (c("total_xt") >= 0.03) | (c("avg_xt") >= 0.01)}


def profile_edges(edges: DataFrame) -> DataFrame:
    """Edges that stand for each team profile and player role, with their weight there; one row per edge and profile."""
    f = edge_flags()
    passes, prog, xt = c("pass_count"), c("progressive_count"), c("total_xt")
    up = lambda v: F.greatest(F.lit(0.0), v)
    repeat, onward = (passes >= 3, passes.cast("double")), (f["progressive"], prog.cast("double"))
    wide = (f["wide"], prog * 2 + up(f["gain"] / 10) + passes * 0.35)
    final = (f["final"] & f["threat"], passes + up(xt * 35))
    rules = {
        "Build-up Control": repeat, "Progressive Passing": onward, "Wide Progression": wide, "Central Access": (f["central"], passes + up(xt * 20)),
        "Final Third Threat": final, "Directness": (f["direct"], F.greatest(F.lit(1.0), f["reach"] / 18) + prog * 1.5),
        "Progressor": onward, "Connector": repeat, "Final Third Creator": final, "Outlet Receiver": (f["progressive"] | f["final"], passes + prog * 2.0),
        "Build-up Anchor": ((c("x0") <= 45) & (passes >= 2), passes.cast("double")),
        "Advanced Link Player": ((c("x1") >= 62) & (f["threat"] | f["progressive"]), passes + up(xt * 30)), "Wide Outlet": wide}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("profile"), on.alias("on"), w.alias("weight")) for k, (on, w) in rules.items()]))
    return edges.select("matchId", "teamName", "playerId", "receiver", rows.alias("r")).where("r.on").select(
        "matchId", "teamName", "playerId", "receiver", "r.profile", "r.weight")


def player_roles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Role scores (0-100) of every player of a network, from the player's own edges, scaled by the side's best.

    Four roles fit everyone; anchor, link player and wide outlet only those whose place is deep, high or wide. An edge is
    read once and gives a row to each of its ends; sums come before the side's maxima, which are taken over its players.
    """
    keys = ["matchId", "teamName"]
    end = lambda who, out: F.struct(c(who).alias("playerId"), F.lit(out).alias("out"))
    e = edges.withColumn("_wide", edge_flags()["wide"]).withColumn("e", F.explode(F.array(end("playerId", True), end("receiver", False))))
    out = c("e.out")
    own = e.groupBy(*keys, c("e.playerId").alias("playerId")).agg(
        F.count("*").alias("links"), F.sum(F.when(out, c("progressive_count")).otherwise(0)).alias("prog_out"),
        F.sum(F.when(~out, c("progressive_count")).otherwise(0)).alias("prog_in"), sum_if(out, c("total_xt")).alias("xt_out"),
        n_if(out & (c("x1") >= 70)).alias("final_out"), n_if(c("x0") <= 45).alias("deep"), n_if(c("x1") >= 62).alias("high"), n_if(c("_wide")).alias("wide"))
    counts = ["links", "prog_out", "prog_in", "xt_out", "final_out", "deep", "high", "wide"]
    s = nodes.join(own, keys + ["playerId"], "left").fillna(0, counts).withColumn("acts", c("prog_out") + c("progressive_carries"))
    s = s.withColumn("made_acts", c("progressive_passes_made") + c("progressive_carries")).withColumn("xtp", F.greatest(F.lit(0.0), c("xt_out")))
    side = W.partitionBy(*keys)
    best = lambda v: F.greatest(F.lit(1.0), F.max(v).over(side))
    s = s.withColumns({f"best_{k}": best(k) for k in ("links", "xt_out", "final_out", "deep", "high", "wide", "made_acts", "take_ons", "count",
                                                      "passes_received", "progressive_passes_received")})
    share = lambda v, top, w: c(v) / c(f"best_{top}") * float(w)
    target = lambda v, goal, w: F.least(F.lit(float(w)), c(v) / float(goal) * float(w))
    y = c("y")
    roles = [
        ("Progressor", None, share("acts", "made_acts", 46) + share("xtp", "xt_out", 26) + share("take_ons", "take_ons", 8)),
        ("Connector", None, share("count", "count", 46) + share("links", "links", 28) + target("count", 30, 10)),
        ("Final Third Creator", None, share("final_out", "final_out", 42) + share("xtp", "xt_out", 28) + share("take_ons", "take_ons", 8)),
        ("Outlet Receiver", None, share("progressive_passes_received", "progressive_passes_received", 42)
         + share("passes_received", "passes_received", 34) + target("passes_received", 18, 8)),
        ("Build-up Anchor", c("x") <= 45, share("passes_made", "count", 34) + share("deep", "deep", 44) + target("deep", 8, 8)),
        ("Advanced Link Player", c("x") >= 60, share("high", "high", 40) + share("xtp", "xt_out", 26) + share("take_ons", "take_ons", 10)),
        ("Wide Outlet", (y <= 20) | (y >= 48), share("wide", "wide", 42) + share("prog_in", "progressive_passes_received", 22)
         + (c("progressive_carries") + c("take_ons")) / (c("best_made_acts") + c("best_take_ons")) * 12.0)]
    rows = F.array(*[F.struct((whole(v) if fits is None else F.when(fits, whole(v))).alias("score"), F.lit(i).alias("place"), F.lit(k).alias("role"))
                     for i, (k, fits, v) in enumerate(roles)])
    # At most seven entries a player: the order is that of scores, then of the list above.
    ranked = F.array_sort(F.transform(F.filter(rows, lambda r: r["score"].isNotNull()), lambda r: F.struct(
        (-r["score"]).alias("s"), r["place"].alias("place"), r["role"].alias("role"))))
    return s.select(*keys, "playerId", "player", F.posexplode(ranked).alias("i", "r")).select(
        *keys, "playerId", "player", c("r.role").alias("role"), (-c("r.s")).alias("score"), (c("i") + 1).alias("rank"))


def team_possession_profiles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Six style scores (0-100) of a side's network, and the matchup score against the other side.

    50 in the matchup is level. Node and edge sums come first; the scores work on two rows per match.
    """
    keys = ["matchId", "teamName"]
    f = edge_flags()
    wide, central, direct = f["wide"], f["central"], f["direct"]
    e = edges.groupBy(*keys).agg(
        F.sum("pass_count").alias("passes"), F.count("*").alias("links"), F.sum("progressive_count").alias("prog"), fsum(c("total_xt")).alias("xt"),
        n_if(f["final"]).alias("final"), n_if(wide).alias("wide"), n_if(central).alias("central"),
        F.sum(F.when(central, c("pass_count")).otherwise(0)).alias("central_passes"), n_if(direct).alias("direct"))
    n = nodes.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("progressive_carries").alias("pc"), F.sum("take_ons").alias("to"))
    s = n.join(e, keys).withColumn("acts", c("prog") + c("pc")).withColumn("xtp", F.greatest(F.lit(0.0), c("xt")))
    # Share of a target reached, in points; the target grows with the players of the network.
    reach = lambda v, per, top: F.least(F.lit(float(top)), v / F.greatest(F.lit(1.0), c("n") * float(per)) * float(top))
    threat = lambda top, w: F.least(F.lit(float(top)), c("xtp") * float(w))
    points = {
        "Build-up Control": reach(c("passes"), 8, 42) + reach(c("links"), 2.4, 28) + threat(14, 42),
        "Progressive Passing": reach(c("acts"), 3.4, 58) + threat(16, 42) + reach(c("wide") + c("direct"), 1.4, 12),
        "Wide Progression": reach(c("wide"), 1.35, 58) + reach(c("acts"), 4.5, 16) + reach(c("to"), 1.6, 10),
        "Central Access": reach(c("central_passes"), 7, 58) + reach(c("central"), 1.8, 22) + threat(10, 28),
        "Final Third Threat": reach(c("final"), 1.25, 56) + threat(24, 58),
        "Directness": reach(c("direct"), 1.45, 68) + reach(c("acts"), 5.5, 14)}
    out = s.select(*keys, *[whole(v).alias(k) for k, v in points.items()]).unpivot(keys, list(points), "profile", "score")
    m = W.partitionBy("matchId", "profile")
    other = F.sum("score").over(m) - c("score")
    return out.withColumn("matchup_score", F.when(F.count("*").over(m) == 2, whole(50 + (c("score") - other) * 0.65)).otherwise(c("score")))
