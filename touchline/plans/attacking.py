"""Territory entries, sequence style and set pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from touchline.functions import predicates as p, zones as z
from touchline.functions.core import fixed, has, has_like, n_if, pct, ratio, sum_if
from touchline.operators.scan import LastBefore, NextAfter, scan

# Defending actions of the entry rule, rows that are no touch, and the set-piece tokens.
DEFENDING = ["Tackle", "Interception", "BallRecovery", "Clearance", "BlockedPass", "Aerial"]
NO_TOUCH = ["SubstitutionOn", "SubstitutionOff", "FormationChange", "FormationSet", "Card", "End", "Start"]
SET_PIECES = {"corner": ("CornerTaken", "FromCorner", 40), "free_kick": ("FreekickTaken", "SetPiece|DirectFreekick", 40),
              "throw_in": ("ThrowIn", "ThrowinSetPiece", 25), "goal_kick": ("GoalKick", None, 20)}
FOLLOW_SECONDS = 20


def c(name):
    return F.col(name)


def seconds():
    return (c("minute") * 60 + c("second")).cast("bigint")


def with_entry_context(events: DataFrame) -> DataFrame:
    """Adds the last defending action of the same possession and the receiver (one ordered scan)."""
    who = F.struct("possession_id", "playerName")
    acts = c("type").isin(DEFENDING)
    ev = scan(events, [LastBefore("_dh", who, acts & (c("h_a") == "h")), LastBefore("_da", who, acts & (c("h_a") == "a")),
                       NextAfter("_nx", F.struct("index", "teamName", "playerName"), ~c("type").isin(NO_TOUCH))])
    last = F.when(c("h_a") == "h", c("_da")).otherwise(c("_dh"))
    same = c("possession_id").isNull() | last["possession_id"].isNull() | (last["possession_id"] == c("possession_id"))
    hit = (c("_nx.index") - c("index") <= 4) & (c("_nx.teamName") == c("teamName"))
    return (ev.withColumns({"last_defender": F.when(same, last["playerName"]), "receiverName": F.when(hit, c("_nx.playerName"))})
            .drop("_dh", "_da", "_nx"))


def with_led_to_shot(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Whether the team shot at or after the row within the same possession, and whether that first shot scored."""
    shots = events.where(c("isShot") & c("possession_id").isNotNull()).select(
        "matchId", "teamName", "possession_id", c("index").alias("_si"), seconds().alias("_st"), c("isGoal").alias("_goal"))
    pairs = rows.select("matchId", "teamName", "possession_id", "eventId", seconds().alias("_t")).join(
        shots, ["matchId", "teamName", "possession_id"]).where(c("_st") >= c("_t"))
    first = pairs.groupBy("matchId", "eventId").agg(F.min_by("_goal", "_si").alias("_g"))
    return (rows.join(first, ["matchId", "eventId"], "left").withColumn("led_to_shot", c("_g").isNotNull())
            .withColumn("led_to_goal", F.coalesce(c("_g"), F.lit(False))).drop("_g"))


def entry_method(into_box):
    """carry, cutback, cross, long_ball or ground_pass, in this order."""
    wide = (c("y") < 13.84 + 4) | (c("y") > 54.16 - 4)
    cut = into_box & (c("x") >= 94) & wide & (c("endX") <= c("x") - 1.5)
    return (F.when(c("type") == "Carry", "carry").when(cut, "cutback").when(has("Cross"), "cross")
            .when(has("Longball") | (has("Chipped") & (c("endX") - c("x") >= 30)), "long_ball").otherwise("ground_pass"))


def territory_entries(events: DataFrame) -> DataFrame:
    """Open-play entries into the final third and box, exits from the own third and final-third receptions.

    One row per entry and kind; an action may be several kinds. Needs ``possession_id``.
    """
    base = p.kind("Pass", "Carry") & p.not_failed() & p.open_play()
    out_of_box = ~p.in_box(c("x"), c("y"))
    kinds = F.array_compact(F.array(
        F.when(base & (c("x") < 70) & (c("endX") >= 70), "final_third"),
        F.when(base & out_of_box & p.in_box(c("endX"), c("endY")), "box"),
        F.when(base & (c("x") < 35) & (c("endX") >= 35), "exit"),
        F.when(p.is_pass() & p.not_failed() & p.open_play() & (c("endX") >= 70), "reception")))
    ev = with_entry_context(events).withColumn("_k", kinds).where(F.size("_k") > 0)
    ev = with_led_to_shot(ev, events).withColumn("kind", F.explode("_k"))
    k = c("kind")
    exit_way = F.when(c("type") == "Carry", "carry").when(has_like("Longball|Chipped"), "long_ball").otherwise("ground_pass")
    return ev.select(
        "matchId", "eventId", "teamName", "opponentName", "kind", "minute",
        F.when(k == "reception", F.coalesce("receiverName", "playerName")).otherwise(c("playerName")).alias("player"),
        F.when(k == "reception", c("playerName")).alias("passer"), "x", "y", c("endX").alias("end_x"), c("endY").alias("end_y"),
        F.when(k == "reception", "reception").when(k == "exit", exit_way).otherwise(entry_method(k == "box")).alias("method"),
        F.when(k == "exit", z.exit_side(c("y"))).otherwise(z.entry_lane(c("endY"))).alias("channel"),
        F.when(k == "reception", p.in_box(c("endX"), c("endY"))).alias("in_box"), "led_to_shot", "led_to_goal",
        F.when(k.isin("final_third", "box"), c("last_defender")).alias("last_defender"),
        F.when(k.isin("final_third", "box"), c("last_defender").isNull()).alias("uncontested"))


def entry_method_shares(entries: DataFrame) -> DataFrame:
    """Share of each method within kind, per match and team."""
    n = entries.groupBy("matchId", "teamName", "kind", "method").agg(F.count("*").alias("entries"), n_if(c("led_to_shot")).alias("to_shot"))
    return n.withColumn("share", pct(c("entries"), F.sum("entries").over(W.partitionBy("matchId", "teamName", "kind"))))


def entry_players(entries: DataFrame) -> DataFrame:
    """Players by entries with their most used method and channel (name order on ties)."""
    per = entries.where(c("kind") != "reception").groupBy("matchId", "teamName", "player", "method").agg(
        F.count("*").alias("n"), n_if(c("led_to_shot")).alias("s"))
    return per.groupBy("matchId", "teamName", "player").agg(
        F.sum("n").alias("entries"), F.sum("s").alias("to_shot"), F.min_by("method", F.struct(-c("n"), "method")).alias("top_method"))


def entry_style(entries: DataFrame) -> DataFrame:
    """How a side gets into the final third: wide, central or mixed, by channel shares."""
    wide, mid = c("channel").isin("right", "left"), c("channel") == "center"
    g = entries.where(c("kind") == "final_third").groupBy("matchId", "teamName").agg(
        F.count("*").alias("entries"), pct(n_if(wide), F.count("*")).alias("wide_share"), pct(n_if(mid), F.count("*")).alias("central_share"))
    return g.withColumn("style", F.when(c("wide_share") >= 55, "wide").when(c("central_share") >= 45, "central").otherwise("mixed"))


def defender_accountability(entries: DataFrame) -> DataFrame:
    """Entries seen from the defence: who was beaten last, and lanes left uncontested (mirrored to own side)."""
    e = entries.where(c("kind").isin("final_third", "box")).withColumn("own_lane", z.entry_lane(68.0 - c("end_y")))
    return e.groupBy("matchId", c("opponentName").alias("defending_team"), F.coalesce("last_defender", F.lit("(uncontested)")).alias("defender"), "own_lane").agg(
        F.count("*").alias("beaten"), n_if(c("led_to_shot")).alias("to_shot"), n_if(c("led_to_goal")).alias("to_goal"))


def defender_ledger(entries: DataFrame, events: DataFrame) -> DataFrame:
    """Defenders with what got past them and what they stopped: beaten rows and defending actions in one grouping.

    ``home_lane`` is the lane of the mean place of at least two actions in the own third, seen from the own side; rows are folded to
    one for each attacker first. Entries nobody defended count for no defender; those are in `uncontested_lanes`.
    """
    none = F.lit(None).cast("double")
    beaten = entries.where(c("kind").isin("final_third", "box") & c("last_defender").isNotNull()).select(
        "matchId", c("opponentName").alias("defending_team"), c("last_defender").alias("defender"), c("player").alias("attacker"), F.lit(True).alias("past"),
        "led_to_shot", "led_to_goal", (c("minute") >= 60).alias("late"), none.alias("deep_y"))
    no = F.lit(False)
    stops = events.where(p.defensive_action() & c("playerName").isNotNull()).select(
        "matchId", c("teamName").alias("defending_team"), c("playerName").alias("defender"), F.lit(None).cast("string").alias("attacker"), no.alias("past"),
        no.alias("led_to_shot"), no.alias("led_to_goal"), no.alias("late"), F.when(c("x") <= 35, c("y")).alias("deep_y"))
    keys = ["matchId", "defending_team", "defender"]
    per = beaten.unionByName(stops).groupBy(*keys, "attacker").agg(
        n_if(c("past")).alias("beaten"), n_if(c("led_to_shot")).alias("to_shot"), n_if(c("led_to_goal")).alias("to_goal"), n_if(c("late")).alias("late"),
        n_if(~c("past")).alias("stops"), F.count("deep_y").alias("deep"), F.sum(fixed(c("deep_y"))).alias("y"))
    out = per.groupBy(*keys).agg(
        *[F.sum(n).alias(n) for n in ("beaten", "to_shot", "to_goal", "late", "stops", "deep")], F.sum("y").alias("y"),
        F.min(F.when(c("attacker").isNotNull(), F.struct((-c("beaten")).alias("n"), "attacker"))).alias("_top"))
    home = F.when(c("deep") >= 2, z.entry_lane(c("y").cast("double") / 1e6 / c("deep")))
    return out.select(*keys, "beaten", "to_shot", "to_goal", "late", "stops", pct(c("stops"), c("stops") + c("beaten")).alias("stop_rate_pct"),
                      home.alias("home_lane"), c("_top.attacker").alias("top_attacker"), (-c("_top.n")).alias("top_attacker_times"))


def uncontested_lanes(entries: DataFrame, ledger: DataFrame) -> DataFrame:
    """Entries nobody defended by lane of the defending side, with the defenders at home there (a squad at most)."""
    keys = ["matchId", "defending_team", "own_lane"]
    free = entries.where(c("kind").isin("final_third", "box") & c("uncontested")).groupBy(
        "matchId", c("opponentName").alias("defending_team"), z.entry_lane(68.0 - c("end_y")).alias("own_lane")).agg(F.count("*").alias("entries"), n_if(c("led_to_shot")).alias("to_shot"))
    at_home = ledger.where(c("home_lane").isNotNull()).groupBy("matchId", "defending_team", c("home_lane").alias("own_lane")).agg(
        F.array_join(F.array_sort(F.collect_list("defender")), ", ").alias("owners"))
    return free.join(at_home, keys, "left")


def vulnerability(entries: DataFrame) -> DataFrame:
    """Where and how a side is entered: counts by own lane and method with danger and uncontested share."""
    e = entries.where(c("kind").isin("final_third", "box"))
    return e.groupBy("matchId", c("opponentName").alias("defending_team"), z.entry_lane(68.0 - c("end_y")).alias("own_lane"), "method").agg(
        F.count("*").alias("entries"), n_if(c("led_to_shot")).alias("to_shot"), pct(n_if(c("uncontested")), F.count("*")).alias("uncontested_pct"))


def sequence_style(events: DataFrame) -> DataFrame:
    """Passes before shots: possession sums first, then one row per match and team."""
    per = events.where(c("possession_id").isNotNull()).groupBy("matchId", "teamName", "possession_id").agg(
        n_if(p.is_pass()).alias("passes"), F.max(c("isShot").cast("int")).alias("shot"))
    s = c("shot") == 1
    return per.groupBy("matchId", "teamName").agg(
        n_if(s).alias("shot_possessions"), ratio(F.coalesce(F.sum(F.when(s, c("passes"))), F.lit(0)), n_if(s)).alias("avg_passes_to_shot"),
        ratio(F.sum("passes"), F.greatest(F.lit(1), F.count("*"))).alias("avg_passes_all"), pct(n_if(s & (c("passes") <= 4)), n_if(s)).alias("direct_share"))


def with_set_piece_context(events: DataFrame) -> DataFrame:
    """Adds the next event and, per set-piece type and side, the latest delivery before each row."""
    ev = events.withColumn("t", seconds())
    at = F.struct("eventId", "index", "t")
    specs = [NextAfter("_next", F.struct("teamName", "playerName", "outcomeType", "t"))]
    for key, (token, _, _) in SET_PIECES.items():
        tag = has_like(f"(?i){token}")
        specs += [LastBefore(f"_{key}_{side}", at, tag & (c("h_a") == side)) for side in ("h", "a")]
    return scan(ev, specs)


def set_piece_deliveries(events: DataFrame) -> DataFrame:
    """Deliveries and the shots credited to them.

    A shot goes to the latest delivery of its type and team within the type's window; it must carry the
    type's situation tag where one exists. Rows: kind ``delivery`` or ``shot``.
    """
    ev = with_set_piece_context(events)
    kept = ~F.coalesce(F.lower(c("_next.outcomeType")) == "unsuccessful", F.lit(False))
    near = (c("_next.t") - c("t") <= FOLLOW_SECONDS) & (c("_next.teamName") == c("teamName"))
    foot = F.when(has("RightFoot"), "right").when(has("LeftFoot"), "left")
    swing = (F.when(foot.isNull(), "unknown").when((c("y") >= 34) == (foot == "right"), "inswinger").otherwise("outswinger"))
    parts = []
    for key, (token, situation, window) in SET_PIECES.items():
        tag = has_like(f"(?i){token}")
        last = F.when(c("h_a") == "h", c(f"_{key}_h")).otherwise(c(f"_{key}_a"))
        good = c("isShot") & (c("t") - last["t"] <= window)
        if situation:
            good = good & F.coalesce(c("situation").rlike(f"(?i){situation}"), F.lit(False))
        parts.append(F.when(tag, F.struct(F.lit(key).alias("piece"), F.lit("delivery").alias("kind"), c("eventId").alias("delivery_id"))))
        parts.append(F.when(good, F.struct(F.lit(key).alias("piece"), F.lit("shot").alias("kind"), last["eventId"].alias("delivery_id"))))
    out = ev.withColumn("_s", F.explode(F.array_compact(F.array(*parts))))
    return out.select(
        "matchId", "eventId", "teamName", "playerName", "_s.piece", "_s.kind", "_s.delivery_id", "minute", "x", "y", F.coalesce("endX", F.lit(0.0)).alias("end_x"),
        F.coalesce("endY", F.lit(0.0)).alias("end_y"), p.completed().alias("successful"), F.coalesce(near & kept, F.lit(False)).alias("retained"),
        F.when(near, c("_next.playerName")).alias("receiver"), F.when(c("_s.piece") == "corner", swing).alias("swing"),
        F.coalesce("xG", F.lit(0.0)).alias("xG"), F.coalesce("isGoal", F.lit(False)).alias("is_goal"))


def set_piece_summary(rows: DataFrame) -> DataFrame:
    d, s = c("kind") == "delivery", c("kind") == "shot"
    g = rows.groupBy("matchId", "teamName", "piece").agg(
        n_if(d).alias("count"), n_if(d & c("successful")).alias("completed"), n_if(d & p.in_box(c("end_x"), c("end_y"))).alias("into_box"),
        n_if(d & c("retained")).alias("retained"), n_if(s).alias("shots_generated"), n_if(s & c("is_goal")).alias("goals_generated"),
        sum_if(s, c("xG")).alias("xg_generated"))
    return g.withColumn("completion_pct", pct(c("completed"), c("count"))).withColumn("retention_pct", pct(c("retained"), c("count")))


def corners_won(events: DataFrame) -> DataFrame:
    return events.where((c("type") == "CornerAwarded") & p.completed()).select("matchId", "eventId", "teamName", "playerName", "minute", "x", "y")


def corner_breakdown(rows: DataFrame) -> DataFrame:
    """Corner end zones with right-side corners mirrored to the left, by swing and near/central/far lane."""
    d = rows.where((c("kind") == "delivery") & (c("piece") == "corner"))
    ey = F.when(c("y") < 34, 68.0 - c("end_y")).otherwise(c("end_y"))
    lane = F.when(~(c("end_x") >= 88.5), "outside").when(ey >= 43.16, "near").when(ey >= 24.84, "central").otherwise("far")
    return d.groupBy("matchId", "teamName", F.when(c("y") >= 34, "left").otherwise("right").alias("side"), lane.alias("end_zone")).agg(
        F.count("*").alias("corners"), n_if(c("successful")).alias("completed"))


def set_piece_takers(rows: DataFrame) -> DataFrame:
    return rows.where(c("kind") == "delivery").groupBy("matchId", "teamName", "piece", "playerName").agg(
        F.count("*").alias("taken"), n_if(c("successful")).alias("completed"), n_if(c("receiver").isNotNull()).alias("found_team_mate"))


