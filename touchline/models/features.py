"""Feature tables of shots and passes, as column expressions over all matches at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from touchline.functions import predicates as p, zones as z
from touchline.functions.core import dist, has, has_like
from touchline.operators.scan import LastBefore, RunningSum, scan
from touchline.operators.state import clock_seconds, with_previous_action

# The posts and bar of the goal, training limits, the penalty value.
POST_LEFT, POST_RIGHT, BAR, CENTRE, GOAL_WIDTH = 30.34, 37.66, 2.44, 34.0, 7.32
MIN_SHOT_X, MAX_SHOT_DISTANCE, PENALTY_XG = 52.5, 60.0, 0.78

SHOT_NUMERIC = ["x", "y", "minute", "second", "expanded_minute", "shot_distance", "shot_angle", "shot_lateral_distance", "shot_distance_sq", "is_header",
                "is_left_foot", "is_right_foot", "is_big_chance", "is_open_play", "is_counter", "is_set_piece", "is_direct_corner", "is_from_corner",
                "is_direct_free_kick", "is_penalty", "prev_time_delta", "prev_action_distance", "prev_action_angle", "prev_action_into_box",
                "prev_action_same_team", "prev_action_success", "shot_after_carry", "shot_after_takeon", "shot_after_cross", "shot_after_through_ball",
                "shot_after_recovery", "shot_after_duel", "game_state_goal_diff"]
SHOT_CATEGORIES = ["league", "season", "h_a", "situation_clean", "body_part", "shot_family", "shot_zone", "minute_bucket", "score_state", "prev_action_type",
                   "prev_action_subtype", "prev_action_outcome"]
PLACEMENT_NUMERIC = ["xG", "x", "y", "shot_distance", "shot_angle", "goal_mouth_y", "goal_mouth_z", "goal_mouth_y_centered", "goal_mouth_z_normalized",
                     "goal_mouth_distance_to_center", "goal_mouth_distance_to_nearest_post", "goal_mouth_distance_to_crossbar", "is_header", "is_left_foot",
                     "is_right_foot", "is_big_chance", "is_penalty", "is_open_play", "is_counter", "is_set_piece", "game_state_goal_diff"]
PLACEMENT_CATEGORIES = ["league", "season", "h_a", "situation_clean", "body_part", "shot_family", "shot_zone", "goal_mouth_zone", "score_state"]
_PASS_NUMERIC = ["x", "y", "endX", "endY", "minute", "second", "expanded_minute", "pass_distance", "pass_angle", "pass_forward_distance", "pass_lateral_distance",
                 "start_distance_to_goal", "end_distance_to_goal", "distance_to_goal_delta", "start_lateral_to_goal", "end_lateral_to_goal", "is_cross",
                 "is_through_ball", "is_long_ball", "is_chipped", "is_headed", "is_corner", "is_free_kick", "is_throw_in", "enters_final_third",
                 "enters_penalty_area", "ends_in_penalty_area", "game_state_goal_diff"]
PASS_NUMERIC = _PASS_NUMERIC + ["ends_in_box_centre", "is_cutback_proxy"]
PASS_CATEGORIES = ["league", "season", "h_a", "pass_type", "play_pattern", "pass_direction", "start_third", "end_third", "start_lane", "end_lane", "minute_bucket",
                   "score_state"]
COMPLETION_NUMERIC = _PASS_NUMERIC + ["is_right_foot", "is_left_foot", "is_switch", "previous_action_team_same", "previous_pass_distance", "previous_pass_angle",
                                      "carry_distance_before_pass", "pass_count_in_possession", "pass_count_log"]
COMPLETION_CATEGORIES = PASS_CATEGORIES + ["previous_action_type"]


def c(name):
    return F.col(name)


def flag(cond):
    return F.coalesce(cond, F.lit(False)).cast("int")


def is_penalty():
    return F.lower(F.trim(F.coalesce("situation", F.lit("")))).isin("penalty", "penaltykick", "penalty kick") | has_like(
        r"(?i)\bpenalty\s*(kick|taken|scored|missed|saved)\b")


def is_direct_free_kick():
    return (F.coalesce("situation", F.lit("")).rlike("(?i)direct.?free|free.?kick") | has_like("(?i)direct.?free|free.?kick")) & ~is_penalty()


def body_part():
    return F.when(has("Head"), "Head").when(has("LeftFoot"), "LeftFoot").when(has("RightFoot"), "RightFoot").otherwise("Unknown")


def shot_family():
    s = F.lower(F.coalesce("situation", F.lit("")))
    return (F.when(is_penalty(), "penalty").when(is_direct_free_kick(), "direct_free_kick").when(has("Head"), "header")
            .when(s.isin("openplay", "open play"), "open_play_foot").when(s.isin("setpiece", "set piece", "fromcorner"), "other_set_piece").otherwise("other"))


def action_subtype(a):
    """Kind of a previous action struct, by the first rule that fits."""
    q = lambda word: F.exists(a["qualifiers"], lambda v: v.rlike(f"(?i){word}"))
    t = a["type"]
    return (F.when(t == "Carry", "carry").when(q("cross"), "cross").when(q("through"), "through_ball").when(q("corner"), "corner")
            .when(q("free.?kick"), "free_kick").when(q("long"), "long_ball").when(t.isin("TakeOn", "Challenge"), "takeon")
            .when(t.isin("BallRecovery", "Interception"), "recovery").when(t.isin("Aerial", "Tackle"), "duel").otherwise(F.lower(t)))


def goal_mouth_zone():
    """Height and side of the shot in the goal mouth."""
    y, zz = c("goal_mouth_y"), c("goal_mouth_z")
    high = F.when(zz < BAR / 3, "low").when(zz < BAR * 2 / 3, "mid").otherwise("high")
    side = F.when(y < CENTRE - GOAL_WIDTH / 6, "left").when(y > CENTRE + GOAL_WIDTH / 6, "right").otherwise("center")
    return F.when(c("type") == "ShotOnPost", "post").when(y.isNull() | zz.isNull(), "unknown").otherwise(F.concat_ws("_", high, side))


def shot_features(events: DataFrame) -> DataFrame:
    """One row per shot: place, body part, family, situation, score state and previous action (<= 20 s).

    The score state is the running one before the shot, home/away is carried, and success of the previous
    action is an exact match. Needs score columns.
    """
    ev = with_previous_action(events)
    prev = c("prev")
    sub = F.when(prev.isNull(), "none").otherwise(action_subtype(prev))
    moved = F.coalesce(prev["endX"].isNotNull() & prev["endY"].isNotNull(), F.lit(False))
    dx, dy = prev["endX"] - prev["x"], prev["endY"] - prev["y"]
    x, y = c("x"), c("y")
    sd = dist(F.lit(105.0), F.lit(34.0), x, y)
    s = F.lower(F.coalesce("situation", F.lit("")))
    shots = ev.where(p.is_shot() | F.coalesce(c("isShot"), F.lit(False))).withColumn("prev_action_subtype", sub)
    after = {k: flag(c("prev_action_subtype") == k) for k in ("carry", "takeon", "cross", "through_ball", "recovery", "duel")}
    out = shots.select(
        "matchId", "eventId", "index", "league", "season", "startDate", "teamId", "teamName", "opponentName", "h_a", "playerId", "playerName", "period", "type", "minute", "second",
        c("expandedMinute").alias("expanded_minute"), "goalOwn", flag(c("type") == "Goal").alias("isGoal"), "xG", x.alias("x"), y.alias("y"), c("goalMouthY").alias("goal_mouth_y"), c("goalMouthZ").alias("goal_mouth_z"),
        sd.alias("shot_distance"), (sd * sd).alias("shot_distance_sq"), z.shot_angle(x, y).alias("shot_angle"), F.abs(y - 34.0).alias("shot_lateral_distance"),
        z.shot_zone(x, y).alias("shot_zone"), z.minute_bucket(c("minute")).alias("minute_bucket"),
        F.when(c("team_goal_diff_before") > 0, "leading").when(c("team_goal_diff_before") < 0, "trailing").otherwise("level").alias("score_state"),
        c("team_goal_diff_before").alias("game_state_goal_diff"), F.coalesce("situation", F.lit("Unknown")).alias("situation_clean"), body_part().alias("body_part"),
        shot_family().alias("shot_family"), flag(has("BigChance")).alias("is_big_chance"), flag(has("Head")).alias("is_header"), flag(has("LeftFoot")).alias("is_left_foot"),
        flag(has("RightFoot")).alias("is_right_foot"), flag(s.isin("openplay", "open play")).alias("is_open_play"), flag(s.contains("set")).alias("is_set_piece"),
        flag((s == "counter") | has("ShotCounter")).alias("is_counter"), flag(has("ShotDirectCorner")).alias("is_direct_corner"),
        flag((s == "fromcorner") | has_like("(?i)corner")).alias("is_from_corner"), flag(p.shot_blocked()).alias("is_blocked"), flag(p.kind("Goal", "SavedShot")).alias("is_on_target"),
        F.coalesce(prev["type"], F.lit("none")).alias("prev_action_type"), "prev_action_subtype", F.coalesce((clock_seconds() - prev["t"]).cast("double"), F.lit(99.0)).alias("prev_time_delta"),
        F.when(moved, F.sqrt(dx * dx + dy * dy)).otherwise(0.0).alias("prev_action_distance"), F.when(moved, F.atan2(dy, dx)).otherwise(0.0).alias("prev_action_angle"),
        flag(moved & p.in_box(prev["endX"], prev["endY"])).alias("prev_action_into_box"), flag(prev["teamId"] == c("teamId")).alias("prev_action_same_team"),
        flag(prev["outcomeType"] == "Successful").alias("prev_action_success"),
        F.when(prev["outcomeType"] == "Successful", "successful").otherwise("unsuccessful").alias("prev_action_outcome"), *[v.alias(f"shot_after_{k}") for k, v in after.items()])
    return (out.withColumn("is_penalty", flag(c("shot_family") == "penalty")).withColumn("is_direct_free_kick", flag(c("shot_family") == "direct_free_kick"))
            .withColumn("xg_fixed", F.when(c("shot_family") == "penalty", PENALTY_XG)))


def xgot_features(shots: DataFrame) -> DataFrame:
    """Goal-mouth geometry on top of the shot features."""
    y, zz = c("goal_mouth_y"), c("goal_mouth_z")
    on, blocked = p.kind("Goal", "SavedShot"), c("is_blocked") == 1
    dz = (zz - BAR / 2) / 4.0
    return shots.withColumns({
        "xgot_is_on_target": on, "xgot_is_blocked": blocked, "xgot_zero_value": ~on | blocked,
        "xgot_training_eligible": on & ~blocked & y.isNotNull() & zz.isNotNull(),
        "goal_mouth_y_centered": F.abs(y - CENTRE), "goal_mouth_z_normalized": zz / BAR,
        "goal_mouth_distance_to_center": F.sqrt((y - CENTRE) * (y - CENTRE) + dz * dz),
        "goal_mouth_distance_to_nearest_post": F.least(F.abs(y - POST_LEFT), F.abs(y - POST_RIGHT)),
        "goal_mouth_distance_to_crossbar": F.abs(F.lit(BAR) - zz), "goal_mouth_zone": goal_mouth_zone(), "xgot_model_target": c("isGoal")})


def pass_type():
    return (F.when(has_like(r"(?i)\bThroughball\b"), "through_ball").when(has_like(r"(?i)\bCross\b"), "cross").when(has_like(r"(?i)\bLongball\b"), "long_ball")
            .when(has_like(r"(?i)\b(Chipped|Chip)\b"), "chipped").when(has_like(r"(?i)\b(Head|HeadPass)\b"), "headed").otherwise("ground_pass"))


def play_pattern():
    return (F.when(has_like(r"(?i)\b(Corner|CornerTaken)\b"), "corner").when(has_like(r"(?i)\b(Free ?Kick|FreekickTaken)\b"), "free_kick")
            .when(has_like(r"(?i)\bThrow-?in\b"), "throw_in").otherwise("open_play"))


def _third(x):
    return F.when(x.isNull(), "unknown").when(x < 35.0, "defensive").when(x < 70.0, "middle").otherwise("attacking")


def _lane(y):
    return F.when(y.isNull(), "unknown").when(y < 68.0 / 3, "left").when(y < 136.0 / 3, "center").otherwise("right")


def pass_geometry(passes: DataFrame) -> DataFrame:
    """Columns shared by both pass models."""
    x, y, ex, ey = (c(n) for n in ("x", "y", "endX", "endY"))
    dx, dy, gx, gy = ex - x, ey - y, F.lit(105.0), F.lit(34.0)
    d0, d1 = dist(gx, gy, x, y), dist(gx, gy, ex, ey)
    diff = c("team_goal_diff_before")
    out = passes.withColumns({
        "expanded_minute": c("expandedMinute"), "is_right_foot": flag(has("RightFoot")), "is_left_foot": flag(has("LeftFoot")),
        "pass_distance": F.sqrt(dx * dx + dy * dy), "pass_angle": F.atan2(dy, dx), "pass_forward_distance": dx, "pass_lateral_distance": F.abs(dy),
        "start_distance_to_goal": d0, "end_distance_to_goal": d1, "distance_to_goal_delta": d0 - d1, "start_lateral_to_goal": F.abs(y - 34.0),
        "end_lateral_to_goal": F.abs(ey - 34.0), "pass_type": pass_type(), "play_pattern": play_pattern(),
        "pass_direction": F.when(dx > 5, "forward").when(dx < -5, "backward").otherwise("sideways"), "start_third": _third(x), "end_third": _third(ex),
        "start_lane": _lane(y), "end_lane": _lane(ey), "minute_bucket": z.minute_bucket(c("minute")), "game_state_goal_diff": diff,
        "score_state": F.when(diff > 0, "leading").when(diff < 0, "trailing").otherwise("level"),
        "enters_final_third": flag((x < 70) & (ex >= 70)), "ends_in_penalty_area": flag(p.in_box(ex, ey)), "enters_penalty_area": flag(~p.in_box(x, y) & p.in_box(ex, ey)),
        "ends_in_box_centre": flag((ex >= 88.5) & ey.between(24.0, 44.0)),
        "is_cutback_proxy": flag((x >= 88.5) & (y.between(0, 16) | y.between(52, 68)) & (ex < x) & ey.between(20, 48)),
        "is_switch": flag((F.sqrt(dx * dx + dy * dy) >= 30) & (((y < 68.0 / 3) & (ey > 136.0 / 3)) | ((y > 136.0 / 3) & (ey < 68.0 / 3))))})
    kinds = {"is_cross": "cross", "is_through_ball": "through_ball", "is_long_ball": "long_ball", "is_chipped": "chipped", "is_headed": "headed"}
    plays = {"is_corner": "corner", "is_free_kick": "free_kick", "is_throw_in": "throw_in"}
    return out.withColumns({**{k: flag(c("pass_type") == v) for k, v in kinds.items()}, **{k: flag(c("play_pattern") == v) for k, v in plays.items()}})


def shot_links(events: DataFrame) -> DataFrame:
    """The last shot that names each event as its origin."""
    shots = events.where((p.is_shot() | F.coalesce(c("isShot"), F.lit(False))) & c("relatedEventId").isNotNull())
    best = shots.groupBy("matchId", c("relatedEventId").alias("eventId")).agg(F.max_by(F.struct(
        c("eventId").alias("id"), "xG", flag(c("isGoal")).alias("goal"), "type"), "index").alias("s"))
    return best.select("matchId", "eventId", c("s.id").alias("xa_target_event_id"), c("s.xG").alias("xa_target_xg"), c("s.goal").alias("xa_target_is_goal"), c("s.type").alias("xa_target_type"))


def assist_features(events: DataFrame) -> DataFrame:
    """Completed passes with assist labels and the shot they led to."""
    done = events.where(p.is_pass() & p.completed())
    out = pass_geometry(done).join(shot_links(events), ["matchId", "eventId"], "left")
    return out.withColumns({
        "xa_target_assist": flag(has_like(r"\b(IntentionalGoalAssist|GoalAssist)\b")),
        "xa_is_direct_shot_assist": flag(has_like(r"\b(ShotAssist|KeyPass|BigChanceCreated|IntentionalAssist)\b")),
        "xa_link_method": F.when(c("xa_target_event_id").isNotNull(), "relatedEventId").otherwise("")})


def completion_features(events: DataFrame) -> DataFrame:
    """Attempted passes with previous action, possession pass count and completion target.

    Needs ``possession_id`` and score columns.
    """
    prev = F.struct("type", "teamId", "playerId", "x", "y", "endX", "endY")
    ev = scan(events, [LastBefore("_p", prev)])
    q = c("_p")
    dx, dy = q["endX"] - q["x"], q["endY"] - q["y"]
    was_pass, was_carry = F.coalesce(q["type"] == "Pass", F.lit(False)), F.coalesce((q["type"] == "Carry") & (q["playerId"] == c("playerId")), F.lit(False))
    ev = ev.withColumns({
        "previous_action_type": F.coalesce(q["type"], F.lit("none")), "previous_action_team_same": flag(q["teamId"] == c("teamId")),
        "previous_pass_distance": F.coalesce(F.when(was_pass, F.sqrt(dx * dx + dy * dy)), F.lit(0.0)), "previous_pass_angle": F.coalesce(F.when(was_pass, F.atan2(dy, dx)), F.lit(0.0)),
        "carry_distance_before_pass": F.coalesce(F.when(was_carry, F.sqrt(dx * dx + dy * dy)), F.lit(0.0))}).drop("_p")
    ev = scan(ev, [RunningSum("pass_count_in_possession", p.is_pass().cast("bigint"), inclusive=True)], ("matchId", "possession_id"))
    out = pass_geometry(ev.where(p.is_pass()))
    return out.withColumns({"pass_count_log": F.log1p(c("pass_count_in_possession").cast("double")), "xpass_completed": flag(p.completed())})


def shot_training_rows(shots: DataFrame, penalties: bool = False) -> DataFrame:
    out = shots if penalties else shots.where(c("shot_family") != "penalty")
    return out.where((c("x") >= MIN_SHOT_X) & (c("shot_distance") <= MAX_SHOT_DISTANCE) & c("isGoal").isNotNull())


def pass_training_rows(passes: DataFrame) -> DataFrame:
    return passes.where(c("pass_distance").between(0.1, 105.0) & c("pass_angle").isNotNull())


def completion_training_rows(passes: DataFrame) -> DataFrame:
    return pass_training_rows(passes).where(F.lower("outcomeType").isin("successful", "unsuccessful"))


def xgot_training_rows(shots: DataFrame) -> DataFrame:
    return shots.where(c("xgot_training_eligible"))


def time_split(matches: DataFrame, train: float = 0.7, calibrate: float = 0.85) -> DataFrame:
    """Train, calibration and test part of each match in time order.

    Positions come from counts per day and a rank inside the day, so no task orders all matches.
    """
    per = matches.select("matchId", "startDate").distinct()
    days = per.groupBy("startDate").agg(F.count("*").alias("n"))
    # One row per calendar day reaches this window.
    days = days.withColumns({"_before": F.coalesce(F.sum("n").over(W.orderBy("startDate").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
                             "_total": F.sum("n").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    at = c("_before") + F.row_number().over(W.partitionBy("startDate").orderBy("matchId"))
    out = per.join(days, "startDate").withColumn("_at", at)
    cut1 = F.greatest(F.lit(1), F.floor(c("_total") * train))
    cut2 = F.greatest(cut1 + 1, F.floor(c("_total") * calibrate))
    return out.select("matchId", "startDate", F.when(c("_at") <= cut1, "train").when(c("_at") <= cut2, "calibrate").otherwise("test").alias("part"))
