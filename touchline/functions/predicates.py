"""Event masks as column expressions. All take the canonical columns of ``touchline.schema``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from touchline.functions.core import dist, has_like

# The feed's own event names, grouped as the product's metrics define them.
SHOT_TYPES = ["Goal", "SavedShot", "MissedShots", "ShotOnPost"]
ON_TARGET_TYPES = ["Goal", "SavedShot"]
PPDA_TYPES = ["Tackle", "Interception", "Challenge", "BlockedPass"]
KEEPER_TYPES = ["Save", "KeeperSave", "KeeperPickup", "Claim", "Punch", "Smother", "KeeperSweeper"]
GROUND_DUEL_TYPES = ["TakeOn", "GoodSkill", "ShieldBallOpp", "Foul", "Tackle", "Challenge"]
DEFENSIVE_TYPES = ["Aerial", "BallRecovery", "BlockedPass", "Challenge", "Clearance", "Error", "Foul",
                   "Interception", "Tackle"]
PRESS_TYPES = ["Interception", "Tackle", "Clearance", "BlockedPass", "BallRecovery", "Challenge"]
ON_BALL_TYPES = ["Pass", "Carry"]
NOT_AN_ACTION = ["SubstitutionOn", "SubstitutionOff", "FormationChange", "Card", "Start", "End", "Save"]
LOCATION_TYPES = ["Goal", "SavedShot", "MissedShots", "ShotOnPost", "Pass", "Carry", "TakeOn", "Tackle",
                  "Interception", "Challenge", "Clearance", "BallRecovery", "BlockedPass", "Aerial", "Foul"]
RESTART_QUALIFIERS = "(?i)CornerTaken|FreekickTaken|IndirectFreekickTaken|ThrowIn|GoalKick|KeeperThrow|KickOff"

BOX_X, BOX_LOW, BOX_HIGH = 88.5, 13.84, 54.16
FINAL_THIRD, OWN_THIRD, HALFWAY = 70.0, 35.0, 52.5


def kind(*names) -> Column:
    return F.col("type").isin(*names)


def is_shot() -> Column:
    return kind(*SHOT_TYPES)


def is_pass() -> Column:
    return F.col("type") == "Pass"


def completed() -> Column:
    """Outcome is exactly Successful."""
    return F.coalesce(F.col("outcomeType") == "Successful", F.lit(False))


def not_failed() -> Column:
    """Outcome Successful, empty or absent: what action views count as success."""
    o = F.lower(F.trim(F.coalesce(F.col("outcomeType"), F.lit(""))))
    return o.isin("successful", "nan", "")


def success_word() -> Column:
    """Dossier meaning: success tagged on the row, compared as a whole word so that
    "Unsuccessful" does not count (a plain substring test would let it through)."""
    return F.coalesce(F.lower(F.col("outcomeType")) == "successful", F.lit(False))


def own_goal() -> Column:
    return F.coalesce(F.col("goalOwn"), F.lit(False)) | has_like(r"(?i)\bown\s*goal\b|\bgoalOwn\b")


def proper_shot() -> Column:
    """Shots and goals without own goals."""
    return (is_shot() | F.coalesce(F.col("isShot"), F.lit(False))) & ~own_goal()


def shot_blocked() -> Column:
    return has_like("(?i)^Blocked$")


def on_target() -> Column:
    return (F.col("type") == "Goal") | ((F.col("type") == "SavedShot") & ~shot_blocked())


def in_box(x: Column, y: Column) -> Column:
    return (x >= BOX_X) & (y >= BOX_LOW) & (y <= BOX_HIGH)


def on_ball_success() -> Column:
    """Successful pass or carry: the rows whose xT and EPV count."""
    return kind(*ON_BALL_TYPES) & completed()


def box_entry_season() -> Column:
    """Season table: successful pass/carry from outside into the box; absent coordinates count as 0."""
    z = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("x", "y", "endX", "endY")]
    return on_ball_success() & ~in_box(z[0], z[1]) & in_box(z[2], z[3])


def box_entry_dossier() -> Column:
    """Dossier: any pass/carry/take-on that ends in the box and starts in front of it."""
    return (kind("Pass", "Carry", "TakeOn") & (F.col("x") < BOX_X) & in_box(F.col("endX"), F.col("endY")))


def open_play() -> Column:
    return ~has_like(RESTART_QUALIFIERS)


def defensive_action() -> Column:
    """Successful defensive action; aerials only when tagged Defensive."""
    return (kind(*DEFENSIVE_TYPES) & ((F.col("type") != "Aerial") | has_like("(?i)defensive"))
            & (F.col("outcomeType").isNull() | F.lower("outcomeType").isin("successful", "nan")))


def duel(which: str = "Total") -> Column:
    ground, aerial = kind(*GROUND_DUEL_TYPES), F.col("type") == "Aerial"
    if which in ("Ground", "Ground Duels", "Offensive", "Defensive"):
        return ground
    if which in ("Aerial", "Aerial Duels"):
        return aerial
    return ground | aerial


def duel_won() -> Column:
    return duel() & not_failed()


def goal_gain() -> Column:
    """Metres gained towards the centre of the goal."""
    gx, gy = F.lit(105.0), F.lit(34.0)
    return dist(gx, gy, F.col("x"), F.col("y")) - dist(gx, gy, F.col("endX"), F.col("endY"))


def prog_pass() -> Column:
    """Metres a pass gains (0 for other types); "progressive" in season tables means > 0."""
    return F.when(is_pass(), goal_gain()).otherwise(0.0)


def prog_carry() -> Column:
    return F.when(F.col("type") == "Carry", goal_gain()).otherwise(0.0)


def progressive() -> Column:
    """30 m inside the own half, 15 m across halfway, 10 m inside the opponent half."""
    x, y = F.coalesce(F.col("x"), F.lit(0.0)), F.coalesce(F.col("y"), F.lit(0.0))
    ex, ey = F.coalesce(F.col("endX"), x), F.coalesce(F.col("endY"), y)
    gx, gy = F.lit(105.0), F.lit(34.0)
    gain = dist(gx, gy, x, y) - dist(gx, gy, ex, ey)
    need = (F.when((x < HALFWAY) & (ex < HALFWAY), 30.0)
            .when((x >= HALFWAY) & (ex >= HALFWAY), 10.0).otherwise(15.0))
    return gain >= need


def progressive_tagged() -> Column:
    """Dossier form: successful pass or carry tagged with metres gained, or going forward by 30 m from the
    own third, 15 m from the middle third, 10 m from the final third."""
    x, ex = F.coalesce("x", F.lit(0.0)), F.coalesce("endX", F.lit(0.0))
    need = F.when(x < 35, 30.0).when(x < 70, 15.0).otherwise(10.0)
    tagged = (F.coalesce(F.col("prog_pass"), F.lit(0.0)) > 0) | (F.coalesce(F.col("prog_carry"), F.lit(0.0)) > 0)
    return kind(*ON_BALL_TYPES) & success_word() & (tagged | ((ex - x >= need) & (ex > x)))
