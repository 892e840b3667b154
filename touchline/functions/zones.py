"""Pitch zones and labels as column expressions (105 x 68, x towards the attacked goal)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Zone names with their lower bounds, in pitch order.
THIRDS = [("defensive", 0.0), ("middle", 35.0), ("final", 70.0)]
ENTRY_LANES = [("right", 0.0), ("right_hs", 13.84), ("center", 24.84), ("left_hs", 43.16), ("left", 54.16)]
EQUAL_CHANNELS = [("right_wing", 0.0), ("right_half_space", 13.6), ("central", 27.2),
                  ("left_half_space", 40.8), ("left_wing", 54.4)]


def band(c: Column, bounds, below=None) -> Column:
    """Name of the last bound not above the value."""
    out = F.lit(below)
    expr = None
    for name, low in reversed(bounds):
        expr = F.when(c >= low, name) if expr is None else expr.when(c >= low, name)
    return expr.otherwise(out)


def third(x: Column) -> Column:
    return F.when((x >= 0) & (x < 105.001), band(x, THIRDS))


def third_name(x: Column) -> Column:
    x = F.coalesce(x, F.lit(0.0))
    return F.when(x >= 70, "Attacking Third").when(x >= 35, "Middle Third").otherwise("Defensive Third")


def entry_lane(y: Column) -> Column:
    return F.when((y >= 0) & (y < 68.01), band(y, ENTRY_LANES)).otherwise("center")


def equal_channel(y: Column) -> Column:
    return F.when((y >= 0) & (y < 68.01), band(y, EQUAL_CHANNELS))


ZONE_COLUMNS = [0.0, 16.5, 34.5, 52.5, 70.5, 88.5]
ZONE_LANES = [("right_wing", 0.0), ("right_half_space", 13.84), ("central", 24.84), ("left_half_space", 43.16), ("left_wing", 54.16)]


def positional_zone(x: Column, y: Column) -> Column:
    """6 x 5 positional grid; the three central lanes of the last column split at the six-yard line."""
    lane = band(y, ZONE_LANES)
    column = band(x, [(str(i + 1), low) for i, low in enumerate(ZONE_COLUMNS)])
    inner = lane.isin("right_half_space", "central", "left_half_space") & (x >= 88.5)
    name = (F.when(inner & (x >= 99.5), F.concat(lane, F.lit("_box_6yd"))).when(inner, F.concat(lane, F.lit("_box_entry")))
            .otherwise(F.concat(lane, F.lit("_z"), column)))
    return F.when((x >= 0) & (x < 105.01) & (y >= 0) & (y < 68.01), name)


def flank(y: Column) -> Column:
    return F.when(y < 22.67, "Left").when(y < 45.33, "Center").otherwise("Right")


def exit_side(y: Column) -> Column:
    return F.when(y < 22.67, "right").when(y > 45.33, "left").otherwise("center")


def shot_zone(x: Column, y: Column) -> Column:
    return (F.when(x.isNull() | y.isNull(), "unknown")
            .when((x >= 99) & y.between(24.84, 43.16), "six_yard_box")
            .when((x >= 88.5) & y.between(13.84, 54.16), "penalty_area")
            .when(x >= 88.5, "wide_box_channel")
            .when(x >= 70, "outside_box_final_third").otherwise("deep_shot"))


def minute_bucket(minute: Column) -> Column:
    out = F.when(minute < 15, "00-15")
    for low in range(15, 90, 15):
        out = out.when(minute < low + 15, f"{low}-{low + 15}")
    return out.otherwise("90+")


def score_state(diff: Column) -> Column:
    return (F.when(diff == 0, "level").when(diff == 1, "leading_by_1").when(diff > 1, "leading_by_2_plus")
            .when(diff == -1, "trailing_by_1").otherwise("trailing_by_2_plus"))


def score_state_label(diff: Column) -> Column:
    return (F.when(diff == 0, "Level").when(diff == 1, "Leading by 1").when(diff > 1, "Leading by 2+")
            .when(diff == -1, "Trailing by 1").otherwise("Trailing by 2+"))


def shot_angle(x: Column, y: Column) -> Column:
    """Angle between the posts seen from the shot (law of cosines), radians."""
    dx, low, high = F.lit(105.0) - x, F.lit(34.0 - 3.66) - y, F.lit(34.0 + 3.66) - y
    a2, b2 = dx * dx + low * low, dx * dx + high * high
    den = F.lit(2.0) * F.sqrt(a2) * F.sqrt(b2)
    cos = F.when(den > 0, (a2 + b2 - F.lit(7.32 * 7.32)) / den).otherwise(1.0)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))
