"""Pitch value surfaces: EPV grid, xT value, and their lookup by pitch cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from touchline.functions.predicates import on_ball_success

ROWS, COLS = 22, 32
GRID_VERSION = "builtin-surface-1"


def default_epv_grid(spark: SparkSession, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    """Smooth left-to-right surface: rises to the goal, rewards the centre, lifts the boxes."""
    cells = spark.range(rows * cols).select(
        F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    x = (F.col("col") + 0.5) / cols
    y = (F.col("row") + 0.5) / rows
    off = F.abs(y - 0.5)
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    centre = 1.0 - clip(off / 0.5)
    near = clip(1.0 - F.sqrt((1.0 - x) * (1.0 - x) + ((y - 0.5) * 0.72) * ((y - 0.5) * 0.72)) / 1.24)
    last = clip((x - 0.66) / 0.34)
    box = ((x >= 88.5 / 105.0) & (off <= 20.16 / 68.0)).cast("double")
    six = ((x >= 99.5 / 105.0) & (off <= 9.16 / 68.0)).cast("double")
    value = (0.004 + 0.018 * F.pow(x, F.lit(1.6)) + 0.065 * near * near * near
             + 0.030 * last * F.pow(centre, F.lit(1.3)) + 0.055 * box * centre + 0.050 * six * centre)
    rising = F.max(value).over(W.partitionBy("row").orderBy("col").rowsBetween(W.unboundedPreceding, 0))
    return cells.select("row", "col", F.least(F.lit(0.32), F.greatest(F.lit(0.0), rising)).alias("value"))


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """A headerless CSV grid (one line per pitch row) as (row, col, value); lines are read one by one, whatever the file's size."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")]
    lines = spark.read.text(path).select("value", *place).where(F.length(F.trim("value")) > 0)
    at = F.row_number().over(W.partitionBy("file").orderBy("block", "id")) - 1
    return (lines.withColumn("row", at).select("row", F.posexplode(F.split("value", ",")).alias("col", "v"))
            .select("row", "col", F.trim("v").cast("double").alias("value")))


def sent_grid(grid: DataFrame, rows: int, cols: int) -> DataFrame:
    """A caller's grid cut to rows * cols cells of one value each, so that it can be sent to all tasks."""
    inside = (F.col("row") >= 0) & (F.col("row") < rows) & (F.col("col") >= 0) & (F.col("col") < cols)
    return grid.where(inside).groupBy("row", "col").agg(F.max("value").alias("value"))


def cell(c: Column, length: float, n: int) -> Column:
    """Half-open cell number; the far edge belongs to the last cell; NULL outside the pitch."""
    return F.when(c.between(0.0, length), F.least(F.floor(c / length * n), F.lit(n - 1))).cast("int")


def observed_cell(c: Column, lo: Column, hi: Column, n: int) -> Column:
    """Equal-width, right-closed bins over the observed range (lowest edge included)."""
    pos = (c - lo) / ((hi - lo) / n)
    return F.when(hi > lo, F.greatest(F.lit(0), F.least(F.ceil(pos) - 1, F.lit(n - 1)))).cast("int")


def with_grid_values(events: DataFrame, grid: DataFrame, prefix: str, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    """Start and end cell values by two broadcast lookups (a grid has rows*cols rows, both given)."""
    out = (events.withColumn(f"{prefix}_start_zone_x", cell(F.col("x"), 105.0, cols))
           .withColumn(f"{prefix}_start_zone_y", cell(F.col("y"), 68.0, rows))
           .withColumn(f"{prefix}_end_zone_x", cell(F.col("endX"), 105.0, cols))
           .withColumn(f"{prefix}_end_zone_y", cell(F.col("endY"), 68.0, rows)))
    grid = sent_grid(grid, rows, cols)
    for side in ("start", "end"):
        g = grid.select(F.col("col").alias(f"{prefix}_{side}_zone_x"), F.col("row").alias(f"{prefix}_{side}_zone_y"),
                        F.col("value").alias(f"{prefix}_{side}"))
        out = out.join(F.broadcast(g), [f"{prefix}_{side}_zone_x", f"{prefix}_{side}_zone_y"], "left")
    return out


def with_epv(events: DataFrame, grid: DataFrame | None = None, version: str = "v1", force: bool = True) -> DataFrame:
    """EPV of successful passes and carries: value at the end minus value at the start.

    Without ``force`` rows already scored by this version keep their values.
    """
    grid = grid if grid is not None else default_epv_grid(events.sparkSession)
    made = ["epv_start", "epv_end", "epv_start_zone_x", "epv_start_zone_y", "epv_end_zone_x", "epv_end_zone_y"]
    old = {c: F.col(c) for c in ("epv_added", "epv_model_version") if c in events.columns}
    src = events.drop(*made).withColumnsRenamed({c: f"_old_{c}" for c in old})
    out = with_grid_values(src, grid, "epv")
    eligible = on_ball_success()
    scored = eligible & F.col("epv_start").isNotNull() & F.col("epv_end").isNotNull()
    if not force and "epv_model_version" in old:
        scored = scored & ~F.coalesce(F.col("_old_epv_model_version") == version, F.lit(False))
    keep = lambda c: F.col(f"_old_{c}") if c in old else F.lit(None)
    out = (out.withColumn("epv_action_eligible", eligible)
           .withColumn("epv_added", F.when(scored, F.col("epv_end") - F.col("epv_start")).otherwise(keep("epv_added")))
           .withColumn("epv_model_version", F.when(scored, version).otherwise(keep("epv_model_version"))))
    for c in made:
        out = out.withColumn(c, F.when(scored, F.col(c)))
    return out.drop(*[f"_old_{c}" for c in old])


def xt_value(x: Column, y: Column) -> Column:
    """Closed-form threat of a pitch point, used where no xT grid is given."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    forward = clip(F.coalesce(x, F.lit(0.0)) / 105.0)
    centre = clip(1.0 - F.abs(F.coalesce(y, F.lit(34.0)) - 34.0) / 34.0)
    return F.pow(forward, F.lit(1.7)) * (0.72 + 0.28 * centre)


def with_xt(events: DataFrame) -> DataFrame:
    """xT of successful passes and carries by the closed form, clipped to -0.25..0.5, 0 elsewhere.

    Values already present and not 0 stay.
    """
    given = F.col("xT") if "xT" in events.columns else F.lit(None).cast("double")
    gain = xt_value(F.col("endX"), F.col("endY")) - xt_value(F.col("x"), F.col("y"))
    fill = F.greatest(F.lit(-0.25), F.least(F.lit(0.5), gain))
    need = given.isNull() | (given == 0)
    return events.withColumn("xT", F.when(need & on_ball_success(), fill).otherwise(F.coalesce(given, F.lit(0.0))))


def with_xt_grid(events: DataFrame, grid: DataFrame, rows: int, cols: int, binning: str = "pitch") -> DataFrame:
    """xT from a grid for successful non-corner passes and carries.

    ``binning="pitch"`` uses fixed cells. ``binning="observed"`` uses equal-width right-closed bins over
    the range of coordinates seen in each match, one range per coordinate.
    """
    eligible = on_ball_success() & ~F.coalesce(F.exists("qualifiers", lambda q: q.contains("Corner")), F.lit(False))
    if binning == "pitch":
        out = with_grid_values(events.drop("xT"), grid, "xt", rows, cols)
    else:
        ends = [("x", "xt_start_zone_x", cols), ("y", "xt_start_zone_y", rows),
                ("endX", "xt_end_zone_x", cols), ("endY", "xt_end_zone_y", rows)]
        span = events.where(eligible).groupBy("matchId").agg(
            *[F.min(c).alias(f"_lo_{c}") for c, _, _ in ends], *[F.max(c).alias(f"_hi_{c}") for c, _, _ in ends])
        out = events.drop("xT").join(span, "matchId", "left")
        for c, z, n in ends:
            out = out.withColumn(z, observed_cell(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}"), n))
        for side in ("start", "end"):
            g = grid.select(F.col("col").alias(f"xt_{side}_zone_x"), F.col("row").alias(f"xt_{side}_zone_y"),
                            F.col("value").alias(f"xt_{side}"))
            out = out.join(F.broadcast(g), [f"xt_{side}_zone_x", f"xt_{side}_zone_y"], "left")
        out = out.drop(*[f"_lo_{c}" for c, _, _ in ends], *[f"_hi_{c}" for c, _, _ in ends])
    out = out.withColumn("xT", F.when(eligible, F.col("xt_end") - F.col("xt_start")))
    for c in ("xt_start", "xt_end", "xt_start_zone_x", "xt_start_zone_y", "xt_end_zone_x", "xt_end_zone_y"):
        out = out.withColumn(c, F.when(eligible, F.col(c)))
    return out


def with_centred_epv(events: DataFrame, grid: DataFrame, rows: int, cols: int) -> DataFrame:
    """The older surface lookup: 106 x 68 pitch with the origin in the centre, 0 off the pitch,
    mirrored for teams playing right to left (``attack_direction = -1``)."""
    out = events
    for side, cx, cy in (("start", "x", "y"), ("end", "endX", "endY")):
        mx = F.col(cx) / 105.0 * 106.0 - 53.0
        my = F.col(cy) - 34.0
        ix = F.floor((mx + 53.0 - 0.0001) / (106.0 / cols)).cast("int")
        ix = F.when(F.col("attack_direction") == -1, F.lit(cols - 1) - ix).otherwise(ix)
        iy = F.floor((my + 34.0 - 0.0001) / (68.0 / rows)).cast("int")
        on = (F.abs(mx) <= 53.0) & (F.abs(my) <= 34.0)
        out = (out.withColumn("_on", on).withColumn("_ix", F.greatest(F.lit(0), F.least(ix, F.lit(cols - 1))))
               .withColumn("_iy", F.greatest(F.lit(0), F.least(iy, F.lit(rows - 1)))))
        g = grid.select(F.col("col").alias("_ix"), F.col("row").alias("_iy"), F.col("value").alias("_v"))
        out = (out.join(F.broadcast(g), ["_ix", "_iy"], "left")
               .withColumn(f"grid_{side}", F.when(F.col("_on"), F.col("_v")).when(~F.col("_on"), 0.0))
               .drop("_on", "_ix", "_iy", "_v"))
    scored = (F.col("type") == "Pass") & (F.col("outcomeType") == "Successful")
    return out.withColumn("EPV", F.when(scored, F.col("grid_end") - F.col("grid_start")))
