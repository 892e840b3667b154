"""Quality of scored rows, reports over expected, prediction write-back and old/new comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from touchline.functions.core import fsum, n_if, ratio

RANGES = 10_000


def c(name):
    return F.col(name)


def model_metrics(rows: DataFrame, target: str, prediction: str, keys=()) -> DataFrame:
    """Log loss, Brier, calibration error, totals, ROC AUC and average precision.

    AUC and average precision are exact: counts by the prediction's own value, running inside ranges of a ten-thousandth;
    the ranges' totals, at most 10 001 rows per key group, run in an ordered window of their own.
    """
    if not keys:
        return model_metrics(rows.withColumn("_key", F.lit(1)), target, prediction, ["_key"]).drop("_key")
    keys = list(keys)
    y = c(target).cast("double")
    q = F.greatest(F.lit(1e-8), F.least(F.lit(1 - 1e-8), c(prediction)))
    r = rows.select(*keys, y.alias("y"), q.alias("q"), c(prediction).alias("p"), F.floor(c(prediction) * RANGES).cast("int").alias("b"), F.least(F.floor(q * 15), F.lit(14)).cast("int").alias("e"))
    base = r.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.sum("y").cast("bigint").alias("positives"), fsum(c("q")).alias("expected"),
        (fsum(-(c("y") * F.log("q") + (1 - c("y")) * F.log(1 - c("q")))) / F.count("*")).alias("log_loss"),
        (fsum((c("q") - c("y")) * (c("q") - c("y"))) / F.count("*")).alias("brier"))
    bucket = r.groupBy(*keys, "e").agg(F.count("*").alias("n"), F.sum("y").alias("sy"), fsum(c("q")).alias("sq"))
    ece = bucket.groupBy(*keys).agg((fsum(F.abs(c("sy") - c("sq"))) / F.sum("n")).alias("calibration_error"))
    hist = r.groupBy(*keys, "b", "p").agg(F.sum("y").cast("bigint").alias("pos"), F.sum(1 - c("y")).cast("bigint").alias("neg"))

    def running(df, by, order):
        up = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        down = W.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, -1)
        n = lambda x, w: F.coalesce(F.sum(x).over(w), F.lit(0))
        return df.withColumns({"_below": n(c("neg"), up), "_tp": n(c("pos"), down), "_all": n(c("pos") + c("neg"), down)})

    ranges = running(hist.groupBy(*keys, "b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), keys, "b").select(
        *keys, "b", c("_below").alias("r_below"), c("_tp").alias("r_tp"), c("_all").alias("r_all"))
    hist = running(hist, [*keys, "b"], "p").join(ranges, [*keys, "b"]).withColumns({
        "_below": c("_below") + c("r_below"), "_tp": c("_tp") + c("r_tp") + c("pos"), "_all": c("_all") + c("r_all") + c("pos") + c("neg")})
    rank = hist.groupBy(*keys).agg(
        ratio(F.sum(c("pos") * (2 * c("_below") + c("neg"))), 2 * F.sum("pos") * F.sum("neg")).alias("roc_auc"),
        (fsum(c("pos") * c("_tp") / c("_all")) / F.sum("pos")).alias("average_precision"))
    return base.join(ece, keys).join(rank, keys).withColumn("over_expected", c("positives") - c("expected"))


def calibration_buckets(rows: DataFrame, target: str, prediction: str, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(c(prediction) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bucket")).agg(
        F.count("*").alias("rows"), (fsum(c(prediction)) / F.count("*")).alias("predicted"), ratio(F.sum(c(target)), F.count("*")).alias("actual"))


def group_over_expected(rows: DataFrame, target: str, prediction: str, columns) -> DataFrame:
    """Attempts, successes and expectation per value of each column, long form."""
    long = rows.select(c(target).alias("y"), c(prediction).alias("q"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("column"), c(n).cast("string").alias("value")) for n in columns])).alias("g"))
    return long.groupBy("g.column", "g.value").agg(F.count("*").alias("attempts"), F.sum("y").alias("successes"), fsum(c("q")).alias("expected")).withColumn(
        "over_expected", c("successes") - c("expected"))


def player_over_expected(rows: DataFrame, target: str, prediction: str, minimum: int, top: int = 25) -> DataFrame:
    """Best and worst players by successes over expectation per hundred attempts."""
    g = rows.groupBy("playerName").agg(F.count("*").alias("attempts"), F.sum(target).alias("successes"), fsum(c(prediction)).alias("expected")).where(c("attempts") >= minimum)
    g = g.withColumn("over_expected", c("successes") - c("expected")).withColumn("per_100", c("over_expected") * 100.0 / c("attempts"))
    best = g.orderBy(F.desc("per_100"), "playerName").limit(top).withColumn("side", F.lit("top"))
    worst = g.orderBy("per_100", "playerName").limit(top).withColumn("side", F.lit("bottom"))
    return best.unionByName(worst)


def extreme_examples(rows: DataFrame, target: str, prediction: str, top: int = 30) -> DataFrame:
    """Least likely successes and most likely failures."""
    hard = rows.where(c(target) == 1).orderBy(c(prediction), "eventId").limit(top).withColumn("kind", F.lit("hardest_success"))
    easy = rows.where(c(target) == 0).orderBy(F.desc(prediction), "eventId").limit(top).withColumn("kind", F.lit("easiest_failure"))
    return hard.unionByName(easy)


def first_prediction(predictions: DataFrame, value: str, order: str) -> DataFrame:
    """Keep the first prediction of each (match, team, event)."""
    return predictions.groupBy("matchId", "teamId", "eventId").agg(F.min_by(value, order).alias(value))


def write_back(events: DataFrame, predictions: DataFrame, value: str, version_col: str, version: str, order: str = "seq", force: bool = False) -> DataFrame:
    """Put predictions on event rows; rows already scored by this version stay unless forced."""
    new = first_prediction(predictions, value, order).withColumnRenamed(value, "_new")
    out = events.join(new, ["matchId", "teamId", "eventId"], "left")
    old = c(version_col) if version_col in events.columns else F.lit(None).cast("string")
    take = c("_new").isNotNull() & (F.lit(force) | ~F.coalesce(old == version, F.lit(False)))
    return out.withColumn(value, F.when(take, c("_new")).otherwise(c(value))).withColumn(version_col, F.when(take, version).otherwise(old)).drop("_new")


def compare_predictions(old: DataFrame, predictions: DataFrame, value: str, target, keys, order: str = "seq") -> DataFrame:
    """Old against new totals, missing counts and changed rows per group."""
    new = first_prediction(predictions, value, order).withColumnRenamed(value, "_new")
    m = old.join(new, ["matchId", "teamId", "eventId"], "left")
    o, n = F.coalesce(c(value), F.lit(0.0)), F.coalesce(c("_new"), F.lit(0.0))
    return m.groupBy(*keys).agg(
        F.count("*").alias("rows"), n_if(target).alias("positives"), fsum(o).alias("old_total"), fsum(n).alias("new_total"), fsum(n - o).alias("delta"),
        n_if(c(value).isNull()).alias("old_missing"), n_if(c("_new").isNull()).alias("new_missing"), n_if(F.abs(n - o) > 1e-9).alias("changed_rows")).withColumn(
        "above_expected", c("positives") - c("new_total"))


def backfill_report(per_match: DataFrame, matches: DataFrame) -> DataFrame:
    """Per-league sums of a comparison by match."""
    m = matches.select("matchId", "league").distinct()
    return per_match.join(m, "matchId").groupBy("league").agg(
        F.count("*").alias("files"), *[F.sum(n).alias(n) for n in ("rows", "new_missing", "changed_rows")], *[fsum(c(n)).alias(n) for n in ("old_total", "new_total", "delta")])


def completeness(events: DataFrame, value: str, version_col: str, eligible, keys=("matchId",)) -> DataFrame:
    """Whether every eligible row of a match carries a value and one version: such matches need no backfill."""
    per = events.groupBy(*keys).agg(
        n_if(eligible).alias("eligible"), n_if(eligible & c(value).isNotNull()).alias("scored"), F.max(F.when(eligible, c(version_col))).alias("version"),
        n_if(eligible & c(version_col).isNull()).alias("unversioned"))
    return per.withColumn("complete", (c("eligible") > 0) & (c("eligible") == c("scored")) & (c("unversioned") == 0))


def training_audit(rows: DataFrame, columns, target: str) -> DataFrame:
    """Counts and target rate per value of each column, with impossible coordinates and duplicate ids as rows."""
    long = rows.select(c(target).alias("y"), F.explode(F.array(*[F.struct(F.lit(n).alias("check"), c(n).cast("string").alias("value")) for n in columns])).alias("g"))
    by = long.groupBy("g.check", "g.value").agg(F.count("*").alias("rows"), F.sum("y").alias("positives"))
    bad = ~(c("x").between(0, 105) & c("y").between(0, 68))
    off = rows.agg(n_if(bad).alias("rows"), F.coalesce(F.sum(F.when(bad, c(target))), F.lit(0)).alias("positives")).select(
        F.lit("impossible_coordinates").alias("check"), F.lit(None).cast("string").alias("value"), "rows", "positives")
    dup = rows.groupBy("matchId", "teamId", "eventId").agg(F.count("*").alias("n"), F.sum(target).alias("y")).where("n > 1").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("y"), F.lit(0)).alias("positives")).select(
        F.lit("duplicate_ids").alias("check"), F.lit(None).cast("string").alias("value"), "rows", "positives")
    return by.unionByName(off).unionByName(dup)


def numeric_summary(rows: DataFrame, columns) -> DataFrame:
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), c(n).cast("double").alias("v")) for n in columns])).alias("g"))
    return long.groupBy("g.column").agg(F.count("g.v").alias("n"), (fsum(c("g.v")) / F.count("g.v")).alias("mean"), F.min("g.v").alias("min"), F.max("g.v").alias("max"))


def apply_shot_rules(scored: DataFrame, raw: str) -> DataFrame:
    """Business rules on a raw shot score: penalties 0.78, own goals 0, else clipped to 0.003-0.95."""
    v = F.greatest(F.lit(0.003), F.least(F.lit(0.95), c(raw)))
    own = c("goalOwn") if "goalOwn" in scored.columns else F.lit(False)
    return scored.withColumn("xG", F.when(own, 0.0).when(c("shot_family") == "penalty", 0.78).otherwise(v))


def apply_xgot_rules(scored: DataFrame, raw: str) -> DataFrame:
    """0 unless on target and not blocked, else clipped to 0.001-0.995."""
    return scored.withColumn("xGOT", F.when(c("xgot_training_eligible"), F.greatest(F.lit(0.001), F.least(F.lit(0.995), c(raw)))).otherwise(0.0))


def apply_pass_rules(scored: DataFrame, raw: str, out: str) -> DataFrame:
    return scored.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), c(raw))))
