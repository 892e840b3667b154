"""Match against season: leave-one-out baselines, strict-below percentiles, player history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from touchline.functions.core import fixed, fsum, ratio

# Metrics where less is better, and sample gates.
LOWER_IS_BETTER = ["ppda", "turnovers", "xG_against", "shots_against", "big_chances_against", "goals_against", "fouls_committed", "dribbled_past"]
TEAM_METRICS = ["goals", "xG", "shots", "shots_on_target", "possession_pct", "pass_accuracy", "big_chances", "ppda", "turnovers", "crosses",
                "dribbles_won", "xGOT"]
PLAYER_METRICS = ["goals", "shots", "key_passes", "xA", "xG", "prog_passes", "tackles", "interceptions", "recoveries", "dribbles_won",
                  "aerial_duels_won", "touches", "passes_completed", "duels_won", "def_actions_total"]
HISTORY_METRICS = ["goals", "xG", "xA", "key_passes", "prog_passes", "xT", "tackles", "interceptions", "dribbles_won", "aerial_duels_won"]
TEAM_MATCHES_MIN, PLAYER_MINUTES_MIN, HISTORY_MINUTES_MIN = 4, 450, 300


def c(name):
    return F.col(name)


def long_form(rows: DataFrame, keys, metrics) -> DataFrame:
    return rows.select(*keys, *[c(m).cast("double").alias(m) for m in metrics]).unpivot(list(keys), list(metrics), "metric", "value").where(
        c("value").isNotNull())


def share_below(values: DataFrame, probes: DataFrame, keys, out: str) -> DataFrame:
    """For each probe the share (0-100) of values of its key group strictly below it.

    Values and probes are stacked and sorted together, probes first on ties, so the running count of
    values is the answer: one sort per group, no pairs.
    """
    keys = list(keys)
    w = W.partitionBy(*keys).orderBy("_v", "_k").rowsBetween(W.unboundedPreceding, 0)
    # The probe's other columns travel in the sorted rows, so nothing is joined back.
    cols = [n_ for n_ in probes.columns if n_ not in keys]
    packed_a = values.select(*keys, c("value").alias("_v"), F.lit(1).alias("_k"), F.lit(None).alias("_p"))
    packed_b = probes.select(*keys, c("value").alias("_v"), F.lit(0).alias("_k"), F.struct(*cols).alias("_p"))
    both = packed_b.unionByName(packed_a)
    both = both.withColumn("_below", F.sum("_k").over(w)).withColumn("_n", F.sum("_k").over(W.partitionBy(*keys))).where(c("_k") == 0)
    return both.select(*keys, "_p.*", F.when(c("_n") == 0, 50.0).otherwise(c("_below") * 100.0 / c("_n")).alias(out))


def _stats(arr: str) -> dict:
    """SQL text of order statistics over a sorted array of doubles (linear interpolation)."""
    def q(p):
        pos = f"((size({arr}) - 1) * {p}D)"
        lo, hi = f"cast(floor({pos}) as int)", f"cast(ceil({pos}) as int)"
        return f"get({arr}, {lo}) + (get({arr}, {hi}) - get({arr}, {lo})) * ({pos} - floor({pos}))"
    total = f"aggregate({arr}, 0L, (a, v) -> a + cast(floor(v * 1e6D + 0.5D) as bigint))"
    mean = f"(cast({total} as double) / 1e6D / size({arr}))"
    var = f"aggregate({arr}, 0D, (a, v) -> a + (v - {mean}) * (v - {mean}))"
    return {"n": f"size({arr})", "mean": mean, "median": q(0.5), "p25": q(0.25), "p75": q(0.75), "min": f"get({arr}, 0)",
            "max": f"get({arr}, size({arr}) - 1)", "std": f"sqrt({var} / size({arr}))"}


def team_baseline(team_rows: DataFrame, metrics=None, minimum: int = TEAM_MATCHES_MIN) -> DataFrame:
    """Each match value of a team against the rest of its season, one row per metric.

    The rest means every other match of that team (leave one out): mean, median, quartiles, extremes,
    population z-score, game rank (1 = best), share of own and of league values strictly below, mean of
    the five latest others, and what all teams managed against this opponent. Sides with fewer than
    ``minimum`` other matches are left out, as are opponent pools that small.

    Season lists hold one number per match of one team in one season, so they stay short.
    """
    metrics = metrics or TEAM_METRICS
    keys = ["league", "season", "matchId", "date", "teamName", "opponentName"]
    v = long_form(team_rows, keys, metrics)
    own = v.groupBy("league", "season", "teamName", "metric").agg(F.array_sort(F.collect_list(F.struct("date", "matchId", "value"))).alias("_own"))
    vs = v.groupBy("league", "season", c("opponentName"), "metric").agg(F.collect_list(F.struct("matchId", "value")).alias("_vs"))
    season = W.partitionBy("league", "season", "metric")
    low = c("metric").isin(LOWER_IS_BETTER)
    by_value = season.orderBy("value")
    v = v.withColumns({
        "_below_all": F.rank().over(by_value) - 1, "_n_all": F.count("*").over(season),
        "_rank_up": F.rank().over(W.partitionBy("league", "season", "teamName", "metric").orderBy(F.desc("value"))),
        "_rank_down": F.rank().over(W.partitionBy("league", "season", "teamName", "metric").orderBy("value")),
        "_other": F.sum("value").over(W.partitionBy("matchId", "metric")), "_lowest": F.min("value").over(W.partitionBy("matchId", "metric"))})
    v = v.join(own, ["league", "season", "teamName", "metric"]).join(vs, ["league", "season", "opponentName", "metric"])
    v = v.selectExpr("*", "array_sort(transform(filter(_own, s -> s.matchId <> matchId), s -> s.value)) as o",
                     "slice(reverse(filter(_own, s -> s.matchId <> matchId)), 1, 5) as _last",
                     "array_sort(transform(filter(_vs, s -> s.matchId <> matchId), s -> s.value)) as p").drop("_own", "_vs")
    v = v.where(F.size("o") >= minimum)
    s, ps = _stats("o"), _stats("p")
    v = v.selectExpr("*", *[f"{e} as {n}" for n, e in s.items()], *[f"if(size(p) >= {minimum}, {ps[n]}, null) as vs_opponent_{n}" for n in ("n", "mean", "median", "p25", "p75", "min", "max")],
                     "cast(aggregate(_last, 0L, (a, q) -> a + cast(floor(q.value * 1e6D + 0.5D) as bigint)) as double) / 1e6D / size(_last) as last5_mean")
    below_own = (c("_rank_down") - 1) * 100.0 / c("n")
    # The league pool leaves this match out: take its other side off the count and off the total.
    below_league = (c("_below_all") - (c("_lowest") < c("value")).cast("int")) * 100.0 / F.nullif(c("_n_all") - 2, F.lit(0))
    flip = lambda x: F.when(low, 100.0 - x).otherwise(x)
    return v.select(*keys, "metric", "value", "n", "mean", "median", "p25", "p75", "min", "max", (c("value") - c("mean")).alias("delta"),
                    F.when(c("std") > 1e-9, (c("value") - c("mean")) / c("std")).otherwise(0.0).alias("z_score"),
                    F.when(low, c("_rank_down")).otherwise(c("_rank_up")).alias("game_rank"), flip(below_own).alias("own_percentile"),
                    flip(below_league).alias("league_percentile"), "last5_mean", *[f"vs_opponent_{n}" for n in ("n", "mean", "median", "p25", "p75", "min", "max")])


def player_baseline(player_rows: DataFrame, metrics=None) -> DataFrame:
    """Each match value of a player against the rest of their season, totals and per 90 minutes."""
    metrics = metrics or PLAYER_METRICS
    keys = ["league", "season", "matchId", "playerName", "mins_played"]
    v = long_form(player_rows, keys, metrics)
    # One row per match of one player season reaches these windows.
    p = W.partitionBy("league", "season", "playerName", "metric")
    micro = fixed(c("value"))
    v = v.withColumns({"_n": F.count("*").over(p) - 1, "_s": F.sum(micro).over(p) - micro, "_m": F.sum("mins_played").over(p) - c("mins_played"),
                       "game_rank": F.rank().over(p.orderBy(F.desc("value")))}).where(c("_n") >= 1)
    total = c("_s").cast("double") / 1e6
    return v.select(*keys[:-1], "metric", "value", c("_n").alias("n"), (total / c("_n")).alias("mean"), "game_rank",
                    ratio(total, F.greatest(F.lit(1), c("_m")), 90.0).alias("season_per90"), ratio(c("value"), F.greatest(F.lit(1), c("mins_played")), 90.0).alias("match_per90"),
                    (c("_m") < PLAYER_MINUTES_MIN).alias("low_sample"))


def player_history(player_rows: DataFrame, minutes: int = HISTORY_MINUTES_MIN, metrics=None) -> DataFrame:
    """Season totals, per-90 rates and percentiles among players with enough minutes."""
    metrics = metrics or HISTORY_METRICS
    keys = ["league", "season", "playerName"]
    tot = player_rows.groupBy(*keys).agg(F.count("*").alias("matches"), F.sum("mins_played").alias("minutes"), *[fsum(c(m)).alias(m) for m in metrics])
    tot = tot.where(c("minutes") >= minutes)
    v = long_form(tot, keys + ["matches", "minutes"], metrics).withColumnRenamed("value", "total")
    v = v.withColumn("value", c("total") * 90.0 / c("minutes"))
    out = share_below(v, v, ["league", "season", "metric"], "percentile")
    return out.withColumnRenamed("value", "per90")


def season_delta(baseline: DataFrame, floor: float = 0.5) -> DataFrame:
    """Difference from the season mean in percent, with a floor under small denominators."""
    base = F.greatest(F.abs(c("mean")), F.lit(floor))
    return baseline.select("matchId", "teamName", "metric", "value", "mean", ((c("value") - c("mean")) * 100.0 / base).alias("delta_pct"))
