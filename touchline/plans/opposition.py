"""Opposition scouting: strengths, style distance, comparable matches, dossier sections.

Everything is per league season, whose team count the competition fixes; each step keys on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from touchline.functions import predicates as p
from touchline.functions.core import fixed, fmean, fsum, n_if, ratio, sum_if
from touchline.operators.scan import LastBefore, scan
from touchline.plans.comparison import LOWER_IS_BETTER, long_form, share_below

LS = ["league", "season"]
# Metric sets and score bounds of the report.
REPORT_METRICS = ["xG", "shot_accuracy", "big_chances", "xG_against", "ppda", "pass_accuracy", "crosses", "through_balls", "possession_pct",
                  "big_chances_against", "clearances", "xG_per_shot"]
STYLE = ["possession_pct", "pass_accuracy", "ppda", "field_tilt_pct", "box_entries", "long_balls", "through_balls", "crosses"]
CHANCES = ["shots", "shots_on_target", "xG", "xG_per_shot", "big_chances"]
WEAK_SPOTS = ["xG_against", "shots_against", "big_chances_against", "goals_against"]
PROFILE = STYLE + CHANCES + WEAK_SPOTS
NOT_RATED = ["possession_pct", "long_balls"]


def c(name):
    return F.col(name)


def team_means(team_rows: DataFrame, metrics) -> DataFrame:
    """Long form (league, season, teamName, metric, value = mean over matches)."""
    v = long_form(team_rows, [*LS, "teamName"], metrics)
    return v.groupBy(*LS, "teamName", "metric").agg(fmean(c("value")).alias("value"))


def report_percentiles(team_rows: DataFrame, metrics=None) -> DataFrame:
    """Mean of each team metric with the share of league match values below it; tagged strength (>= 70)
    or weakness (<= 30)."""
    metrics = metrics or REPORT_METRICS
    out = share_below(long_form(team_rows, [*LS, "teamName"], metrics), team_means(team_rows, metrics), [*LS, "metric"], "_p")
    pctl = F.when(c("metric").isin(LOWER_IS_BETTER), 100.0 - c("_p")).otherwise(c("_p"))
    out = out.withColumn("percentile", pctl).drop("_p")
    return out.withColumn("tag", F.when(c("percentile") >= 70, "strength").when(c("percentile") <= 30, "weakness"))


def strengths_and_weaknesses(percentiles: DataFrame, top: int = 6) -> DataFrame:
    rated = percentiles.where(c("tag").isNotNull() & ~c("metric").isin(NOT_RATED))
    order = F.when(c("tag") == "strength", -c("percentile")).otherwise(c("percentile"))
    w = W.partitionBy(*LS, "teamName", "tag").orderBy(order, "metric")
    return rated.withColumn("rank", F.row_number().over(w)).where(c("rank") <= top)


def key_players(player_rows: DataFrame, top: int = 6) -> DataFrame:
    """Players by xG + xA + 0.03 per shot."""
    g = player_rows.groupBy(*LS, "teamName", "playerName").agg(
        F.sum("goals").alias("goals"), fsum(c("xG")).alias("xg"), fsum(c("xA")).alias("xa"), F.sum("shots").alias("shots"), F.sum("mins_played").alias("mins"))
    g = g.withColumn("threat_micro", fixed(c("xg")) + fixed(c("xa")) + c("shots") * 30000)
    w = W.partitionBy(*LS, "teamName").orderBy(F.desc("threat_micro"), F.desc("mins"), "playerName")
    return g.withColumn("rank", F.row_number().over(w)).where(c("rank") <= top)


ROLES = {"finishers": "xG", "creators": "xA", "progressors": "prog_passes", "carriers": "prog_carries"}


def role_rankings(player_rows: DataFrame, top: int = 5) -> DataFrame:
    g = player_rows.groupBy(*LS, "teamName", "playerName").agg(
        F.sum("mins_played").alias("mins"), *[F.sum(fixed(c(m).cast("double"))).alias(m) for m in ROLES.values()])
    v = g.unpivot([*LS, "teamName", "playerName", "mins"], list(ROLES.values()), "metric", "micro")
    w = W.partitionBy(*LS, "teamName", "metric").orderBy(F.desc("micro"), F.desc("mins"), "playerName")
    role = F.create_map(*[F.lit(x) for r, m in ROLES.items() for x in (m, r)])
    return v.withColumn("rank", F.row_number().over(w)).where(c("rank") <= top).withColumn("role", role[c("metric")]).drop("metric")


def result(a: Column, b: Column) -> Column:
    return F.when(a > b, "W").when(a == b, "D").otherwise("L")


def recent_form(team_rows: DataFrame, window: int = 5) -> DataFrame:
    """Record and averages over the latest matches of each team season."""
    w = W.partitionBy(*LS, "teamName").orderBy(F.desc("date"), F.desc("matchId"))
    last = team_rows.withColumn("_n", F.row_number().over(w)).where(c("_n") <= window).withColumn("_r", result(c("goals"), c("goals_against")))
    return last.groupBy(*LS, "teamName").agg(
        *[n_if(c("_r") == r).alias(n) for r, n in (("W", "wins"), ("D", "draws"), ("L", "losses"))],
        *[fmean(c(m).cast("double")).alias(f"avg_{m}") for m in ("goals", "goals_against", "xG", "xG_against", "shots", "shots_against")])


def home_away_split(team_rows: DataFrame) -> DataFrame:
    r = result(c("goals"), c("goals_against"))
    return team_rows.groupBy(*LS, "teamName", "homeAway").agg(
        F.count("*").alias("matches"), *[n_if(r == x).alias(n) for x, n in (("W", "wins"), ("D", "draws"), ("L", "losses"))],
        *[fmean(c(m).cast("double")).alias(f"avg_{m}") for m in ("goals", "goals_against", "xG", "xG_against", "shots", "shots_against", "possession_pct", "ppda")])


def style_profiles(team_rows: DataFrame) -> DataFrame:
    return team_means(team_rows, PROFILE).withColumnRenamed("value", "mean")


def style_distance(team_rows: DataFrame) -> DataFrame:
    """Distance of every team's profile to every other team of its season, features z-scored (sample
    deviation, 0 counts as 1). A season has as many teams as its competition admits."""
    v = team_means(team_rows, PROFILE)
    s = W.partitionBy(*LS, "metric")
    sd = F.stddev_samp("value").over(s)
    z = v.withColumn("z", (c("value") - F.avg("value").over(s)) / F.when(F.coalesce(sd, F.lit(0.0)) == 0, 1.0).otherwise(sd))
    packed = z.groupBy(*LS, "teamName").agg(F.array_sort(F.collect_list(F.struct("metric", "z"))).alias("p"))
    ref = packed.select(*LS, c("teamName").alias("reference"), c("p").alias("q"))
    pair = packed.join(ref, LS).where(c("teamName") != c("reference"))
    d = F.sqrt(F.aggregate(F.zip_with("p", "q", lambda a, b: (a["z"] - b["z"]) * (a["z"] - b["z"])), F.lit(0.0), lambda a, x: a + x))
    out = pair.select(*LS, "reference", "teamName", F.round(d, 4).alias("distance"))
    w = W.partitionBy(*LS, "reference").orderBy("distance", "teamName")
    return out.withColumn("similarity", F.round(100.0 / (1.0 + c("distance")), 1)).withColumn("rank", F.row_number().over(w))


def comparable_matches(team_rows: DataFrame, sample: int = 5, peers: int = 8) -> DataFrame:
    """For each (opponent, reference): the opponent's latest matches against the reference and its nearest
    peers; missing places are filled with its latest other matches."""
    dist = style_distance(team_rows).select(*LS, "reference", c("teamName").alias("peer"), "rank")
    # Peers are ranked without the scouted opponent itself.
    pairs = dist.select(*LS, "reference", c("peer").alias("opponent"), c("rank").alias("_own"))
    near = pairs.join(dist, LS + ["reference"]).where(c("peer") != c("opponent"))
    near = near.where(c("rank") - (c("rank") > c("_own")).cast("int") <= peers).select(*LS, "reference", "opponent", c("peer").alias("opponentName"), F.lit(True).alias("_near"))
    itself = pairs.select(*LS, "reference", "opponent", c("reference").alias("opponentName"), F.lit(True).alias("_near"))
    games = team_rows.select(*LS, c("teamName").alias("opponent"), "opponentName", "matchId", "date", "homeAway", "goals", "goals_against", "xG", "xG_against")
    rows = pairs.join(games, LS + ["opponent"]).join(near.unionByName(itself), LS + ["reference", "opponent", "opponentName"], "left")
    k = W.partitionBy(*LS, "reference", "opponent")
    near_col = F.coalesce(c("_near"), F.lit(False))
    rows = rows.withColumn("similar", near_col).withColumn("_n", F.row_number().over(k.orderBy(F.desc("similar"), F.desc("date"), F.desc("matchId"))))
    rows = rows.where(c("_n") <= sample)
    return rows.select(*LS, "reference", "opponent", "matchId", "date", "opponentName", "homeAway", result(c("goals"), c("goals_against")).alias("result"), "xG", "xG_against",
                       F.when(c("similar"), "similar_opponent").otherwise("recent_fallback").alias("sample_reason"), c("_n").cast("int").alias("place"))


def analysis_pool(team_rows: DataFrame, minimum: int = 4) -> DataFrame:
    """Rows each team is judged on: its season plus the one before once it has enough matches, else the
    season before if there is one, else the season so far. Seasons are numbered years."""
    n = team_rows.groupBy(*LS, "teamName").agg(F.count("*").alias("n"))
    seasons = team_rows.select("league", c("season").alias("pool_season")).distinct()
    prev = (c("season").cast("int") - 1).cast("string")
    has_prev = n.withColumn("pool_season", prev).join(seasons, ["league", "pool_season"], "left_semi").select(*LS, "teamName", F.lit(True).alias("_prev"))
    rule = n.join(has_prev, LS + ["teamName"], "left").withColumn("_prev", F.coalesce("_prev", F.lit(False)))
    strategy = F.when(c("n") >= minimum, "current_plus_previous").when(c("_prev"), "previous_season").otherwise("current_season")
    pools = F.when(c("n") >= minimum, F.when(c("_prev"), F.array(c("season"), prev)).otherwise(F.array(c("season")))).when(c("_prev"), F.array(prev)).otherwise(F.array(c("season")))
    rule = rule.select("league", "season", "teamName", strategy.alias("strategy"), F.explode(pools).alias("pool_season"))
    size = team_rows.groupBy("league", c("season").alias("pool_season")).agg(F.count("*").alias("pool_rows"))
    return rule.join(size, ["league", "pool_season"])


def event_situation() -> Column:
    text = F.lower(F.concat_ws(" ", "situation", F.concat_ws(" ", "qualifiers")))
    return (F.when(text.rlike("corner|free ?kick|set ?piece|throw ?in"), "set_piece").when(text.rlike("counter|fast ?break"), "transition")
            .when(text.contains("longball"), "direct").otherwise("open_play"))


def build_up_action() -> Column:
    d = F.coalesce("endX", F.lit(0.0)) - c("x")
    return p.kind("Pass", "Carry") & p.success_word() & (c("x") < 70) & d.between(-8, 18)


def direct_action() -> Column:
    d = F.coalesce("endX", F.lit(0.0)) - c("x")
    return p.kind("Pass", "Carry") & p.success_word() & ((d >= 28) | ((c("endX") >= 88.5) & (d >= 18)))


def dossier_lane(y: Column) -> Column:
    return F.when(y < 22.67, "left").when(y > 45.33, "right").otherwise("central")


def pitch_profile(events: DataFrame) -> DataFrame:
    """Event rows of the dossier by kind: progressive, box entry, build-up, direct, shot, chance source.

    One pass; an event of several kinds gives several rows. A chance source is the team's event right
    before a shot. Needs score state columns.
    """
    own = F.struct("eventId", "type", "playerName", "x", "y", "endX", "endY", "situation", "qualifiers", "xA", "team_goal_diff_before")
    ev = scan(events, [LastBefore("_h", own, c("h_a") == "h"), LastBefore("_a", own, c("h_a") == "a")])
    ev = ev.withColumn("_src", F.when(p.is_shot(), F.when(c("h_a") == "h", c("_h")).otherwise(c("_a")))).drop("_h", "_a")
    ok = p.kind("Pass", "Carry") & p.success_word()
    entry = ok & (c("x") < p.BOX_X) & p.in_box(F.coalesce("endX", F.lit(-1.0)), F.coalesce("endY", F.lit(-1.0)))
    kinds = F.array_compact(F.array(
        F.when(build_up_action(), "build_up"), F.when(direct_action(), "direct"), F.when(p.progressive_tagged(), "progressive"), F.when(entry, "box_entry"),
        F.when(p.is_shot(), "shot"), F.when(c("_src").isNotNull(), "chance_source")))
    ev = ev.withColumn("kind", F.explode(kinds))
    src = c("kind") == "chance_source"
    pick = lambda n: F.when(src, c(f"_src.{n}")).otherwise(c(n))
    ev = ev.select("league", "season", "matchId", "teamName", "kind", pick("eventId").alias("eventId"), c("eventId").alias("at_event"), pick("type").alias("type"), pick("playerName").alias("player"),
                   pick("x").alias("x"), pick("y").alias("y"), pick("endX").alias("end_x"), pick("endY").alias("end_y"), pick("situation").alias("situation"), pick("qualifiers").alias("qualifiers"),
                   pick("team_goal_diff_before").alias("_d"), F.when(c("kind") == "shot", c("xG")).when(src, c("_src.xA")).alias("value"))
    state = F.when(c("_d") > 0, "leading").when(c("_d") < 0, "trailing").otherwise("level")
    return ev.withColumn("game_state", state).withColumn("event_situation", event_situation()).drop("_d", "situation", "qualifiers")


def channel_shares(profile: DataFrame) -> DataFrame:
    n = profile.where(c("kind").isin("progressive", "box_entry", "shot")).groupBy(*LS, "teamName", "kind", dossier_lane(c("y")).alias("channel")).agg(F.count("*").alias("count"))
    return n.withColumn("pct", ratio(c("count"), F.sum("count").over(W.partitionBy(*LS, "teamName", "kind")), 100.0))


def pitch_bins(profile: DataFrame, nx: int = 6, ny: int = 5) -> DataFrame:
    """Counts and mean movement per pitch cell and kind."""
    bx = F.least(F.lit(nx - 1), F.greatest(F.lit(0), F.floor(c("x") / (105.0 / nx)))).cast("int")
    by = F.least(F.lit(ny - 1), F.greatest(F.lit(0), F.floor(c("y") / (68.0 / ny)))).cast("int")
    return profile.groupBy(*LS, "teamName", "kind", bx.alias("x_bin"), by.alias("y_bin")).agg(
        F.count("*").alias("count"), fmean(c("x")).alias("mean_x"), fmean(c("y")).alias("mean_y"), fmean(c("end_x")).alias("mean_end_x"), fmean(c("end_y")).alias("mean_end_y"))


def game_state_profile(events: DataFrame) -> DataFrame:
    """Shots and xG for and against by score state of the team (sign of the difference before the shot).

    Each shot counts once for the shooter and once against the other side, in the other side's state.
    """
    d = c("team_goal_diff_before")
    state = lambda x: F.when(x > 0, "leading").when(x < 0, "trailing").otherwise("level")
    xg = F.coalesce("xG", F.lit(0.05))
    sides = F.array(F.struct(c("teamName").alias("team"), state(d).alias("state"), F.lit(True).alias("own")),
                    F.struct(c("opponentName").alias("team"), state(-d).alias("state"), F.lit(False).alias("own")))
    s = events.where(p.is_shot()).select(*LS, "matchId", xg.alias("xg"), F.explode(sides).alias("s"))
    per = s.groupBy(*LS, c("s.team").alias("teamName"), c("s.state").alias("state"), "matchId").agg(
        n_if(c("s.own")).alias("f"), n_if(~c("s.own")).alias("a"), sum_if(c("s.own"), c("xg")).alias("xf"), sum_if(~c("s.own"), c("xg")).alias("xa"))
    g = per.groupBy(*LS, "teamName", "state").agg(F.count("*").alias("matches"), F.sum("f").alias("shots"), F.sum("a").alias("shots_against"), fsum(c("xf")).alias("xG"), fsum(c("xa")).alias("xGA"))
    return g.withColumn("xG_per_match", c("xG") / c("matches")).withColumn("xGA_per_match", c("xGA") / c("matches"))


def bounded(v: Column, low: float, high: float, invert: bool = False) -> Column:
    s = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (v - low) / (high - low) * 100.0))
    s = (100.0 - s) if invert else s
    return F.when(v.isNull(), 50.0).otherwise(s)


def possession_identity(team_rows: DataFrame) -> DataFrame:
    """Control, directness, territory and tempo scores (0-100) and the leading label of each team season."""
    m = team_rows.groupBy(*LS, "teamName").agg(*[fmean(c(n).cast("double")).alias(n) for n in (
        "possession_pct", "pass_accuracy", "field_tilt_pct", "box_entries", "long_balls", "possessions", "passes", "prog_passes", "prog_carries")])
    m = m.withColumn("ppp", c("passes") / F.greatest(c("possessions"), F.lit(0.01))).withColumn("prog", c("prog_passes") + c("prog_carries"))
    m = m.withColumn("pp", c("prog") / F.greatest(c("possessions"), F.lit(0.01)))
    ppp, pp = c("ppp"), c("pp")
    third = lambda a, b, d: (a + b + d) / 3.0
    m = (m.withColumn("control", third(bounded(c("possession_pct"), 35, 65), bounded(c("pass_accuracy"), 68, 90), bounded(ppp, 2.5, 6.5)))
         .withColumn("directness", third(bounded(c("long_balls"), 25, 80), bounded(pp, 1.5, 5.0), bounded(ppp, 2.5, 6.5, True)))
         .withColumn("territory", third(bounded(c("field_tilt_pct"), 35, 65), bounded(c("box_entries"), 5, 18), bounded(c("prog"), 160, 420)))
         .withColumn("tempo", third(bounded(c("possessions"), 70, 130), bounded(pp, 1.5, 5.0), bounded(ppp, 2.5, 6.5, True))))
    top = F.greatest("control", "directness", "territory", "tempo")
    label = (F.when(c("control") == top, "Control-first possession").when(c("directness") == top, "Direct forward possession")
             .when(c("territory") == top, "Territory pressure").otherwise("High-tempo possession"))
    return m.select(*LS, "teamName", c("ppp").alias("passes_per_possession"), c("pp").alias("progressive_per_possession"), "control", "directness", "territory", "tempo", label.alias("label"))


def dossier(team_rows: DataFrame, player_rows: DataFrame) -> DataFrame:
    """All dossier sections of every team season as rows (section, item, value), sharing league/season/team."""
    keys = [*LS, "teamName"]
    def part(df, section, item, value):
        return df.select(*keys, F.lit(section).alias("section"), item.alias("item"), value.cast("double").alias("value"))
    pcts = report_percentiles(team_rows)
    sw = strengths_and_weaknesses(pcts)
    ident = possession_identity(team_rows).unpivot(keys, ["control", "directness", "territory", "tempo"], "item", "value")
    form = recent_form(team_rows)
    return (part(pcts, "percentile", c("metric"), c("percentile"))
            .unionByName(part(sw, "rated", F.concat_ws(":", "tag", "metric"), c("rank")))
            .unionByName(part(key_players(player_rows), "key_player", c("playerName"), c("rank")))
            .unionByName(part(ident, "identity", c("item"), c("value")))
            .unionByName(part(form, "form", F.lit("wins"), c("wins"))).unionByName(part(form, "form", F.lit("losses"), c("losses"))))


