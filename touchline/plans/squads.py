"""Squads, transfers, coaches and player names around an opponent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from touchline.functions.names import ascii_fold

LS = ["league", "season"]


def c(name):
    return F.col(name)


def squads(events: DataFrame) -> DataFrame:
    return events.where(c("playerName").isNotNull()).select(*LS, "teamName", "playerName").distinct()


def squad_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """Players who joined and who left between two squads of the same teams."""
    k = ["league", "teamName", "playerName"]
    joined = now.join(before.select(*k).distinct(), k, "left_anti").select(*k, F.lit("in").alias("change"))
    left = before.join(now.select(*k).distinct(), k, "left_anti").select(*k, F.lit("out").alias("change"))
    return joined.unionByName(left)


def moves(events: DataFrame) -> DataFrame:
    """A player's change of team from one match day to the next within a season."""
    per = events.where(c("playerName").isNotNull()).groupBy(*LS, "playerName", "startDate").agg(F.min("teamName").alias("teamName"))
    # One row per match day of one player season.
    w = W.partitionBy(*LS, "playerName").orderBy("startDate")
    out = per.withColumn("from_team", F.lag("teamName").over(w)).where(c("from_team") != c("teamName"))
    return out.select(*LS, "playerName", c("startDate").alias("date"), "from_team", c("teamName").alias("to_team"))


def team_transfers(rows: DataFrame) -> DataFrame:
    """Transfers seen from each team, latest of equal ones, with loans that were superseded and arrivals that
    left again in the same window taken out."""
    keys = [*LS, "playerName"]
    uniq = rows.groupBy(*keys, "type", "from_team", "to_team").agg(F.max("date").alias("date"))
    other = uniq.where(c("type") != "return from loan").groupBy(*keys).agg(F.max("date").alias("_d"))
    uniq = uniq.join(other, keys, "left").where(~((c("type") == "return from loan") & F.coalesce(c("_d") >= c("date"), F.lit(False)))).drop("_d")
    sides = F.array(F.struct(c("to_team").alias("teamName"), F.lit("in").alias("direction")), F.struct(c("from_team").alias("teamName"), F.lit("out").alias("direction")))
    out = uniq.select("*", F.explode(sides).alias("s")).select(*keys, "type", "date", "from_team", "to_team", "s.*")
    sold = out.where(c("direction") == "out").groupBy(*keys, "teamName").agg(F.max("date").alias("_out"))
    out = out.join(sold, [*keys, "teamName"], "left")
    return out.where(~((c("direction") == "in") & F.coalesce(c("_out") >= c("date"), F.lit(False)))).drop("_out")


def season_coaches(stints: DataFrame, seasons: DataFrame) -> DataFrame:
    """The coach of each team season: the overlapping stint that started last.

    Stints and seasons are spread over the years they touch, so the join has keys; a pair counts in its first common year.
    """
    years = lambda a, b: F.explode(F.sequence(F.year(a), F.year(b)))
    ends = seasons.groupBy("league").agg(F.max("season_end").alias("_last"))
    open_end = F.coalesce("end", "_last")
    spread = stints.join(ends, "league").where((c("start") <= open_end) & (F.year("start") <= F.year("_last"))).withColumn("_y", years("start", F.least(open_end, "_last")))
    of = seasons.withColumn("_y", years("season_start", "season_end"))
    hit = spread.join(of, ["league", "_y"]).where(
        (c("start") <= c("season_end")) & (F.coalesce(c("end"), c("season_end")) >= c("season_start")) & (c("_y") == F.greatest(F.year("start"), F.year("season_start"))))
    return hit.groupBy(*LS, "teamName").agg(F.max_by("coach", F.struct("start", "coach")).alias("coach"), F.count("*").alias("stints"))


def coach_changes(coaches: DataFrame) -> DataFrame:
    w = W.partitionBy("league", "teamName").orderBy("season")
    prev = F.lag("coach").over(w)
    return coaches.withColumn("previous_coach", prev).withColumn("status", F.when(prev.isNull(), "unknown").when(prev == c("coach"), "same").otherwise("changed"))


def person_key(x):
    return F.trim(F.regexp_replace(F.lower(ascii_fold(x)), r"[^a-z ]+", " "))


def resolve_people(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Name to known person by stages: same name, flipped words, surname and initial, one word only.

    A stage counts only when it names exactly one person; earlier stages win.
    """
    def stages(df, col):
        words = F.filter(F.split(person_key(c(col)), " +"), lambda w: w != "")
        n = F.size(words)
        last, first = F.try_element_at(words, F.lit(-1)), F.get(words, F.lit(0))
        keys = F.array_compact(F.array(
            F.struct(F.lit(1).alias("stage"), F.array_join(words, " ").alias("k")), F.struct(F.lit(2).alias("stage"), F.array_join(F.array_sort(words), " ").alias("k")),
            F.when(n > 1, F.struct(F.lit(3).alias("stage"), F.concat_ws(" ", F.substring(first, 1, 1), last).alias("k"))), F.when(n == 1, F.struct(F.lit(4).alias("stage"), last.alias("k")))))
        return df.select(c(col), F.explode(keys).alias("s")).select(col, "s.stage", "s.k")
    w, k = stages(wanted, "name"), stages(known, "person")
    one = k.groupBy("stage", "k").agg(F.min("person").alias("person"), F.max("person").alias("_hi")).where(c("person") == c("_hi")).drop("_hi")
    hit = w.join(one, ["stage", "k"])
    return hit.groupBy("name").agg(F.min_by("person", "stage").alias("person"), F.min("stage").alias("stage"))


def repair_team_names(events: DataFrame, teams: DataFrame) -> DataFrame:
    """Missing, "None" and numeric team names replaced by the name of the team id."""
    bad = c("teamName").isNull() | c("teamName").isin("", "None", "nan") | c("teamName").rlike(r"^\d+(\.0)?$")
    names = teams.groupBy("teamId").agg(F.min("name").alias("_n"))
    return events.join(names, "teamId", "left").withColumn("teamName", F.when(bad, F.coalesce("_n", "teamName")).otherwise(c("teamName"))).drop("_n")


def lineup_context(sample: DataFrame, history: DataFrame, fallback: DataFrame) -> DataFrame:
    """Formation of each sampled match from the history table, else from the event-built one."""
    h = history.select("matchId", "teamName", c("formation").alias("_h"))
    f = fallback.select("matchId", "teamName", c("formation").alias("_f"))
    out = sample.join(h, ["matchId", "teamName"], "left").join(f, ["matchId", "teamName"], "left")
    return out.withColumn("formation", F.coalesce("_h", "_f")).withColumn("source", F.when(c("_h").isNotNull(), "history").when(c("_f").isNotNull(), "events").otherwise("none")).drop("_h", "_f")


def team_context(coaches: DataFrame, transfers: DataFrame, squad: DataFrame) -> DataFrame:
    """Coach, squad size and transfer counts of each team season."""
    n = squad.groupBy(*LS, "teamName").agg(F.count("*").alias("squad"))
    t = transfers.groupBy(*LS, "teamName").agg(F.count_if(c("direction") == "in").alias("arrivals"), F.count_if(c("direction") == "out").alias("departures"))
    return n.join(coaches.select(*LS, "teamName", "coach"), [*LS, "teamName"], "left").join(t, [*LS, "teamName"], "left").fillna(0, ["arrivals", "departures"])
