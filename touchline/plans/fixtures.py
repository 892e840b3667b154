"""Fixtures: keys, rounds, provider merge, standings, name matching, schedules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from touchline.functions.names import jaccard, name_tokens, normal_name, ratcliff

# Provider states, the file-name pattern, round limits.
STATES = {"FINISHED": "completed", "AWARDED": "completed", "IN_PLAY": "live", "PAUSED": "live", "SCHEDULED": "upcoming", "TIMED": "upcoming",
          "POSTPONED": "postponed", "SUSPENDED": "postponed", "CANCELLED": "cancelled"}
KEY_PATTERN = r"(\d{4}-\d{2}-\d{2})_(\d+)_(\d+)_vs_(\d+)_(.+)\.parquet$"
ROUND_DAYS, ORPHAN_DAYS = 4, 7
PLAIN_WORDS = ["city", "club", "real", "sporting", "united"]


def c(name):
    return F.col(name)


def clean_key(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), r"[^A-Za-z0-9_-]", "_")


def event_key(league, season, date, match_id, home_id, away_id, score) -> Column:
    """Deterministic object key of a match."""
    name = F.concat_ws("_", date.cast("string"), F.regexp_replace(match_id.cast("string"), r"\.0$", ""), home_id.cast("string"), F.lit("vs"), away_id.cast("string"),
                       F.regexp_replace(clean_key(score), "-", "_"))
    return F.concat(F.lit("event_data/"), clean_key(league), F.lit("/"), clean_key(season), F.lit("/"), name, F.lit(".parquet"))


def parse_key(key: Column) -> list:
    """Date, ids and score out of a key; all NULL when the name does not fit."""
    part = lambda i: F.nullif(F.regexp_extract(key, KEY_PATTERN, i), F.lit(""))
    return [F.to_date(part(1)).alias("start_date"), part(2).alias("match_id"), part(3).cast("bigint").alias("home_team_id"), part(4).cast("bigint").alias("away_team_id"),
            F.regexp_replace(part(5), "_+", "-").alias("score"), F.regexp_extract(key, r"event_data/([^/]+)/([^/]+)/", 1).alias("league"),
            F.regexp_extract(key, r"event_data/([^/]+)/([^/]+)/", 2).alias("season")]


def fixture_catalogue(files: DataFrame, path: str = "path") -> DataFrame:
    return files.select(c(path), *parse_key(c(path))).where(c("match_id").isNotNull())


def page(df: DataFrame, order, offset: int, limit: int) -> DataFrame:
    """One page in a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def season_key(d: Column) -> Column:
    """Seasons start in June: 2024_2025."""
    y = F.when(F.month(d) >= 6, F.year(d)).otherwise(F.year(d) - 1)
    return F.concat_ws("_", y.cast("string"), (y + 1).cast("string"))


def provider_state(status: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in STATES.items() for v in pair])
    return F.coalesce(F.try_element_at(table, F.upper(status)), F.lit("unknown"))


def score_label(home: Column, away: Column) -> Column:
    return F.when(home.isNull() | away.isNull(), "").otherwise(F.concat_ws("-", home.cast("string"), away.cast("string")))


def infer_rounds(fixtures: DataFrame, merge_orphans: bool = False) -> DataFrame:
    """Round number per fixture: a new round starts after four days or when a team plays again. With ``merge_orphans`` a
    round of one match close behind the one before joins it.

    The fold sees one league season, whose fixture list is fixed by the format, and keeps the starts of rounds only.
    """
    keys = ["league", "season"]
    listed = fixtures.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", "match_id", "home_team", "away_team"))).alias("list"))
    starts = listed.selectExpr(*keys, "list", f"""aggregate(transform(list, (f, i) -> named_struct('i', i, 'date', f.date, 'pair', array(f.home_team, f.away_team))),
      named_struct('since', cast(null as date), 'teams', cast(array() as array<string>), 'starts', cast(array() as array<int>)),
      (a, f) -> if(a.since is null or datediff(f.date, a.since) > {ROUND_DAYS} or arrays_overlap(a.teams, f.pair),
        named_struct('since', f.date, 'teams', f.pair, 'starts', array_append(a.starts, f.i)),
        named_struct('since', a.since, 'teams', array_union(a.teams, f.pair), 'starts', a.starts)),
      a -> a.starts) as starts""")
    groups = starts.selectExpr(*keys, "size(list) as n", "list", "posexplode(starts) as (round, first)", "starts").selectExpr(
        *keys, "round", "slice(list, first + 1, coalesce(try_element_at(starts, round + 2), n) - first) as part")
    if merge_orphans:
        w = W.partitionBy(*keys).orderBy("round")  # one row per round
        alone = (F.size("part") == 1) & (F.datediff(c("part")[0]["date"], F.lag(F.element_at("part", -1)["date"]).over(w)) <= ORPHAN_DAYS)
        groups = groups.withColumn("new", F.when(alone, 0).otherwise(1)).withColumn("round", F.sum("new").over(w).cast("int"))
    else:
        groups = groups.withColumn("round", c("round") + 1)
    return groups.select(*keys, "round", F.explode("part").alias("f")).select(*keys, c("f.match_id").alias("match_id"), "round")


def round_summary(fixtures: DataFrame, rounds: DataFrame) -> DataFrame:
    return fixtures.join(rounds, ["league", "season", "match_id"]).groupBy("league", "season", "round").agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("match_count"))


def manifest_rounds(fixtures: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rounds named by a manifest (league, season, round, match_id), for the seasons it covers fully and
    without naming a match twice; other seasons get nothing and fall back to inference."""
    keys = ["league", "season"]
    hit = manifest.join(fixtures.select(*keys, "match_id"), keys + ["match_id"], "left_semi")
    want = fixtures.groupBy(*keys).agg(F.count_distinct("match_id").alias("want"))
    got = hit.groupBy(*keys).agg(F.count("*").alias("got"), F.count_distinct("match_id").alias("uniq"))
    good = want.join(got, keys).where((c("want") == c("got")) & (c("got") == c("uniq"))).select(*keys)
    return hit.join(good, keys, "left_semi")


def hub_counts(fixtures: DataFrame) -> DataFrame:
    return fixtures.groupBy("league", "season", "state").agg(F.count("*").alias("fixtures"))


def merge_provider(completed: DataFrame, provider: DataFrame, near_days: int = 0) -> DataFrame:
    """Completed matches with provider fields, and the provider fixtures nobody matches.

    Same date and teams first; with ``near_days`` also the nearest date within that many days. The date
    is spread over its neighbours, so the join stays an equi-join.
    """
    key = [F.lower("home_team").alias("h"), F.lower("away_team").alias("a")]
    left = completed.select("league", "season", "match_id", "date", *key)
    shift = F.explode(F.sequence(F.lit(-near_days), F.lit(near_days)))
    right = provider.select("league", "season", "fixture_id", c("date").alias("p_date"), "matchday", "status", *key, shift.alias("_d")).withColumn("date", F.date_add("p_date", c("_d")))
    hit = right.join(left, ["league", "season", "date", "h", "a"])
    # One provider fixture takes its nearest match; one match keeps its nearest fixture.
    best = hit.groupBy("league", "season", "fixture_id").agg(F.min_by(F.struct("match_id", "matchday", "status", c("_d")), F.struct(F.abs("_d"), "match_id")).alias("b"))
    per = best.groupBy("league", "season", c("b.match_id").alias("match_id")).agg(F.min_by(F.struct("fixture_id", "b.matchday", "b.status"), F.struct(F.abs(c("b._d")), "fixture_id")).alias("p"))
    done = completed.join(per, ["league", "season", "match_id"], "left").select(
        "league", "season", "match_id", "date", "home_team", "away_team", c("p.fixture_id").alias("fixture_id"), c("p.matchday").alias("matchday"), F.lit("completed").alias("state"))
    rest = provider.join(best.select("league", "season", "fixture_id"), ["league", "season", "fixture_id"], "left_anti").select(
        "league", "season", F.lit(None).cast("string").alias("match_id"), "date", "home_team", "away_team", "fixture_id", "matchday", provider_state(c("status")).alias("state"))
    return done.unionByName(rest)


def match_names(wanted: DataFrame, known: DataFrame, keys=(), minimum: float = 0.78) -> DataFrame:
    """Best known name for each wanted name: exact, else by token overlap, sequence similarity or subset.

    Candidates share a key group and a word or two letters in a row. That loses nothing at a limit of 0.78: if M letters
    match and no two stand side by side in both names, M - 1 or more letters do not match, so 2M / (3M - 1) >= 0.78 and
    M <= 2; names that short share a letter. The two sides are competition-sized name lists.
    """
    keys = list(keys)
    def side(df, col, p):
        t = df.select(*keys, c(col).alias(p)).distinct()
        t = t.withColumn(f"{p}_n", normal_name(c(p))).withColumn(f"{p}_t", name_tokens(c(p), ("1", "afc", "cf", "fc")))
        n = F.length(f"{p}_n")
        pieces = lambda width: F.when(n >= width, F.transform(F.sequence(F.lit(1), F.greatest(n - (width - 1), F.lit(1))), lambda i: F.substr(c(f"{p}_n"), i, F.lit(width)))).otherwise(F.array())
        return t.withColumn("_b", F.explode(F.array_distinct(F.concat(c(f"{p}_t"), pieces(2), F.when(n <= 4, pieces(1)).otherwise(F.array())))))
    pairs = side(wanted, "name", "w").join(side(known, "name", "k"), keys + ["_b"]).drop("_b").distinct()
    small, large = F.when(F.size("w_t") <= F.size("k_t"), c("w_t")).otherwise(c("k_t")), F.when(F.size("w_t") <= F.size("k_t"), c("k_t")).otherwise(c("w_t"))
    inside = (F.size(F.array_except(small, large)) == 0) & (F.size(F.array_except(small, F.array(*map(F.lit, PLAIN_WORDS)))) > 0)
    score = F.greatest(jaccard(c("w_t"), c("k_t")), ratcliff(c("w_n"), c("k_n")), F.when(inside, 0.9).otherwise(0.0))
    pairs = pairs.withColumn("score", F.when(c("w_n") == c("k_n"), 2.0).otherwise(score)).where(c("score") >= minimum)
    return pairs.groupBy(*keys, c("w").alias("name")).agg(F.max_by(F.struct(c("k").alias("known"), c("score").alias("score")), F.struct("score", "k")).alias("b")).select(
        *keys, "name", c("b.known").alias("known"), F.least(c("b.score"), F.lit(1.0)).alias("score"))


def name_similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Larger of the similarity of the normal names and of their sorted words."""
    sort = lambda x: F.array_join(F.array_sort(F.split(x, " ")), " ")
    na, nb = normal_name(c(a)), normal_name(c(b))
    return pairs.withColumn("similarity", F.greatest(ratcliff(na, nb), ratcliff(sort(na), sort(nb))))


RESOLVE_SCHEMA = "league string, season string, fixture_id string, match_id string, problem string"


def _assign(pdf: pd.DataFrame, margin: float) -> pd.DataFrame:
    """Greedy assignment of one league season: fixtures in time order, each provider match used once."""
    used, out = set(), []
    for (kick, fid), g in pdf.groupby(["date", "fixture_id"], sort=True):
        free = g[g["match_id"].notna() & ~g["match_id"].isin(used)].sort_values(["score", "match_id"], ascending=[False, True])
        r0 = g.iloc[0]
        if free.empty:
            out.append((r0.league, r0.season, fid, None, "no match"))
        elif len(free) > 1 and free["score"].iloc[0] - free["score"].iloc[1] < margin:
            out.append((r0.league, r0.season, fid, None, "ambiguous"))
        else:
            used.add(free["match_id"].iloc[0])
            out.append((r0.league, r0.season, fid, free["match_id"].iloc[0], None))
    return pd.DataFrame(out, columns=["league", "season", "fixture_id", "match_id", "problem"])


def resolve_fixtures(fixtures: DataFrame, matches: DataFrame, minimum: float = 0.72, margin: float = 0.04, bonus: float = 0.08) -> DataFrame:
    """Provider match of each fixture: dates at most a day apart, both names similar, clear winner.

    Only pairs of neighbouring dates are compared; the greedy step sees one league season's candidates.
    """
    keys = ["league", "season"]
    right = matches.select(*keys, "match_id", c("date").alias("m_date"), c("home_team").alias("mh"), c("away_team").alias("ma"), F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias("_d"))
    right = right.withColumn("date", F.date_add("m_date", c("_d")))
    pair = fixtures.join(right, keys + ["date"])
    sort = lambda x: F.array_join(F.array_sort(F.split(x, " ")), " ")
    def sim(a, b):
        na, nb = normal_name(c(a)), normal_name(c(b))
        return F.greatest(ratcliff(na, nb), ratcliff(sort(na), sort(nb)))
    pair = pair.withColumns({"_h": sim("home_team", "mh"), "_a": sim("away_team", "ma")}).where(F.least("_h", "_a") >= minimum)
    pair = pair.withColumn("score", (c("_h") + c("_a")) / 2.0 + F.when(c("_d") == 0, bonus).otherwise(0.0))
    rows = fixtures.select(*keys, "fixture_id", "date").join(pair.select(*keys, "fixture_id", "match_id", "score"), keys + ["fixture_id"], "left")
    return rows.groupBy(*keys).applyInPandas(lambda p: _assign(p, margin), RESOLVE_SCHEMA)


def schedule_groups(fixtures: DataFrame, delay_minutes: int = 180, window: int = 30, buffer: int = 5) -> DataFrame:
    """Ingestion groups: fixtures due within 30 minutes of the first one of the group.

    The window starts at the group's first fixture and does not chain; it is a fold over the sorted due
    times of one league season.
    """
    due = fixtures.where(c("state").isin("upcoming", "live", "completed")).withColumn("due", (F.unix_timestamp("kickoff") / 60).cast("bigint") + delay_minutes)
    arr = due.groupBy("league", "season").agg(F.array_sort(F.collect_list(F.struct("due", "fixture_id"))).alias("xs"))
    fold = f"""aggregate(xs, struct(cast(array() as array<struct<due:bigint,fixture_id:string,g:int>>) as done, cast(null as bigint) as first, 0 as g),
      (a, x) -> if(a.first is null or x.due - a.first > {window},
        struct(array_append(a.done, struct(x.due as due, x.fixture_id as fixture_id, a.g + 1 as g)) as done, x.due as first, a.g + 1 as g),
        struct(array_append(a.done, struct(x.due as due, x.fixture_id as fixture_id, a.g as g)) as done, a.first as first, a.g as g)), a -> a.done)"""
    rows = arr.selectExpr("league", "season", f"inline({fold})")
    return rows.groupBy("league", "season", c("g").alias("group_no")).agg(F.count("*").alias("fixtures"), F.min("due").alias("first_due"), (F.max("due") + buffer).alias("run_at"))


def standings_payload(official: DataFrame, local: DataFrame) -> DataFrame:
    """Official rows with local xG where names match; seasons without them get the calculated table."""
    keys = ["league", "season"]
    names = match_names(official.select(*keys, c("provider_name").alias("name")), local.select(*keys, c("teamName").alias("name")), keys)
    off = (official.join(names.select(*keys, c("name").alias("provider_name"), c("known").alias("teamName")), keys + ["provider_name"], "left")
           .join(local.select(*keys, "teamName", "xg", "xga"), keys + ["teamName"], "left")
           .select(*keys, F.coalesce("teamName", "provider_name").alias("team"), "position", "points", "xg", "xga", F.lit(True).alias("is_official")))
    calc = local.join(official.select(*keys).distinct(), keys, "left_anti").select(
        *keys, c("teamName").alias("team"), "position", c("pts").alias("points"), "xg", "xga", F.lit(False).alias("is_official"))
    return off.unionByName(calc)


