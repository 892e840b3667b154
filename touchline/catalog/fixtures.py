"""Fixtures, rounds, provider merge and standings, derived from the feed's matches."""

from pyspark.sql import functions as F

from touchline.catalog.feed_checks import FEED, FEED4
from touchline.catalog.registry import query
from touchline.catalog.season import TABLE_SQL, team_rows
from touchline.plans import fixtures as x, season
from touchline.plans.match_views import match_context
from touchline.sources.feed import match_feed

MATCH_SQL = """,
mm AS (SELECT league, season, matchId AS match_id, startDate AS date, max(CASE WHEN h_a='h' THEN teamName END) AS home_team, max(CASE WHEN h_a='a' THEN teamName END) AS away_team, CAST(max(CASE WHEN h_a='h' THEN teamId END) AS BIGINT) AS home_id, CAST(max(CASE WHEN h_a='a' THEN teamId END) AS BIGINT) AS away_id,
 count(*) FILTER (WHERE type='Goal' AND (h_a='h') <> goalOwn) AS hg, count(*) FILTER (WHERE type='Goal' AND (h_a='h') = goalOwn) AS ag FROM feed GROUP BY ALL)"""


def matches(spark, sf_dir, teams=20):
    f = match_feed(spark, sf_dir, teams)
    ids = f.groupBy("matchId").agg(F.max(F.when(F.col("h_a") == "h", F.col("teamId"))).cast("bigint").alias("home_id"),
                                   F.max(F.when(F.col("h_a") == "a", F.col("teamId"))).cast("bigint").alias("away_id"))
    return match_context(f).join(ids, "matchId").withColumnsRenamed({"matchId": "match_id", "home_goals": "hg", "away_goals": "ag"})


@query("fixture_keys", "S2 S3 S4 S9 P33 P55", FEED + MATCH_SQL + """
SELECT concat('event_data/League_One/', season, '/', date, '_', match_id, '_', home_id, '_vs_', away_id, '_', hg, '_', ag, '.parquet') AS path, date AS start_date, match_id, home_id AS home_team_id, away_id AS away_team_id, concat(hg, '-', ag) AS score, 'League_One' AS league, season FROM mm""")
def fixture_keys(spark, sf_dir):
    m = matches(spark, sf_dir)
    key = x.event_key(F.col("league"), F.col("season"), F.col("date"), F.col("match_id"), F.col("home_id"), F.col("away_id"), x.score_label(F.col("hg"), F.col("ag")))
    return x.fixture_catalogue(m.select(key.alias("path")))


@query("fixture_page", "S2 T4", FEED + MATCH_SQL + " SELECT match_id, date, home_team FROM mm ORDER BY date DESC, CAST(match_id AS BIGINT) DESC LIMIT 7 OFFSET 3")
def fixture_page(spark, sf_dir):
    m = matches(spark, sf_dir).select("match_id", "date", "home_team")
    return x.page(m, [F.desc("date"), F.desc(F.col("match_id").cast("bigint"))], 3, 7)


ROUND_SQL = MATCH_SQL + """,
od AS (SELECT *, row_number() OVER (PARTITION BY league, season ORDER BY date, match_id) AS n FROM mm),
rd AS (SELECT league, season, match_id, n, 1 AS rnd, date AS st, [home_team, away_team] AS ts, date FROM od WHERE n=1
 UNION ALL SELECT o.league, o.season, o.match_id, o.n, CASE WHEN o.date - r.st > 4 OR list_has_any(r.ts, [o.home_team, o.away_team]) THEN r.rnd+1 ELSE r.rnd END, CASE WHEN o.date - r.st > 4 OR list_has_any(r.ts, [o.home_team, o.away_team]) THEN o.date ELSE r.st END,
  CASE WHEN o.date - r.st > 4 OR list_has_any(r.ts, [o.home_team, o.away_team]) THEN [o.home_team, o.away_team] ELSE list_concat(r.ts, [o.home_team, o.away_team]) END, o.date FROM rd r JOIN od o ON o.league=r.league AND o.season=r.season AND o.n=r.n+1)"""


@query("inferred_rounds", "W19 U3 A48", FEED4.replace("WITH ", "WITH RECURSIVE ", 1) + ROUND_SQL + """
SELECT league, season, CAST(rnd AS INT) AS "round", min(date) AS start_date, max(date) AS end_date, count(*) AS match_count FROM rd GROUP BY ALL""")
def inferred_rounds(spark, sf_dir):
    m = matches(spark, sf_dir, 4)
    return x.round_summary(m, x.infer_rounds(m))


@query("manifest_rounds", "J32 S20", FEED4 + MATCH_SQL + """
SELECT league, season, CAST(CAST(match_id AS BIGINT) // 2 AS INT) AS "round", match_id FROM mm WHERE CAST(season AS INT) % 2 = 0""")
def manifest_rounds(spark, sf_dir):
    m = matches(spark, sf_dir, 4)
    no = F.col("match_id").cast("bigint")
    manifest = m.where((F.col("season").cast("int") % 2 == 0) | (no % 2 == 0)).select("league", "season", (F.floor(no / 2)).cast("int").alias("round"), "match_id")
    return x.manifest_rounds(m, manifest)


PROV_SQL = MATCH_SQL + """,
pv AS (SELECT league, season, concat('P', match_id) AS fixture_id, CAST(date + CAST(CAST(match_id AS BIGINT) % 3 - 1 AS INT) AS DATE) AS date, CAST(CAST(match_id AS BIGINT) % 38 AS INT) AS matchday, CASE WHEN CAST(match_id AS BIGINT) % 5 = 4 THEN 'POSTPONED' ELSE 'FINISHED' END AS status, home_team, away_team FROM mm),
cm AS (SELECT * FROM mm WHERE CAST(match_id AS BIGINT) % 5 <> 4)"""


def provider(m):
    no = F.col("match_id").cast("bigint")
    return m.select("league", "season", F.concat(F.lit("P"), "match_id").alias("fixture_id"), F.date_add("date", (no % 3 - 1).cast("int")).alias("date"), (no % 38).cast("int").alias("matchday"),
                    F.when(no % 5 == 4, "POSTPONED").otherwise("FINISHED").alias("status"), "home_team", "away_team")


@query("fixture_hub", "J20 P43", FEED + PROV_SQL + """
SELECT c.league, c.season, c.match_id, c.date, c.home_team, c.away_team, p.fixture_id, p.matchday, 'completed' AS state FROM cm c LEFT JOIN pv p ON p.league=c.league AND p.season=c.season AND p.home_team=c.home_team AND p.away_team=c.away_team AND abs(p.date-c.date) <= 1
UNION ALL SELECT p.league, p.season, NULL, p.date, p.home_team, p.away_team, p.fixture_id, p.matchday, CASE WHEN status='POSTPONED' THEN 'postponed' ELSE 'completed' END FROM pv p WHERE NOT EXISTS (SELECT 1 FROM cm c WHERE p.league=c.league AND p.season=c.season AND p.home_team=c.home_team AND p.away_team=c.away_team AND abs(p.date-c.date) <= 1)""")
def fixture_hub(spark, sf_dir):
    m = matches(spark, sf_dir)
    return x.merge_provider(m.where(F.col("match_id").cast("bigint") % 5 != 4), provider(m), 1)


@query("fixture_hub_counts", "A48", FEED + PROV_SQL + """
SELECT league, season, state, count(*) AS fixtures FROM (SELECT league, season, 'completed' AS state FROM cm UNION ALL SELECT league, season, 'postponed' FROM pv WHERE status='POSTPONED') GROUP BY ALL""")
def fixture_hub_counts(spark, sf_dir):
    m = matches(spark, sf_dir)
    return x.hub_counts(x.merge_provider(m.where(F.col("match_id").cast("bigint") % 5 != 4), provider(m), 1))


@query("resolved_fixtures", "J21 J22 UD1 UD7")
def resolved_fixtures(spark, sf_dir):
    m = matches(spark, sf_dir)
    fx = provider(m).withColumn("home_team", F.concat("home_team", F.lit(" FC"))).select("league", "season", "fixture_id", "date", "home_team", "away_team")
    return x.resolve_fixtures(fx, m)


@query("team_name_similarity", "J22 UD1")
def team_name_similarity(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("a"), F.reverse(F.split("p_name", " ")).alias("r"))
    return x.name_similarity(s.select("a", F.array_join("r", " ").alias("b")), "a", "b")


@query("schedule_groups", "W19", FEED.replace("WITH ", "WITH RECURSIVE ", 1) + MATCH_SQL + """,
du AS (SELECT league, season, match_id, CAST(epoch(date) // 60 + (CAST(match_id AS BIGINT) * 17) % 240 + 180 AS BIGINT) AS due FROM mm), od AS (SELECT *, row_number() OVER (PARTITION BY league, season ORDER BY due, match_id) AS n FROM du),
fo AS (SELECT league, season, n, due, due AS f, 1 AS g FROM od WHERE n=1 UNION ALL SELECT o.league, o.season, o.n, o.due, CASE WHEN o.due - r.f > 30 THEN o.due ELSE r.f END, CASE WHEN o.due - r.f > 30 THEN r.g+1 ELSE r.g END FROM fo r JOIN od o ON o.league=r.league AND o.season=r.season AND o.n=r.n+1)
SELECT league, season, CAST(g AS INT) AS group_no, count(*) AS fixtures, min(due) AS first_due, max(due)+5 AS run_at FROM fo GROUP BY ALL""")
def schedule_groups(spark, sf_dir):
    m = matches(spark, sf_dir)
    kick = F.timestamp_seconds(F.unix_date("date").cast("bigint") * 86400 + (F.col("match_id").cast("bigint") * 17) % 240 * 60)
    return x.schedule_groups(m.select("league", "season", F.col("match_id").alias("fixture_id"), F.lit("upcoming").alias("state"), kick.alias("kickoff")))


@query("standings_payload", "J19 A68 S26", TABLE_SQL + """
SELECT league, season, teamName AS team, row_number() OVER (PARTITION BY league, season ORDER BY pts DESC, gd DESC, gf DESC, teamName) AS "position", pts AS points, xg, xga, CAST(season AS INT) % 2 = 0 AS is_official FROM tab""")
def standings_payload(spark, sf_dir):
    local = season.league_table(team_rows(spark, sf_dir))
    official = local.where(F.col("season").cast("int") % 2 == 0).select("league", "season", F.concat("teamName", F.lit(" FC")).alias("provider_name"), "position", F.col("pts").alias("points"))
    return x.standings_payload(official, local)
