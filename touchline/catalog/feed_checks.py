"""The feed itself and its check values."""

from pyspark.sql import functions as F

from touchline.catalog.registry import query
from touchline.sources.feed import feed_sql, match_feed

FEED = feed_sql()
FEED4 = feed_sql(4)
DENSE = feed_sql(pace=4)
SQUAD = feed_sql(20, 1, 14)


@query("feed_check_values", "S1", FEED + """
SELECT count(*) AS n_rows, count(DISTINCT matchId) AS n_matches, count(DISTINCT teamName) AS n_teams,
  count(*) FILTER (WHERE type = 'Goal') AS goals, count(*) FILTER (WHERE outcomeType = 'Successful') AS successful,
  CAST(sum("minute") AS BIGINT) AS minutes, CAST(sum(x10) AS BIGINT) AS x10, CAST(sum(q) AS BIGINT) AS q,
  count(*) FILTER (WHERE list_contains(qualifiers, 'Cross')) AS crosses,
  max(startDate) AS last_date, count(DISTINCT season) AS n_seasons FROM feed""")
def feed_check_values(spark, sf_dir):
    f = match_feed(spark, sf_dir)
    return f.agg(F.count("*").alias("n_rows"), F.count_distinct("matchId").alias("n_matches"),
                 F.count_distinct("teamName").alias("n_teams"),
                 F.count_if(F.col("type") == "Goal").alias("goals"),
                 F.count_if(F.col("outcomeType") == "Successful").alias("successful"),
                 F.sum("minute").alias("minutes"), F.sum("x10").alias("x10"), F.sum("q").alias("q"),
                 F.count_if(F.array_contains("qualifiers", "Cross")).alias("crosses"),
                 F.max("startDate").alias("last_date"), F.count_distinct("season").alias("n_seasons"))
