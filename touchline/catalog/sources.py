"""Scans, dedupe, source merging, pages and provider payloads."""

from pyspark.sql import functions as F

from touchline.catalog.feed_checks import FEED
from touchline.catalog.registry import query
from touchline.sources import pages as pg, providers as pr, store
from touchline.sources.feed import match_feed


@query("lineitem_dedupe", "W14 ST2", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn FROM lineitem) WHERE rn = 1""")
def lineitem_dedupe(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    li = li.withColumn("seq", F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))
    return store.dedupe_events(li, "seq", ("l_orderkey", "l_linenumber")).drop("seq", "l_shipdate", "l_quantity")


@query("match_scan", "S1 S13", FEED + """ SELECT eventId, type, "minute", x, y FROM feed WHERE matchId = '1'""")
def match_scan(spark, sf_dir):
    return match_feed(spark, sf_dir).where("matchId = '1'").select("eventId", "type", "minute", "x", "y")


@query("archive_page", "S5 T4", FEED + """ SELECT matchId, count(*) AS "events" FROM feed WHERE matchId IN (SELECT DISTINCT matchId FROM feed ORDER BY matchId LIMIT 4 OFFSET 2) GROUP BY matchId""")
def archive_page(spark, sf_dir):
    f = match_feed(spark, sf_dir)
    return store.events_of(f, store.match_id_page(f, 2, 4)).groupBy("matchId").agg(F.count("*").alias("events"))


@query("hybrid_source", "S6 S23 U1", FEED + """
SELECT matchId, CASE WHEN CAST(matchId AS BIGINT) % 3 = 0 THEN 'enriched' ELSE 'archive' END AS source, count(*) AS "events" FROM feed GROUP BY ALL""")
def hybrid_source(spark, sf_dir):
    f = match_feed(spark, sf_dir)
    enriched = f.where("cast(matchId as bigint) % 3 = 0").withColumn("source", F.lit("enriched")).withColumn("epv_added", F.lit(0.0))
    out = store.hybrid(f.withColumn("source", F.lit("archive")), enriched)
    return out.groupBy("matchId", "source").agg(F.count("*").alias("events"))


@query("pending_matches", "S7 U2", FEED + """ SELECT matchId, startDate FROM (SELECT DISTINCT matchId, startDate FROM feed WHERE CAST(matchId AS BIGINT) % 4 <> 1)""")
def pending_matches(spark, sf_dir):
    m = match_feed(spark, sf_dir).select("matchId", "league", "season", "startDate").distinct()
    ledger = m.select("matchId", (F.col("matchId").cast("bigint") % 4 == 1).alias("uploaded"))
    return store.pending_matches(m, ledger).select("matchId", "startDate")


@query("latest_order_per_customer", "S22", """
SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey""")
def latest_order_per_customer(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("seq"))
    return store.latest_per_key(o, ["o_custkey"], "seq").drop("seq")


@query("match_fingerprint_counts", "S10", FEED + """ SELECT matchId, count(*) AS "rows" FROM feed GROUP BY matchId""")
def match_fingerprint_counts(spark, sf_dir):
    return store.fingerprint(match_feed(spark, sf_dir)).select("matchId", "rows")


@query("match_validation", "P44", FEED + """
SELECT matchId, count(*) AS "rows", CASE WHEN count(*) < 50 THEN 'too_few_rows' ELSE '' END AS problems FROM feed GROUP BY matchId""")
def match_validation(spark, sf_dir):
    return store.validate_matches(match_feed(spark, sf_dir)).select("matchId", "rows", F.array_join("violations", ",").alias("problems"))


@query("column_promotion", "S11", """
SELECT 'o_orderkey' AS "column", count(o_orderkey) AS "values", count(TRY_CAST(CAST(o_orderkey AS VARCHAR) AS DOUBLE)) AS numbers, true AS promote FROM orders UNION ALL SELECT 'o_orderpriority', count(o_orderpriority), count(TRY_CAST(o_orderpriority AS DOUBLE)), false FROM orders""")
def column_promotion(spark, sf_dir):
    return store.numeric_columns(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_orderkey", "o_orderpriority"])


@query("page_scripts", "S16", r"""
SELECT page_id, CAST(unnest(generate_series(0, len(b)-1)) AS INT) AS script_no, unnest(b) AS body FROM (SELECT page_id, regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1) AS b FROM pages) WHERE len(b) > 0""")
def page_scripts(spark, sf_dir):
    return pg.script_bodies(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("page_payloads", "S16", r"""
SELECT page_id, url, payload, CASE WHEN regexp_matches(html, '(?i)access denied|are you a robot|captcha|request blocked') THEN 'blocked' WHEN NOT contains(lower(html), '</html>') THEN 'incomplete' WHEN payload IS NULL THEN 'no_payload' END AS refused
FROM (SELECT *, list_filter(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1), lambda s: contains(s, 'track'))[1] AS payload FROM pages)""")
def page_payloads(spark, sf_dir):
    return pg.page_payloads(spark.read.parquet(f"{sf_dir}/pages.parquet"), "track")


@query("page_breadcrumbs", "S16", r"""
SELECT page_id, CAST(unnest(generate_series(0, len(b)-1)) AS INT) AS place, trim(regexp_replace(unnest(b), '<[^>]+>', '', 'g')) AS "text" FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?is)<nav[^>]*>(.*?)</nav>', 1), '(?is)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2) AS b FROM pages) WHERE len(b) > 0""")
def page_breadcrumbs(spark, sf_dir):
    return pg.breadcrumbs(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def payloads(spark, sf_dir):
    """The feed as provider payloads: one JSON text per match (at most 500 events each), then parsed back."""
    f = match_feed(spark, sf_dir)
    back = {"TakeOn": "Dribble", "BallRecovery": "Ball Recovery", "BlockedPass": "Block", "Foul": "Foul Committed"}
    name = F.when(F.col("isShot"), "Shot").otherwise(F.coalesce(F.try_element_at(pr.lookup(back), F.col("type")), F.col("type")))
    yards = lambda x, y: F.array(F.col(x) / 105.0 * 120.0, 80.0 - F.col(y) / 68.0 * 80.0)
    bad = F.col("outcomeType") == "Unsuccessful"
    ev = F.struct(
        F.col("eventId").cast("string").alias("id"), F.col("index").cast("int").alias("index"), F.when(F.col("period") == "FirstHalf", 1).otherwise(2).alias("period"), "minute", "second",
        F.struct(name.alias("name")).alias("type"), F.struct(F.col("teamId").cast("bigint").alias("id"), F.col("teamName").alias("name")).alias("team"),
        F.struct(F.col("playerId").alias("id"), F.col("playerName").alias("name")).alias("player"), yards("x", "y").alias("location"),
        F.when(F.col("type") == "Pass", F.struct(yards("endX", "endY").alias("end_location"), F.when(bad, F.struct(F.lit("Incomplete").alias("name"))).alias("outcome"),
                                                 F.array_contains("qualifiers", "Cross").alias("cross"))).alias("pass"),
        F.when(F.col("isShot"), F.struct(F.col("xG").alias("statsbomb_xg"), F.struct(F.when(F.col("isGoal"), "Goal").when(F.col("type") == "SavedShot", "Saved").otherwise("Off T").alias("name")).alias("outcome"),
                                         F.col("relatedEventId").cast("string").alias("key_pass_id"))).alias("shot"))
    home = F.max(F.when(F.col("h_a") == "h", F.struct(F.col("teamId").cast("bigint").alias("id"), F.col("teamName").alias("name"))))
    away = F.max(F.when(F.col("h_a") == "a", F.struct(F.col("teamId").cast("bigint").alias("id"), F.col("teamName").alias("name"))))
    g = f.groupBy("matchId").agg(F.min("startDate").cast("string").alias("d"), F.min("league").alias("l"), F.min("season").alias("s"), home.alias("h"), away.alias("a"), F.collect_list(ev).alias("events"))
    body = F.struct(F.struct(F.col("matchId").cast("bigint").alias("match_id"), F.col("d").alias("match_date"), F.col("l").alias("competition"), F.col("s").alias("season"), F.col("h").alias("home"), F.col("a").alias("away")).alias("match"), "events")
    return pr.read_payloads(g.select(F.to_json(body).alias("payload")))


@query("payload_events", "S14 S17 P1 P2 P3 P38 P39", FEED + """
SELECT matchId, "index", teamName, opponentName, h_a, playerName, type, period, "minute", CAST(floor(x*1e6+0.5) AS BIGINT) AS x_micro, CAST(floor(y*1e6+0.5) AS BIGINT) AS y_micro, xG AS "xG", list_contains(qualifiers,'Cross') AND type='Pass' AS is_cross FROM feed""")
def payload_events(spark, sf_dir):
    from touchline.functions.core import fixed
    ev = pr.nested_events(payloads(spark, sf_dir))
    return ev.select("matchId", "index", "teamName", "opponentName", "h_a", "playerName", "type", "period", "minute", fixed(F.col("x")).alias("x_micro"), fixed(F.col("y")).alias("y_micro"),
                     "xG", F.array_contains("qualifiers", "Cross").alias("is_cross"))


@query("payload_matches", "S18", FEED + """
SELECT matchId, min(startDate) AS "startDate", min(league) AS league, max(CASE WHEN h_a='h' THEN teamName END) AS home_team, max(CASE WHEN h_a='a' THEN teamName END) AS away_team, CAST(count(*) AS INT) AS "events" FROM feed GROUP BY matchId""")
def payload_matches(spark, sf_dir):
    return pr.match_rows(payloads(spark, sf_dir)).drop("season")


@query("related_event_tags", "J5", FEED + f"""
, lk AS (SELECT relatedEventId AS id, bool_or(isGoal) AS g, max(xG) AS xg FROM feed WHERE "isShot" AND relatedEventId IS NOT NULL GROUP BY ALL)
SELECT f.eventId::varchar AS "sourceId", g AS led_to_goal, lk.xg AS target_xg FROM feed f JOIN lk ON lk.id=f.eventId""")
def related_event_tags(spark, sf_dir):
    ev = pr.with_related_passes(pr.nested_events(payloads(spark, sf_dir))).where("target_xg is not null")
    return ev.select("sourceId", F.array_contains("qualifiers", "IntentionalGoalAssist").alias("led_to_goal"), "target_xg")


@query("keyed_payload_events", "S15 P2 P29", FEED + """
SELECT matchId, eventId, teamName, h_a, playerName, type, period FROM feed""")
def keyed_payload_events(spark, sf_dir):
    f = match_feed(spark, sf_dir)
    g = f.groupBy("matchId").agg(
        F.min("startDate").cast("string").alias("d"), F.map_from_entries(F.collect_set(F.struct(F.col("teamId").cast("string"), F.struct(F.col("teamName").alias("name"), F.when(F.col("h_a") == "h", "home").otherwise("away").alias("side"))))).alias("teams"),
        F.map_from_entries(F.collect_set(F.struct(F.col("playerId").cast("string"), F.struct(F.col("playerName").alias("name"), F.col("teamName").alias("team"))))).alias("players"),
        F.collect_list(F.struct(F.col("eventId").alias("id"), F.col("playerId").cast("string").alias("player"), F.col("teamId").cast("string").alias("team"), "type", "x", "y", "minute", "second",
                                F.when(F.col("period") == "FirstHalf", "1H").otherwise("2H").alias("half"))).alias("events"))
    body = F.struct(F.struct(F.col("matchId").cast("bigint").alias("id"), F.col("d").alias("date")).alias("match"), "teams", "players", "events")
    return pr.keyed_events(g.select(F.to_json(body).alias("payload"))).select("matchId", "eventId", "teamName", "h_a", "playerName", "type", "period")


