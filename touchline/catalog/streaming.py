"""Batch twins of the stream jobs (tests run both forms against each other)."""

import uuid

from pyspark.sql import functions as F

from touchline.catalog.feed_checks import FEED
from touchline.catalog.match_state import XT_SQL, possession_sql
from touchline.catalog.registry import fsum_sql, n_sql, pct_sql, query
from touchline.operators import grids
from touchline.session import checkpoint_dir
from touchline.sources.feed import match_feed
from touchline.streaming import ingest, jobs, keyed, possessions

PRESS = "type IN ('Interception','Tackle','Clearance','BlockedPass','BallRecovery','Challenge')"
OK = "outcomeType = 'Successful'"


def timed(spark, sf_dir):
    f = match_feed(spark, sf_dir)
    return f.withColumn("ts", F.col("ts").cast("timestamp"))


@query("team_time_windows", "ST3", FEED + f"""
SELECT epoch(time_bucket(INTERVAL 15 minutes, ts)) AS window_start, matchId, teamName, count(*) AS "events", {n_sql("type='Pass'")} AS passes, {pct_sql(n_sql("type='Pass' AND " + OK), n_sql("type='Pass'"))} AS pass_accuracy_pct, {n_sql(PRESS)} AS press_actions,
 {n_sql("turnover OR type='Dispossessed'")} AS turnovers FROM feed GROUP BY ALL""")
def team_time_windows(spark, sf_dir):
    return jobs.team_windows(timed(spark, sf_dir)).withColumn("window_start", F.unix_timestamp("window_start").cast("double"))


@query("sliding_momentum", "ST4", FEED + XT_SQL + f""",
v AS (SELECT f.matchId, f.teamName, f.ts, greatest(0.0::double, least(0.1::double, xt.xt)) AS v FROM feed f JOIN xt USING (eventId)),
w AS (SELECT matchId, teamName, v, epoch(time_bucket(INTERVAL 1 minute, ts)) - 60*k AS ws FROM v CROSS JOIN (VALUES (0),(1),(2)) t(k))
SELECT ws AS window_start, matchId, teamName, CAST(floor(max(v)*1e6+0.5) AS BIGINT) AS best, CAST(floor({fsum_sql('v')}*1e6+0.5) AS BIGINT) AS total FROM w GROUP BY ws, matchId, teamName""")
def sliding_momentum(spark, sf_dir):
    from touchline.functions.core import fixed
    out = jobs.sliding_momentum(grids.with_xt(timed(spark, sf_dir)))
    return out.select(F.unix_timestamp("window_start").cast("double").alias("window_start"), "matchId", "teamName", fixed(F.col("best")).alias("best"), fixed(F.col("total")).alias("total"))


@query("pressure_spells", "ST5 A50", FEED + f"""
, a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 seconds THEN 0 ELSE 1 END AS n FROM feed WHERE {PRESS} WINDOW w AS (PARTITION BY matchId, teamName ORDER BY ts)),
b AS (SELECT *, sum(n) OVER (PARTITION BY matchId, teamName ORDER BY ts) AS g FROM a)
SELECT matchId, teamName, epoch_us(min(ts)) AS spell_start, count(*) AS actions, {n_sql(OK)} AS won FROM b GROUP BY matchId, teamName, g""")
def pressure_spells(spark, sf_dir):
    return jobs.pressure_spells(timed(spark, sf_dir)).select("matchId", "teamName", F.unix_micros("spell_start").alias("spell_start"), "actions", "won")


@query("shot_leadups_by_time", "ST8", FEED + """
SELECT s.matchId, s.teamName, s.eventId AS shot_id, a.eventId, a.type FROM feed s JOIN feed a ON a.matchId=s.matchId AND a.teamName=s.teamName AND a.ts < s.ts AND a.ts >= s.ts - INTERVAL 15 seconds WHERE s."isShot" """)
def shot_leadups_by_time(spark, sf_dir):
    ev = timed(spark, sf_dir)
    return jobs.shot_leadups(ev.where("isShot"), ev)


@query("schedule_upsert", "ST9", FEED + """
, m AS (SELECT DISTINCT CAST(matchId AS BIGINT) AS m, startDate AS d FROM feed)
SELECT CAST(m AS VARCHAR) AS fixture_id, epoch(CASE WHEN m % 4 = 1 THEN d ELSE d + CAST(m % 2 AS INT) END)::double AS kickoff, CASE WHEN m % 4 = 1 THEN 'uploaded' WHEN m % 5 = 2 THEN 'postponed' WHEN m % 2 = 1 THEN 'pending' ELSE 'failed' END AS state,
 CASE WHEN m % 4 <> 1 AND m % 2 = 1 THEN 0 ELSE 3 END AS attempts FROM m""")
def schedule_upsert(spark, sf_dir):
    m = match_feed(spark, sf_dir).select(F.col("matchId").cast("bigint").alias("m"), "startDate").distinct()
    ledger = m.select(F.col("m").cast("string").alias("fixture_id"), F.col("startDate").cast("timestamp").alias("kickoff"), F.when(F.col("m") % 4 == 1, "uploaded").otherwise("failed").alias("state"), F.lit(3).alias("attempts"))
    feed = m.select(F.col("m").cast("string").alias("fixture_id"), F.date_add("startDate", (F.col("m") % 2).cast("int")).cast("timestamp").alias("kickoff"),
                    F.when(F.col("m") % 5 == 2, "postponed").otherwise("upcoming").alias("state"), F.lit(2).alias("seq"))
    old = feed.withColumn("seq", F.lit(1)).withColumn("state", F.lit("cancelled"))
    return jobs.merge_schedule(ledger, feed.unionByName(old)).withColumn("kickoff", F.unix_timestamp("kickoff").cast("double"))


@query("late_rows", "ST10", FEED + """
, r AS (SELECT matchId, eventId, ts, CASE WHEN eventId % 17 = 0 THEN "index" + 40 ELSE "index" END AS arrival FROM feed), p AS (SELECT matchId, arrival, max(ts) AS m FROM r GROUP BY ALL),
k AS (SELECT matchId, arrival, max(m) OVER (PARTITION BY matchId ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mk FROM p)
SELECT r.matchId, r.eventId FROM r JOIN k USING (matchId, arrival) WHERE ts < mk - INTERVAL 120 seconds""")
def late_rows(spark, sf_dir):
    r = timed(spark, sf_dir).withColumn("arrival", F.when(F.col("eventId") % 17 == 0, F.col("index") + 40).otherwise(F.col("index")))
    return jobs.late_rows(r.select("matchId", "eventId", "ts", "arrival")).select("matchId", "eventId")


def in_files(spark, rows, parts, home):
    """Rows written as one landing after another, by the values 0, 1, ... of the column ``part``; a stream reads one file a batch."""
    for n in range(parts):
        rows.where(F.col("part") == n).drop("part").coalesce(1).write.mode("append").parquet(f"{home}/landed")
    return spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/landed")

def landings(spark, rows, parts, home, start):
    """Rows land one part after another, by the values 0, 1, ... of the column ``part``, each written by all tasks; ``start`` starts the stream
    on from its checkpoint after every landing and takes it as one batch."""
    for n in range(parts):
        rows.where(F.col("part") == n).drop("part").write.mode("append").parquet(f"{home}/landed")
        start(spark.readStream.schema(rows.drop("part").schema).parquet(f"{home}/landed")).awaitTermination()


def replay(spark, rows, parts, home):
    """A stream over all that has landed, about a landing's number of files a batch."""
    schema = rows.drop("part").schema
    files = len(spark.read.schema(schema).parquet(f"{home}/landed").inputFiles())
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, -(-files // parts))).parquet(f"{home}/landed")


@query("streamed_possessions", "ST6", FEED + possession_sql(True) + """
SELECT f.eventId, p.possession_id, p.possession_team, false AS late FROM feed f LEFT JOIN poss p USING (matchId, "index")""")
def streamed_possessions(spark, sf_dir):
    """The feed lands in five batches, a third of its rows one and another third two batches away from their place; the stream's state puts them in order."""
    home = f"{checkpoint_dir(spark).rstrip('/')}/possessions-{uuid.uuid4().hex}"
    ev = match_feed(spark, sf_dir).select("matchId", "eventId", "index", "teamName", "type", "outcomeType", "turnover",
                                          F.timestamp_seconds(F.lit(1_700_000_000) + F.col("minute") * 60 + F.col("second")).alias("ts"),
                                          F.pmod(F.floor(F.col("index") / 100) + F.col("eventId") % 3, F.lit(5)).alias("part"))
    stream = in_files(spark, ev, 5, home).withWatermark("ts", "3 hours")
    name, old = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, possessions.ROCKSDB)
    try:
        job = possessions.possession_stream(stream).writeStream.option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start(
            path=f"{home}/out", format="parquet", outputMode="append")
        job.awaitTermination()
    finally:
        spark.conf.set(name, old)
    return spark.read.schema(possessions.OUT).parquet(f"{home}/out").select("eventId", "possession_id", "possession_team", "late")


@query("landed_once", "ST1 ST2", FEED + """
SELECT eventId, type, "minute", x, season, 1 AS copies FROM feed""")
def landed_once(spark, sf_dir):
    """The feed lands in four batches with repeats inside a batch and over batches; then the whole source is replayed by a second stream."""
    home = f"{checkpoint_dir(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}"
    ev = match_feed(spark, sf_dir).drop("k", "ts", "v100", "x10", "y10", "endX10", "endY10", "q")
    part = F.col("eventId") % 4
    rows = (ev.withColumn("part", part).unionByName(ev.where("eventId % 5 = 0").withColumn("part", part))
            .unionByName(ev.where("eventId % 7 = 0").withColumn("part", (part + 1 + F.col("eventId") % 2) % 4)))
    landings(spark, rows, 4, home, lambda stream: ingest.land_once(stream, f"{home}/table", f"{home}/checkpoint-0"))
    ingest.land_once(replay(spark, rows, 4, home), f"{home}/table", f"{home}/checkpoint-1").awaitTermination()
    return ingest.read_landed_events(spark, f"{home}/table").groupBy("eventId").agg(
        F.min("type").alias("type"), F.min("minute").alias("minute"), F.min("x").alias("x"), F.min("season").alias("season"), F.count("*").alias("copies"))


# Schedule rows of four batches: kick-offs move, fixtures are postponed, called off and played.
BATCHES = 4
STEP_SQL = """l{m} AS (SELECT coalesce(l.fixture_id, f.fixture_id) AS fixture_id, CASE WHEN l.state='uploaded' THEN l.kickoff ELSE coalesce(f.kickoff, l.kickoff) END AS kickoff,
 CASE WHEN l.state='uploaded' THEN 'uploaded' WHEN f.state IN ('cancelled','postponed') THEN f.state WHEN l.state IS NULL OR (f.kickoff IS NOT NULL AND f.kickoff IS DISTINCT FROM l.kickoff) THEN 'pending' ELSE l.state END AS state,
 CASE WHEN l.state='uploaded' OR NOT (f.kickoff IS NOT NULL AND f.kickoff IS DISTINCT FROM l.kickoff) THEN coalesce(l.attempts, 0) ELSE 0 END AS attempts
 FROM l{n} l FULL JOIN (SELECT * FROM f WHERE part = {n}) f ON l.fixture_id = f.fixture_id)"""


@query("streamed_ledger", "ST9", FEED + """
, m AS (SELECT DISTINCT CAST(matchId AS BIGINT) AS m, startDate AS d FROM feed),
l0 AS (SELECT CAST(m AS VARCHAR) AS fixture_id, epoch(d)::double AS kickoff, CASE WHEN m % 6 = 1 THEN 'uploaded' ELSE 'failed' END AS state, 3 AS attempts FROM m WHERE m % 3 <> 0),
f AS (SELECT CAST(m AS VARCHAR) AS fixture_id, p.part, epoch(d + CAST((m // 2 + p.part) % 3 // 2 AS INT))::double AS kickoff,
 CASE WHEN (m + p.part) % 7 = 2 THEN 'postponed' WHEN (m + p.part) % 11 = 3 THEN 'cancelled' ELSE 'upcoming' END AS state FROM m, (VALUES (0),(1),(2),(3)) p(part) WHERE (m + p.part) % 4 <> 1),
""" + ",\n".join(STEP_SQL.format(n=n, m=n + 1) for n in range(BATCHES)) + """
SELECT fixture_id, kickoff, state, attempts FROM l4""")
def streamed_ledger(spark, sf_dir):
    """The ledger starts with two thirds of the fixtures; four batches of schedule rows follow, the last two under a new checkpoint."""
    home = f"{checkpoint_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    m = match_feed(spark, sf_dir).select(F.col("matchId").cast("bigint").alias("m"), "startDate").distinct()
    table = keyed.ledger(spark, f"{home}/table")
    table.put(m.where("m % 3 <> 0").select(F.col("m").cast("string").alias("fixture_id"), F.col("startDate").cast("timestamp").alias("kickoff"),
                                           F.when(F.expr("m % 6 = 1"), "uploaded").otherwise("failed").alias("state"), F.lit(3).alias("attempts")), 0)
    feed = m.select("*", F.explode(F.sequence(F.lit(0), F.lit(BATCHES - 1))).alias("part")).where("(m + part) % 4 <> 1")
    state = F.when(F.expr("(m + part) % 7 = 2"), "postponed").when(F.expr("(m + part) % 11 = 3"), "cancelled").otherwise("upcoming")
    feed = feed.select(F.col("m").cast("string").alias("fixture_id"), F.expr("date_add(startDate, cast((m div 2 + part) % 3 div 2 as int))").cast("timestamp").alias("kickoff"),
                       state.alias("state"), F.lit(2).alias("seq"), "part")
    old = feed.withColumn("seq", F.lit(1)).withColumn("state", F.lit("cancelled"))
    half = BATCHES // 2
    for run in range(2):
        rows = feed.unionByName(old).where(F.col("part").between(run * half, run * half + half - 1)).withColumn("part", F.col("part") - run * half)
        keyed.schedule_ledger(in_files(spark, rows, half, f"{home}/{run}"), f"{home}/table", f"{home}/checkpoint-{run}").awaitTermination()
    return table.rows().withColumn("kickoff", F.unix_timestamp("kickoff").cast("double"))


PART_SQL = """CASE WHEN eventId % 17 = 0 THEN least("index" // 150 + 1, 5) ELSE least("index" // 150, 5) END"""


@query("late_side_table", "ST10", FEED + f"""
, r AS (SELECT eventId, matchId, league, season, ts, {PART_SQL} AS part FROM feed), p AS (SELECT matchId, part, max(ts) AS m FROM r GROUP BY ALL),
k AS (SELECT matchId, part, max(m) OVER (PARTITION BY matchId ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mk FROM p),
a AS (SELECT r.*, coalesce(ts < mk - INTERVAL 120 seconds, false) AS late FROM r JOIN k USING (matchId, part)),
s AS (SELECT DISTINCT league, season FROM a WHERE late)
SELECT a.eventId, a.late, s.league IS NOT NULL AS rerun, 1 AS copies FROM a LEFT JOIN s ON s.league = a.league AND s.season = a.season""")
def late_side_table(spark, sf_dir):
    """The feed lands in six batches by place in the match; every 17th event comes a batch later. Late rows go to the side table; their seasons are made again."""
    home = f"{checkpoint_dir(spark).rstrip('/')}/late-{uuid.uuid4().hex}"
    block = F.floor(F.col("index") / 150)
    ev = timed(spark, sf_dir).select("eventId", "matchId", "league", "season", "ts", F.least(F.when(F.col("eventId") % 17 == 0, block + 1).otherwise(block), F.lit(5)).alias("part"))
    landings(spark, ev, 6, home, lambda stream: keyed.split_late(stream, f"{home}/table", f"{home}/checkpoint"))
    rows = keyed.read_split(spark, f"{home}/table", "eventId long, matchId string, league string, season string, ts timestamp")
    again = keyed.seasons_to_rerun(rows).select(F.col("eventId").alias("_e")).distinct()
    return rows.join(again, F.col("eventId") == F.col("_e"), "left").groupBy("eventId").agg(
        F.max("late").alias("late"), F.max(F.col("_e").isNotNull()).alias("rerun"), F.count("*").cast("int").alias("copies"))
