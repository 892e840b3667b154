"""Each stream job gives what its batch twin gives on a finished feed."""
import time
import uuid

from pyspark.sql import functions as F

from touchline.operators import state
from touchline.plans.defending import loss_sequences
from touchline.sources.feed import match_feed
from touchline.streaming import jobs


def landed(spark, sf, tmp_path, parts=3):
    f = match_feed(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    root = str(tmp_path / "landed")
    rows = f.select("matchId", "teamId", "teamName", "opponentName", "h_a", "eventId", "index", "playerName", "minute", "second", "period", "type", "outcomeType", "turnover", "goalOwn", "isShot",
                    "qualifiers", "x", "y", "endX", "endY", "ts")
    for n in range(parts):
        rows.where(f"index >= {n * 500 // parts} and index < {(n + 1) * 500 // parts}").coalesce(1).write.mode("append").parquet(root)
    return rows, root


def run(query_df, mode="append"):
    name = "q" + uuid.uuid4().hex[:8]
    q = query_df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    end = time.time() + 120
    while q.isActive and time.time() < end:  # a query with timeouts goes on with empty batches
        seen = [p["numInputRows"] for p in q.recentProgress]
        if any(seen) and seen[-1] == 0:
            break
        time.sleep(0.2)
    q.stop()
    return query_df.sparkSession.table(name)


def stream(spark, rows, root):
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(root)


def test_windows_and_spells(spark, sf, tmp_path):
    rows, root = landed(spark, sf, tmp_path)
    live = jobs.with_event_time(stream(spark, rows, root), "10 days")
    got = run(jobs.team_windows(live), "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.team_windows(rows).collect()))
    spells = run(jobs.pressure_spells(live), "complete")
    assert sorted(map(tuple, spells.collect())) == sorted(map(tuple, jobs.pressure_spells(rows).collect()))


def test_running_score(spark, sf, tmp_path):
    rows, root = landed(spark, sf, tmp_path)
    got = run(jobs.running_score(stream(spark, rows, root)))
    want = state.with_score(rows).select("matchId", "eventId", "index", "home_score_before", "away_score_before")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_regain_timer(spark, sf, tmp_path):
    rows, root = landed(spark, sf, tmp_path)
    got = run(jobs.regain_timer(stream(spark, rows, root))).collect()
    full = {r.eventId: r.regain_id for r in loss_sequences(rows.withColumn("season", F.lit("s"))).collect()}
    found = {r.loss_id: r.regain_id for r in got}
    # every loss is told once; those without an answer may still wait at the end of the feed
    assert len(found) == len(got) and all(full[k] == v for k, v in found.items())
    assert {k for k, v in full.items() if v is not None} <= set(found)


def test_late_duplicates_are_dropped(spark, sf, tmp_path):
    rows, root = landed(spark, sf, tmp_path)
    rows.where("index < 100").coalesce(1).write.mode("append").parquet(root)
    got = run(jobs.dedupe_late(jobs.with_event_time(stream(spark, rows, root), "10 days")).select("eventId"))
    assert got.count() == 1000


def test_interval_join(spark, sf, tmp_path):
    rows, root = landed(spark, sf, tmp_path)
    s = stream(spark, rows, root)
    got = run(jobs.shot_leadups(jobs.with_event_time(s.where("isShot"), "10 days"), jobs.with_event_time(s, "10 days")))
    want = jobs.shot_leadups(rows.where("isShot"), rows)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_landing_and_schedule(spark, sf, tmp_path):
    rows, root = landed(spark, sf, tmp_path)
    jobs.land(stream(spark, rows, root), str(tmp_path / "table"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "table")).count() == 1000
