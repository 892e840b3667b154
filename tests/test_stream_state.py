"""Possession state with gaps, and ingest that is replayed, killed and late."""
import uuid

import pytest
from pyspark.sql import functions as F

from touchline.operators import state
from touchline.schema import conform
from touchline.session import checkpoint_dir
from touchline.streaming import ingest, possessions


def rows_of(spark, places, match="1", late=0):
    kinds = ["Pass", "Tackle", "Card", "Goal", "Pass", "SubstitutionOn", "Dispossessed"]
    out = [(match, i, i, "A" if i * 7 % 5 < 3 else "B", kinds[i % 7], "Successful" if i % 3 else "Unsuccessful", i % 4 == 0, 1_700_000_000 + i + late) for i in places]
    return spark.createDataFrame(out, "matchId string, eventId long, index long, teamName string, type string, outcomeType string, turnover boolean, t long")


@pytest.fixture
def home(spark):
    return f"{checkpoint_dir(spark)}/test-stream-{uuid.uuid4().hex}"


def numbered(spark, home, files):
    for n, f in enumerate(files):
        f.withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(f"{home}/in")
    schema = spark.read.parquet(f"{home}/in").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in").withWatermark("ts", "10 seconds")
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, possessions.ROCKSDB)
    try:
        possessions.possession_stream(stream, 60).writeStream.option("checkpointLocation", f"{home}/c").trigger(availableNow=True).start(
            path=f"{home}/out", format="parquet", outputMode="append").awaitTermination()
    finally:
        spark.conf.set(name, old)
    return {(r.matchId, r.eventId): (r.possession_id, r.possession_team, r.late) for r in spark.read.schema(possessions.OUT).parquet(f"{home}/out").collect()}


def test_a_gap_is_given_up_by_the_timer_and_the_rest_goes_on(spark, home):
    files = [rows_of(spark, [0, 1, 4, 3]), rows_of(spark, [5, 6]), rows_of(spark, [0], "2", late=5000), rows_of(spark, [1], "2", late=5000)]
    got = numbered(spark, home, files)
    kept = rows_of(spark, [0, 1, 3, 4, 5, 6])
    want = {("1", r.eventId): (r.possession_id, r.possession_team, False) for r in state.with_possession(kept).collect()}
    assert {k: v for k, v in got.items() if k[0] == "1"} == want and ("2", 1) in got


def test_order_over_batches_does_not_matter(spark, home):
    got = numbered(spark, home, [rows_of(spark, p) for p in ([9, 2, 0], [8, 1, 4], [3, 7, 5, 6])])
    want = {("1", r.eventId): (r.possession_id, r.possession_team, False) for r in state.with_possession(rows_of(spark, range(10))).collect()}
    assert got == want


def events(spark, ids, league="L", **extra):
    rows = [(league, "2024", "1", i, 1, f"type {n}") for n, i in enumerate(ids)]
    return conform(spark.createDataFrame(rows, "league string, season string, matchId string, eventId long, teamId long, type string"))


def landed(spark, home):
    return sorted((r.eventId, r.type) for r in ingest.read_landed_events(spark, home).select("eventId", "type").collect())


def test_repeats_in_a_batch_and_over_batches_and_replays_add_nothing(spark, home):
    ingest.land_batch(events(spark, [1, 2, 1]), home, "a", 0)
    assert landed(spark, home) == [(1, "type 0"), (2, "type 1")]
    ingest.land_batch(events(spark, [2, 3]), home, "a", 1)
    ingest.land_batch(events(spark, [2, 3]), home, "a", 1)     # the batch runs again
    ingest.land_batch(events(spark, [1, 2, 1]), home, "a", 0)  # and an earlier one
    ingest.land_batch(events(spark, [3, 2, 1]), home, "b", 0)  # another stream replays the source
    assert landed(spark, home) == [(1, "type 0"), (2, "type 1"), (3, "type 1")]


def test_a_kill_between_the_two_writes_is_mended_by_the_replay(spark, home, monkeypatch):
    ingest.land_batch(events(spark, [1]), home, "a", 0)
    real = ingest.first_of_key
    with monkeypatch.context() as m:
        m.setattr("pyspark.sql.DataFrameWriter.partitionBy", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            ingest.land_batch(events(spark, [1, 2]), home, "a", 1)
    assert ingest.first_of_key is real
    ingest.land_batch(events(spark, [1, 2]), home, "a", 1)
    ingest.land_batch(events(spark, [2]), home, "a", 2)
    assert landed(spark, home) == [(1, "type 0"), (2, "type 1")]


def test_null_keys_and_names_and_empty_batches(spark, home):
    ingest.land_batch(events(spark, [1, None, None], league=None), home, "a", 0)
    ingest.land_batch(events(spark, [None, 1], league=None), home, "a", 1)
    ingest.land_batch(events(spark, [5]).limit(0), home, "a", 2)
    ingest.land_batch(events(spark, [5]), home, "a", 3)
    assert sorted(str(r.eventId) for r in ingest.read_landed_events(spark, home).collect()) == ["1", "5", "None"]


def test_a_landing_of_many_files_is_one_batch(spark, tmp_path):
    from touchline.catalog.streaming import landings, replay
    rows = spark.range(0, 400, 1, 4).withColumn("part", F.col("id") % 3)
    seen = []

    def start(stream, at="a"):
        return stream.writeStream.foreachBatch(lambda b, n: seen.append((n, b.count(), len(b.inputFiles())))).option(
            "checkpointLocation", str(tmp_path / at)).trigger(availableNow=True).start()

    landings(spark, rows, 3, str(tmp_path), start)
    assert [s[:2] for s in seen] == [(0, 134), (1, 133), (2, 133)] and len(list((tmp_path / "landed").glob("*.parquet"))) == 12
    seen.clear()
    start(replay(spark, rows, 3, str(tmp_path)), "b").awaitTermination()
    assert len(seen) == 3 and sum(s[1] for s in seen) == 400
