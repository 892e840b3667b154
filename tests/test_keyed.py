"""Ledger and late rows of a stream: replays, folds, what is written."""
import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare_with_sql import TABLES, rows
from touchline.streaming import jobs, keyed

DAY = dt.datetime(2024, 1, 1)


def schedule(spark, ids, day, state="upcoming"):
    return spark.createDataFrame([(str(i), DAY + dt.timedelta(days=day), state, 1) for i in ids], "fixture_id string, kickoff timestamp, state string, seq int")


def state(table, **kw):
    return sorted(tuple(r) for r in table.rows(**kw).collect())


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Six batches on a ledger of 400 fixtures; each batch is applied twice, as after a kill before its commit."""
    t = keyed.ledger(spark, str(tmp_path_factory.mktemp("ledger")))
    t.put(schedule(spark, range(400), 0).select("fixture_id", "kickoff", F.lit("pending").alias("state"), F.lit(2).alias("attempts")), 0)
    for n, ids in enumerate([[1, 2], [2, 3], range(300), [3, 900], [], [1]], start=1):
        for _ in range(2):
            t.fold(n)
            keyed.apply_schedule(t, schedule(spark, ids, n, "postponed" if n == 4 else "upcoming"), n)
    return t


def test_ledger_equals_one_batch_fold_after_another(spark, table):
    want = schedule(spark, range(400), 0).select("fixture_id", "kickoff", F.lit("pending").alias("state"), F.lit(2).alias("attempts"))
    for n, ids in enumerate([[1, 2], [2, 3], range(300), [3, 900], [], [1]], start=1):
        want = spark.createDataFrame(jobs.merge_schedule(want, schedule(spark, ids, n, "postponed" if n == 4 else "upcoming")).collect(), keyed.LEDGER)
    assert state(table) == sorted(tuple(r) for r in want.collect())


def test_what_is_written_follows_the_batch(spark, table):
    delta = {r.version: r["count"] for r in spark.read.parquet(f"{table.root}/delta").groupBy("version").count().collect()}
    assert delta == {0: 400, 1: 2, 2: 2, 3: 300, 4: 2, 6: 1}
    # the first fold takes the start, the second the large batch, small ones take none
    assert sorted(r.upto for r in spark.read.parquet(f"{table.root}/folds").collect()) == [0, 3]


def test_a_fold_that_dies_before_its_line_changes_nothing(spark, table):
    before = state(table)
    table.rows().limit(5).withColumn("version", F.lit(6)).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{table.root}/base/upto=6")
    assert state(table) == before
    assert state(table, below=3) != before and len(state(table, below=1)) == 400


def test_a_new_checkpoint_goes_on(spark, tmp_path):
    t = keyed.ledger(spark, str(tmp_path / "l"))
    a, b = t.first_version("one"), t.first_version("two")
    assert a < b and t.first_version("one") == a and state(t) == []
    keyed.apply_schedule(t, schedule(spark, [None, 5], 1).withColumn("fixture_id", F.expr("nullif(fixture_id, 'None')")), a)
    assert [r[0] for r in state(t)] == ["5"]


def test_late_rows_are_kept_apart_once(spark, tmp_path):
    t = keyed.KeyedTable(spark, str(tmp_path / "marks"), "matchId", keyed.MARKS)
    at = lambda s: DAY + dt.timedelta(seconds=s)
    batches = [[("a", at(0)), ("a", at(500)), ("b", at(0))], [("a", at(379)), ("a", at(380)), ("b", at(100)), (None, at(0)), ("a", None)], [("b", at(0)), ("a", at(900))]]
    for n, batch in enumerate(batches):
        for _ in range(2):
            t.fold(n)
            keyed.route_late(t, spark.createDataFrame(batch, "matchId string, ts timestamp"), str(tmp_path), n, 120)
    out = keyed.read_split(spark, str(tmp_path), "matchId string, ts timestamp").collect()
    assert len(out) == 10 and [(r.matchId, r.ts, r.version) for r in out if r.late] == [("a", at(379), 1)]


@pytest.mark.parametrize("name", ["streamed_ledger", "late_side_table", "resolved_people", "resolved_stats_players", "matched_clubs"])
def test_queries_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    got, cols = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    want, wcols = rows([d[0] for d in cur.description], cur.fetchall())
    assert cols == wcols and got == want
    if name in ("resolved_people", "late_side_table"):
        at = cols.index("stage" if name == "resolved_people" else "late")
        assert len({r[at] for r in got}) > (6 if name == "resolved_people" else 1)
