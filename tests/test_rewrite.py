"""The resumable archive rewrite: windows, kills between steps, changes that must not pass."""
import uuid

import pytest
from pyspark.sql import functions as F

from touchline.session import checkpoint_dir
from touchline.sources.rewrite import Rewrite


@pytest.fixture
def archive(spark):
    root = f"{checkpoint_dir(spark)}/test-rewrite-{uuid.uuid4().hex}/events"
    rows = [(f"L {i % 2}", str(2020 + i % 3), str(i), n, float(n)) for i in range(6) for n in range(4)]
    spark.createDataFrame(rows, "league string, season string, matchId string, eventId long, xG double").write.partitionBy("league", "season").parquet(root)
    return root


def doubled(rows):
    return rows.withColumn("xG", F.when(F.col("season") == "2021", F.col("xG")).otherwise(F.col("xG") * 2))


def values(spark, root):
    return sorted((r.matchId, r.eventId, r.xG) for r in spark.read.parquet(root).collect())


def want(untouched=()):
    return sorted((str(i), n, float(n) if i % 3 == 1 or i in untouched else 2.0 * n) for i in range(6) for n in range(4))


def statuses(report):
    return {(r.league, r.season): r.status for r in report.collect()}


def test_only_changed_units_are_swapped_and_a_second_run_of_that_name_does_nothing(spark, archive):
    run = Rewrite(spark, archive, "a", doubled)
    assert len(run.plan()) == 6 and set(statuses(run.report()).values()) == {"planned"}
    got = statuses(run.apply())
    assert all(s == ("unchanged" if season == "2021" else "applied") for (_, season), s in got.items()) and values(spark, archive) == want()
    assert statuses(Rewrite(spark, archive, "a", doubled).apply()) == got and values(spark, archive) == want()
    changed = {(r.league, r.season): (r.changed_rows, r.changed_matches, r.rows_before) for r in run.report().collect()}
    assert changed["L 0", "2020"] == (3, 1, 4) and changed["L 1", "2021"] == (0, 0, 4)  # 0 doubled is 0


@pytest.mark.parametrize("step", ["stage", "compare", "backup", "swap", "ledger"])
def test_a_run_that_dies_before_a_step_is_finished_by_the_next_call(spark, archive, step):
    seen = []

    def before(now, folder):
        if now == step:
            seen.append(folder)
            raise RuntimeError("killed")

    with pytest.raises(RuntimeError, match="killed"):
        Rewrite(spark, archive, "a", doubled, before_step=before).apply(parallel=1)
    assert seen
    Rewrite(spark, archive, "a", doubled).apply()
    assert values(spark, archive) == want()
    old = spark.read.parquet(f"{archive}_runs/a/backup/league=L 0/season=2020").agg(F.sum("xG")).first()[0]
    assert old == 6.0


def test_windows_and_named_units(spark, archive):
    run = Rewrite(spark, archive, "w", doubled)
    assert len(run.plan(batch_size=4, batch_index=1)) == 2
    assert len(run.plan(batch_size=4, batch_index=0)) == 2  # the plan of a run stays
    one = Rewrite(spark, archive, "one", doubled)
    one.plan(units=[("L 0", "2020")])
    one.apply()
    assert values(spark, archive) == want(untouched=(1, 2, 3, 4, 5))
    none = Rewrite(spark, archive, "none", doubled)
    none.plan(units=[])
    assert none.apply().count() == 0


def test_a_change_that_drops_columns_or_fails_leaves_the_archive(spark, archive):
    before = values(spark, archive)
    with pytest.raises(ValueError, match="drops"):
        Rewrite(spark, archive, "bad", lambda d: d.drop("xG")).apply()
    with pytest.raises(Exception, match="no value"):
        Rewrite(spark, archive, "worse", lambda d: d.withColumn("xG", F.raise_error(F.lit("no value")).cast("double"))).apply()
    assert values(spark, archive) == before


def test_jobs_do_not_grow_with_units_and_repeated_rows_count(spark):
    """Sixty units go through a run in the jobs of one; a unit whose repeated row is gone has changed."""
    root = f"{checkpoint_dir(spark)}/test-rewrite-{uuid.uuid4().hex}/events"
    rows = [("L", str(i), str(i), n // 2, 1.0) for i in range(60) for n in range(4)]
    spark.createDataFrame(rows, "league string, season string, matchId string, eventId long, xG double").write.partitionBy("league", "season").parquet(root)
    calls = []

    def distinct(d):
        calls.append(d.select("season").distinct().count())
        odd = F.col("season").cast("int") % 2 == 1
        return d.where(odd).dropDuplicates().unionByName(d.where(~odd))

    left = lambda d: d.groupBy("league", "season", "matchId", "eventId").count().where("count > 1").select("league", "season")
    got = {r.season: (r.status, r.rows, r.rows_before, r.changed_matches, r.changed_rows) for r in Rewrite(spark, root, "a", distinct).apply().collect()}
    assert calls == [60]
    assert got == {str(i): ("applied", 2, 4, 1, 0) if i % 2 else ("unchanged", 4, 4, 0, 0) for i in range(60)}
    assert spark.read.parquet(root).count() == 180
    again = {r.season: r.status for r in Rewrite(spark, root, "b", distinct, left).apply(skip_complete=True).collect()}
    assert again == {str(i): "skipped_complete" if i % 2 else "unchanged" for i in range(60)} and calls == [60, 30]
