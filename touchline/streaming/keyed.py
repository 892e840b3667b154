"""A table of one row per key that a stream brings up to date batch by batch: bucketed deltas, merged on read, folded now and then.

A batch writes only the rows it changes, to ``<root>/delta/version=<v>/bucket=<b>``; a key's row is the one of its highest version. A
batch looks up its own keys below its version, in the buckets they fall into, so a batch that runs again reads and writes the same.
Once the deltas hold half as many rows as the base, the next batch first folds all versions before its own into
``<root>/base/upto=<v>``; the line in ``<root>/folds`` that makes the base visible is written last. So what is written follows the rows of
the batches, whatever the size of the table. Folded deltas are left out by the names of their folders and may be removed.

Versions of a stream's checkpoint begin behind those of all earlier ones, so a new checkpoint goes on with the table as it is.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

BUCKETS = 64
FOLD_SHARE = 0.5
RUN_SIZE = 1_000_000_000  # most batches of one checkpoint


def c(name):
    return F.col(name)


class KeyedTable:
    """``ddl``: columns of a row, the key among them."""

    def __init__(self, spark: SparkSession, root: str, key: str, ddl: str, buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.ddl, self.buckets = spark, root, key, ddl, buckets
        self.names = spark.createDataFrame([], ddl).columns

    def _found(self, part: str, ddl: str) -> DataFrame:
        try:
            return self.spark.read.schema(ddl).parquet(f"{self.root}/{part}")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], ddl)

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def first_version(self, checkpoint: str) -> int:
        """Version of batch 0 of a checkpoint; a checkpoint seen before keeps its own."""
        run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
        known = self._found("runs", "place long, run string")
        mine, last = known.agg(F.max(F.when(c("run") == run, c("place"))), F.max("place")).first()
        if mine is None:
            mine = (last or 0) + 1
            self.spark.createDataFrame([(mine,)], "place long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/runs/run={run}")
        return mine * RUN_SIZE

    def folded(self, below: int) -> int:
        """Highest visible fold before a version, -1 without one."""
        found = self._found("folds", "rows long, upto long").where(c("upto") < below).agg(F.max("upto")).first()[0]
        return -1 if found is None else found

    def rows(self, below: int = 2 ** 62, buckets: list[int] | None = None) -> DataFrame:
        """One row of each key, as it was before a version; only of some buckets where they are named."""
        fold = self.folded(below)
        base = self._found("base", f"{self.ddl}, version long, upto long, bucket int").where(c("upto") == fold).drop("upto")
        delta = self._found("delta", f"{self.ddl}, version long, bucket int").where((c("version") > fold) & (c("version") < below))
        both = base.unionByName(delta)
        if buckets is not None:
            both = both.where(c("bucket").isin(buckets))
        row = F.struct(*[n for n in self.names if n != self.key])
        return both.groupBy(self.key).agg(F.max_by(row, "version").alias("_r")).select(self.key, "_r.*").select(*self.names)

    def known(self, rows: DataFrame, below: int) -> DataFrame:
        """Rows of the buckets into which the keys of ``rows`` fall."""
        touched = [r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect()]  # at most `buckets` numbers
        return self.rows(below, touched)

    def put(self, rows: DataFrame, version: int) -> None:
        """Write the changed rows of a batch, one for each key. A batch without changes writes an empty folder."""
        rows.select(*self.names, self._bucket().alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/delta/version={version}")

    def fold(self, below: int) -> bool:
        """Fold all versions before this one into a new base if their deltas have grown to its share; True if it did."""
        at = self.folded(below)
        delta = self._found("delta", f"{self.ddl}, version long, bucket int").where((c("version") > at) & (c("version") < below))
        size = self._found("folds", "rows long, upto long").where(c("upto") == at).agg(F.max("rows")).first()[0] or 0
        upto, n = delta.agg(F.max("version"), F.count("*")).first()
        if upto is None or n <= size * FOLD_SHARE:
            return False
        whole = self.rows(below).withColumn("version", F.lit(upto)).withColumn("bucket", self._bucket())
        home = f"{self.root}/base/upto={upto}"
        whole.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(home)
        n = self._found("base", f"{self.ddl}, version long, upto long, bucket int").where(c("upto") == upto).count()
        self.spark.createDataFrame([(n,)], "rows long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/folds/upto={upto}")
        return True


LEDGER = "fixture_id string, kickoff timestamp, state string, attempts int"


def ledger(spark: SparkSession, root: str) -> KeyedTable:
    return KeyedTable(spark, root, "fixture_id", LEDGER)


def apply_schedule(table: KeyedTable, batch: DataFrame, version: int) -> None:
    """Schedule rows onto the ledger: only rows that they change are written."""
    from touchline.streaming.jobs import merge_schedule
    batch = batch.where("fixture_id is not null")
    before = table.known(batch, version)
    after = merge_schedule(before.join(batch.select("fixture_id").distinct(), "fixture_id", "left_semi"), batch).select(*table.names)
    same = after.alias("a").join(before.alias("b"), (c("a.fixture_id") == c("b.fixture_id")) & c("a.kickoff").eqNullSafe(c("b.kickoff")) & c("a.state").eqNullSafe(c("b.state"))
                                 & c("a.attempts").eqNullSafe(c("b.attempts")), "left_anti")
    table.put(same, version)


def schedule_ledger(feed: DataFrame, root: str, checkpoint: str):
    """Start a stream of schedule rows (fixture_id, kickoff, state, seq) that keeps the ledger up to date."""
    table = ledger(feed.sparkSession, root)
    first = table.first_version(checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        table.fold(first + number)
        apply_schedule(table, batch, first + number)

    return feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


MARKS = "matchId string, mark timestamp"


def route_late(table: KeyedTable, batch: DataFrame, root: str, version: int, delay_seconds: int) -> None:
    """Rows of a batch to ``<root>/rows/late=<..>/version=<v>``: late if a row of an earlier batch of the match is newer by more than the delay.

    Rows without a match or time are on time.
    """
    marks = table.known(batch, version).select(c("matchId").alias("_match"), c("mark"))
    out = batch.join(marks, c("matchId") == c("_match"), "left").withColumn(
        "late", F.coalesce(c("ts") < c("mark") - F.expr(f"INTERVAL {int(delay_seconds)} SECONDS"), F.lit(False))).drop("_match", "mark")
    # both parts in one write: a batch that runs again replaces its own folder
    out.write.mode("overwrite").partitionBy("late").parquet(f"{root}/rows/version={version}")
    seen = batch.where("matchId is not null and ts is not null").groupBy("matchId").agg(F.max("ts").alias("_new"))
    newer = seen.join(marks, c("matchId") == c("_match"), "left").where("mark is null or _new > mark").select("matchId", c("_new").alias("mark"))
    table.put(newer, version)


def split_late(stream: DataFrame, root: str, checkpoint: str, delay_seconds: int = 120):
    """Start a stream that keeps on-time rows and late rows (columns matchId, ts and any others) apart; together they hold every input row once."""
    table = KeyedTable(stream.sparkSession, f"{root}/marks", "matchId", MARKS)
    first = table.first_version(checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        table.fold(first + number)
        route_late(table, batch, root, first + number, delay_seconds)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_split(spark: SparkSession, root: str, ddl: str) -> DataFrame:
    """All rows with `late` and the version that brought them."""
    return spark.read.schema(f"{ddl}, version long, late boolean").parquet(f"{root}/rows")


def seasons_to_rerun(rows: DataFrame, since: int = -1) -> DataFrame:
    """Whole rows of the league seasons that late rows behind a version touch: what their season tables are made of again."""
    touched = rows.where(c("late") & (c("version") > since)).select(c("league").alias("_l"), c("season").alias("_s")).distinct()
    return rows.join(touched, c("league").eqNullSafe(c("_l")) & c("season").eqNullSafe(c("_s")), "left_semi")
