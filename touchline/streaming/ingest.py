"""Exactly-once ingest over batches: a key index beside the table, looked up for each batch and written with it.

A batch's rows go to ``<root>/events/run=<r>/batch=<n>``, the keys of these rows to ``<root>/keys/run=<r>/batch=<n>/league=../season=..``; r names the stream's checkpoint. A batch keeps the
first row of each key that no other batch holds. As it never looks at its own folders, a batch that runs again, whole or after a kill between its two
writes, writes the same again; a source that is replayed under a new checkpoint adds nothing. Only the index of the league seasons that a batch
touches is read, keys and nothing else.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from touchline.schema import conform, event_ddl
from touchline.sources.store import by_folder

KEYS = ("matchId", "teamId", "eventId")
MOST_PARTS = 10_000  # league seasons of a batch whose names prune the index; a batch of more reads all of it


def first_of_key(rows: DataFrame, keys=KEYS) -> DataFrame:
    """One row of each key: the least by all its other columns, so that a batch that runs again chooses the same one."""
    rest = [n for n in rows.columns if n not in keys]
    order = F.struct(*[F.col(n) for n in rest])
    return rows.groupBy(*keys).agg(F.min(order).alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def known_keys(spark: SparkSession, root: str, run: str, batch: int, parts: list | None, keys=KEYS) -> DataFrame:
    """Keys that other batches hold, of the given league seasons."""
    schema = ", ".join([*(f"{n} {'string' if n == 'matchId' else 'bigint'}" for n in keys), "run string", "batch bigint", "league string", "season string"])
    try:
        found = spark.read.schema(schema).parquet(f"{root}/keys")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    found = found.where((F.col("run") != run) | (F.col("batch") != batch))
    if parts is not None:
        # names of the partition folders, so whole folders are left out; an empty name is read back as NULL
        found = found.where(F.coalesce("league", F.lit("")).isin([a for a, _ in parts]) & F.coalesce("season", F.lit("")).isin([b for _, b in parts]))
    return found


def land_batch(rows: DataFrame, root: str, run: str, batch: int, keys=KEYS) -> None:
    """Write what is new of one batch. Rows without a league or season are filed under an empty name in the index."""
    spark, keys = rows.sparkSession, list(keys)
    where = [F.coalesce(n, F.lit("")).alias(n) for n in ("league", "season")]
    rows = conform(rows)
    names = rows.select(*where).distinct().limit(MOST_PARTS + 1).collect()
    rows = first_of_key(rows, keys)
    known = known_keys(spark, root, run, batch, [tuple(r) for r in names] if len(names) <= MOST_PARTS else None, keys)
    same = [F.col(f"r.{n}").eqNullSafe(F.col(f"k.{n}")) for n in keys]
    cond = same[0]
    for s in same[1:]:
        cond &= s
    new = rows.alias("r").join(known.alias("k"), cond, "left_anti")
    at = f"{root}/events/run={run}/batch={batch}"
    new.write.mode("overwrite").parquet(at)
    done = spark.read.schema(new.schema).parquet(at)
    by_folder(done.select(*keys, *where), "league", "season").write.mode("overwrite").partitionBy("league", "season").parquet(f"{root}/keys/run={run}/batch={batch}")


def land_once(stream: DataFrame, root: str, checkpoint: str, keys=KEYS):
    """Start a stream that appends each key once, however often batches or the whole source are replayed."""
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    return stream.writeStream.foreachBatch(lambda rows, number: land_batch(rows, root, run, number, keys)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_landed_events(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(event_ddl()).parquet(f"{root}/events").drop("run", "batch")
