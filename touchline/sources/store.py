"""Reading and writing match tables: scans, publishing, merging sources, inventories."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from touchline.operators.scan import bounded
from touchline.schema import conform, event_ddl


def read_events(spark: SparkSession, root: str) -> DataFrame:
    """Canonical events below a folder partitioned by league and season; an absent folder is empty."""
    try:
        return conform(spark.read.schema(event_ddl()).parquet(root))
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], event_ddl())


def with_bound(events: DataFrame, pos: str = "index") -> DataFrame:
    """Events whose position column carries the bound that one pass over that column proves (see operators.scan)."""
    most = events.agg(F.max(pos)).first()[0]
    return events.withColumn(pos, bounded(F.col(pos), pos, None if most is None else int(most) + 1))


def read_jdbc_events(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """Row-store archive, read in parallel ranges of a numeric key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options)
    return conform(reader.load())


def match_id_page(events: DataFrame, offset: int, limit: int) -> DataFrame:
    return events.select("matchId").distinct().orderBy("matchId").offset(offset).limit(limit)


def events_of(events: DataFrame, ids: DataFrame) -> DataFrame:
    return events.join(ids, "matchId", "left_semi")


def dedupe_events(events: DataFrame, order: str = "seq", keys=("matchId", "teamId", "eventId")) -> DataFrame:
    """First row of each key.

    An aggregate, not a window: copies fold inside each map task before the shuffle, so a key that holds
    a large share of all rows sends one row per task.
    """
    keys = list(keys)
    rest = [c for c in events.columns if c not in keys]
    best = events.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*events.columns)


def hybrid(archive: DataFrame, enriched: DataFrame) -> DataFrame:
    """Enriched matches replace their archive versions; the rest comes from the archive."""
    ids = enriched.select("matchId").distinct()
    return archive.join(ids, "matchId", "left_anti").unionByName(enriched, allowMissingColumns=True)


def pending_matches(matches: DataFrame, ledger: DataFrame, league=None, season=None, limit: int | None = None) -> DataFrame:
    """Matches not yet published, oldest first."""
    out = matches.join(ledger.where(F.col("uploaded")).select("matchId"), "matchId", "left_anti")
    if league:
        out = out.where(F.col("league") == league)
    if season:
        out = out.where(F.col("season") == season)
    out = out.orderBy("startDate", "matchId")
    return out.limit(limit) if limit else out


def latest_per_key(rows: DataFrame, keys, order: str) -> DataFrame:
    """Upsert as a union and a fold: the latest version of each key."""
    keys = list(keys)
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*rows.columns)


def align(rows: DataFrame, target: DataFrame) -> DataFrame:
    """Rows with exactly the target's columns, absent ones NULL."""
    have = set(rows.columns)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in target.schema])


def plain_columns(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for stores without nested types."""
    return df.select(*[F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(c) for c in df.columns])


def numeric_columns(df: DataFrame, columns) -> DataFrame:
    """For each text column whether every non-NULL value is a number (then it may be promoted)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).cast("string").alias("v")) for n in columns])).alias("g"))
    return long.groupBy("g.column").agg(F.count("g.v").alias("values"), F.count(F.col("g.v").try_cast("double")).alias("numbers")).withColumn(
        "promote", (F.col("values") > 0) & (F.col("values") == F.col("numbers")))


def fingerprint(df: DataFrame, keys=("matchId",)) -> DataFrame:
    """Row count and an order-free content hash per match."""
    return plain_columns(df).groupBy(*keys).agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*[c for c in df.columns])).alias("hash"))


def by_folder(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt by the columns that name their folders, so that a folder gets one file, or some where it holds much, and not one of each task."""
    return df.hint("rebalance", *[F.col(n) for n in columns])


def publish(events: DataFrame, root: str, league: str = "league", season: str = "season") -> DataFrame:
    """Write matches not yet stored, verified before they become visible; stored ones stay untouched.

    New matches go to a staging folder first, are read back and compared by count and hash, and only then
    appended. Rows are written in the canonical column types. Returns the ids that were published.
    """
    spark, events = events.sparkSession, conform(events)
    parts = events.select(league, season).distinct()  # one row per league season
    known = read_events(spark, root).join(F.broadcast(parts), [league, season]).select("matchId").distinct()
    new = events.join(known, "matchId", "left_anti")
    staged_at = f"{root.rstrip('/')}_staging/{uuid.uuid4().hex}"
    by_folder(new, league, season).write.partitionBy(league, season).parquet(staged_at)
    staged = spark.read.schema(new.schema).parquet(staged_at)
    bad = fingerprint(new).withColumnsRenamed({"rows": "r1", "hash": "h1"}).join(fingerprint(staged.select(*new.columns)), "matchId", "full").where(
        ~(F.col("r1").eqNullSafe(F.col("rows")) & F.col("h1").eqNullSafe(F.col("hash"))))
    if not bad.isEmpty():
        raise ValueError("staged rows differ from their source; nothing was published")
    by_folder(staged, league, season).write.mode("append").partitionBy(league, season).parquet(root)
    return staged.select("matchId").distinct()


def write_season_tables(tables: dict, root: str, source: str, schema_version: int = 5) -> None:
    """The season tables with lineage columns; only the partitions present are replaced."""
    for name, df in tables.items():
        out = df.withColumns({"schema_version": F.lit(schema_version), "source": F.lit(source)})
        (by_folder(out, "league", "season").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("league", "season").parquet(f"{root}/{name}"))


def read_season_table(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    """The given columns of a season table, or an empty one where it is absent."""
    try:
        return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{name}")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def backup(df: DataFrame, root: str, version: str) -> str:
    path = f"{root.rstrip('/')}_backup/{version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def file_inventory(spark: SparkSession, root: str, depth: int = 2) -> DataFrame:
    """Files and bytes by folder prefix, from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    part = F.array_join(F.slice(F.split(F.regexp_replace("path", ".*?" + root.rstrip("/").split("/")[-1] + "/", ""), "/"), 1, depth), "/")
    return files.groupBy(part.alias("prefix")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def validate_matches(events: DataFrame, minimum: int = 50, coverage: float = 0.0) -> DataFrame:
    """Rule violations per match as an array: enough rows, two teams, both halves, a date, metric coverage."""
    def rule(cond: Column, name: str) -> Column:
        return F.when(cond, F.lit(name))
    per = events.groupBy("matchId").agg(
        F.count("*").alias("rows"), F.count_distinct("teamName").alias("teams"), F.count_distinct(F.when(F.col("period").isin("FirstHalf", "SecondHalf"), F.col("period"))).alias("halves"),
        F.count("startDate").alias("dated"), *[F.count(n).alias(f"n_{n}") for n in ("xG", "xGOT", "xA", "xPass")],
        F.count_if(F.col("isShot")).alias("shots"), F.count_if(F.col("type") == "Pass").alias("passes"))
    v = F.array_compact(F.array(rule(F.col("rows") < minimum, "too_few_rows"), rule(F.col("teams") != 2, "not_two_teams"), rule(F.col("halves") < 2, "missing_half"),
                                rule(F.col("dated") == 0, "no_date"), rule(F.col("n_xG") <= coverage * F.col("shots"), "no_xg"), rule(F.col("n_xPass") <= coverage * F.col("passes"), "no_xpass")))
    return per.select("matchId", "rows", v.alias("violations"))
