"""Resumable rewrite of a partitioned archive: plan, stage, verify, back up, swap.

A run has a name. Its unit is a league season, one partition folder of the archive. The plan is written once per run, so a resumed run works on
the same units. Spark works on many units at once, as many as `UNITS`: one job each writes and compares them all, so that time goes by rows and
not by units. Each unit goes through steps that can be repeated or found done from what lies in the shared folder:

1. the changed rows are written aside, moved below ``<root>_runs/<run>/staged`` when the job has ended, and compared with their source,
2. the live folder is renamed to ``<root>_runs/<run>/backup``,
3. the staged folder is renamed to the live place,
4. one line of the ledger says how the unit ended.

A run that dies between any two steps is continued by calling it again with the same name. A reader can find a unit's live folder missing only between
steps 2 and 3, and the ledger has no line for it then. Folder renames are single operations on HDFS and local disks; object stores copy, so
there a unit should be read through its ledger line. Only counts and keys of units reach the driver: one row per league season.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from touchline.sources.store import by_folder, plain_columns

UNIT = ["league", "season"]
UNITS = 500  # league seasons that one job works on
NO_NAME = "__HIVE_DEFAULT_PARTITION__"


def c(name):
    return F.col(name)


class Folders:
    """The few folder operations of the swap, through the file system that Spark itself uses for the path."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, text: str):
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def exists(self, text: str) -> bool:
        return self.fs.exists(self.path(text))

    def move(self, old: str, new: str) -> None:
        self.fs.mkdirs(self.path(new).getParent())
        if self.exists(new) or not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"cannot move {old} to {new}")

    def write_text(self, at: str, text: str) -> None:
        """A small file that appears whole or not at all."""
        aside = self.path(f"{at}.tmp")
        self.fs.mkdirs(aside.getParent())
        out = self.fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.exists(at) and not self.fs.rename(aside, self.path(at)):
            raise OSError(f"cannot write {at}")

    def read_text(self, at: str) -> str:
        """A small file whole."""
        source = self.fs.open(self.path(at))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def partitions(self, root: str) -> list[tuple[str, str, str]]:
        """(folder, league, season) of every partition, from the listing alone."""
        found, unescape = [], self.jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        for league in self.fs.listStatus(self.path(root)):
            name = league.getPath().getName()
            if name.startswith("league="):
                for season in self.fs.listStatus(league.getPath()):
                    inner = season.getPath().getName()
                    if inner.startswith("season="):
                        found.append((f"{name}/{inner}", unescape(name[7:]), unescape(inner[7:])))
        return sorted(found)


class Rewrite:
    """A named run over the archive at `root`.

    `change` maps events of several units to new ones with the same columns and matches, in the same units; units are read with the columns of all of
    them. `complete`, if given, maps events to the (league, season) rows of the units in which something is left to do.
    `before_step(step, folder)` is called before every step; tests use it to end a run on purpose.
    """

    def __init__(self, spark: SparkSession, root: str, run: str, change: Callable[[DataFrame], DataFrame],
                 complete: Callable[[DataFrame], DataFrame] | None = None, before_step: Callable[[str, str], None] = lambda step, folder: None):
        self.spark, self.root, self.run, self.change, self.complete, self.before = spark, root.rstrip("/"), run, change, complete, before_step
        self.home = f"{self.root}_runs/{run}"
        self.folders = Folders(spark, self.root)

    def read(self, folders: str | list[str], base: str | None = None) -> DataFrame:
        """Events of partition folders with the folders' names as text columns, behind all others."""
        base, folders = base or self.root, [folders] if isinstance(folders, str) else folders
        paths = [f"{base}/{f}" for f in folders]
        found = self.spark.read.option("mergeSchema", "true").parquet(*paths).schema
        kept = [f for f in found if f.name not in UNIT]
        schema = T.StructType([*kept, *[T.StructField(n, T.StringType()) for n in UNIT]])
        rows = self.spark.read.schema(schema).option("basePath", base).parquet(*paths)
        return rows.withColumns({n: F.coalesce(n, F.lit(NO_NAME)) for n in UNIT})

    def planned(self) -> list[str]:
        at = f"{self.home}/plan"
        return [r.value for r in self.spark.read.text(at).collect() if r.value] if self.folders.exists(f"{at}/_SUCCESS") else []

    def plan(self, units=None, batch_size: int | None = None, batch_index: int = 0) -> list[str]:
        """Fix the run's units: all partitions or the (league, season) pairs given, in order, one batch window of them. A run that has a plan keeps it."""
        if not self.folders.exists(f"{self.home}/plan/_SUCCESS"):
            found = [folder for folder, league, season in self.folders.partitions(self.root) if units is None or (league, season) in set(map(tuple, units))]
            if batch_size:
                found = found[batch_index * batch_size:(batch_index + 1) * batch_size]
            self.spark.createDataFrame([(f,) for f in found], "value string").coalesce(1).write.mode("overwrite").text(f"{self.home}/plan")
        return self.planned()

    def _line(self, folder: str) -> str:
        return f"{self.home}/ledger/{folder.replace('/', ',')}.json"

    def _compare(self, old: DataFrame, new: DataFrame) -> dict:
        """Rows, changed rows and changed matches of each unit: rows by a content hash, matches by their order-free sum."""
        both = None
        for side, rows in enumerate((old, new.select(*old.columns))):
            hashed = F.xxhash64(*[c(n) for n in rows.columns])
            one = plain_columns(rows).select(*UNIT, "matchId", hashed.alias("h"), F.lit(side).alias("side"))
            both = one if both is None else both.unionByName(one)
        of = lambda side: c("side") == side
        rows = both.groupBy(*UNIT, "matchId", "h").agg(F.count_if(of(0)).alias("a"), F.count_if(of(1)).alias("b"))
        # a hash counts in the bits of its match if it is there an odd number of times
        bits = lambda n: F.coalesce(F.bit_xor(F.when(c(n) % 2 == 1, c("h"))), F.lit(0))
        match = rows.groupBy(*UNIT, "matchId").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), (bits("a") != bits("b")).alias("other"),
                                                   F.sum(F.greatest(c("b") - c("a"), F.lit(0))).alias("changed"))
        # rows without a match id equal none of the other side
        nameless = (c("a") > 0).cast("int") + (c("b") > 0).cast("int")
        differs = F.when(c("matchId").isNull(), nameless).otherwise((c("other") | (c("a") != c("b"))).cast("int"))
        units = match.groupBy(*UNIT).agg(F.sum("b").alias("rows"), F.sum("a").alias("rows_before"), F.sum(differs).alias("changed_matches"),
                                         F.sum("changed").alias("changed_rows"))
        return {(r.league, r.season): {n: r[n] for n in ("rows", "rows_before", "changed_matches", "changed_rows")} for r in units.collect()}  # a row per unit

    def _end(self, folder: str, status: str, numbers: dict) -> None:
        self.before("ledger", folder)
        self.folders.write_text(self._line(folder), json.dumps({"run": self.run, "folder": folder, "status": status, **numbers}))

    def _each(self, parallel: int, work: Callable, folders: list[str]) -> None:
        """Folder steps of units, some at a time."""
        with ThreadPoolExecutor(parallel) as pool:
            for done in [pool.submit(work, folder) for folder in folders]:
                done.result()

    def _stage(self, old: DataFrame, folders: list[str], parallel: int) -> None:
        """Changed rows of units written aside; a unit's folder is moved in whole after the job, so one that is there is complete."""
        for folder in folders:
            self.before("stage", folder)
        kept = [n for n in old.columns if n not in UNIT]
        new = self.change(old)
        missing = set(old.columns) - set(new.columns)
        if missing:
            raise ValueError(f"the change drops {sorted(missing)}")
        new = new.select(*kept, *[n for n in new.columns if n not in old.columns], *UNIT)
        aside = f"{self.home}/aside/{uuid.uuid4().hex}"
        by_folder(new, *UNIT).write.partitionBy(*UNIT).parquet(aside)

        def move(folder: str) -> None:
            if self.folders.exists(f"{aside}/{folder}"):
                self.folders.move(f"{aside}/{folder}", f"{self.home}/staged/{folder}")
            else:  # a unit without rows
                new.where("false").drop(*UNIT).write.mode("overwrite").parquet(f"{self.home}/staged/{folder}")

        self._each(parallel, move, folders)

    def _swap(self, folder: str, numbers: dict | None) -> None:
        live, staged, backup = f"{self.root}/{folder}", f"{self.home}/staged/{folder}", f"{self.home}/backup/{folder}"
        at = f"{self.home}/numbers/{folder.replace('/', ',')}.json"
        if numbers is not None:
            self.folders.write_text(at, json.dumps(numbers))
            self.before("backup", folder)
            self.folders.move(live, backup)
        if self.folders.exists(staged) and not self.folders.exists(live):
            self.before("swap", folder)
            self.folders.move(staged, live)
        self._end(folder, "applied", json.loads(self.folders.read_text(at)))

    def _units(self, folders: list[str], skip_complete: bool, parallel: int) -> None:
        """Some units through all their steps."""
        folders = [f for f in folders if not self.folders.exists(self._line(f))]
        swapped = [f for f in folders if self.folders.exists(f"{self.home}/backup/{f}")]
        self._each(parallel, lambda f: self._swap(f, None), swapped)
        todo = [f for f in folders if f not in set(swapped)]
        if todo and skip_complete and self.complete:
            old = self.read(todo)
            left = {tuple(r) for r in self.complete(old).select(*UNIT).distinct().collect()}  # a row per unit
            done = [f for f in todo if self._names(f)[1:] not in left]
            rows = {(r.league, r.season): r["count"] for r in old.groupBy(*UNIT).count().collect()} if done else {}  # a row per unit
            self._each(parallel, lambda f: self._end(f, "skipped_complete", {"rows": rows.get(self._names(f)[1:], 0)}), done)
            todo = [f for f in todo if f not in set(done)]
        if not todo:
            return
        fresh = [f for f in todo if not self.folders.exists(f"{self.home}/staged/{f}")]
        if fresh:
            self._stage(self.read(fresh), fresh, parallel)
        for folder in todo:
            self.before("compare", folder)
        old, staged = self.read(todo), self.read(todo, f"{self.home}/staged")
        numbers, added = self._compare(old, staged), set(staged.columns) - set(old.columns)

        def finish(folder: str) -> None:
            found = numbers.get(self._names(folder)[1:], dict.fromkeys(("rows", "rows_before", "changed_matches", "changed_rows"), 0))
            if not found["changed_matches"] and not added:
                return self._end(folder, "unchanged", found)
            self._swap(folder, found)

        self._each(parallel, finish, todo)

    def _names(self, folder: str) -> tuple[str, str, str]:
        unescape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        a, b = folder.split("/")
        return folder, unescape(a[7:]), unescape(b[7:])

    def apply(self, skip_complete: bool = False, parallel: int = 4) -> DataFrame:
        """Work through the plan, `UNITS` of it in a job and some folders at a time, and give the report. May be called again after any failure."""
        folders = self.plan()
        for at in range(0, len(folders), UNITS):
            self._units(folders[at:at + UNITS], skip_complete, parallel)
        return self.report()

    def report(self) -> DataFrame:
        """One row per planned unit: planned, skipped_complete, unchanged or applied, with rows and changes."""
        lines = f"{self.home}/ledger"
        schema = "folder string, status string, rows long, rows_before long, changed_matches long, changed_rows long"
        done = self.spark.read.schema(schema).json(lines) if self.folders.exists(lines) else self.spark.createDataFrame([], schema)
        units = self.spark.createDataFrame([self._names(f) for f in self.planned()], "folder string, league string, season string")
        return units.join(done, "folder", "left").select("league", "season", F.coalesce("status", F.lit("planned")).alias("status"), "rows", "rows_before",
                                                         "changed_matches", "changed_rows")
