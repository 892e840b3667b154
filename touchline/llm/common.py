"""What several text operators share: word rules, Arrow maps over whole rows, written intermediate tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.session import checkpoint_dir

#: Words between ASCII white space, as the near-duplicate and quality contracts take them.
SPACED_WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(column, UPPER, LOWER)


#: Rows of an Arrow batch for text columns; Spark's own default makes batches of tens of megabytes from long texts.
BATCH_ROWS = 2000


def in_batches(df: DataFrame) -> DataFrame:
    """The same frame, with the session's Arrow batches cut to `BATCH_ROWS` rows where they still have Spark's default."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(BATCH_ROWS))
    return df


def release() -> None:
    """Give freed memory back to the system: a worker that Spark keeps for later tasks then holds little."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mapped(df: DataFrame, batches, schema) -> DataFrame:
    """Map Arrow batches in tasks, with memory given back at the end of each task."""
    def run(source):
        try:
            yield from batches(source)
        finally:
            release()

    return in_batches(df).mapInArrow(run, schema)


def arrow_rows(df: DataFrame, schema: str, rows: Callable[..., Iterator[tuple]]) -> DataFrame:
    """Map whole rows in tasks. `rows` gets an iterator of tuples in the frame's column order (one Arrow batch in
    memory at a time) and yields tuples in the order of `schema`."""
    fields = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema
    out = to_arrow_schema(fields)

    def batches(source):
        def read():
            for batch in source:
                yield from zip(*(c.to_pylist() for c in batch.columns)) if batch.num_columns else ()
        pending, size = [], 0
        for row in rows(read()):
            pending.append(row)
            size += 64 + sum(len(v) for v in row if hasattr(v, "__len__"))
            if len(pending) >= 4096 or size >= 4_000_000:
                yield _batch(pending, out)
                pending, size = [], 0
        if pending:
            yield _batch(pending, out)

    return mapped(df, batches, fields)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def replace_text(df: DataFrame, change: Callable[[str], str], column: str = "text", length: str = "n_chars") -> DataFrame:
    """The same rows and columns with one text column rewritten in tasks; a null text stays null. The length
    column, if there is one, follows where the text changed."""
    names = df.columns

    def batches(source):
        for batch in source:
            at = names.index(column)
            before = batch.column(at).to_pylist()
            after = [None if t is None else change(t) for t in before]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(after, batch.schema.field(at).type))
            if length in names and (k := names.index(length)) != at:
                old = batch.column(k).to_pylist()
                new = [o if a == b else len(b) for o, a, b in zip(old, before, after)]
                batch = batch.set_column(k, batch.schema.field(k), pa.array(new, batch.schema.field(k).type))
            yield batch

    return mapped(df, batches, df.schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """A frame written to the shared folder and read back: each row is made once and lineage ends there."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_rows(df: DataFrame, limit: int) -> list | None:
    """All rows if there are at most `limit` of them, else None: a checked bound before anything is broadcast."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None
