"""Session settings for tests and local runs; a cluster brings its own."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, app: str = "touchline", shuffle: int | None = None) -> SparkSession:
    return (SparkSession.builder.master(f"local[{cpus}]").appName(app)
            .config("spark.sql.shuffle.partitions", str(shuffle or cpus))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.ui.enabled", "false")
            .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # a stack walk for every column expression
            .config("spark.driver.memory", "12g")
            .config("spark.sql.warehouse.dir", os.path.join(tempfile.gettempdir(), "touchline-warehouse"))
            .getOrCreate())


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster. Where none is named, a local session gets a temporary one of its own; a cluster must name one,
    as a folder of one machine would be lost to the others."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="touchline-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def materialise(df, name: str = "rows"):
    """Write a frame to the shared checkpoint folder and read it back: lineage ends there, and losing an
    executor costs a re-read instead of a re-run."""
    import uuid
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
