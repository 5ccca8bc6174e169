"""Session helpers: a tuned local session, and lineage cuts that survive lost executors."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "codequarry", cpus: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with the settings every query here is written for (a cluster brings its own)."""
    cpus = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # a checkpoint goes when its frame does
        .getOrCreate()
    )


def scratch(spark: SparkSession) -> str:
    """The session's folder below ``spark.checkpoint.dir``, which all executors share; only a local session gets a private one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="codequarry-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` by checkpoint() in the session's shared folder, so a lost executor loses nothing.

    Set ``spark.cleaner.referenceTracking.cleanCheckpoints`` when the session starts, as ``build_session`` does: then files of
    frames that are no longer in use are removed.
    """
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A frame read straight from files, over at least as many partitions as the session has cores.

    For work that is heavy for each byte read. Input with more partitions than cores, as any large one has, isn't moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
