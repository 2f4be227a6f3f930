"""The session this engine is written for."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def build(name: str = "corpusloom", master: str | None = None, **conf: object) -> SparkSession:
    """A session with UTC times, adaptive execution (skew joins, coalescing) and Arrow; ``conf`` keys have dots or underscores for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": "1000",
        "spark.ui.showConsoleProgress": "false",
    } | {k if "." in k else k.replace("_", "."): str(v) for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it; clusters without such a path take it by ``--py-files``."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def spread(df):
    """``df`` dealt out to all cores if its scan has fewer tasks, as one small file has; a large input stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
