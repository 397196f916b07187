"""Settings the jobs rely on, for callers that build their own session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Recording a Python stack per column expression costs more than planning these queries.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: str | int | None = None, memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and benchmarks. On a cluster, pass the cluster's own session instead."""
    cores = str(cores or os.environ.get("BENCH_CPUS") or 8)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("grootboek")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else cores)
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
