"""A session with the settings that variant tables need."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: INFO ids are case-sensitive, `chr=1/` must stay text, and a non-append write replaces touched partitions only.
SETTINGS = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build(threads: int | str = "*", **more: str) -> SparkSession:
    """A local session unless a master is already set for this process (spark-submit)."""
    builder = SparkSession.builder.appName("varloom")
    if SparkSession.getActiveSession() is None and "spark.master" not in more:
        builder = builder.master(f"local[{threads}]")
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, by spark.checkpoint.dir; on a local master one of this machine will do."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="varloom-")
    return found
