"""Session defaults for the engine; a session that exists already is left alone."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of long texts: smaller batches to Python than the defaults, where the session sets none.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}
ROOT = str(Path(__file__).resolve().parent.parent)


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; on a cluster leave ``master`` unset."""
    builder = (
        SparkSession.builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return ready(builder.getOrCreate())


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when the driver found it through ``sys.path`` only."""
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    environment.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")  # freed batches go back to the system
    for key, value in ARROW.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the named Parquet tables below ``sf_dir``, whatever store it lies in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
