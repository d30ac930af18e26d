"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, below a temporary folder if all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="peakloom-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        base = "file://" + _OWN[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, codec: str = "zstd", **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors. ``options``: the writer's."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", codec).options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_parts(df: DataFrame, name: str, *keys: str) -> tuple[DataFrame, str]:
    """The same in folders by ``keys``, with the path, which the caller deletes."""
    path = shared_dir(df.sparkSession, name)
    df.write.partitionBy(*keys).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return bool(folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder))


def delete_path(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return bool(folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True))
