"""Tables stored in buckets of their token keys, so that joins and groups by these keys move no row.

Files are external Parquet tables of the session's catalogue with a bucket specification. The specification lies
beside the files, so another session registers the same files again before it reads them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..staging import delete_path, path_exists

#: Tokens of one bucket, and the least number of buckets.
TOKENS, LEAST = 200_000, 8


def buckets_for(tokens: int) -> int:
    """A power of two, so that tables of nearly the same size get the same number; it hangs on the data alone."""
    return max(LEAST, 1 << max(0, (tokens // TOKENS)).bit_length())


def _name(path: str) -> str:
    return "peakloom_" + hashlib.md5(path.rstrip("/").encode()).hexdigest()


def write_bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> None:
    """One file for each bucket, sorted by ``keys``. The rows are moved here, once, by the hash that names the bucket."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    dealt = df.repartition(buckets, *keys).sortWithinPartitions(*keys)
    dealt.write.format("parquet").mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(_name(path))
    spec = json.dumps({"keys": list(keys), "buckets": buckets})
    spark.createDataFrame([(spec,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.buckets")


def is_bucketed(spark: SparkSession, path: str) -> bool:
    """True if the table and its specification are complete."""
    return path_exists(spark, f"{path}/_SUCCESS") and path_exists(spark, f"{path}.buckets/_SUCCESS")


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The table with its buckets, registered in this session's catalogue if it is not there."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        spec = json.loads(spark.read.text(f"{path}.buckets", wholetext=True).first()[0])
        keys = ", ".join(f"`{k}`" for k in spec["keys"])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {spec['buckets']} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def drop_bucketed(spark: SparkSession, path: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    delete_path(spark, path)
    delete_path(spark, f"{path}.buckets")


def co_located(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join of two tables in equal buckets of ``keys``, bucket by bucket."""
    return left.join(right.hint("merge"), list(keys), how)
