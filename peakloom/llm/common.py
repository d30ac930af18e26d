"""What the training-data operators share: folders, staging and batched text handling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import delete_path, shared_dir
from ..staging import staged as _staged

__all__ = ["drop_staged", "fold", "partitions", "ragged", "shared_dir", "slices", "staged", "tasks_for"]


def staged(df: DataFrame, name: str, codec: str = "zstd", files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, in at most ``files`` files if given."""
    return _staged(df.coalesce(files) if files and files < partitions(df.sparkSession) else df, name, codec)


def tasks_for(spark: SparkSession, rows: int, row_bytes: int) -> int:
    """Tasks for a table of known size: 32 MB each, but four for each core, so that small tables are no more files than that."""
    return max(4 * spark.sparkContext.defaultParallelism, -(-rows * row_bytes // (32 << 20)))


def drop_staged(df: DataFrame) -> None:
    """Delete the files that ``staged`` wrote, once nothing will read them again."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        delete_path(df.sparkSession, folder)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: str = "doc_id"):
    """True for rows held out of training: crc32 of the id as text, modulo 4, is 2. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about ``most`` bytes of ``column`` (a longer value stands alone)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate ``values[s:s+n]`` for each start and length without a loop."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return values[:0]
    index = np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)
    return values[index]
