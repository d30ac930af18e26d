"""Spectra to keyed token rows, and explicit row identity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..staging import staged

CHUNK = 1024


def locally_numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows in range partitions and sorted by ``order``, with _part and _local: the partition and the place in it."""
    schema = StructType([*df.schema.fields, StructField("_part", IntegerType()), StructField("_local", LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            extra = [pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(at, at + b.num_rows, dtype=np.int64))]
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=schema.names)

    ranged = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    return ranged.mapInArrow(number, schema)


def global_index(df: DataFrame, order: Sequence[str], name: str = "global_spectrum") -> DataFrame:
    """Number the rows 0.. in ``order`` without one task seeing all of them.

    Rows are range-partitioned and sorted, numbered within their partition and written; only a count for each
    partition comes to the driver. Ties are numbered in any order, so ``order`` should be total.
    """
    rows = staged(locally_numbered(df, order), "indexed")
    counts = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    base, total = [0] * (max(counts, default=-1) + 1), 0
    for part in range(len(base)):
        base[part], total = total, total + counts.get(part, 0)
    offset = F.element_at(F.lit(base or [0]), F.col("_part") + 1).cast("long")
    return rows.withColumn(name, offset + F.col("_local")).drop("_part", "_local")


def chunked(spectra: DataFrame, size: int = CHUNK) -> DataFrame:
    """Add chunk_idx and spectrum_idx (row in the chunk) from global_spectrum."""
    g = F.col("global_spectrum")
    return spectra.withColumns({"chunk_idx": F.floor(g / size).cast("int"), "spectrum_idx": (g % size).cast("int")})


def valid_mask(padding: Column) -> Column:
    """True for the latent token, then for every position that is not padding."""
    return F.concat(F.array(F.lit(True)), F.transform(padding, lambda x: ~x))


def flatten(spectra: DataFrame, mask: str = "valid", keys: Sequence[str] = ("spectrum_idx",)) -> DataFrame:
    """One row (keys, position) for each true place of a mask; place 0 is the latent token."""
    rows = spectra.select(*keys, F.posexplode(mask).alias("position", "ok"))
    return rows.where("ok").drop("ok")


def split_peaks(values: Column, mask: Column) -> Column:
    """Kept (mz, intensity) pairs of a spectrum: ``values`` is an array of pairs, as encoders take them."""
    return F.transform(F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda x: x["m"]), lambda x: F.struct(x["v"][0].alias("mz"), x["v"][1].alias("intensity")))


def padded(values: Column, size: Column, fill: Column) -> Column:
    """A ragged array filled up to ``size``."""
    return F.concat(values, F.array_repeat(fill, F.greatest(size - F.size(values), F.lit(0))))


def peak_rows(spectra: DataFrame, keys: Sequence[str] = ("chunk_idx", "spectrum_idx")) -> DataFrame:
    """One row for each peak (keys, position from 1, mz, intensity)."""
    return spectra.select(*keys, F.posexplode(F.arrays_zip("mz_array", "intensity_array")).alias("at", "p")).select(
        *keys, (F.col("at") + 1).alias("position"), F.col("p.mz_array").alias("mz"), F.col("p.intensity_array").alias("intensity")
    )


def with_latent(peaks: DataFrame, spectra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Peak rows and, for every spectrum, the latent row: position 0, m/z and intensity 0, other columns null."""
    latent = spectra.select(*keys, F.lit(0).alias("position"), F.lit(0.0).alias("mz"), F.lit(0.0).alias("intensity"))
    return peaks.unionByName(latent, allowMissingColumns=True)


def token_in_chunk(tokens: DataFrame) -> DataFrame:
    """Place of a token in its chunk, in order of spectrum and position: a window over one chunk's bounded rows."""
    place = F.row_number().over(W.partitionBy("chunk_idx").orderBy("spectrum_idx", "position")) - 1
    return tokens.withColumn("token_in_chunk", place)


def running_offset(counts: DataFrame, key: str, n: str) -> DataFrame:
    """Rows before each key: a cumulative sum over one row for each chunk."""
    before = F.sum(n).over(W.orderBy(key).rowsBetween(W.unboundedPreceding, -1))
    return counts.withColumn("offset", F.coalesce(before, F.lit(0)))


def cap_peaks(spectra: DataFrame, most: int, mz: str = "mz_array", intensity: str = "intensity_array") -> DataFrame:
    """Both arrays cut to the ``most`` most intense peaks of a spectrum (ties: the earlier one), in stored order."""
    peaks = F.transform(F.arrays_zip(F.col(mz).alias("m"), F.col(intensity).alias("i")), lambda x, at: F.struct((-x["i"]).alias("k"), at.alias("at"), x["m"].alias("m"), x["i"].alias("i")))
    kept = F.array_sort(F.transform(F.slice(F.array_sort(peaks), 1, most), lambda x: F.struct(x["at"].alias("at"), x["m"].alias("m"), x["i"].alias("i"))))
    rows = spectra.withColumn("_kept", F.when(F.size(mz) > most, kept))
    keep = lambda c, field: F.coalesce(F.transform("_kept", lambda x: x[field]), F.col(c)).alias(c)
    return rows.withColumns({mz: keep(mz, "m"), intensity: keep(intensity, "i")}).drop("_kept")


def first_tokens(tokens: DataFrame, most: int) -> DataFrame:
    """The first ``most`` tokens by (chunk_idx, token_in_chunk), with their number as token_id.

    Offsets come from one row for each chunk, and chunks past the last one needed are not read.
    """
    offsets = running_offset(tokens.groupBy("chunk_idx").agg(F.count("*").alias("n")), "chunk_idx", "n")
    wanted = capped(offsets, "offset", most).select("chunk_idx", "offset")
    numbered = tokens.join(F.broadcast(wanted), "chunk_idx").withColumn("token_id", F.col("offset") + F.col("token_in_chunk"))
    return capped(numbered, "token_id", most).drop("offset")


def capped(tokens: DataFrame, key: str, most: int) -> DataFrame:
    """First ``most`` values of a number that starts at 0: a predicate that reaches the scan, unlike a limit."""
    return tokens.where(F.col(key) < most)
