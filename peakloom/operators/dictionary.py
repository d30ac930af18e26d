"""Sparse dictionaries: encoding, reconstruction, sweeps and geometry.

A dictionary is a table (feature_idx, w_enc, b_enc, w_dec) with the shared decoder bias and threshold. Its weights are
bounded by d_model x d_dict and checked against ``WEIGHT_BYTES`` before they are sent to the workers; activations
grow with the data and are only ever streamed past them in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import d, dot
from ..staging import staged

WEIGHT_BYTES = 1 << 30
#: Groups in which the sums of tasks meet first.
FAN = 64
#: Features of a dictionary that is joined in column expressions.
FEW = 256
MULTIPLIERS = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0)


@dataclass
class Dictionary:
    w_enc: np.ndarray  # d_model x d_dict
    b_enc: np.ndarray
    w_dec: np.ndarray  # d_dict x d_model
    b_dec: np.ndarray
    threshold: float
    firing_count: np.ndarray | None = None
    info: dict = field(default_factory=dict)

    def preactivations(self, x: np.ndarray) -> np.ndarray:
        return (x - self.b_dec) @ self.w_enc + self.b_enc

    def encode(self, x: np.ndarray, scale: float = 1.0) -> np.ndarray:
        h = self.preactivations(x)
        return np.where(h > self.threshold * scale, h, 0.0)

    def decode(self, features: np.ndarray, bias: bool = True) -> np.ndarray:
        return features @ self.w_dec + (self.b_dec if bias else 0.0)

    def table(self, spark: SparkSession) -> DataFrame:
        n = self.w_dec.shape[0]
        listed = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x, float).ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
        rows = pa.table({"feature_idx": pa.array(np.arange(n, dtype=np.int32)), "w_enc": listed(self.w_enc.T), "b_enc": pa.array(self.b_enc.astype(float)), "w_dec": listed(self.w_dec)})
        return spark.createDataFrame(rows, "feature_idx int, w_enc array<double>, b_enc double, w_dec array<double>")


def from_table(rows: DataFrame, threshold: float, b_dec: np.ndarray | None = None) -> Dictionary:
    """Read a dictionary's rows to the driver, after a check of their size."""
    size = rows.agg(F.sum(F.size("w_enc") + F.size("w_dec"))).first()[0] or 0
    if 8 * size > WEIGHT_BYTES:
        raise ValueError(f"the dictionary takes {8 * size} bytes; encode by blocks of features")
    got = rows.select("feature_idx", "w_enc", "b_enc", "w_dec").toArrow().sort_by("feature_idx")
    enc, dec = (matrix(got.column(c).combine_chunks()) for c in ("w_enc", "w_dec"))
    return Dictionary(enc.T.copy(), got.column("b_enc").to_numpy(), dec, np.zeros(enc.shape[1]) if b_dec is None else b_dec, threshold)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def encode_sparse(activations: DataFrame, dictionary: Dictionary, keys: Sequence[str], vector: str = "activation") -> DataFrame:
    """keys, feature_idx, activation of every feature over the threshold (strictly); features at 0 are not stored."""
    schema = activations.select(*keys).schema.simpleString()[7:-1].replace(":", " ") + ", feature_idx int, activation double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            f = dictionary.encode(matrix(b.column(vector)))
            row, feature = np.nonzero(f)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in keys), pa.array(feature, pa.int32()), pa.array(f[row, feature])], names=[*keys, "feature_idx", "activation"])

    return activations.select(*keys, vector).mapInArrow(run, schema)


def encode_exact(activations: DataFrame, dictionary: DataFrame, threshold: float, keys: Sequence[str], vector: str = "activation") -> DataFrame:
    """The same in column expressions, for dictionaries of a few features (at most ``FEW``, checked) and no decoder bias."""
    if dictionary.limit(FEW + 1).count() > FEW:
        raise ValueError(f"more than {FEW} features; encode_sparse takes them")
    h = dot(F.col(vector), F.col("w_enc")) + F.col("b_enc")
    rows = activations.select(*keys, vector).join(F.broadcast(dictionary.select("feature_idx", "w_enc", "b_enc")))
    return rows.select(*keys, "feature_idx", h.alias("activation")).where(F.col("activation") > threshold)


def reconstruction(activations: DataFrame, dictionary: Dictionary, scales: Sequence[float] = (1.0,), vector: str = "activation") -> DataFrame:
    """One row for each threshold scale with every reconstruction and sparsity metric, in a single pass.

    Each task sums squared residuals, squares, column sums, active features and firing counts of its rows; the sums
    of tasks meet in two small aggregations by scale.
    """
    schema = "scale double, salt int, n long, resid double, total double, active double, sums array<double>, firing array<long>"
    types = [pa.float64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64())]
    names = ["scale", "salt", "n", "resid", "total", "active", "sums", "firing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        d_dict, d_model = dictionary.w_dec.shape
        acc = {s: [0, 0.0, 0.0, 0.0, np.zeros(d_model), np.zeros(d_dict, np.int64)] for s in scales}
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(vector))
            h = dictionary.preactivations(x)
            for s in scales:
                f = np.where(h > dictionary.threshold * s, h, 0.0)
                a = acc[s]
                a[0] += len(x)
                a[1] += float(((x - dictionary.decode(f)) ** 2).sum())
                a[2] += float((x**2).sum())
                a[3] += float((f != 0).sum())
                a[4] += x.sum(0)
                a[5] += (f > 0).sum(0)
        salt = TaskContext.get().partitionId() % FAN
        rows = [(s, salt, *a[:4], a[4].tolist(), a[5].tolist()) for s, a in acc.items() if a[0]]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    def add(group: pa.Table) -> pa.Table:
        """One row with the sums of all columns."""
        head = [group.column(c)[0].as_py() for c in ("scale", "salt")]
        sums = [np.asarray(group.column(c).to_numpy()).sum() for c in names[2:6]]
        arrays = [matrix(group.column(c).combine_chunks()).sum(0) for c in ("sums", "firing")]
        return pa.table([pa.array([v], t) for v, t in zip([*head, *sums, arrays[0].tolist(), arrays[1].astype(np.int64).tolist()], types, strict=True)], names=names)

    # Tasks' sums meet in FAN groups of each scale, then in one, so that no task holds the arrays of all.
    parts = activations.select(vector).mapInArrow(run, schema).groupBy("scale", "salt").applyInArrow(add, schema)
    summed = parts.groupBy("scale").applyInArrow(add, schema)
    centred = F.greatest(F.col("total") - F.aggregate("sums", d(0), lambda a, x: a + x * x) / F.col("n"), d(1e-12))
    width, size = dictionary.w_dec.shape[1], dictionary.w_dec.shape[0]
    near = F.greatest(F.lit(1), F.floor(F.col("n") / 100000))
    share = lambda cond: F.size(F.filter("firing", cond)) * 100.0 / size
    ordered = F.transform(F.array_sort("firing"), lambda x, i: x.cast("double") * (i + 1))
    total_fired = F.aggregate("firing", d(0), lambda a, x: a + x)
    weighted = F.aggregate(ordered, d(0), lambda a, x: a + x)
    return summed.select(
        "scale", F.col("n").alias("n_tokens"), (1 - F.col("resid") / centred).alias("fve_overall"), (1 - F.col("resid") / F.greatest("total", d(1e-12))).alias("fve_uncentered"),
        (F.col("resid") / (F.col("n") * width)).alias("mse_total"), (F.col("resid") / F.col("n")).alias("sse_per_token"), (F.col("active") / F.col("n")).alias("l0_mean"),
        share(lambda x: x == 0).alias("strict_dead_pct"), share(lambda x: x < near).alias("near_dead_pct"),
        F.when(total_fired > 0, (2 * weighted - (size + 1) * total_fired) / (size * total_fired)).otherwise(d(0)).alias("firing_rate_gini"), F.col("firing").alias("firing_count"),
    )


def threshold_sweep(activations: DataFrame, dictionary: Dictionary, multipliers: Sequence[float] = MULTIPLIERS) -> DataFrame:
    """multiplier, fve, l0_mean, dead_pct for every multiplier, all in one pass."""
    return reconstruction(activations, dictionary, multipliers).select(F.col("scale").alias("multiplier"), F.col("fve_overall").alias("fve"), "l0_mean", F.col("strict_dead_pct").alias("dead_pct"))


def firing_counts(features: DataFrame, all_features: DataFrame) -> DataFrame:
    """feature_idx, firing_count of every feature, dead ones included."""
    counts = features.where("activation > 0").groupBy("feature_idx").agg(F.count("*").alias("firing_count"))
    return all_features.select("feature_idx").join(counts, "feature_idx", "left").withColumn("firing_count", F.coalesce("firing_count", F.lit(0)))


def layer_mean(activations: DataFrame, most: int = 200_000, key: str = "token_id", vector: str = "activation") -> DataFrame:
    """dim, mean over the first ``most`` tokens, in double."""
    rows = activations.where(F.col(key) < most).select(F.posexplode(vector).alias("dim", "x"))
    return rows.groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def encoder_decoder_alignment(dictionary: DataFrame) -> DataFrame:
    """Mean |cosine| of encoder columns and decoder rows."""
    norm = F.sqrt(dot(F.col("w_enc"), F.col("w_enc")) * dot(F.col("w_dec"), F.col("w_dec")))
    return dictionary.agg(F.avg(F.abs(dot(F.col("w_enc"), F.col("w_dec")) / F.greatest(norm, d(1e-12)))).alias("encoder_decoder_alignment"))


def near_duplicate_directions(rows: DataFrame, cosine: float = 0.95, sample: int = 2000, seed: int = 0, key: str = "feature_idx", vector: str = "w_dec", draw: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """a, b, cosine of the pairs over ``cosine`` within a fixed-size hash sample; both of its sides are bounded by it."""
    drawn = rows.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).orderBy(draw(key, F.lit(seed)), key).limit(sample)
    unit = drawn.withColumn("v", F.transform("v", lambda x: x / F.greatest(F.sqrt(dot(F.col("v"), F.col("v"))), d(1e-12))))
    a, b = unit.select(F.col("k").alias("a"), F.col("v").alias("va")), unit.select(F.col("k").alias("b"), F.col("v").alias("vb"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", dot(F.col("va"), F.col("vb")).alias("cosine")).where(F.col("cosine") > cosine)


def geometry(dictionary: Dictionary, spark: SparkSession, sample: int = 2000) -> dict:
    """The report of the geometric phase: near-duplicates of a drawn sample, as reports have them, and of all directions."""
    from .directions import effective_rank, pairs_over, unit_rows

    table = staged(dictionary.table(spark), "dictionary")
    return {
        "near_duplicate_pairs": pairs_over(unit_rows(table), 0.95).count(),
        "encoder_decoder_alignment": encoder_decoder_alignment(table).first()[0],
        "near_duplicate_pairs_in_sample": near_duplicate_directions(table, sample=sample).count(),
        "near_duplicate_sample_size": min(sample, dictionary.w_dec.shape[0]),
        "near_duplicate_cosine_threshold": 0.95,
        "effective_rank": effective_rank(table),
    }
