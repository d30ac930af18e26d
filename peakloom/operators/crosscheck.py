"""Features across layers and seeds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import d
from ..sources.bucketed import co_located


def products(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """anchor, feature_idx, sxy: sums of x * y over tokens from lists of both sides (keys, feature_idx, activation).

    Each side is one list for each token, so a join moves or meets tokens and not pairs of features; on tables in equal
    buckets of ``keys`` nothing is moved at all. A task multiplies the lists of a batch as sparse blocks and adds up
    one number for each pair that it meets, and only these are shuffled: at most tasks x anchors x features rows.
    """

    def listed(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.collect_list(F.struct(F.col("feature_idx").cast("int").alias("f"), F.col("activation").cast("double").alias("v"))).alias(name))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = np.zeros(0, np.int64), np.zeros(0)
        for b in batches:
            (na, fa, va), (nb, fb, vb) = (_blocks(b.column(c)) for c in ("a", "b"))
            repeat = np.repeat(nb, na)  # each entry of the left meets all of the right in its token
            start = np.repeat(np.cumsum(nb) - nb, na)
            at = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat) + np.repeat(start, repeat)
            pair = np.repeat(fa.astype(np.int64) << 32, repeat) | fb[at]
            index, inverse = np.unique(np.concatenate([index, pair]), return_inverse=True)
            total = np.bincount(inverse, np.concatenate([total, np.repeat(va, repeat) * vb[at]]), len(index))
        if len(index):
            yield pa.RecordBatch.from_arrays([pa.array((index >> 32).astype(np.int32)), pa.array((index & 0xFFFFFFFF).astype(np.int32)), pa.array(total)], names=["anchor", "feature_idx", "sxy"])

    met = co_located(listed(left, "a"), listed(right, "b"), keys).select("a", "b")
    return met.mapInArrow(multiply, "anchor int, feature_idx int, sxy double").groupBy("anchor", "feature_idx").agg(F.sum("sxy").alias("sxy"))


def _blocks(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = column.flatten()
    return column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), *(flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))


def feature_correlation(anchors: DataFrame, others: DataFrame, n_tokens: int, keys: Sequence[str]) -> DataFrame:
    """anchor, layer, feature_idx, r: Pearson over ``n_tokens`` shared tokens from sparse activations.

    ``anchors``: keys, feature_idx, activation of the anchor features; ``others`` with a layer as well. Absent rows are
    zeros, so sums over stored rows and the number of tokens give every moment. A constant side has r 0.
    """
    a, b = (x.withColumn("activation", F.col("activation").cast("double")) for x in (anchors, others))
    moments = lambda df, s, *by: df.groupBy(*by).agg(F.sum("activation").alias(f"s{s}"), F.sum(F.col("activation") * F.col("activation")).alias(f"s{s}{s}"))
    sa, sb = moments(a.withColumnRenamed("feature_idx", "anchor"), "x", "anchor"), moments(b, "y", "layer", "feature_idx")
    layers = sorted(r["layer"] for r in b.select("layer").distinct().collect())  # a few
    if not layers:
        return sa.join(sb).select("anchor", "layer", "feature_idx", d(0).alias("r"))
    parts = [products(a, b.where(F.col("layer") == layer), keys).withColumn("layer", F.lit(layer)) for layer in layers]
    grid = sa.join(F.broadcast(sb)).join(reduce(DataFrame.unionByName, parts), ["anchor", "layer", "feature_idx"], "left")
    n = d(n_tokens)
    cov = n * F.coalesce("sxy", d(0)) - F.col("sx") * F.col("sy")
    var = F.greatest(n * F.col("sxx") - F.col("sx") * F.col("sx"), d(0)) * F.greatest(n * F.col("syy") - F.col("sy") * F.col("sy"), d(0))
    return grid.select("anchor", "layer", "feature_idx", F.when(var > 0, cov / F.sqrt(F.greatest(var, d(1e-300)))).otherwise(d(0)).alias("r"))


def top_matches(correlations: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` features of each layer with the highest signed r for each anchor, rank from 1."""
    order = W.partitionBy("anchor", "layer").orderBy(F.col("r").desc(), "feature_idx")
    return correlations.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def match_table(top: DataFrame, anchor_layer: int, layers: Sequence[int], k: int = 5) -> DataFrame:
    """One row for each anchor: best feature, its r, and the list ``F7:0.812;...`` for every layer."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature_idx", "r"))), lambda x: F.format_string("F%d:%.3f", x["feature_idx"], x["r"])), ";")
    rows = top.groupBy("anchor").pivot("layer", list(layers)).agg(F.min_by("feature_idx", "rank").alias("best_feature"), F.min_by("r", "rank").alias("best_corr"), text.alias(f"top{k}"))
    names = {f"{layer}_{c}": f"L{layer}_{c}" for layer in layers for c in ("best_feature", "best_corr", f"top{k}")}
    return rows.select(F.lit(anchor_layer).alias("anchor_layer"), F.col("anchor").alias("anchor_feature"), *[F.col(a).alias(b) for a, b in names.items()])


def seed_overlap(mine: DataFrame, seeds: DataFrame, k: int = 10) -> DataFrame:
    """concept, seed, intersection, union, jaccard of top-``k`` feature lists; seeds without a list are skipped.

    ``mine``: concept, rank, feature_idx (rank from 1); ``seeds`` with a seed as well.
    """
    a = mine.where(F.col("rank") <= k).groupBy("concept").agg(F.collect_set("feature_idx").alias("a"))
    b = seeds.where(F.col("rank") <= k).groupBy("concept", "seed").agg(F.collect_set("feature_idx").alias("b"))
    both, any_of = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    return a.join(b, "concept").select("concept", "seed", both.alias("intersection"), any_of.alias("union"), (both / F.greatest(any_of, F.lit(1))).alias("jaccard"))


def shared_sample(features: DataFrame, tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Activations of the sampled tokens; the sample is bounded by its option, not by the data."""
    return features.join(F.broadcast(tokens.select(*keys)), list(keys))


def mean_jaccard(overlap: DataFrame) -> DataFrame:
    return overlap.groupBy("concept").agg(F.avg("jaccard").alias("mean_jaccard"), F.sort_array(F.collect_list(F.struct("seed", "intersection", "union", "jaccard"))).alias("per_seed"))


def missing_layers(requested: Sequence[int], present: DataFrame, layer: str = "layer") -> DataFrame:
    """Requested layers that a table does not hold."""
    wanted = present.sparkSession.createDataFrame([(int(x),) for x in requested], "layer int")
    return wanted.join(present.select(F.col(layer).cast("int").alias("layer")).distinct(), "layer", "left_anti")
