"""Results of phases 3 and 4 kept up to date as chunks arrive: mergeable state of each feature in Spark's state store.

What a task of a micro-batch sees is merged there by feature (counts add up, top rows are merged and cut), so a hot
feature is one row for each task before anything is shuffled. The state of a feature takes these rows in with the same
merge, whatever their order. Each micro-batch appends the features that it changed under its number; a batch that runs
again after a failure writes the same folder, and a stream that is started again goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .chunks import write_increments

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The row that stands for all tokens: its counts are the concepts' own.
ALL = -1
STATE = "n long, counts array<long>, activation array<double>, chunk_idx array<int>, token_in_chunk array<long>"
SCHEMA = f"feature_idx int, {STATE}"


def labelled(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of one or more chunks as ``update`` takes them: firing features with their token's concepts, and all tokens.

    Chunks hold whole tokens, so features and labels meet inside a chunk, before the stream.
    """
    keys = ["chunk_idx", "token_in_chunk"]
    fired = features.where("activation > 0").join(labels.select(*keys, "concepts"), keys).select("feature_idx", "activation", *keys, "concepts")
    return fired.unionByName(labels.select(F.lit(ALL).alias("feature_idx"), F.lit(0.0).alias("activation"), *keys, "concepts"))


def merged(parts: list[tuple], k: int) -> tuple:
    """n, counts, and the ``k`` rows of largest activation (ties: the earlier token) of several such tuples."""
    activation, chunk, token = (np.concatenate([np.asarray(p[i], t) for p in parts]) for i, t in ((2, float), (3, np.int64), (4, np.int64)))
    best = np.lexsort((token, chunk, -activation))[:k]
    return sum(int(p[0]) for p in parts), np.sum([np.asarray(p[1], np.int64) for p in parts], axis=0), activation[best], chunk[best], token[best]


def partial_states(rows: DataFrame, n_concepts: int, k: int) -> DataFrame:
    """One row of state for each feature that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for b in batches:
            feature, activation, chunk, token, mask = (b.column(c).to_numpy(zero_copy_only=False) for c in ("feature_idx", "activation", "chunk_idx", "token_in_chunk", "concepts"))
            bits = (mask[:, None] >> np.arange(n_concepts)) & 1
            order = np.lexsort((token, chunk, -activation, feature))
            found, first = np.unique(feature[order], return_index=True)
            for f, own in zip(found.tolist(), np.split(order, first[1:]), strict=True):
                top = own[: k if f != ALL else 0]
                state = (len(own), bits[own].sum(0), activation[top], chunk[top], token[top])
                held[f] = merged([held[f], state], k) if f in held else state
        if held:
            columns = [list(held), *[[s[i] for s in held.values()] for i in range(5)]]
            types = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["feature_idx", "n", "counts", "activation", "chunk_idx", "token_in_chunk"])

    return rows.select("feature_idx", F.col("activation").cast("double").alias("activation"), F.col("chunk_idx").cast("int"), F.col("token_in_chunk").cast("long"), "concepts").mapInArrow(run, SCHEMA)


class FeatureState(StatefulProcessor):
    """Takes the rows of a micro-batch into the state of their feature and gives the new state."""

    def __init__(self, k: int) -> None:
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803 (names of the interface)
        parts = [self.state.get()] if self.state.exists() else []
        for frame in rows:
            parts += list(frame[["n", "counts", "activation", "chunk_idx", "token_in_chunk"]].itertuples(index=False, name=None))
        n, counts, *top = merged(parts, self.k)
        lists = [counts.tolist(), *[t.tolist() for t in top]]
        self.state.update((n, *lists))
        yield pd.DataFrame({"feature_idx": [key[0]], "n": [n], **{c: [v] for c, v in zip(("counts", "activation", "chunk_idx", "token_in_chunk"), lists, strict=True)}})

    def close(self) -> None:
        pass


def keep_states(rows: DataFrame, target: str, checkpoint: str, n_concepts: int, k: int = 20):
    """Start a stream that keeps the state of every feature of ``labelled`` rows and appends changed ones to ``target``."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    states = partial_states(rows, n_concepts, k).groupBy("feature_idx").transformWithStateInPandas(FeatureState(k), SCHEMA, "Update", "None")
    return write_increments(states, lambda df: df, target, checkpoint)


def last_states(spark: SparkSession, target: str) -> DataFrame:
    """The state of each feature after the last batch that changed it."""
    rows = spark.read.schema(f"{SCHEMA}, batch long").parquet(target)
    fields = [c for c in rows.columns if c not in ("feature_idx", "batch")]
    return rows.groupBy("feature_idx").agg(F.max_by(F.struct(*fields), "batch").alias("x")).select("feature_idx", "x.*")


def top_tokens_of(states: DataFrame) -> DataFrame:
    """feature_idx, rank, activation, chunk_idx, token_in_chunk, as ``associations.top_tokens`` gives them."""
    rows = states.where(F.col("feature_idx") != ALL).select("feature_idx", F.posexplode(F.arrays_zip("activation", "chunk_idx", "token_in_chunk")).alias("rank", "x"))
    return rows.select("feature_idx", "rank", "x.activation", "x.chunk_idx", "x.token_in_chunk")


def contingency_of(states: DataFrame, n_features: int) -> DataFrame:
    """feature_idx, concept_idx, n11, mf, mc, n over all features, as ``associations.contingency`` gives them."""
    spark = states.sparkSession
    every = spark.range(n_features).select(F.col("id").cast("int").alias("feature_idx"))
    total = states.where(F.col("feature_idx") == ALL).select(F.col("n").alias("total"), F.posexplode("counts").alias("concept_idx", "mc"))
    own = states.where(F.col("feature_idx") != ALL).select("feature_idx", F.col("n").alias("mf"), "counts")
    rows = every.join(own, "feature_idx", "left").join(F.broadcast(total))  # a row for each concept
    return rows.select("feature_idx", "concept_idx", F.coalesce(F.get("counts", F.col("concept_idx")), F.lit(0)).alias("n11"), F.coalesce("mf", F.lit(0)).alias("mf"), "mc", F.col("total").alias("n"))
