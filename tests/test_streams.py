"""State kept over micro-batches and restarts against the batch operators."""

import numpy as np
import pandas as pd

from peakloom.operators import associations
from peakloom.streaming import state
from peakloom.streaming.chunks import stream_chunks

KEYS = ["chunk_idx", "token_in_chunk"]


def rows_of(spark, chunks, seed=0):
    rng = np.random.default_rng(seed)
    labels, features = [], []
    for c in chunks:
        for t in range(30):
            labels.append((c, t, int(rng.integers(0, 8))))
            features += [(c, t, int(f), float(rng.integers(0, 5))) for f in rng.choice(6, 3, replace=False)] + [(c, t, 9, 1.0)]  # 9 fires everywhere, with ties
    return spark.createDataFrame(features, "chunk_idx int, token_in_chunk long, feature_idx int, activation double"), spark.createDataFrame(labels, "chunk_idx int, token_in_chunk long, concepts long")


def as_set(df, columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_states_equal_batches_after_each_restart(spark, tmp_path):
    source, target, progress = (f"file://{tmp_path}/{n}" for n in ("in", "out", "cp"))
    done = []
    for some in ([0, 1, 2], [3], [4, 5]):
        done += some
        for c in some:
            piece = state.labelled(*rows_of(spark, [c], c))
            piece.coalesce(1).write.mode("append").parquet(source)
        state.keep_states(stream_chunks(spark, source, piece.schema), target, progress, 3, 7).awaitTermination()
        features, labels = (a.unionByName(b) if b is not None else a for a, b in [(x, None) for x in rows_of(spark, [done[0]], done[0])])
        for c in done[1:]:
            more = rows_of(spark, [c], c)
            features, labels = features.unionByName(more[0]), labels.unionByName(more[1])
        states = state.last_states(spark, target)
        top = ["feature_idx", "rank", "activation", *KEYS]
        assert as_set(state.top_tokens_of(states), top) == as_set(associations.top_tokens(features.where("activation > 0"), 7, KEYS), top)
        counts = ["feature_idx", "concept_idx", "n11", "mf", "mc", "n"]
        assert as_set(state.contingency_of(states, 12), counts) == as_set(associations.contingency(features, labels, 12, 3, KEYS), counts)


def test_merging_hangs_on_no_order():
    rng = np.random.default_rng(1)
    parts = [(n, rng.integers(0, n + 1, 3), rng.integers(0, 3, n).astype(float), rng.integers(0, 2, n), rng.integers(0, 99, n)) for n in (4, 1, 0, 6)]
    want = state.merged(parts, 5)
    for order in ((3, 1, 0, 2), (2, 3, 1, 0)):
        got = state.merged([state.merged([parts[i] for i in order[:2]], 5), *[parts[i] for i in order[2:]]], 5)
        assert got[0] == want[0] and all(np.array_equal(a, b) for a, b in zip(got[1:], want[1:], strict=True))


def test_partial_states_are_one_row_for_each_feature_of_a_task(spark):
    rows = state.labelled(*rows_of(spark, [0, 1])).coalesce(1)
    got = state.partial_states(rows, 3, 4).toPandas()
    assert sorted(got["feature_idx"]) == [-1, 0, 1, 2, 3, 4, 5, 9] and isinstance(got, pd.DataFrame)
    assert got.set_index("feature_idx").loc[9, "n"] == 60 and len(got.set_index("feature_idx").loc[9, "activation"]) == 4
