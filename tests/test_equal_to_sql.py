"""Queries against their SQL, digit by digit, on tables on which they once differed."""

from collections import Counter

import pytest

from oracle import connect
from peakloom.plans import catalogue


def exact(spark, name, folder):
    df = catalogue.queries()[name](spark, folder)
    names = sorted(df.columns)
    mine = Counter(tuple(r[c] for c in names) for r in df.collect())
    cur = connect(folder).execute(catalogue.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    return mine, Counter(tuple(r[cols.index(c)] for c in names) for r in cur.fetchall())


@pytest.mark.parametrize("name", ["seed_jaccard", "mean_jaccard"])
def test_seeds_without_a_common_feature(spark, tmp_path, name):
    """Concept A: its first other seed has other features only. B: lists of fewer than ten. C: no seed shares any."""
    rows = [("A", seed, f + (20 if seed == 1 else 0)) for seed in (0, 1, 2, 3) for f in range(12)]
    rows += [("B", seed, f + seed) for seed in (0, 1, 2) for f in range(4)]
    rows += [("C", seed, f + 13 * (seed % 3)) for seed in (0, 1, 2) for f in range(10)]
    step = 3 if name == "seed_jaccard" else 4
    made = [(c, step * i + seed % step, f) for i, (c, seed, f) in enumerate(rows) if seed < step]
    spark.createDataFrame(made, "o_orderpriority string, o_orderkey long, o_custkey long").toPandas().to_parquet(f"{tmp_path}/orders.parquet")
    mine, theirs = exact(spark, name, str(tmp_path))
    assert theirs and mine == theirs and {r[0] for r in theirs} == {"A", "B"}


def test_spectra_of_more_than_fifteen_peaks(spark, tmp_path):
    rows = [(1, i, i, 1, 1.0 + i, 100.0 * i + 7, 0.05, 0.0, "A", "F", "2020-01-01") for i in range(1, 18)] + [(2, 1, 1, 1, 5.0, 350.0, 0.0, 0.0, "R", "O", "2020-01-02")]
    names = "l_orderkey l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
    spark.createDataFrame(rows, names).toPandas().to_parquet(f"{tmp_path}/lineitem.parquet")
    mine, theirs = exact(spark, "padded_arrays", str(tmp_path))
    assert len(theirs) == 30 and mine == theirs


def test_turned_vectors_to_the_last_digit(spark):
    mine, theirs = exact(spark, "near_duplicate_pairs", "/root/testdata/sf0.01")
    assert len(theirs) == 500 and mine == theirs


def test_mzml_files_are_written_by_many_tasks(spark, monkeypatch):
    from peakloom.plans import catalogue_tables

    seen = []
    write = catalogue_tables.write_mzml
    monkeypatch.setattr(catalogue_tables, "write_mzml", lambda rows, path: (seen.append(rows.rdd.getNumPartitions()), write(rows, path)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mine, theirs = exact(spark, "mzml_spectra", "/root/testdata/sf0.001")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert seen == [4] and mine == theirs


def test_ablation_rows_meet_by_the_spectrum_alone(spark):
    """No exchange by concept: rows for each planned set are made where the spectrum lies."""
    from peakloom.plans import catalogue_plans

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue_plans._moved(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "concept_idx" not in "".join(x for x in plan.splitlines() if " Exchange hashpartitioning" in x)


def test_strata_take_the_pairs_once(spark, monkeypatch):
    calls = []
    pairs = catalogue._pairs
    monkeypatch.setattr(catalogue, "_pairs", lambda *a: (calls.append(1), pairs(*a))[1])
    mine, theirs = exact(spark, "strata", "/root/testdata/sf0.001")
    assert len(calls) == 1 and mine == theirs


def test_only_pairs_with_near_sketches_meet_their_vectors(spark):
    import math

    from peakloom.operators import directions

    limit, p = directions.sketch_limit(0.95, 1e-6), math.acos(0.95) / math.pi
    tail = lambda most: sum(math.comb(128, i) * p**i * (1 - p) ** (128 - i) for i in range(most + 1, 129))
    assert tail(limit) <= 1e-6 < tail(limit - 1)
    found = catalogue.queries()["near_duplicate_pairs"](spark, "/root/testdata/sf0.001")
    assert "bit_count" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("odd", ["copies", "parts missing", "no length", "repeated keys"])
def test_every_pair_over_the_limit_is_there(spark, tmp_path, odd):
    """Copies, vectors with null or missing components, of length 0, and keys that several rows have."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    v = np.random.default_rng(5).normal(size=(60, 64)).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    if odd == "copies":
        rows += [(100 + i, rows[i % 2][1]) for i in range(40)] + [(200 + i, (3 * v[2]).tolist()) for i in range(3)]
    elif odd == "parts missing":
        rows += [(100, [None, *rows[0][1][1:]]), (101, [*rows[1][1][:63], None]), (102, rows[2][1][:63]), (103, [*rows[3][1], 0.1]), (104, []), (105, [None] * 64), (106, None), (None, rows[4][1])]
    elif odd == "no length":
        rows += [(100, [0.0] * 64), (101, [0.0] * 64)]
    else:
        rows += [(0, (v[0] + v[1]).tolist()), (1, rows[1][1]), (1, rows[2][1]), (5, (-v[5]).tolist())]
    pq.write_table(pa.table({"vec_id": pa.array([k for k, _ in rows], pa.int64()), "embedding": pa.array([x for _, x in rows], pa.list_(pa.float32()))}), f"{tmp_path}/embeddings.parquet")
    mine, theirs = (Counter(tuple(str(round(x, 5)) for x in r) for r in found.elements()) for found in exact(spark, "near_duplicate_pairs", str(tmp_path)))
    assert len(theirs) > 60 and mine == theirs
