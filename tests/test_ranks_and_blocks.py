"""Ranks, quantiles, neighbours and correlations that no single task makes, against plain versions; and their plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.operators import crosscheck, interpretation, statistics


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("few", [1, 16, 4096])
def test_quantiles_of_groups(spark, few):
    rng = np.random.default_rng(2)
    groups = {"wide": rng.normal(size=700) ** 5 * 10.0 ** rng.integers(-30, 30, 700), "ties": rng.integers(0, 4, 500).astype(float), "one": np.array([3.5]), "two": np.array([1.0, -1.0]), "same": np.full(90, 2.0)}
    rows = [(g, float(x), "n", 1) for g, v in groups.items() for x in v] + [("wide", None, "n", 1), ("none", None, "n", 1)]
    df = spark.createDataFrame(rows, "g string, v double, bin string, low int")
    shares = (0.0, 0.1, 1 / 3, 0.5, 1.0)
    got = {r["g"]: r for r in statistics.exact_quantiles(df, ["g"], "v", shares, few).collect()}
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(s) for s in shares])).alias("q")).collect() if r["q"]}
    assert set(got) == set(groups) == set(want)
    for g, v in groups.items():
        assert got[g]["n"] == len(v) and np.allclose(got[g]["q"], want[g], rtol=1e-14, atol=0)
    whole = statistics.exact_quantiles(df, [], "v", [0.25], few).first()
    assert np.isclose(whole["q"][0], df.agg(F.percentile("v", F.lit(0.25))).first()[0], rtol=1e-14)
    assert statistics.exact_quantiles(df.where("v IS NULL"), [], "v", [0.5], few).collect() == []


def test_gini_and_running_sums(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.random(900), np.full(50, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)
    i = np.arange(1, len(x) + 1)
    want = (2 * (i * np.sort(x)).sum() - (len(x) + 1) * x.sum()) / (len(x) * x.sum())
    found = statistics.gini(df, "x")
    assert np.isclose(found.first()[0], want) and "SinglePartition" not in plan(statistics.running_sums(df.groupBy("x").count(), "x", "count"))
    counts = spark.createDataFrame([(float(v), int(n)) for v, n in zip(range(40), rng.integers(1, 9, 40), strict=True)], "v double, n long")
    rows = statistics.running_sums(counts, "v", "n").orderBy("v").collect()
    assert [r["before"] for r in rows] == [0.0, *np.cumsum([r["n"] for r in rows])[:-1].astype(float)]
    assert statistics.gini(df.where("x < 0"), "x").first()[0] == 0.0


def plain_neighbours(peaks, k):
    out = {}
    for i, (p, m) in enumerate(peaks):
        near = sorted((abs(m - n), q, n) for j, (q, n) in enumerate(peaks) if j != i)[:k]
        out[p] = [round(n, 4) for _, _, n in sorted(near, key=lambda x: x[1])]
    return out


def test_neighbours_of_ties_and_few(spark):
    rng = np.random.default_rng(7)
    spectra = {0: [(i + 1, float(m)) for i, m in enumerate(rng.integers(0, 12, 60))], 1: [(1, 5.0)], 2: [(i + 1, 7.0) for i in range(20)], 3: [(i + 1, float(m)) for i, m in enumerate(rng.random(40) * 500)], 4: [(1, 3.0), (2, 3.0)]}
    rows = [(s, p, m) for s, own in spectra.items() for p, m in own]
    df = spark.createDataFrame([*rows, (3, 99, None)], "spectrum int, position int, mz double")
    found = interpretation.nearest_peaks(df, None, ["spectrum"])
    got = {(r["spectrum"], r["position"]): r["neighbour_mzs"] for r in found.collect()}
    assert got == {(s, p): v for s, own in spectra.items() for p, v in plain_neighbours(own, 6).items()}
    text = plan(found)
    assert "Join" not in text and text.count("Exchange hashpartitioning") == 1
    wanted = spark.createDataFrame([(0, 3), (0, 3), (2, 20), (9, 1)], "spectrum int, position int")
    assert {(r["spectrum"], r["position"]): r["neighbour_mzs"] for r in interpretation.nearest_peaks(df, wanted, ["spectrum"]).collect()} == {k: got[k] for k in ((0, 3), (2, 20))}


def test_correlations_by_blocks(spark):
    rng = np.random.default_rng(9)
    x = rng.random((200, 9)) * (rng.random((200, 9)) < 0.3)
    y = rng.random((200, 7)) * (rng.random((200, 7)) < 0.4)
    y[:, 6] = 0.5
    rows = lambda m: [(t // 50, t, f, float(m[t, f]), 3) for t in range(200) for f in range(m.shape[1]) if m[t, f]]
    a = spark.createDataFrame(rows(x), "chunk int, token int, feature_idx int, activation double, a int")
    b = spark.createDataFrame(rows(y), "chunk int, token int, feature_idx int, activation double, b int").withColumn("layer", F.explode(F.array(F.lit(2), F.lit(4))))
    got = {(r["anchor"], r["layer"], r["feature_idx"]): r["r"] for r in crosscheck.feature_correlation(a, b, 200, ["chunk", "token"]).collect()}
    assert len(got) == 9 * 2 * 7
    for (f, _, g), r in got.items():
        assert np.isclose(r, 0.0 if g == 6 else np.corrcoef(x[:, f], y[:, g])[0, 1])
    sums = {(r["anchor"], r["feature_idx"]): r["sxy"] for r in crosscheck.products(a, b.where("layer = 2"), ["chunk", "token"]).collect()}
    assert all(np.isclose(v, (x[:, f] * y[:, g]).sum()) for (f, g), v in sums.items()) and len(sums) > 50
    assert crosscheck.feature_correlation(a, b.where("layer = 9"), 200, ["chunk", "token"]).collect() == []
