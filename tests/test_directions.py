"""Near-duplicate directions and ranks against all pairs and a decomposition."""

import numpy as np
import pytest

from peakloom.operators import directions
from peakloom.operators.dictionary import Dictionary, encode_exact, from_table


def table_of(spark, rows):
    return spark.createDataFrame(rows, "feature_idx int, w_dec array<double>, v string, t int, code int, a int")


def planted(n, d, near, seed):
    """Random directions, and ``near`` of them again at cosines of 0.94 to 0.99."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(near):
        side = rng.normal(size=d)
        side -= side @ x[i] * x[i]
        c = rng.uniform(0.94, 0.99)
        x[n - 1 - i] = 3 * (c * x[i] + np.sqrt(1 - c * c) * side / np.linalg.norm(side))
    return x


def brute(x, cosine):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = set()
    for at in range(0, len(u), 1024):
        a, b = np.nonzero(u[at : at + 1024] @ u.T > cosine)
        found |= {(int(i) + at, int(j)) for i, j in zip(a, b, strict=True) if i + at < j}
    return found


def test_recall_over_a_whole_dictionary(spark):
    x = planted(12_288, 32, 2500, 4)
    found = directions.near_duplicate_pairs(table_of(spark, [(i, v.tolist(), "c", 0, 0, 0) for i, v in enumerate(x)]))
    got, want = {(r["a"], r["b"]) for r in found.pairs.collect()}, brute(x, 0.95)
    assert len(want) > 1500 and got <= want and len(got) >= 0.99 * len(want)
    assert found.bits == 14 and found.tables == directions.tables_for(0.95, 14, 0.995)


def test_copies_are_members_and_counted(spark):
    x = planted(60, 8, 10, 1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100 + i, x[0].tolist()) for i in range(200)] + [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [1.0] * 7 + [None])]
    found = directions.near_duplicate_pairs(table_of(spark, [(*r, "c", 0, 0, 0) for r in rows]), recall=0.999999)
    whole = np.array([v for _, v in rows[:260]])
    assert found.count() == len(brute(whole, 0.95))
    members = {r["key"]: r["representative"] for r in found.members.collect()}
    assert len(members) == 260 and all(members[100 + i] == 0 for i in range(200))
    nothing = directions.near_duplicate_pairs(table_of(spark, []))
    assert nothing.count() == 0 and nothing.pairs.collect() == []
    with pytest.raises(ValueError):
        directions.near_duplicate_pairs(table_of(spark, []), cosine=1.0)


@pytest.mark.parametrize("clustered", [False, True])
def test_every_pair_in_blocks_of_any_size(spark, monkeypatch, clustered):
    """All pairs of brute force, none twice, over many blocks, some of which planes prove to be apart."""
    monkeypatch.setattr(directions, "BLOCK_ROWS", 64)
    x = planted(3000, 32, 600, 6)
    if clustered:
        x = np.repeat(x[:30], 100, axis=0) + 0.05 * np.random.default_rng(1).normal(size=x.shape) / np.sqrt(32)
    x = np.concatenate([x, x[:100]])  # copies
    rows = directions.unit_rows(table_of(spark, [(i, v.tolist(), "c", 0, 0, 0) for i, v in enumerate(x)]).repartition(5))
    found = directions.pairs_over(rows, 0.95)
    got = [(r["a"], r["b"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(x, 0.95)
    assert directions.pairs_over(rows.where("false"), 0.95).collect() == []


def test_products_are_exact_at_the_limit_and_for_large_components():
    one = lambda *x: np.array([x], float)
    met = lambda a, b, over: [t.tolist() for *_, t in directions.products_over(np.array([1]), a, np.array([0]), b, over, False)]
    just = np.nextafter(0.95, 1)
    assert met(one(1.0, 0.0), one(just, 0.0), 0.95) == [[just]] and met(one(1.0, 0.0), one(0.95, 0.0), 0.95) == []
    assert met(one(-1e39, 2.0), one(1e-40, 1.0), 0.95) == [[-1e39 * 1e-40 + 2.0]]
    assert np.isnan(met(one(np.nan, 0.0), one(1.0, 0.0), 0.95)[0][0])


@pytest.mark.parametrize("shape", [(300, 12), (5, 9)])
def test_ranks_equal_those_of_a_decomposition(spark, shape):
    x = np.random.default_rng(3).normal(size=shape) * np.linspace(0.1, 3, shape[1])
    s = np.linalg.svd(x, compute_uv=False)
    p = s / s.sum()
    rows = table_of(spark, [(i, v.tolist(), "c", 0, 0, 0) for i, v in enumerate(x)] + [(900, None, "c", 0, 0, 0)]).repartition(7)
    assert abs(directions.effective_rank(rows) - np.exp(-(p * np.log(p)).sum())) < 1e-6
    assert np.allclose(directions.gram(rows), x.T @ x)
    assert directions.effective_rank(rows.where("false")) == 1.0


def test_dictionaries_go_through_arrow_and_back(spark):
    rng = np.random.default_rng(2)
    own = Dictionary(rng.normal(size=(5, 9)), rng.normal(size=9), rng.normal(size=(9, 5)), rng.normal(size=5), 0.1)
    back = from_table(own.table(spark).repartition(3), 0.1, own.b_dec)
    assert all(np.array_equal(getattr(own, n), getattr(back, n)) for n in ("w_enc", "b_enc", "w_dec", "b_dec"))
    many = spark.range(300).selectExpr("CAST(id AS INT) AS feature_idx", "array(1D) AS w_enc", "0D AS b_enc")
    with pytest.raises(ValueError, match="more than 256"):
        encode_exact(spark.range(1).selectExpr("id AS token_id", "array(1D) AS activation"), many, 0.0, ["token_id"])
