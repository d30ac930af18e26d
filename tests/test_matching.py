"""Matching inside the row against the band join and plain sums, and its plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.operators import concepts, matching
from peakloom.operators.fragments import theoretical_ions

SPECTRA = "k int, peptide string, precursor_charge int, mods array<struct<position:int,mass:double>>, mz_array array<double>, intensity_array array<double>, position string, charge int"
MADE = ["ion_type", "ion_index", "internal_end", "residue", "fragment_charge", "neutral_loss"]


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def spectra(spark):
    rng = np.random.default_rng(3)
    peptides = [("PEPTIDEK", 3, []), ("ACMMK", 2, [(2, 57.021464), (3, 15.994915), (0, 42.010565), (99, 5.0)]), ("GGGGGGGG", 4, []), ("AXK", 2, []), ("K", 2, []), ("", 2, []), (None, 2, []), ("LVNELTEFAK", None, []), ("MK", 1, [(1, None)])]
    rows = []
    for i in range(60):
        peptide, charge, mods = peptides[i % len(peptides)]
        mz = [float(x) for x in rng.uniform(20, 900, rng.integers(0, 40))]
        own = matching.ions_of(peptide, charge, tuple(mods))
        if own is not None:
            mz += [float(x) for x in rng.choice(own.mz, 20) * (1 + rng.uniform(-25e-6, 25e-6, 20))]
        mz += [0.0, -5.0]
        rng.shuffle(mz)
        rows.append((i, peptide, charge, mods, mz, [float(x) for x in rng.integers(1, 50, len(mz))], "clash", 7))
    rows.append((100, "PEPTIDEK", 2, [], None, None, "clash", 7))
    rows.append((101, "PEPTIDEK", 2, [], [], [], "clash", 7))
    return spark.createDataFrame(rows, SPECTRA)


@pytest.mark.parametrize("tolerance,mode,series,internal", [(20.0, "ppm", "byIp", True), (0.5, "Da", "abcxyzIp", True), (30.0, "Da", "by", False)])
def test_rows_equal_those_of_the_join(spectra, tolerance, mode, series, internal):
    exploded = spectra.select("k", F.posexplode(F.arrays_zip("mz_array", "intensity_array")).alias("at", "p"))
    peaks = exploded.select("k", (F.col("at") + 1).alias("position"), F.col("p.mz_array").alias("mz"), F.col("p.intensity_array").alias("intensity"))
    keep = ["k", "position", "mz", "intensity", "threshold", *MADE]
    want = concepts.annotate(spectra.drop("position"), peaks, ["k"], tolerance, mode, series, internal).select(keep)
    got = matching.match_spectra(spectra, ["k"], tolerance, mode, series, internal).select(keep)
    key = lambda r: (r["k"], r["position"])
    got, want = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert len(got) == len(want) > 1000
    for a, b in zip(got, want, strict=True):
        assert [x for x in a if not isinstance(x, float)] == [x for x in b if not isinstance(x, float)]
        assert np.allclose([x for x in a if isinstance(x, float)], [x for x in b if isinstance(x, float)], rtol=1e-12)
    assert sum(r["ion_type"] is not None for r in got) > 300


def test_ions_equal_those_of_expressions(spectra):
    distinct = spectra.where("k < 9").select("k", "peptide", "precursor_charge", "mods")
    want = {}
    for r in theoretical_ions(distinct, ["k"], "abcxyzIp").collect():
        want.setdefault(r["k"], []).append((r["ion_type"], r["ion_index"] or -1, r["internal_end"] or -1, r["residue"], r["fragment_charge"], r["neutral_loss"], round(r["theory_mz"], 9)))
    for r in distinct.collect():
        own = matching.ions_of(r["peptide"], r["precursor_charge"], tuple((m["position"], m["mass"]) for m in r["mods"]), "abcxyzIp")
        if own is None:
            assert r["k"] not in want
            continue
        got = [(matching.TYPES[k], int(i), int(e), matching.LETTERS[s] if s >= 0 else None, int(z), matching.LOSS_NAMES[n], round(float(m), 9)) for k, i, e, s, z, n, m in zip(own.kind, own.index, own.end, own.residue, own.charge, own.loss, own.mz, strict=True)]
        assert sorted(got, key=str) == sorted(want[r["k"]], key=str)
        assert (np.diff(own.mz) >= 0).all()


def test_no_row_moves(spark, spectra, tmp_path):
    spectra.write.parquet(str(tmp_path / "spectra"))
    stored = spark.read.parquet(str(tmp_path / "spectra"))
    found = matching.match_spectra(stored, ["k"], carry=["peptide", "mods"]).withColumn("spectrum_mask", F.lit(0).cast("long"))
    found = concepts.label_tokens(found.withColumn("mods", F.transform("mods", lambda m: F.struct(m["position"].alias("position"), F.lit("oxidation").alias("ptm")))), None, ["k"])
    assert "Exchange" not in plan_of(found) and found.count() == found.select("k", "position").distinct().count()


def test_carried_columns_nulls_and_nothing(spark, spectra):
    got = matching.match_spectra(spectra.where("k >= 100"), ["k"], carry=["peptide", "charge"]).collect()
    assert [(r["k"], r["position"], r["peptide"], r["charge"], r["mz"], r["ion_type"], r["threshold"]) for r in got] == [(100, 0, "PEPTIDEK", 7, 0.0, None, None), (101, 0, "PEPTIDEK", 7, 0.0, None, None)]
    assert matching.match_spectra(spectra.where("k < 0"), ["k"]).count() == 0
    odd = spark.createDataFrame([(1, "PEPTIDEK", 2, None, [100.0, None, float("nan")], [1.0, None, 3.0], "x", 1)], SPECTRA)
    got = matching.match_spectra(odd, ["k"]).collect()
    assert [r["ion_type"] for r in got] == [None] * 4 and got[1]["threshold"] == pytest.approx(2.8)
    with pytest.raises(ValueError, match="ppm or Da"):
        matching.match_spectra(spectra, ["k"], mode="x")
