"""Hand-made cases for scalars and operators that the query tests do not reach."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.functions import numeric as N
from peakloom.functions import proforma as P
from peakloom.operators import adapters, associations, causal, concepts, crosscheck, fragments, interpretation, statistics, tokens, training
from peakloom.operators.dictionary import Dictionary, encode_sparse, from_table, reconstruction
from peakloom.plans.registry import CONCEPTS, bitmask, has
from peakloom.sources import artefacts, spectra


def one(df):
    return df.first()[0]


def test_notation(spark):
    df = spark.createDataFrame([("YGPHTM(+15.99)AGDDPTK",), ("[UNIMOD:4]AC(+.98)K",)], "s string")
    p = P.to_proforma(F.col("s"))
    rows = df.select(p.alias("p"), P.bare_sequence(p).alias("b"), P.exact_mass(p).alias("e"), P.modifications(p).alias("m")).collect()
    assert (rows[0]["p"], rows[0]["b"], rows[0]["e"]) == ("YGPHTM[+15.99]AGDDPTK", "YGPHTMAGDDPTK", "YGPHTM[+15.994915]AGDDPTK")
    assert [tuple(m) for m in rows[0]["m"]] == [(6, "+15.99", -1)]
    assert [tuple(m) for m in rows[1]["m"]] == [(0, "UNIMOD:4", 4), (2, "+0.98", -1)]
    table = {"(+42.01)": 1, "Q(-17.03)": 28}
    mods = spark.createDataFrame([(0, "+42.01", "QK"), (0, "-17.03", "QK"), (1, "-17.03", "QK"), (1, "+99.9", "QK")], "position int, mod_name string, pep string")
    mod = F.struct("position", "mod_name", F.lit(-1).alias("unimod_id"))
    assert [r[0] for r in mods.select(P.unimod_id(mod, F.col("pep"), table)).collect()] == [1, 28, 28, -1]


def test_coverage_and_lengths(spark):
    rows = spark.createDataFrame([("b", 3, None), ("y", 3, None), ("internal", 3, 5), ("precursor", None, None), ("I", None, None)], "ion string, k int, e int")
    lo, hi = concepts.coverage(F.col("ion"), F.col("k"), F.col("e"), F.lit(10))
    assert [tuple(r) for r in rows.select(lo, hi).collect()] == [(1, 3), (8, 10), (3, 5), (1, 10), (None, None)]
    sizes = spark.createDataFrame([("A" * n,) for n in (6, 7, 15, 16)], "p string")
    flags = concepts.spectrum_flags(F.col("p"), F.array().cast("array<string>"), F.lit(2))
    got = [tuple(r) for r in sizes.select(*[flags[f"peptide_length_{x}"] for x in ("short", "medium", "long")]).collect()]
    assert got == [(True, False, False), (False, True, False), (False, True, False), (False, False, True)]


def test_theory_matches_textbook_masses(spark):
    df = spark.createDataFrame([(1, "PEPTIDE", 2, [])], "k int, peptide string, precursor_charge int, mods array<struct<position:int,mass:double>>")
    ions = fragments.theoretical_ions(df, ["k"]).where("neutral_loss = ''").toPandas()
    b2 = ions[(ions.ion_type == "b") & (ions.ion_index == 2)].theory_mz.iloc[0]
    y1 = ions[(ions.ion_type == "y") & (ions.ion_index == 1)].theory_mz.iloc[0]
    p = ions[ions.ion_type == "precursor"].theory_mz.iloc[0]
    assert abs(b2 - 227.1026) < 1e-3 and abs(y1 - 148.0604) < 1e-3 and abs(p - 400.6873) < 1e-3
    assert len(ions[ions.ion_type == "internal"]) == 10


def test_noise_latent_and_bits(spark):
    row = spark.range(1).select(bitmask({CONCEPTS[0]: F.lit(True), CONCEPTS[49]: F.lit(True), CONCEPTS[3]: F.lit(None).cast("boolean")}).alias("m"))
    assert one(row) == 1 | 1 << 49
    assert row.select(has(F.col("m"), 49), has(F.col("m"), 3)).first() == (True, False)


def test_erfc_and_learning_rate(spark):
    xs = [0.0, 0.3, 1.0, 4.0, 9.0, 50.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(N.chi2_p(F.col("x"))).collect()]
    assert all(abs(a - math.erfc(math.sqrt(x / 2))) < 2e-7 * max(1, 1) for a, x in zip(got, xs, strict=True))
    config = training.TrainConfig(lr=1e-3, warmup=10)
    rates = [r[0] for r in spark.range(60).select(N.cosine_warmup(F.col("id"), 1e-3, 10, 50)).collect()]
    assert np.allclose(rates, [training.learning_rate(i, config, 50) for i in range(60)])


def test_bh_against_a_plain_version(spark):
    rng = np.random.default_rng(0)
    p = np.concatenate([rng.random(60), rng.random(30) * 1e-3, [0.02] * 10])
    df = statistics.bh_reject(spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "i int, p_value double"))
    order = np.sort(p)
    passing = np.flatnonzero(order <= (np.arange(len(p)) + 1) / len(p) * 0.05)
    cut = order[passing[-1]]
    assert {r["i"] for r in df.where("rejected").collect()} == set(np.flatnonzero(p <= cut).tolist())


def test_reconstruction_against_numpy(spark):
    rng = np.random.default_rng(1)
    w = rng.normal(size=(6, 4))
    model = Dictionary(w.T.copy(), np.zeros(6), w, np.zeros(4), 0.4)
    x = rng.normal(size=(50, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "token_id long, activation array<double>").repartition(3)
    row = reconstruction(df, model).first()
    f = model.encode(x)
    resid = ((x - f @ w) ** 2).sum()
    assert np.isclose(row["fve_overall"], 1 - resid / ((x - x.mean(0)) ** 2).sum()) and np.isclose(row["l0_mean"], (f != 0).sum() / 50) and list(row["firing_count"]) == (f > 0).sum(0).tolist()
    sparse = encode_sparse(df, model, ["token_id"])
    assert sparse.count() == (f != 0).sum()
    again = from_table(model.table(spark), 0.4)
    assert np.allclose(again.w_enc, model.w_enc)


def test_gradients_against_differences():
    rng = np.random.default_rng(2)
    config = training.TrainConfig(d_dict=7, k=2, k_aux=2)
    model = training.init(5, config)
    model.b_enc = rng.normal(0, 0.05, 7)
    x = rng.normal(size=(9, 5))

    def loss(m):
        """Masks and the auxiliary target as they are at the model's own point."""
        h = np.maximum(m.preactivations(x), 0)
        e = m.decode(h * mask) - x
        return (e**2).mean() + config.alpha * ((m.decode(h * aux, bias=False) - target) ** 2).mean()

    h0 = np.maximum(model.preactivations(x), 0)
    mask = training.batch_topk(h0, 2)[0]
    aux = training.aux_topk(h0, mask, 2)
    target = x - model.decode(h0 * mask)
    grads, _ = training.gradients(model, x, config)
    for name in ("w_enc", "w_dec", "b_enc", "b_dec"):
        p = getattr(model, name)
        at = np.unravel_index(int(np.abs(grads[name]).argmax()), p.shape)
        p[at] += 1e-5
        up = loss(model)
        p[at] -= 2e-5
        down = loss(model)
        p[at] += 1e-5
        assert np.isclose((up - down) / 2e-5, grads[name][at], rtol=1e-3, atol=1e-7)


def test_training_lowers_the_loss(spark):
    rng = np.random.default_rng(3)
    basis = rng.normal(size=(6, 8))
    x = rng.random((600, 6)) * (rng.random((600, 6)) < 0.3) @ basis
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "token_id long, activation array<double>")
    model, log = training.train(df, training.TrainConfig(d_dict=12, k=3, k_aux=3, epochs=4, batch=64, warmup=4, lr=2e-2))
    assert log[-1]["recon_loss"] < 0.6 * log[0]["recon_loss"] and np.allclose(np.linalg.norm(model.w_dec, axis=1), 1)
    assert training.steps_per_epoch([5, 5], 4) == 3 and training.steps_per_epoch([5, 5], 4, False) == 4
    with pytest.raises(ValueError):
        training.split_chunks(spark.createDataFrame([(0,)], "chunk_idx int"), training.TrainConfig())


@pytest.mark.parametrize("across", [True, False])
def test_a_round_in_a_task_equals_the_same_steps_in_memory(spark, across):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, i // 50, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 6)).astype(np.float32))], "token_id long, chunk_idx int, activation array<float>")
    config = training.TrainConfig(d_dict=9, k=2, k_aux=2, batch=48, warmup=2, lr=1e-2, across_chunks=across)
    start = lambda: training.Trainer(training.init(6, config), config, 8, training.AdamW(config))
    rows, _ = training.ordered_epoch(df, config, 0)
    got = training.run_round([rows.coalesce(1)], start())
    x = np.array([r["activation"] for r in rows.coalesce(1).collect()], float)
    own = start()
    own.model.firing_count = np.zeros(9, np.int64)
    for at in range(0, 200, 48):
        own.step(x[at : at + 48])
    assert np.allclose(got.model.w_dec, own.model.w_dec) and np.allclose(got.model.b_enc, own.model.b_enc) and np.isclose(got.model.threshold, own.model.threshold)
    assert got.model.firing_count.tolist() == own.model.firing_count.tolist() and got.optimiser.step == 5
    assert np.allclose(got.optimiser.state["w_enc"][1], own.optimiser.state["w_enc"][1])
    whole = {tuple(v) for v in x.tolist()}
    assert len(whole) == 200 and not np.array_equal(x, np.array([r["activation"] for r in df.collect()]))


def test_parts_are_averaged_and_train(spark):
    rng = np.random.default_rng(6)
    basis = rng.normal(size=(6, 8))
    x = rng.random((900, 6)) * (rng.random((900, 6)) < 0.3) @ basis
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "token_id long, activation array<double>")
    seen = []
    config = training.TrainConfig(d_dict=12, k=3, k_aux=3, epochs=5, batch=64, warmup=4, lr=2e-2, parts=3, averaged=True)
    model, log = training.train(df, config, record=seen.append)
    assert seen == log and log[-1]["recon_loss"] < 0.7 * log[0]["recon_loss"]
    h = np.maximum(model.preactivations(x.astype(np.float32).astype(float)), 0)
    assert np.isclose(model.threshold, training.batch_topk(h, 3)[1], rtol=0.2)
    rows, _ = training.ordered_epoch(df, config, 0)
    assert rows.groupBy("part").count().count() == 3 and rows.count() == 900


def test_batches_of_a_stream():
    rng = np.random.default_rng(7)
    parts = [rng.normal(size=(n, 2)) for n in (3, 0, 10, 1, 1)]
    got = list(training.batches_of(iter(parts), 4))
    assert [len(x) for x in got] == [4, 4, 4, 3] and np.array_equal(np.concatenate(got), np.concatenate(parts))


def test_null_p_values_against_the_exact_distribution(spark):
    """The share of the fixed-margin distribution that reaches the observed statistic, summed over all tables."""
    cases = [(0, 0, 30, 40, 200, 3.0), (1, 2, 12, 9, 60, 1.0), (2, 1, 50, 100, 400, 6.0)]
    rows = [(f, c, mf, mc, n, chi, 0.5) for f, c, mf, mc, n, chi in cases] + [(3, 0, 0, 5, 100, 0.0, 1.0)]
    pairs = spark.createDataFrame(rows, "feature_idx int, concept_idx int, mf long, mc long, n long, chi2 double, p_value double")
    got = {r["feature_idx"]: r for r in causal.hypergeometric_null(pairs, draws=6000).collect()}
    for f, _, mf, mc, n, chi in cases:
        exact = 0.0
        for n11 in range(max(0, mf + mc - n), min(mf, mc) + 1):
            n10, n01, n00 = mf - n11, mc - n11, n - mf - mc + n11
            stat = n * (n11 * n00 - n10 * n01) ** 2 / (mf * (n - mf) * mc * (n - mc))
            exact += (stat >= chi) * math.comb(mc, n11) * math.comb(n - mc, n10) / math.comb(n, mf)
        assert abs(got[f]["empirical_p"] - exact) < 0.02 and np.isclose(got[f]["discrepancy_ratio"], got[f]["empirical_p"] / 0.5)
    assert got[3]["empirical_p"] is None
    again = {r["feature_idx"]: r["empirical_p"] for r in causal.hypergeometric_null(pairs.repartition(3), draws=6000).collect()}
    assert again == {k: r["empirical_p"] for k, r in got.items()}


def test_token_losses_and_substitutions():
    rng = np.random.default_rng(8)
    logits, targets = rng.normal(size=(5, 6)), np.array([2, 0, 5, 1])
    ce, hit = adapters.token_losses(logits, targets)
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    assert np.allclose(ce, [-np.log(p[i, t]) for i, t in enumerate(targets) if t]) and hit.tolist() == [logits[i].argmax() == t for i, t in enumerate(targets) if t]
    assert len(adapters.token_losses(logits[:3], targets)[0]) == 1 and len(adapters.token_losses(logits[:1], targets)[0]) == 0
    w = rng.normal(size=(5, 4))
    model, x = Dictionary(w.T.copy(), np.zeros(5), w, np.zeros(4), 0.1), rng.normal(size=(7, 4))
    f = model.encode(x)
    f[:, [1, 3]] = 0
    assert np.allclose(adapters.substituted(x, "ablate", model, ablated=[1, 3]), f @ w) and np.array_equal(adapters.substituted(x, "clean"), x)
    assert not adapters.substituted(x, "zero").any() and np.allclose(adapters.substituted(x, "mean", mean=x.mean(0)), x.mean(0))
    with pytest.raises(ValueError):
        adapters.substituted(x, "other", model)
    with pytest.raises(ValueError):
        adapters.substituted(x, "sae")


def test_models_that_cannot_be_patched_are_refused():
    class Encoder:
        enable_nested_tensor = True

    class Model:
        encoder, use_flash_attention = Encoder(), False

    assert adapters.usable_model(Model()).encoder.enable_nested_tensor is False
    Model.use_flash_attention = True
    with pytest.raises(ValueError):
        adapters.usable_model(Model())
    assert adapters.residue_ids({"M(+15.99)": "M[UNIMOD:35]", "x": "y", "(+42.01)": 1}, {"x": "z"}) == {"M(+15.99)": 35, "(+42.01)": 1}


def test_full_ties_of_candidates_have_one_outcome(spark):
    rows = [(1, "b", 3, None, None, 1, "", 500.0, 500.0 + d) for d in (0.5, -0.5)] * 3
    df = spark.createDataFrame(rows, "token int, ion_type string, ion_index int, internal_end int, residue string, fragment_charge int, neutral_loss string, mz double, theory_mz double")
    for n in (1, 2, 5):
        assert fragments.best_candidates(df.repartition(n), ["token"]).first()["theory_mz"] == 499.5


def test_other_series(spark):
    df = spark.createDataFrame([(0, "GAS", 2)], "k int, peptide string, precursor_charge int").withColumn("mods", F.array().cast("array<struct<position:int,mass:double>>"))
    got = {(r["ion_type"], r["ion_index"]): r["theory_mz"] for r in fragments.theoretical_ions(df, ["k"], "abcxyz", internal=False).where("neutral_loss = ''").collect()}
    g, a, s = 57.021464, 71.037114, 87.032028
    assert np.isclose(got["a", 2], g + a - 27.994915 + 1.007276) and np.isclose(got["c", 1], g + 17.026549 + 1.007276)
    assert np.isclose(got["x", 1], s + 18.010565 + 25.979265 + 1.007276) and np.isclose(got["z", 2], a + s + 18.010565 - 17.026549 + 1.007276)


def test_features_that_fire_nearly_everywhere_have_their_zeros(spark):
    keys = ["chunk_idx", "token_in_chunk"]
    toks = spark.createDataFrame([(0, t) for t in range(3000)], "chunk_idx int, token_in_chunk int")
    acts = spark.createDataFrame([(0, t, 1, 1.0 + t / 3000) for t in range(2990)] + [(0, t, 2, 1.0) for t in range(20)], "chunk_idx int, token_in_chunk int, feature_idx int, activation double")
    scale = interpretation.feature_scale(acts, acts.select("feature_idx", "activation").limit(0))
    rows = interpretation.sample_examples(acts, scale, toks, keys).where("activation = 0").collect()
    by = {f: [r["token_in_chunk"] for r in rows if r["feature_idx"] == f] for f in (1, 2)}
    assert len(by[1]) == len(by[2]) == 8 and min(by[1]) >= 2990 and min(by[2]) >= 20


def test_selectivity_guards(spark):
    rows = spark.createDataFrame([(i, float(i), 0.5) for i in range(9)], "g int, delta_ce double, prevalence double")
    assert causal.selectivity(rows, []).first()["selectivity"] is None
    few = spark.createDataFrame([(i, float(i), i / 5) for i in range(5)], "g int, delta_ce double, prevalence double")
    assert causal.selectivity(few, []).first()["selectivity"] is None


def test_sampling_is_stable_and_keeps_to_its_rules(spark):
    feats = spark.createDataFrame([(i, 10.0 ** (-(i % 5)), i / 50, i % 3 > 0) for i in range(60)], "feature_idx int, firing_rate double, f1_dom double, rejected boolean")
    a = causal.stratified_features(feats, 10, seed=1).collect()
    assert a == causal.stratified_features(feats.repartition(7), 10, seed=1).collect() and len(a) == 10
    targets = feats.where("feature_idx < 3").select("feature_idx")
    controls = causal.matched_controls(targets, feats, 4).collect()
    assert len(controls) == 12 and all(r["feature_idx"] >= 3 and r["feature_idx"] % 5 == r["target_idx"] % 5 for r in controls)


def test_examples_and_replies(spark):
    acts = spark.createDataFrame([(0, t, 1, (t % 40 + 1) / 40) for t in range(200)], "chunk_idx int, token_in_chunk int, feature_idx int, activation double")
    toks = spark.createDataFrame([(0, t) for t in range(600)], "chunk_idx int, token_in_chunk int")
    top = spark.createDataFrame([(1, 0, 1.0, 0, 39), (1, 1, 0.9, 5, 2)], "feature_idx int, rank int, activation double, chunk_idx int, token_in_chunk int")
    keys = ["chunk_idx", "token_in_chunk"]
    scale = interpretation.feature_scale(acts, top)
    got = interpretation.sample_examples(acts, scale, toks, keys).toPandas()
    assert len(got) == 9 * 2 + 6 + 8 and (got.activation == 0).sum() == 8 and sorted(got.example_id) == list(range(32))
    replies = spark.createDataFrame([(1, "ids\n1, 0.5\nprose\n1,2.5\n3,-1\n9,x\n8,0.1")], "feature_idx int, reply string")
    valid = spark.createDataFrame([(1, 1), (1, 3), (1, 9)], "feature_idx int, example_id int")
    assert {(r["example_id"], r["predicted"]) for r in interpretation.parse_predictions(replies, valid).collect()} == {(1, 1.0), (3, 0.0)}
    text, summary = interpretation.parse_description(F.col("r"))
    df = spark.createDataFrame([("DESCRIPTION: a\nb\nSUMMARY: s\nt",), ("only text ",)], "r string")
    assert [tuple(r) for r in df.select(text, summary).collect()] == [("a\nb", "s"), ("only text", "")]


def test_retries_and_pearson_guards(spark):
    class Flaky:
        n = 0

        def complete(self, prompt):
            self.n += 1
            if self.n < 3:
                raise RuntimeError
            return "ok"

    waits = []
    assert adapters.call(Flaky(), "x", sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0)], "k string, x double, y double")
    assert {r["k"]: r["r"] for r in statistics.pearson(rows, ["k"], "x", "y").collect()} == {"a": None, "b": None}


def test_restored_pairs_and_errors(spark):
    sig = spark.createDataFrame([(1, "a", 0.5, 0.4, 2.0, 7, 9.0, 0.001, True)], "feature_idx int, concept string, f1 double, f1_dom double, lift double, n_co long, chi2 double, p_value double, p_value_bh_significant boolean")
    feats = spark.createDataFrame([(1,), (2,)], "feature_idx int")
    names = spark.createDataFrame([(0, "a"), (1, "b")], "concept_idx int, concept string")
    rows = associations.restored(sig, feats, names).collect()
    assert len(rows) == 4 and sum(r["rejected"] for r in rows) == 1 and sum(r["p_value"] == 1.0 for r in rows) == 3
    with pytest.raises(ValueError):
        associations.restored(sig, feats.where("feature_idx = 2"), names)


def test_match_table(spark):
    top = spark.createDataFrame([(1, 4, 7, 0.9, 1), (1, 4, 8, 0.5, 2), (1, 6, 3, 0.1, 1)], "anchor int, layer int, feature_idx int, r double, rank int")
    row = crosscheck.match_table(top, 2, [4, 6]).first()
    assert row["L4_best_feature"] == 7 and row["L4_top5"] == "F7:0.900;F8:0.500" and row["L6_best_corr"] == 0.1


def test_sources(spark, tmp_path):
    (tmp_path / "x.mgf").write_text("BEGIN IONS\nTITLE=s1\nPEPMASS=500.5 10\nCHARGE=2+\nSEQ=PEPK\n100.1 5\n200.2 7.5\nEND IONS\n\nBEGIN IONS\nTITLE=s2\nPEPMASS=400\n150 1\nEND IONS\n")
    rows = {r["spectrum_id"]: r for r in spectra.read_spectra(spark, f"file://{tmp_path}/x.mgf").collect()}
    assert rows["s1"]["mz_array"] == [100.1, 200.2] and rows["s1"]["precursor_charge"] == 2 and rows["s1"]["sequence"] == "PEPK" and rows["s2"]["precursor_mz"] == 400.0
    import base64
    import struct

    pack = lambda v: base64.b64encode(struct.pack(f"<{len(v)}d", *v)).decode()
    array = lambda kind, v: f'<binaryDataArray><cvParam name="64-bit float"/><cvParam name="no compression"/><cvParam name="{kind} array"/><binary>{pack(v)}</binary></binaryDataArray>'
    (tmp_path / "x.mzML").write_text(f'<mzML xmlns="http://psi.hupo.org/ms/mzml"><spectrum id="q"><cvParam name="ms level" value="2"/><cvParam name="selected ion m/z" value="321.5"/><cvParam name="charge state" value="3"/>{array("m/z", [1.5, 2.5])}{array("intensity", [9, 8])}</spectrum></mzML>')
    row = spectra.read_spectra(spark, f"file://{tmp_path}/x.mzML").first()
    assert (row["spectrum_id"], row["precursor_mz"], row["precursor_charge"], row["mz_array"], row["intensity_array"]) == ("q", 321.5, 3, [1.5, 2.5], [9.0, 8.0])
    raw = spark.createDataFrame([("", "PEP", None), ("AB", "CD", "AB(+1)")], "sequence string, peptide string, modified_sequence string")
    got = sorted(tuple(r)[:5] for r in spectra.normalised(raw.withColumn("i", F.when(F.col("sequence") == "", 4).otherwise(7)), "i").collect())
    assert got == [("row_4", "PEP", "PEP", 0, 0.0), ("row_7", "AB", "AB(+1)", 0, 0.0)]
    with pytest.raises(ValueError):
        spectra.normalised(raw)
    merged = spectra.merge_splits([raw, raw], ["sequence"])
    assert sorted(int(r["spectrum_id"]) for r in merged.collect()) == [0, 1, 2, 3]


@pytest.mark.parametrize("kind", ["parquet", "mgf", "mzml"])
def test_spectra_are_numbered_by_files_and_rows(spark, tmp_path, kind):
    for f in "ab":
        ids = [f"{f}{i}" for i in range(40)]
        if kind == "parquet":
            spark.createDataFrame([(x,) for x in ids], "spectrum_id string").coalesce(1).write.parquet(f"file://{tmp_path}/{f}.parquet")
        elif kind == "mgf":
            (tmp_path / f"{f}.mgf").write_text("".join(f"BEGIN IONS\nTITLE={x}\nPEPMASS=1\n100 1\nEND IONS\n" for x in ids))
        else:
            (tmp_path / f"{f}.mzml").write_text("<mzML>" + "".join(f'<spectrum id="{x}"><cvParam name="ms level" value="2"/></spectrum>' for x in ids) + "</mzML>")
    rows = spectra.numbered_spectra(spark, f"file://{tmp_path}/*.{kind}").select("global_spectrum", "spectrum_id").collect()
    assert [r["spectrum_id"] for r in sorted(rows)] == [f"{f}{i}" for f in "ab" for i in range(40)] and sorted(r[0] for r in rows) == list(range(80))


def test_loader_check(spark):
    a = spark.createDataFrame([(0, "x", 500.0), (1, "y", 400.0)], "global_spectrum long, spectrum_id string, precursor_mz double")
    b = spark.createDataFrame([(0, "x", 500.000001), (1, "z", 400.0), (2, "w", 1.0)], "global_spectrum long, spectrum_id string, precursor_mz double")
    assert sorted(r[0] for r in spectra.loader_mismatches(a, b).collect()) == [1, 2]
    spectra.check_loader(a, a)
    with pytest.raises(ValueError):
        spectra.check_loader(a, b)


def test_artefacts_guards(spark, tmp_path):
    out = artefacts.Artefacts(spark, f"file://{tmp_path}/a")
    spark.range(3).withColumn("schema_version", F.lit(99)).write.parquet(f"file://{tmp_path}/a/old")
    with pytest.raises(ValueError):
        out.read("old")
    with pytest.raises(ValueError):
        artefacts.check_alignment(spark.range(3).selectExpr("0 AS chunk_idx"), spark.range(4).selectExpr("0 AS chunk_idx"))
    assert artefacts.load_dotenv("﻿export A='1'\nB=2\n# no\nC = \"x\"", {"B": "9"}) == {"B": "9", "A": "1", "C": "x"}
    assert artefacts.is_model_id("name-v1") and not artefacts.is_model_id("/x/model.ckpt")


def test_padding_and_flatten(spark):
    df = spark.createDataFrame([(1, [False, True]), (2, [False, False])], "spectrum_idx int, pad array<boolean>")
    rows = tokens.flatten(df.withColumn("valid", tokens.valid_mask(F.col("pad")))).collect()
    assert sorted(map(tuple, rows)) == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]
    got = df.select(tokens.padded(F.col("pad"), F.lit(3), F.lit(False)).alias("p")).first()["p"]
    assert got == [False, True, False]


def test_streamed_increments(spark, tmp_path):
    from peakloom.streaming.chunks import label_sums, merged_label_sums, stream_chunks, write_increments

    for i in range(3):
        spark.createDataFrame([(i, 1), (i, 3)], "chunk_idx int, concepts long").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = stream_chunks(spark, f"file://{tmp_path}/in", "chunk_idx int, concepts long")
    q = write_increments(stream, lambda df: label_sums(df, 2), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    q.awaitTermination(120)
    assert tuple(merged_label_sums(spark, f"file://{tmp_path}/out").select("n", "c0", "c1").first()) == (6, 6, 3)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from peakloom import staging

    conf = SimpleNamespace(get=lambda key, default: None)
    with pytest.raises(RuntimeError):
        staging.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")), "x")
    assert staging.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[4]")), "x").startswith("file:///")


def test_nothing_but_llm_imports_llm():
    import pathlib
    import re

    root = pathlib.Path(__file__).resolve().parent.parent / "peakloom"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", path.read_text()), path


def plain_family(fired, masks, n_features, n_concepts, q=0.05):
    """Rejected pairs by sorting all p-values of the family; ``fired``: tokens of each feature."""
    n, p = len(masks), {}
    for f in range(n_features):
        for c in range(n_concepts):
            own = fired.get(f, [])
            n11, mf, mc = sum(masks[t] >> c & 1 for t in own), len(own), sum(m >> c & 1 for m in masks)
            n10, n01, n00 = mf - n11, mc - n11, n - mf - mc + n11
            chi2 = n * (n11 * n00 - n10 * n01) ** 2 / max(mf * (n00 + n01) * mc * (n00 + n10), 1e-12)
            p[f, c] = math.erfc(math.sqrt(chi2 / 2))
    cut = max((x for i, x in enumerate(sorted(p.values()), 1) if x <= i / len(p) * q), default=-1)
    return {k for k, x in p.items() if x <= cut}


def test_features_that_never_fire_belong_to_the_family(spark):
    """Six features that fire and 194 that do not: fewer pairs are rejected than among those that fire alone."""
    masks = [t % 8 if t % 8 < 3 else 0 for t in range(400)]
    concept = [[t for t in range(400) if masks[t] >> c & 1] for c in (0, 1)]
    other = [[t for t in range(400) if not masks[t] >> c & 1] for c in (0, 1)]
    shares = [(40, 4), (30, 6), (20, 8), (6, 14), (7, 18), (2, 12)]  # of each feature: tokens with its concept, and without
    fired = {f: concept[f % 2][:a] + other[f % 2][:b] for f, (a, b) in enumerate(shares)}
    features = spark.createDataFrame([(t, f, 1.0) for f, own in fired.items() for t in own] + [(5, 900, 1.0), (6, 3, 0.0)], "token int, feature_idx int, activation double")
    labels = spark.createDataFrame(list(enumerate(masks)), "token int, concepts long")
    rows = associations.associations(features, labels, 200, 2, ["token"]).collect()
    assert len(rows) == 400
    got = {(r["feature_idx"], r["concept_idx"]) for r in rows if r["rejected"]}
    assert got == plain_family(fired, masks, 200, 2) and 0 < len(got) < len(plain_family(fired, masks, 6, 2))
    dead = [r for r in rows if r["feature_idx"] >= 6]
    assert all((r["mf"], r["n11"], r["p_value"], r["f1_dom"], r["lift"], r["rejected"]) == (0, 0, 1.0, 0.0, 0.0, False) for r in dead)
    names = spark.createDataFrame([(0, "a"), (1, "b")], "concept_idx int, concept string")
    stats = {r["feature_idx"]: r for r in associations.per_feature_stats(spark.createDataFrame(rows), names).collect()}
    assert sorted(stats) == list(range(200)) and (stats[199]["firing_rate"], stats[199]["best_concept"], stats[199]["n_significant_concepts"]) == (0.0, "a", 0)


def test_an_mzml_file_is_split_and_gives_the_rows_of_one_task(spark, tmp_path):
    """Byte ranges cut inside elements; header, first-level spectra, empty elements, quotes and other lists stay out or whole."""
    rng = np.random.default_rng(3)
    made = [(f'scan="{i}" & <{i}>', None, None, 100.0 + i, 1 + i % 3, rng.random(20).tolist(), rng.random(20).tolist()) for i in range(120)]
    spectra.write_mzml(spark.createDataFrame(made, spectra.SCHEMA).coalesce(1), f"file://{tmp_path}/parts")
    text = "".join(p.read_text() for p in sorted((tmp_path / "parts").glob("part-*")))
    first = '<spectrum id="first"><cvParam name="ms level" value="1"/></spectrum>\n'
    (tmp_path / "one.mzML").write_text(f'<?xml version="1.0"?>\n<mzML xmlns="http://psi.hupo.org/ms/mzml"><run><spectrumList count="121">\n{first}<spectrum id="empty" index="0"/>{text}</spectrumList><chromatogramList><chromatogram id="tic"><binary>AAAA</binary></chromatogram></chromatogramList></run></mzML>')
    path = f"file://{tmp_path}/one.mzML"
    whole = spectra.numbered_spectra(spark, path)
    assert spectra.read_mzml(spark, path).rdd.getNumPartitions() == 1
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        split = spectra.read_mzml(spark, path)
        assert split.rdd.getNumPartitions() > 5
        rows = spectra.numbered_spectra(spark, path).orderBy("global_spectrum").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [tuple(r) for r in rows] == [tuple(r) for r in whole.orderBy("global_spectrum").collect()]
    assert [tuple(r)[:7] for r in rows] == [("empty", None, None, None, None, [], []), *made]
    assert [r["global_spectrum"] for r in rows] == list(range(121))


def test_option_names():
    from peakloom.cli import parser

    args = parser().parse_args("train --output-dir o --target-layer 4 --n-epochs 2 --warmup-steps 7 --lr-min-ratio 0.2 --alpha-aux 0.5 --grad-clip-norm 2 --no-tangent-grad-projection --val-every 9 --log-every 3 --spectra-path s --averaged".split())
    assert (args.out, args.layers, args.epochs, args.warmup, args.lr_min_ratio, args.alpha_aux, args.grad_clip_norm, args.tangent_grad_projection, args.val_every, args.log_every, args.source, args.averaged) == ("o", "4", 2, 7, 0.2, 0.5, 2.0, False, 9, 3, "s", True)
