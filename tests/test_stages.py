"""All stages end to end on a few made-up spectra."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom import cli
from peakloom.operators.adapters import EchoClient, HashModel
from peakloom.operators.training import TrainConfig
from peakloom.plans import stages
from peakloom.plans.registry import BIT, CONCEPTS
from peakloom.sources.artefacts import CSV_COLUMNS, Artefacts

PEPTIDES = ["PEPTIDEK", "AM(+15.99)GDDPTK", "SAC(+57.02)K", "ELVISLIVESK", "N(+.98)GFWYR"]
CONFIG = {"d_dict": 12, "k": 3, "k_aux": 4, "epochs": 1, "batch": 128, "warmup": 2, "lr": 1e-2}


def spectra(spark, n=48, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        mz = np.sort(rng.uniform(100, 1200, 12)).tolist()
        rows.append((f"s{n - i:03d}", "".join(c for c in PEPTIDES[i % 5] if c.isalpha()), PEPTIDES[i % 5], float(rng.uniform(400, 900)), int(2 + i % 3), mz, rng.uniform(1, 100, 12).tolist()))
    return spark.createDataFrame(rows, "spectrum_id string, sequence string, modified_sequence string, precursor_mz double, precursor_charge int, mz_array array<double>, intensity_array array<double>")


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    spectra(spark).coalesce(1).write.parquet(f"file://{root}/in")
    out = Artefacts(spark, f"file://{root}/out")
    model = HashModel(6)
    manifest = stages.extract(spark, f"file://{root}/in", out, model, [2, 4], chunk=8, batch=8)
    stages.label(out)
    for layer, seed in ((2, 0), (2, 1), (4, 0)):
        stages.train_layer(out, layer, TrainConfig(**CONFIG, seed=seed))
    stages.evaluate(out, stages.EvaluationConfig(2, 1, skip=("5", "6", "7", "8")))
    config = stages.EvaluationConfig(2, 0, other_layers=(4, 9), other_seeds=(1, 7), ablation_top_n=4, ablation_singles=3, controls=3, q=0.5)
    report = stages.evaluate(out, config, model)
    return out, manifest, report, root, model, config


def test_extraction_counts_order_and_resume(spark, run):
    out, manifest, _, root, model, _ = run
    assert manifest["n_chunks"] == 6 and manifest["n_spectra"] == 48 and manifest["n_tokens"] == 48 * 13
    ids = [r["spectrum_id"] for r in out.read("spectra").orderBy("global_spectrum").collect()]
    assert ids == [f"s{48 - i:03d}" for i in range(48)]
    again = stages.extract(spark, f"file://{root}/in", out, model, [2, 4], chunk=8, batch=8)
    assert {k: again[k] for k in ("n_chunks", "n_tokens")} == {k: manifest[k] for k in ("n_chunks", "n_tokens")}
    chunks = {r["chunk_idx"]: (r["n_spectra"], r["n_tokens"]) for r in out.read("chunks").collect()}
    assert chunks == {i: (8, 8 * 13) for i in range(6)}
    before = {tuple(r) for r in out.committed("activations").collect()}
    stages.extract(spark, f"file://{root}/in", out, model, [2, 4, 6], chunk=8, batch=8)  # one more layer goes into the chunks
    after = {tuple(r) for r in out.committed("activations").collect()}
    assert before < after and len(after) == 18 and out.layer(6).count() == out.layer(2).count() == 48 * 13
    spectra(spark, seed=1).coalesce(1).write.parquet(f"file://{root}/other")
    with pytest.raises(ValueError, match="differ"):
        stages.extract(spark, f"file://{root}/other", out, model, [2, 4], chunk=8, batch=8)


def test_baseline_equals_the_model(run):
    out, _, report, _, model, _ = run
    rows = out.read("baseline").groupBy("global_spectrum").agg(F.sum("ce").alias("ce"), F.count("*").alias("n")).collect()
    source = {r["global_spectrum"]: r for r in out.read("spectra").collect()}
    for r in rows[:5]:
        s = source[r["global_spectrum"]]
        ce, _ = model.losses([{"mz": s["mz_array"], "peptide": s["peptide"], "global_spectrum": 0}], "clean", ())[0]
        assert np.isclose(r["ce"], ce.sum()) and r["n"] == len(ce) == len(s["peptide"])
    assert len(rows) == 48


def test_peak_cap_and_no_baseline(spark, run, tmp_path):
    out = Artefacts(spark, f"file://{tmp_path}/out")
    manifest = stages.extract(spark, f"file://{run[3]}/in", out, HashModel(4), [1], chunk=16, batch=16, most=20, n_peaks=5, baseline=False)
    assert manifest["n_tokens"] == 20 * 6 and not out.done("baseline")
    mine = {r["global_spectrum"]: (r["mz_array"], r["intensity_array"]) for r in out.read("spectra").collect()}
    full = {r["global_spectrum"]: (np.array(r["mz_array"]), np.array(r["intensity_array"])) for r in run[0].read("spectra").collect()}
    for i, (mz, intensity) in mine.items():
        keep = np.sort(np.argsort(-full[i][1], kind="stable")[:5])
        assert mz == full[i][0][keep].tolist() and intensity == full[i][1][keep].tolist()


def test_labels_and_manifest(run):
    out = run[0]
    labels = out.read("labels")
    assert labels.count() == 48 * 13
    latent = labels.where("position = 0")
    assert latent.where(F.getbit("concepts", F.lit(BIT["is_latent_token"])) != 1).count() == 0
    noise = labels.where(F.getbit("concepts", F.lit(BIT["is_noise_peak"])) == 1)
    assert noise.where(F.getbit("concepts", F.lit(BIT["is_fragment_charge_1"])) != 1).count() == 0
    phi = out.read("concept_phi")
    assert phi.count() == len(CONCEPTS) ** 2 and phi.where("ci = cj AND phi != 1").count() == 0
    manifest = out.read_json("annotation_manifest.json")
    assert manifest["registry"]["names"] == list(CONCEPTS) and manifest["n_tokens"] == 48 * 13 and manifest["vocab"]["ion_type"]["b"] == 3
    assert np.isclose(manifest["base_rates"]["is_latent_token"], 1 / 13)


def test_labels_of_missing_chunks_only(spark, run, tmp_path):
    """Two chunks first, all of them next: the same labels as in one go."""
    out, source = Artefacts(spark, f"file://{tmp_path}/out"), run[0]
    for name in ("spectra", "tokens"):
        out.write_chunks(source.read(name).where("chunk_idx < 2"), name)
    stages.label(out)
    for name in ("spectra", "tokens"):
        out.write_chunks(source.read(name).where("chunk_idx >= 2"), name)
    assert stages.label(out)["n_tokens"] == 48 * 13
    assert out.read("labels").exceptAll(source.read("labels")).count() == 0


def test_ablation_moves_losses_by_what_is_ablated(run):
    out, _, _, _, model, _ = run
    dictionary = out.load_dictionary("dictionary_L2_s0")
    bound = model.patched(2, dictionary, np.zeros(6))
    rows = [{"mz": [200.0, 300.0], "peptide": "PEPTIDEK", "global_spectrum": 1}]
    x = model.capture(rows, [2])[0][2]
    active = np.flatnonzero(dictionary.encode(x.astype(np.float32)).sum(0)).tolist()
    silent = [i for i in range(12) if i not in active]
    loss = lambda mode, ids=(): bound.losses(rows, mode, ids)[0][0]
    assert np.allclose(loss("ablate", silent), loss("sae")) and not np.allclose(loss("ablate", active[:1]), loss("sae"))
    assert not np.allclose(loss("zero"), loss("clean")) and np.allclose(loss("mean"), loss("zero"))


def test_report_of_all_phases(run):
    out, _, report, _, _, _ = run
    assert report["phase_1_2"]["n_tokens"] == 48 * 13
    assert [x["multiplier"] for x in report["phase_6"]["sweep"]] == [0.5, 0.75, 1.0, 1.25, 1.5, 2.0]
    assert 1 <= report["phase_5"]["effective_rank"] <= 6
    p7 = report["phase_7"]
    assert p7["n_spectra"] == 48 and p7["clean_ce_alignment"]["aligned"] and p7["clean_ce_alignment"]["max_abs_diff"] < 1e-6 and p7["clean_ce_alignment"]["n"] == 48
    per = report["phase_8"]["per_concept"]
    assert list(per) == list(CONCEPTS)
    tested = {c: x for c, x in per.items() if x["n_eligible_features"]}
    assert tested and all(x["causal"] and x["top_n_features"] for x in tested.values())
    assert all(len(x["per_feature_ablation"]) == min(3, x["n_eligible_features"]) for x in tested.values())
    csv = stages.evaluation_of(out, 2).read_csv("causal_ablation")
    assert tuple(csv.columns) == CSV_COLUMNS["causal_ablation"]
    assert {r["concept"] for r in csv.collect()} == {c for c, x in tested.items() if x["causal"]["mean_delta_ce"] is not None}


def test_causal_figures_against_a_plain_version(run):
    """Deltas, terciles and controls of every tested concept from the stored losses, in numpy."""
    out, _, report, _, _, _ = run
    here = stages.evaluation_of(out, 2)
    losses, plan = here.read("losses").toPandas(), here.read("ablation_plan").toPandas()
    labels = out.read("labels").toPandas()
    full = losses[losses["mode"] == "sae"].set_index("global_spectrum").mean_ce

    def contrast(delta, p):
        lo, hi = np.quantile(p, [1 / 3, 2 / 3])
        return delta[p >= hi].mean() - delta[p <= lo].mean() if len(p) >= 6 and lo != hi else np.nan

    checked = 0
    for concept, x in report["phase_8"]["per_concept"].items():
        if not x["causal"]:
            continue
        c = BIT[concept]
        p = labels.assign(v=(labels.concepts.to_numpy() >> c) & 1).groupby("global_spectrum").v.mean()
        own = plan[plan.concept_idx == c]
        found = {}
        for _, s in own.iterrows():
            ce = losses[(losses["mode"] == "ablate") & (losses.set_idx == s.set_idx)].set_index("global_spectrum").mean_ce
            delta = (ce - full).reindex(p.index).to_numpy()
            found[s.kind, s.replicate] = delta.mean(), contrast(delta, p.to_numpy())
        mean, sel = found["group", 0]
        assert np.isclose(x["causal"]["mean_delta_ce"], mean)
        assert (x["causal"]["selectivity"] is None and np.isnan(sel)) or np.isclose(x["causal"]["selectivity"], sel)
        controls = [v[1] for k, v in found.items() if k[0] == "control" and v[1] == v[1]]
        if len(controls) >= 2 and np.std(controls, ddof=1) > 1e-12 and sel == sel:
            assert np.isclose(x["causal"]["selectivity_z"], (sel - np.mean(controls)) / np.std(controls, ddof=1))
            checked += 1
        for i, f in enumerate(x["per_feature_ablation"]):
            assert np.isclose(f["mean_delta_ce"], found["single", i + 1][0])
    assert checked


def test_layers_and_seeds(run):
    out, _, report, _, _, _ = run
    cross = report["cross_layer"]
    assert cross["other_layers"] == [4] and cross["skipped_layers"] == [9] and cross["n_anchors"] == len(cross["matches"]) > 0
    row = cross["matches"][0]
    assert set(row) == {"anchor_layer", "anchor_feature", "L4_best_feature", "L4_best_corr", "L4_top5"} and row["anchor_layer"] == 2
    mine, other = (out.load_dictionary(f"dictionary_L{layer}_s0") for layer in (2, 4))
    acts = {layer: np.array([r["activation"] for r in out.layer(layer).orderBy("chunk_idx", "token_in_chunk").collect()]) for layer in (2, 4)}
    a, b = mine.encode(acts[2])[:, row["anchor_feature"]], other.encode(acts[4])
    r = [np.corrcoef(a, col)[0, 1] if col.std() else -2 for col in b.T]
    assert int(np.argmax(r)) == row["L4_best_feature"] and np.isclose(max(r), row["L4_best_corr"], atol=1e-6)
    seeds = report["cross_seed"]
    assert seeds["n_other_seeds"] == 1
    tops = {s: stages.evaluation_of(out, 2, s).read_json("report.json")["phase_4"]["per_concept_top"] for s in (0, 1)}
    for x in seeds["results"]:
        a, b = ({f["feature_idx"] for f in tops[s][x["concept"]][:10]} for s in (0, 1))
        assert np.isclose(x["mean_jaccard"], len(a & b) / len(a | b))


def test_cached_resume(run, monkeypatch):
    """Phase 4 comes from the earlier tables, and what hangs on it is the same."""
    out, _, report, _, model, config = run
    monkeypatch.setattr(stages, "associations", lambda *a: pytest.fail("phase 4 was run again"))
    assert stages.evaluate(out, config, model)["elapsed_s"] == report["elapsed_s"]
    again = stages.evaluate(out, stages.EvaluationConfig(**{**config.__dict__, "skip": ("1", "2", "3", "4", "5", "6", "7")}), model)
    assert again["phase_4"]["n_significant_pairs"] == report["phase_4"]["n_significant_pairs"] and again["phase_6"] == report["phase_6"]
    pick = lambda r: {c: (x["top_n_features"], x["n_eligible_features"], [f["feature_idx"] for f in x["per_feature_ablation"]]) for c, x in r["phase_8"]["per_concept"].items()}
    assert pick(again) == pick(report)
    assert [m["anchor_feature"] for m in again["cross_layer"]["matches"]] == [m["anchor_feature"] for m in report["cross_layer"]["matches"]]
    with pytest.raises(FileNotFoundError):
        stages.evaluate(out, stages.EvaluationConfig(4, skip=("3", "4"), phase4_cache=out.path("nowhere")), model)


def test_summary(run):
    rows = {r["layer"]: r for r in stages.summary(run[0], [2, 4]).collect()}
    assert rows[2]["complete"] and not rows[4]["complete"] and rows[4]["fve"] == "-"
    assert rows[2]["fve"] == f"{run[2]['phase_1_2']['fve_overall']:.4f}" and rows[2]["n_sig_pairs"] == f"{run[2]['phase_4']['n_significant_pairs']:,d}"
    z = [x["causal"]["selectivity_z"] for x in run[2]["phase_8"]["per_concept"].values() if x["causal"] and not x["diagnostic"] and x["causal"]["selectivity_z"] is not None]
    assert rows[2]["mean_selectivity_z"] == (f"{np.mean(z):.3f}" if z else "-")


def test_description(run):
    out = run[0]
    found = stages.describe(out, 2, EchoClient(), n=3, chunks=4, with_concepts=True)
    assert found.columns[:3] == ["feature_idx", "stratum", "pearson_r"] and found.count()
    assert stages.evaluation_of(out, 2).cached_tokens() == 48 * 13
    to = out.sub("layer_2/seed_0/interpretation")
    prompt = to.read("prompts").first()["prompt"]
    assert "matched_ion" in prompt and "concepts " in prompt and "nearby_mz" in prompt
    lines = [json.loads(r["value"]) for r in out.spark.read.text(to.path("feature_descriptions.json")).collect()]
    assert len(lines) == found.count() and all("description" in x and set(CSV_COLUMNS["feature_descriptions"]) <= set(x) for x in lines)
    assert stages.describe(out, 2, None, n=3, chunks=4).collect() == found.collect()
    only = stages.describe(out, 2, EchoClient(), n=3, chunks=4, strata=("unlabelled",), dry=True, force=True)
    assert {r["stratum"] for r in only.collect()} <= {"unlabelled"}


def test_missing_layer_is_an_error(run):
    with pytest.raises(ValueError):
        run[0].layer(9)


def test_training_log_is_kept_by_epoch(run):
    out = run[0]
    rows = [json.loads(r["value"]) for r in out.spark.read.text(out.path("dictionary_L2_s0/log.jsonl")).collect()]
    assert sorted("validation" in r for r in rows) == [False, True]


def test_command_line(spark, run, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "build_session", lambda: spark)
    env = tmp_path / "settings"
    env.write_text("export PEAKLOOM_TEST_KEY='x'\n")
    monkeypatch.setenv("PEAKLOOM_TEST_KEY", "kept")
    base = ["--out", f"file://{tmp_path}/out", "--layers", "1"]
    assert cli.main(["extract", *base, "--source", f"file://{run[3]}/in", "--chunk-size", "16", "--batch-size", "16", "--max-spectra", "32", "--env-file", f"file://{env}", "--model-path", "a/b.ckpt"], HashModel(4)) == 0
    table = tmp_path / "ptms.json"
    table.write_text(json.dumps({"C(+57.02)": 35}))  # another id than its mass has
    assert cli.main(["annotate", *base, "--ion-types", "abcxyzIp", "--no-internal", "--fragment-tol", "0.05", "--fragment-tol-mode", "Da", "--ptm-table", f"file://{table}"]) == 0
    labels = Artefacts(spark, f"file://{tmp_path}/out").read("labels")
    assert labels.where(F.getbit("concepts", F.lit(BIT["spectrum_contains_cam_cys"])) == 1).count() == 0
    assert cli.main(["train", *base, "--d-dict", "8", "--k", "2", "--k-aux", "2", "--epochs", "1", "--train-batch", "64", "--warmup", "2", "--within-chunks", "--parts", "2", "--val-fraction", "0.4"]) == 0
    assert cli.main(["evaluate", *base, "--skip", "8", "5"], HashModel(4)) == 0
    assert cli.main(["summary", *base]) == 0


def test_a_write_that_is_cut_short_is_done_again(spark, tmp_path):
    """Killed in a task, killed between data and manifest, then resumed: the table is that of one write."""
    out = Artefacts(spark, f"file://{tmp_path}/run")
    rows = spark.range(60).select((F.col("id") % 6).cast("int").alias("chunk_idx"), F.col("id").alias("x"))
    out.write_chunks(rows.where("chunk_idx < 2"), "tokens")
    broken = rows.where("chunk_idx >= 2").withColumn("x", F.when(F.col("chunk_idx") == 5, F.raise_error(F.lit("killed"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="killed"):
        out.write_chunks(broken, "tokens")
    assert sorted(r[0] for r in out.read("tokens").select("chunk_idx").distinct().collect()) == [0, 1]
    half = Artefacts(spark, out.root)
    half.commit = lambda *_: (_ for _ in ()).throw(RuntimeError("killed before the manifest"))
    with pytest.raises(RuntimeError, match="before the manifest"):
        half.write_chunks(rows.where("chunk_idx in (2, 3)").withColumn("x", F.col("x") + 1000), "tokens")
    assert spark.read.parquet(out.path("tokens")).count() == 40 and out.read("tokens").count() == 20
    left = out.missing_chunks(rows, "tokens")
    assert sorted(r[0] for r in left.select("chunk_idx").distinct().collect()) == [2, 3, 4, 5]
    out.write_chunks(left.where("chunk_idx != 4"), "tokens")
    out.write_chunks(out.missing_chunks(rows, "tokens"), "tokens")
    assert out.read("tokens").select(rows.columns).exceptAll(rows).count() == 0 and out.read("tokens").count() == 60
    manifest = {r["chunk_idx"]: (r["n_rows"], r["n_files"]) for r in out.committed("tokens").collect()}
    assert manifest == {c: (10, 1) for c in range(6)} and out.missing_chunks(rows, "tokens").count() == 0


def test_one_more_layer_goes_into_chunks_that_are_there(spark, run, tmp_path):
    source = run[0]
    out = Artefacts(spark, f"file://{tmp_path}/run")
    for name in ("spectra", "tokens"):
        out.write_chunks(source.read(name), name)
    first = source.read("activations")
    out.write_chunks(first.where("layer = 2"), "activations", layer=True)
    out.write_chunks(first.where("layer = 4 AND chunk_idx = 0"), "activations", layer=True)
    chunks = sorted(r[0] for r in out.missing_chunks(out.read("spectra"), "activations", [2, 4]).select("chunk_idx").distinct().collect())
    assert chunks == [r[0] for r in source.read("spectra").select("chunk_idx").distinct().orderBy("chunk_idx").collect()][1:]
    assert out.missing_chunks(out.read("spectra"), "activations", [2]).count() == 0
    rest = out.undone(first.where("layer = 4"), "activations", ["layer", "chunk_idx"])
    out.write_chunks(rest, "activations", layer=True)
    assert out.read("activations").count() == first.count() and out.missing_chunks(out.read("spectra"), "activations", [2, 4]).count() == 0
