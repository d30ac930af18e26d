"""The stages in order, each skipped where its output is complete."""

from __future__ import annotations

import logging
import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import d
from ..functions.proforma import bare_sequence, delta_mass, exact_mass, modifications, to_proforma
from ..operators.adapters import CompletionClient, ModelAdapter, capture_activations, capture_baseline, interpret, spectrum_losses
from ..operators.associations import anchors, association_rows, associations, per_concept_top, per_family_top, per_feature_stats, restored, significant_totals, top_tokens
from ..operators.causal import ablation_plan, ablation_rows, best_causal_record, cached_clean_ce, causal_reports, ce_alignment, correlated_masks, loss_recovered, mean_selectivity_z, null_test, numbered_sets, prevalence, prevalence_lists
from ..operators.concepts import label_tokens, spectrum_mask, tracked_mods
from ..operators.crosscheck import feature_correlation, match_table, mean_jaccard, missing_layers, seed_overlap, shared_sample, top_matches
from ..operators.dictionary import encode_sparse, geometry, layer_mean, reconstruction, threshold_sweep
from ..operators.interpretation import STRATA, add_global_top, concept_names, description_prompt, description_scores, example_rows, feature_scale, half, intensity_rank, median_by_stratum, nearest_peaks, parse_description, parse_predictions, prediction_prompt, results, sample_examples, select_strata
from ..operators.matching import match_spectra
from ..operators.statistics import base_rates, phi_matrix
from ..operators.tokens import cap_peaks, capped, chunked, first_tokens, peak_rows, token_in_chunk
from ..operators.training import TrainConfig, split_chunks, train
from ..plans.registry import CONCEPTS, FAMILIES, ION_TYPES, LOSS_TYPES, concept_table, decode
from ..sources.artefacts import Artefacts, check_alignment
from ..sources.bucketed import buckets_for, drop_bucketed, is_bucketed, read_bucketed, write_bucketed
from ..sources.spectra import check_loader, normalised, numbered_spectra
from ..staging import staged

LOG = logging.getLogger("peakloom")
KEYS = ["chunk_idx", "spectrum_idx"]
TOKEN = ["chunk_idx", "token_in_chunk"]
BY_TOKEN = "labels_by_token"
PHASES = ("1", "2", "3", "4", "5", "6", "7", "8", "cross_layer", "cross_seed")


def extract(spark: SparkSession, source: str, out: Artefacts, model: ModelAdapter, layers: Sequence[int], chunk: int = 1024, batch: int = 32, most: int | None = None, n_peaks: int | None = None, baseline: bool = True) -> dict:
    """Spectra, tokens, activations and the model's own losses. Chunks that are there already are left as they are.

    Spectra are numbered in the order of the source's files and rows; what is stored already must agree with it.
    """
    if chunk < 1 or batch < 1 or chunk % batch and chunk > batch:
        raise ValueError("chunks must hold whole batches")
    if most is not None and most <= 0:
        raise ValueError("the cap on spectra must be positive")
    rows = normalised(numbered_spectra(spark, source), "global_spectrum")
    if most:
        rows = capped(rows, "global_spectrum", most)
    if n_peaks:
        rows = cap_peaks(rows, n_peaks)
    proforma = to_proforma(F.col("modified_sequence"))
    spectra = chunked(rows, chunk).withColumns({"proforma": proforma, "peptide": bare_sequence(F.col("sequence")), "modifications": modifications(proforma)})
    if out.done("spectra"):
        stored = out.read("spectra")
        check_loader(stored, spectra.join(stored.select("chunk_idx").distinct(), "chunk_idx", "left_semi"))
    out.write_chunks(out.missing_chunks(spectra, "spectra"), "spectra")
    spectra = out.read("spectra")
    latent = spectra.select(*KEYS, "global_spectrum", F.lit(0).alias("position"), d(0).alias("mz"), d(0).alias("intensity"))
    tokens = token_in_chunk(peak_rows(spectra, [*KEYS, "global_spectrum"]).unionByName(latent))
    out.write_chunks(out.missing_chunks(tokens, "tokens"), "tokens")
    tokens = out.read("tokens")
    inputs = spectra.select("chunk_idx", "global_spectrum", "peptide", F.col("mz_array").alias("mz"))
    wanted = [x for x in layers if out.missing_chunks(inputs.select("chunk_idx"), "activations", [x]).limit(1).count()]
    if wanted:
        vectors = capture_activations(out.missing_chunks(inputs, "activations", wanted), model, wanted, batch)
        rows = vectors.join(tokens.select("global_spectrum", "position", *TOKEN), ["global_spectrum", "position"])
        out.write_chunks(out.undone(rows, "activations", ["layer", "chunk_idx"]), "activations", layer=True)
    todo = out.missing_chunks(inputs, "baseline")
    if baseline and todo.limit(1).count():
        out.write_chunks(capture_baseline(todo, model, batch), "baseline")
    absent = [r["layer"] for r in missing_layers(layers, out.read("activations")).collect()]
    if absent:
        raise ValueError(f"the model gave no activations of layers {absent}")
    check_alignment(out.layer(layers[0]).select("chunk_idx"), tokens.select("chunk_idx"))
    return out.extraction_manifest(spectra, tokens, {"chunk": chunk, "layers": list(layers), "source": source, "n_peaks": n_peaks, "max_spectra": most})


def label(out: Artefacts, tolerance: float = 20.0, mode: str = "ppm", series: str = "byIp", internal: bool = True, ptm_table: dict[str, int] | None = None) -> dict:
    """Concept bitmasks of every token, base rates, phi and a manifest.

    ``ptm_table``: UNIMOD ids of notations such as ``M(+15.99)``, looked up before masses are.

    Chunks that have labels already are left as they are; statistics are of the whole table all the same.
    """
    tokens = out.read("tokens")
    spectra = out.missing_chunks(out.read("spectra"), "labels")
    if spectra.limit(1).count():
        masses = F.transform(modifications(exact_mass(F.col("proforma"))), lambda m: F.struct(m["position"].alias("position"), F.coalesce(delta_mass(m["mod_name"]), d(0)).alias("mass")))
        before = F.sum("n").over(W.partitionBy("chunk_idx").orderBy("spectrum_idx").rowsBetween(W.unboundedPreceding, -1))
        rows = spectra.withColumns({"names": tracked_mods(F.col("modifications"), F.col("peptide"), ptm_table), "mods": masses, "n": 1 + F.coalesce(F.greatest(F.size(F.arrays_zip("mz_array", "intensity_array")), F.lit(0)), F.lit(0))})
        rows = rows.withColumns({"spectrum_mask": spectrum_mask(F.col("peptide"), F.col("precursor_charge"), F.col("names")), "first_token": F.coalesce(before, F.lit(0)).cast("int")})
        found = match_spectra(rows, KEYS, tolerance, mode, series, internal, ["global_spectrum", "first_token", "peptide", "names", "spectrum_mask"])
        found = found.withColumnRenamed("names", "mods").withColumn("token_in_chunk", F.col("first_token") + F.col("position"))
        drop_bucketed(out.spark, out.path(BY_TOKEN))
        out.write_chunks(label_tokens(found, None, KEYS, ["token_in_chunk", "global_spectrum"]), "labels")
    labels = out.read("labels")
    check_alignment(labels.select("chunk_idx"), tokens.select("chunk_idx"))
    rates = base_rates(labels, len(CONCEPTS)).join(F.broadcast(concept_table(labels.sparkSession)), "concept_idx")
    out.write(rates, "concept_rates")
    out.write(phi_matrix(labels, len(CONCEPTS)), "concept_phi")
    rows = {r["concept"]: r for r in out.read("concept_rates").collect()}  # one for each concept
    manifest = {
        "config": {"tolerance": tolerance, "mode": mode, "ion_types": series, "internal": internal},
        "registry": {"names": list(CONCEPTS), "families": {f: list(c) for f, c in FAMILIES.items()}, "diagnostic": [c for c, r in rows.items() if r["diagnostic"]]},
        "base_rates": {c: rows[c]["base_rate"] for c in CONCEPTS}, "n_tokens": next(iter(rows.values()))["total"],
        "vocab": {"ion_type": ION_TYPES, "neutral_loss": LOSS_TYPES}, "n_chunks": labels.select("chunk_idx").distinct().count(),
    }
    out.write_json(manifest, "annotation_manifest.json")
    return manifest


def train_layer(out: Artefacts, layer: int, config: TrainConfig) -> None:
    """The dictionary of a layer and seed; the log has a row as soon as an epoch has ended."""
    name = f"dictionary_L{layer}_s{config.seed}"
    if out.done(f"{name}/weights"):
        return
    out.clear(f"{name}/log.jsonl")
    rows = out.layer(layer).withColumn("token_id", F.xxhash64(*TOKEN))
    split = split_chunks(rows.select("chunk_idx").distinct(), config)
    own = rows.join(F.broadcast(split), "chunk_idx")
    model, _ = train(own.where("NOT val"), config, own.where("val"), lambda row: out.append_log(row, f"{name}/log.jsonl"))
    out.save_dictionary(model, name)


@dataclass
class EvaluationConfig:
    """Options of one evaluation."""

    layer: int
    seed: int = 0
    skip: tuple[str, ...] = ()
    q: float = 0.05
    top_tokens: int = 20
    ablation_spectra: int = 5000
    ablation_top_n: int = 10
    ablation_singles: int = 100
    controls: int = 5
    rate_bins: int = 5
    null_features: int = 120
    null_draws: int = 100
    cross_tokens: int = 100_000
    cross_top: int = 5
    other_layers: tuple[int, ...] = ()
    other_seeds: tuple[int, ...] = ()
    phase4_cache: str | None = None
    force: bool = False

    def runs(self, phase: str) -> bool:
        return phase not in self.skip


def evaluation_of(out: Artefacts, layer: int, seed: int = 0) -> Artefacts:
    """The folder of one evaluation."""
    return out.sub(f"layer_{layer}/seed_{seed}/eval")


def evaluate(out: Artefacts, config: EvaluationConfig, model: ModelAdapter | None = None) -> dict:
    """All phases of one layer and seed that are not skipped; those that need the model are left out without one.

    A report that is there already is returned as it is, unless ``force`` is set or phases are skipped. If phase 4 is
    skipped and others need it, its tables are read from an earlier run, whose other results are carried over.
    """
    if odd := set(config.skip) - set(PHASES):
        raise ValueError(f"no such phases: {sorted(odd)}")
    here = evaluation_of(out, config.layer, config.seed)
    if here.done("report.json") and not config.force and not config.skip:
        LOG.info("%s has a report", here.root)
        return here.read_json("report.json")
    began, spark = time.time(), out.spark
    dictionary = out.load_dictionary(f"dictionary_L{config.layer}_s{config.seed}")
    acts, concepts = out.layer(config.layer), concept_table(spark)
    report: dict = {"schema_version": 1, "config": asdict(config)}
    if config.runs("1") and config.runs("2"):
        report["phase_1_2"] = reconstruction(acts, dictionary).drop("scale", "firing_count").first().asDict()
    if config.runs("5"):
        report["phase_5"] = geometry(dictionary, spark)
    if config.runs("6"):
        report["phase_6"] = {"sweep": [r.asDict() for r in threshold_sweep(acts, dictionary).orderBy("multiplier").collect()]}
    pairs = None
    if config.runs("3") or config.runs("4"):
        features = _features(out, config.layer, config.seed)
        if config.runs("3"):
            here.write_csv(top_tokens(features, config.top_tokens), "top_activating_tokens")
        if config.runs("4"):
            pairs = _associate(here, features, _labels_by_token(out), dictionary.w_enc.shape[1], config, concepts, report)
    elif any(config.runs(p) for p in ("8", "cross_layer", "cross_seed")):
        pairs = _cached_pairs(here if config.phase4_cache is None else Artefacts(spark, config.phase4_cache), out, config, concepts, report)
    if pairs is None and config.runs("3") and not config.runs("4") and any(config.runs(p) for p in ("8", "cross_layer", "cross_seed")):
        pairs = _cached_pairs(here if config.phase4_cache is None else Artefacts(spark, config.phase4_cache), out, config, concepts, report)
    if model is not None and (config.runs("7") or config.runs("8") and pairs is not None):
        _causal_phases(out, here, config, model, dictionary, pairs, concepts, report)
    if config.runs("cross_layer") and config.other_layers and pairs is not None:
        _cross_layer(out, here, config, pairs, report)
    if config.runs("cross_seed") and config.other_seeds and pairs is not None:
        _cross_seed(out, config, report)
    report["elapsed_s"] = time.time() - began
    here.write_json(report, "report.json")
    LOG.info("evaluated layer %d, seed %d in %.1f s", config.layer, config.seed, report["elapsed_s"])
    return report


def _features(out: Artefacts, layer: int, seed: int) -> DataFrame:
    """Sparse features of a layer under its dictionary, encoded once, in buckets of their tokens."""
    path = out.path(f"layer_{layer}/seed_{seed}/features")
    if not is_bucketed(out.spark, path):
        rows = encode_sparse(out.layer(layer), out.load_dictionary(f"dictionary_L{layer}_s{seed}"), TOKEN)
        write_bucketed(rows, path, TOKEN, buckets_for(out.read("tokens").count()))
    return read_bucketed(out.spark, path)


def _labels_by_token(out: Artefacts) -> DataFrame:
    """chunk_idx, token_in_chunk, concepts of all tokens, in the same buckets as the features of every layer."""
    path = out.path(BY_TOKEN)
    if not is_bucketed(out.spark, path):
        write_bucketed(out.read("labels").select(*TOKEN, "concepts"), path, TOKEN, buckets_for(out.read("tokens").count()))
    return read_bucketed(out.spark, path)


def _associate(here: Artefacts, features: DataFrame, labels: DataFrame, n_features: int, config: EvaluationConfig, concepts: DataFrame, report: dict) -> DataFrame:
    here.write(associations(features, labels, n_features, len(CONCEPTS), TOKEN, config.q), "pairs")
    pairs = here.read("pairs")
    here.write_csv(association_rows(pairs, concepts), "feature_label_associations")
    here.write_csv(per_feature_stats(pairs, concepts), "per_feature_stats")
    tops = per_concept_top(pairs).join(F.broadcast(concepts.select("concept_idx", "concept")), "concept_idx").orderBy("concept_idx", "rank")
    by_concept: dict[str, list] = {}
    for r in tops.collect():  # 20 features of each concept
        by_concept.setdefault(r["concept"], []).append({k: r[k] for k in ("feature_idx", "f1_dom", "lift", "n_co", "score", "p_value")})
    by_family: dict[str, list] = {}
    for r in per_family_top(pairs, concepts).orderBy("family", "rank").collect():
        by_family.setdefault(r["family"], []).append({k: r[k] for k in ("feature_idx", "best_concept_name", "f1_dom")})
    report["phase_4"] = {**significant_totals(pairs).first().asDict(), "per_concept_top": by_concept, "per_family_top": by_family}
    return pairs


def _cached_pairs(cache: Artefacts, out: Artefacts, config: EvaluationConfig, concepts: DataFrame, report: dict) -> DataFrame | None:
    """Phase 4 of an earlier run from its report and tables; None if there is none where this run would have written it."""
    needed = ("report.json", "feature_label_associations.csv", "per_feature_stats.csv")
    if lacking := [n for n in needed if not cache.done(n)]:
        if config.phase4_cache is not None:
            raise FileNotFoundError(f"{cache.root} lacks {lacking}")
        LOG.warning("%s lacks %s: the phases that need them are skipped", cache.root, lacking)
        return None
    n, earlier = cache.cached_tokens(), cache.read_json("report.json")
    for key, value in earlier.items():
        if key not in ("schema_version", "config", "elapsed_s", "phase_8", "cross_layer", "cross_seed"):
            report.setdefault(key, value)
    marginals = out.read("concept_rates").select("concept_idx", F.col("marginal").alias("mc"))
    pairs = restored(cache.read_csv("feature_label_associations"), cache.feature_marginals(), concepts)
    pairs = pairs.join(F.broadcast(marginals), "concept_idx").withColumns({"n": F.lit(n).cast("long"), "n11": F.col("n_co")})
    return staged(pairs.select("feature_idx", "concept_idx", "n11", "mf", "mc", "n", "f1", "f1_dom", "lift", "chi2", "p_value", "rejected"), "restored")


def _causal_phases(out: Artefacts, here: Artefacts, config: EvaluationConfig, model: ModelAdapter, dictionary, pairs: DataFrame | None, concepts: DataFrame, report: dict) -> None:
    """Phases 7 and 8 from one pass of the model over the capped spectra: every mode, and every planned set of features."""
    spark = out.spark
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spectra = capped(out.read("spectra"), "global_spectrum", config.ablation_spectra).select("global_spectrum", F.col("mz_array").alias("mz"), "peptide").repartition(width, "global_spectrum")
    plan, sets = None, []
    if config.runs("8") and pairs is not None:
        rates = pairs.groupBy("feature_idx").agg((F.first("mf") / F.greatest(F.first("n"), F.lit(1))).alias("firing_rate"))
        rates = staged(rates, "rates")
        here.write(numbered_sets(ablation_plan(pairs, rates, config.ablation_top_n, config.ablation_singles, config.controls, config.rate_bins, config.seed)), "ablation_plan")
        plan = here.read("ablation_plan")
        sets = [r["features"] for r in plan.select("set_idx", "features").distinct().orderBy("set_idx").collect()]  # bounded by the options
    mean = np.array([r["mean"] for r in layer_mean(first_tokens(out.layer(config.layer), 200_000)).orderBy("dim").collect()])
    bound = model.patched(config.layer, dictionary, mean)
    here.write(spectrum_losses(spectra, bound, ("clean", "sae", "zero", "mean") if config.runs("7") else ("sae",), sets), "losses")
    losses = here.read("losses")
    if config.runs("7"):
        report["phase_7"] = loss_recovered(losses).first().asDict()
        stored = capped(out.read("spectra").select("chunk_idx", "global_spectrum"), "global_spectrum", config.ablation_spectra)
        base = capped(out.read("baseline"), "global_spectrum", config.ablation_spectra) if out.done("baseline") else None
        cached = cached_clean_ce(stored.select("chunk_idx").distinct(), base) if base is not None else None
        report["phase_7"]["clean_ce_alignment"] = None if cached is None else ce_alignment(cached, losses.where("mode = 'clean'")).first().asDict()
    if plan is None:
        return
    labels = capped(out.read("labels"), "global_spectrum", config.ablation_spectra)
    shares = staged(prevalence_lists(prevalence(labels, len(CONCEPTS)), len(CONCEPTS)), "prevalence")
    masks = correlated_masks(out.read("concept_phi"))
    groups, singles = causal_reports(staged(ablation_rows(plan, losses, shares), "ablations"), masks)
    here.write(groups, "causal_groups")
    here.write(singles.join(plan.where("kind = 'single'").select("concept_idx", "replicate", F.col("features")[0].alias("feature_idx"), "f1_dom", "lift"), ["concept_idx", "replicate"]), "causal_singles")
    report["phase_8"] = _causal_report(here, pairs, plan, concepts, config)
    report["phase_8"]["mean_selectivity_z"] = mean_selectivity_z(here.read("causal_groups"), concepts).first()[0]
    report["phase_8"]["permutation_test"] = [r.asDict() for r in null_test(pairs, config.null_features, config.null_draws).collect()]
    eligible = pairs.where("rejected").groupBy("concept_idx").agg(F.count("*").alias("n_eligible"))
    here.write_csv(here.read("causal_groups").join(eligible, "concept_idx").join(F.broadcast(concepts), "concept_idx").orderBy("concept_idx"), "causal_ablation")


def _causal_report(here: Artefacts, pairs: DataFrame, plan: DataFrame, concepts: DataFrame, config: EvaluationConfig) -> dict:
    """The report's dictionary by concept; its rows are bounded by concepts and the number of single features."""
    eligible = {r["concept_idx"]: r["n"] for r in pairs.where("rejected").groupBy("concept_idx").agg(F.count("*").alias("n")).collect()}
    groups = {r["concept_idx"]: r.asDict() for r in here.read("causal_groups").collect()}
    chosen = {r["concept_idx"]: r["features"] for r in plan.where("kind = 'group'").collect()}
    single: dict[int, list[dict]] = {}
    for r in here.read("causal_singles").orderBy("concept_idx", "replicate").collect():
        single.setdefault(r["concept_idx"], []).append({k: r[k] for k in ("feature_idx", "mean_delta_ce", "selectivity", "f1_dom", "lift")})
    out = {}
    for c in concepts.orderBy("concept_idx").collect():
        i, group = c["concept_idx"], groups.get(c["concept_idx"])
        kept = {k: v for k, v in (group or {}).items() if k not in ("concept_idx", "matched_random_count", "n_correlated_controlled")}
        out[c["concept"]] = {
            "concept": c["concept"], "family": c["family"], "diagnostic": c["diagnostic"], "n_eligible_features": eligible.get(i, 0), "top_n_features": chosen.get(i, []),
            "matched_random_count": group["matched_random_count"] if group else 0, "n_correlated_concepts_controlled": group["n_correlated_controlled"] if group else 0,
            "causal": kept or None, "per_feature_ablation": single.get(i, []),
        }
    return {"per_concept": out}


def _cross_layer(out: Artefacts, here: Artefacts, config: EvaluationConfig, pairs: DataFrame, report: dict) -> None:
    """The best matches of the anchors at other layers, over one sample of tokens."""
    skipped = [r["layer"] for r in missing_layers(config.other_layers, out.read("activations")).collect()]
    layers = [layer for layer in config.other_layers if layer not in skipped]
    chosen = anchors(pairs)
    sample = staged(first_tokens(out.layer(config.layer).select(*TOKEN), config.cross_tokens), "cross-tokens")
    mine = shared_sample(_features(out, config.layer, config.seed).join(F.broadcast(chosen.select("feature_idx")), "feature_idx", "left_semi"), sample, TOKEN)
    others = None
    for layer in layers:
        rows = shared_sample(_features(out, layer, config.seed), sample, TOKEN).withColumn("layer", F.lit(layer))
        others = rows if others is None else others.unionByName(rows)
    found: list[dict] = []
    if others is not None:
        top = top_matches(feature_correlation(mine, others, sample.count(), TOKEN), config.cross_top)
        here.write_csv(match_table(top, config.layer, layers, config.cross_top).orderBy("anchor_feature"), "cross_layer_matches")
        found = [r.asDict() for r in out.spark.read.option("header", True).option("inferSchema", True).csv(here.path("cross_layer_matches.csv")).collect()]  # as many as anchors
    report["cross_layer"] = {"matches": found, "n_anchors": len(found), "other_layers": layers, "skipped_layers": skipped}


def _cross_seed(out: Artefacts, config: EvaluationConfig, report: dict) -> None:
    """How far the best features of a concept agree with those of other seeds that have a report."""
    spark = out.spark
    ranks = lambda tops, seed: [(c, seed, i + 1, int(f["feature_idx"])) for c, rows in (tops or {}).items() for i, f in enumerate(rows)]
    schema = "concept string, seed int, rank int, feature_idx int"
    mine = spark.createDataFrame(ranks(report["phase_4"]["per_concept_top"], config.seed), schema)
    reports = {s: evaluation_of(out, config.layer, s) for s in config.other_seeds}
    found = {s: a.read_json("report.json") for s, a in reports.items() if a.done("report.json")}
    others = spark.createDataFrame([row for s, r in found.items() for row in ranks((r.get("phase_4") or {}).get("per_concept_top"), s)], schema)
    rows = mean_jaccard(seed_overlap(mine.drop("seed"), others)).orderBy("concept").collect()  # one for each concept
    report["cross_seed"] = {"results": [r.asDict(recursive=True) for r in rows], "n_other_seeds": len(found)}


def summary(out: Artefacts, layers: Sequence[int], seed: int = 0) -> DataFrame:
    """One line of formatted figures for each layer; ``-`` where a report has none, and no figure for a layer without a report."""
    rows = []
    for layer in layers:
        here = evaluation_of(out, layer, seed)
        r = here.read_json("report.json") if here.done("report.json") else None
        p12, p4, p7, p8 = ((r or {}).get(k) or {} for k in ("phase_1_2", "phase_4", "phase_7", "phase_8"))
        rows.append((layer, r is not None, *[p12.get(k) for k in ("fve_overall", "l0_mean", "strict_dead_pct", "firing_rate_gini")], p4.get("n_significant_pairs"), p4.get("n_features_with_concept"), p7.get("loss_recovered_vs_zero"), p7.get("top1_drop_pp"), p8.get("mean_selectivity_z")))
    schema = "layer int, complete boolean, fve double, l0 double, dead_pct double, gini double, n_sig_pairs long, features_with_concept long, loss_recovered double, top1_drop_pp double, mean_selectivity_z double"
    return summary_table(out.spark.createDataFrame(rows, schema))


#: Printed form of each figure.
FORMATS = {"fve": "%.4f", "l0": "%.1f", "dead_pct": "%.1f", "gini": "%.3f", "n_sig_pairs": "%,d", "features_with_concept": "%,d", "loss_recovered": "%.4f", "top1_drop_pp": "%.2f", "mean_selectivity_z": "%.3f"}


def summary_table(rows: DataFrame) -> DataFrame:
    """The figures of ``FORMATS`` as text; null and NaN become ``-``."""
    none = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    return rows.select(*[c for c in rows.columns if c not in FORMATS], *[F.when(none(c), "-").otherwise(F.format_string(f, F.col(c))).alias(c) for c, f in FORMATS.items() if c in rows.columns])


def describe(out: Artefacts, layer: int, client: CompletionClient, n: int = 40, chunks: int = 12, seed: int = 0, dry: bool = False, strata: Sequence[str] = STRATA, with_concepts: bool = False, dictionary_seed: int = 0, force: bool = False) -> DataFrame:
    """Descriptions of chosen features and how well they predict held-out activations.

    Descriptions that are there already are returned as they are, unless ``force`` is set.
    """
    here, to = evaluation_of(out, layer, dictionary_seed), out.sub(f"layer_{layer}/seed_{dictionary_seed}/interpretation")
    if to.done("median_by_stratum") and not force:
        LOG.info("%s has descriptions", to.root)
        return to.read_csv("feature_descriptions")
    stats, causal, top = here.read_csv("per_feature_stats"), here.causal_records(), here.read_csv("top_activating_tokens")
    best = best_causal_record(causal)
    chosen = staged(select_strata(stats, best, n, seed, strata), "strata")
    acts = _features(out, layer, dictionary_seed).where(F.col("chunk_idx") < chunks).join(F.broadcast(chosen.select("feature_idx")), "feature_idx")
    tokens = out.read("tokens").where(F.col("chunk_idx") < chunks)
    scale = feature_scale(acts, top.join(F.broadcast(chosen.select("feature_idx")), "feature_idx"))
    found = sample_examples(acts, scale, tokens, TOKEN, seed)
    found = half(add_global_top(found, top, scale, tokens, TOKEN), TOKEN, seed)
    labels = out.read("labels").where(F.col("chunk_idx") < chunks).select(*TOKEN, "concepts", F.col("ion_type").alias("ion"))
    peaks = tokens.where("position > 0")
    ranked = intensity_rank(peaks, KEYS).select(*KEYS, "position", "peak_rank", "n_peaks", "rel_intensity")
    wanted = staged(found.join(tokens, TOKEN).join(labels, TOKEN).join(out.read("spectra").select(*KEYS, F.col("proforma"), "precursor_mz", "precursor_charge"), KEYS), "wanted")
    near = nearest_peaks(peaks, wanted.where("position > 0").select(*KEYS, "position", "mz").distinct(), KEYS)
    rows = wanted.join(ranked, [*KEYS, "position"], "left").join(near, [*KEYS, "position"], "left").select(
        "feature_idx", "example_id", "activation", "describe", (F.col("position") == 0).alias("is_latent"), F.col("mz").alias("peak_mz"), F.coalesce("rel_intensity", d(0)).alias("rel_intensity"), F.coalesce("peak_rank", F.lit(0)).alias("peak_rank"), F.coalesce("n_peaks", F.lit(0)).alias("n_peaks"),
        decode(F.col("ion").cast("int"), ION_TYPES).alias("ion_type"), F.col("proforma").alias("peptide"), "precursor_mz", "precursor_charge", F.coalesce("neighbour_mzs", F.array().cast("array<double>")).alias("neighbour_mzs"), concept_names(F.col("concepts")).alias("concepts"),
    )
    to.write(rows, "examples")
    rows = to.read("examples")
    first = example_rows(rows.where("describe"), True, with_concepts).select("feature_idx", description_prompt(F.col("table_text"), with_concepts).alias("prompt"))
    to.write(first, "prompts")
    to.write(interpret(to.read("prompts"), client, dry), "replies")
    text, short = parse_description(F.col("reply"))
    described = to.read("replies").select("feature_idx", text.alias("description"), short.alias("summary"))
    second = example_rows(rows.where("NOT describe"), False, with_concepts).join(described, "feature_idx").select("feature_idx", prediction_prompt(F.col("description"), F.col("table_text"), with_concepts).alias("prompt"))
    to.write(interpret(second, client, dry), "predictions")
    held = rows.where("NOT describe")
    scores = description_scores(parse_predictions(to.read("predictions"), held), held)
    to.write_csv(results(scores, chosen, stats, best, described.select("feature_idx", "summary")), "feature_descriptions")
    done = to.read_csv("feature_descriptions")
    to.write_rows_json(done.join(described.select("feature_idx", "description"), "feature_idx", "left"), "feature_descriptions.json")
    to.write(median_by_stratum(done), "median_by_stratum")
    return done
