"""Per-spectrum losses, concept prevalence, and what ablations show."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import d
from ..plans.registry import has
from ..staging import staged
from .statistics import exact_quantiles

Draw = Callable[..., Column]
LEAST_SPECTRA = 6
MATCH_DEX = 0.3


def prevalence(labels: DataFrame, n_concepts: int, key: str = "global_spectrum", mask: str = "concepts") -> DataFrame:
    """key and p0, p1, ...: share of a spectrum's tokens (the latent one included) with each concept."""
    return labels.groupBy(key).agg(*[F.avg(F.when(has(F.col(mask), i), d(1)).otherwise(d(0))).alias(f"p{i}") for i in range(n_concepts)])


def spectrum_ce(tokens: DataFrame, key: str = "global_spectrum") -> DataFrame:
    """key, mean_ce, correct, valid from rows of real output tokens (ce, hit)."""
    return tokens.groupBy(key).agg((F.sum("ce") / F.greatest(F.count("*"), F.lit(1))).alias("mean_ce"), F.sum(F.col("hit").cast("long")).alias("correct"), F.count("*").alias("valid"))


def cached_clean_ce(chunks: DataFrame, baseline: DataFrame, key: str = "global_spectrum") -> DataFrame | None:
    """Clean losses from stored baselines; None if any chunk has none."""
    if chunks.join(baseline.select("chunk_idx").distinct(), "chunk_idx", "left_anti").limit(1).count():
        return None
    return spectrum_ce(baseline, key)


def weighted_mean(value: Column, valid: Column) -> Column:
    """Token-weighted mean, as an aggregate; null of no rows."""
    return F.sum(value * valid) / F.greatest(F.sum(valid), d(1))


def ce_alignment(cached: DataFrame, fresh: DataFrame, key: str = "global_spectrum") -> DataFrame:
    """n, means, mean and largest absolute difference, and whether the means agree within 1 percent (0.01 at least)."""
    both = cached.select(key, F.col("mean_ce").alias("a")).join(fresh.select(key, F.col("mean_ce").alias("b")), key)
    out = both.agg(F.count("*").alias("n"), F.avg("a").alias("cached_mean"), F.avg("b").alias("fresh_mean"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_abs_diff"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_abs_diff"))
    return out.withColumn("aligned", F.col("mean_abs_diff") <= F.greatest(d(0.01), 0.01 * F.abs("cached_mean")))


def loss_recovered(losses: DataFrame) -> DataFrame:
    """Phase-7 row from (mode, mean_ce, correct, valid): token-weighted losses, share recovered, top-1 accuracy drop."""
    of = lambda mode, c: F.sum(F.when(F.col("mode") == mode, c))
    only = lambda mode, c: F.when(F.col("mode") == mode, F.col(c).cast("double"))
    mean = lambda mode: weighted_mean(only(mode, "mean_ce"), only(mode, "valid"))
    accuracy = lambda mode: of(mode, F.col("correct").cast("double")) / F.greatest(of(mode, F.col("valid").cast("double")), d(1))
    modes = {f"ce_{m}": mean(m) for m in ("clean", "sae", "zero", "mean")}
    out = losses.agg(*[c.alias(n) for n, c in modes.items()], accuracy("clean").alias("top1_acc_clean"), accuracy("sae").alias("top1_acc_sae"), of("clean", F.col("valid")).alias("n_tokens"), F.count(F.when(F.col("mode") == "clean", 1)).alias("n_spectra"))
    gap = F.col("ce_zero") - F.col("ce_clean")
    return out.withColumns({"loss_recovered_vs_zero": F.when(F.abs(gap) > 1e-12, (F.col("ce_zero") - F.col("ce_sae")) / gap), "top1_drop_pp": (F.col("top1_acc_clean") - F.col("top1_acc_sae")) * 100})


def deltas(ablated: DataFrame, full: DataFrame, keys: Sequence[str] = ("global_spectrum",)) -> DataFrame:
    """delta_ce of every spectrum that both runs hold; ``ablated`` may have a set_idx as well."""
    base = full.select(*keys, F.col("mean_ce").alias("_full"))
    return ablated.join(base, list(keys)).withColumn("delta_ce", F.col("mean_ce") - F.col("_full")).drop("_full")


def tercile_cuts(rows: DataFrame, keys: Sequence[str], p: str = "prevalence") -> DataFrame:
    """keys, n, lo_cut, hi_cut: the exact terciles of prevalence, interpolated."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile(p, F.lit(1.0 / 3.0)).alias("lo_cut"), F.percentile(p, F.lit(2.0 / 3.0)).alias("hi_cut"))


def selectivity(rows: DataFrame, keys: Sequence[str], delta: str = "delta_ce", p: str = "prevalence", cuts: DataFrame | None = None, cut_keys: Sequence[str] = ()) -> DataFrame:
    """keys, n, lo_cut, hi_cut, selectivity: mean delta on the top tercile of prevalence less that on the bottom one.

    Both terciles hold their edge. Null for fewer than six spectra or equal edges. Where groups share their spectra,
    as ablations of one concept do, ``cuts`` by ``cut_keys`` (some of ``keys``) are taken once and for all.
    """
    by = list(keys)
    cuts, on = (tercile_cuts(rows, by, p), by) if cuts is None else (cuts, list(cut_keys))
    joined = rows.join(F.broadcast(cuts), on) if on else rows.join(F.broadcast(cuts))  # one row for each concept or set: rows stay
    mean = lambda cond: F.avg(F.when(cond, F.col(delta)))
    out = joined.groupBy(*by, "n", "lo_cut", "hi_cut").agg(mean(F.col(p) >= F.col("hi_cut")).alias("hi"), mean(F.col(p) <= F.col("lo_cut")).alias("lo"), F.avg(delta).alias("mean_delta_ce"))
    fine = (F.col("n") >= LEAST_SPECTRA) & (F.col("lo_cut") != F.col("hi_cut"))
    return out.select(*by, "n", "lo_cut", "hi_cut", F.when(fine, F.col("hi") - F.col("lo")).alias("selectivity"), "mean_delta_ce")


def orthogonal_selectivity(rows: DataFrame, keys: Sequence[str], others: Sequence[str], delta: str = "delta_ce", p: str = "prevalence") -> DataFrame:
    """Selectivity over the spectra where every correlated concept (columns ``others``) is absent."""
    for c in others:
        rows = rows.where(F.col(c) <= 0)
    return selectivity(rows, keys, delta, p)


def rate_bins(features: DataFrame, bins: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """Adds bin by quantiles of log10 firing rate in each group; a feature within 1e-9 of an upper edge is in both bins."""
    rows = features.withColumn("log_rate", F.log10(F.greatest("firing_rate", d(1e-12))))
    rows = staged(rows, "rates")
    edges = exact_quantiles(rows, keys, "log_rate", [i / bins for i in range(bins + 1)]).withColumnRenamed("q", "e").drop("n")
    every = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.struct(b.alias("bin"), F.element_at("e", b + 1).alias("low"), F.element_at("e", b + 2).alias("high")))
    binned = (rows.join(edges, list(keys)) if keys else rows.join(F.broadcast(edges))).withColumn("x", F.explode(every))
    return binned.where((F.col("log_rate") >= F.col("x.low")) & (F.col("log_rate") < F.col("x.high") + 1e-9)).withColumn("bin", F.col("x.bin")).drop("x", "e")


def unit_hash(*parts: Column | str | int) -> Column:
    """A number in (0, 1) that hangs on its parts alone: sampling without state."""
    columns = [F.lit(p) if isinstance(p, int) else F.col(p) if isinstance(p, str) else p for p in parts]
    return (F.pmod(F.xxhash64(*columns), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def stratified_features(features: DataFrame, total: int, bins: int = 5, seed: int = 0, keys: Sequence[str] = (), draw: Draw = unit_hash) -> DataFrame:
    """keys, bin, place, feature_idx, firing_rate, f1_dom: a weighted sample without replacement in each firing-rate bin of a group.

    Smallest -ln(u) / f1_dom first; ``draw`` gives u, a number in (0, 1), from its parts.
    """
    per_bin, by = max(1, total // bins), list(keys)
    key = -F.log(draw("feature_idx", "bin", seed)) / F.greatest("f1_dom", d(1e-6))
    drawn = rate_bins(features.where("rejected"), bins, keys).withColumn("key", key)
    ranked = drawn.withColumn("place", F.row_number().over(W.partitionBy(*by, "bin").orderBy("key", "feature_idx"))).where(F.col("place") <= per_bin)
    first = ranked.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy("bin", "place"))).where(F.col("_n") <= total)
    return first.select(*by, "bin", "place", "feature_idx", "firing_rate", "f1_dom")


def matched_controls(targets: DataFrame, features: DataFrame, replicates: int = 5, seed: int = 0, dex: float = MATCH_DEX, keys: Sequence[str] = (), draw: Draw = unit_hash) -> DataFrame:
    """keys, replicate, target_idx, feature_idx: for each target and replicate one feature of like firing rate, no target of its group.

    ``targets``: keys, feature_idx; ``features``: feature_idx, firing_rate of the whole dictionary. A band join on log10
    of the rate; the one with the least ``draw`` is taken.
    """
    by = list(keys)
    log = features.select("feature_idx", "firing_rate").withColumn("log_rate", F.log10(F.greatest("firing_rate", d(1e-12))))
    pool = log.withColumn("_bin", F.floor(F.col("log_rate") / dex))
    own = targets.select(*by, "feature_idx").distinct()
    wanted = own.join(log, "feature_idx").select(*by, F.col("feature_idx").alias("target_idx"), F.col("log_rate").alias("target_rate"), F.explode(F.array(*[F.floor(F.col("log_rate") / dex) + i for i in (-1, 0, 1)])).alias("_bin"))
    near = wanted.join(pool, "_bin").where(F.abs(F.col("log_rate") - F.col("target_rate")) < dex).join(own, [*by, "feature_idx"], "left_anti")
    rows = near.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    best = rows.groupBy(*by, "replicate", "target_idx").agg(F.min_by("feature_idx", F.struct(draw("feature_idx", "target_idx", "replicate", seed).alias("u"), F.col("feature_idx"))).alias("feature_idx"))
    return best.select(*by, "replicate", "target_idx", "feature_idx")


def ablation_plan(pairs: DataFrame, rates: DataFrame, top_n: int = 10, singles: int = 100, replicates: int = 5, bins: int = 5, seed: int = 0, draw: Draw = unit_hash) -> DataFrame:
    """concept_idx, kind, replicate, features, f1_dom, lift: every set of features that is ablated for a concept.

    ``group``: a stratified sample of its rejected features; ``control``: features of like firing rates, one set for each
    replicate; ``single``: its ``singles`` rejected features with the highest f1_dom, replicate counting them from 1.
    ``rates``: feature_idx, firing_rate. All concepts are planned together.
    """
    by, none = ["concept_idx"], F.lit(None).cast("double")
    rejected = pairs.where("rejected").select("concept_idx", "feature_idx", "f1_dom", "lift", "rejected").join(rates, "feature_idx")
    group = stratified_features(rejected, top_n, bins, seed, by, draw)
    control = matched_controls(group, rates, replicates, seed, keys=by, draw=draw)
    listed = F.sort_array(F.collect_set("feature_idx")).alias("features")
    single = rejected.withColumn("replicate", F.row_number().over(W.partitionBy(*by).orderBy(F.col("f1_dom").desc(), "feature_idx"))).where(F.col("replicate") <= singles)
    parts = [
        group.groupBy(*by).agg(listed).select(*by, F.lit("group").alias("kind"), F.lit(0).alias("replicate"), "features", none.alias("f1_dom"), none.alias("lift")),
        control.groupBy(*by, "replicate").agg(listed).select(*by, F.lit("control").alias("kind"), "replicate", "features", none.alias("f1_dom"), none.alias("lift")),
        single.select(*by, F.lit("single").alias("kind"), "replicate", F.array("feature_idx").alias("features"), "f1_dom", "lift"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def numbered_sets(plan: DataFrame) -> DataFrame:
    """The plan with set_idx: equal sets of features have one number, so each is run once. A plan is small: its size is bounded by its options."""
    sets = plan.select("features").distinct().withColumn("set_idx", F.row_number().over(W.orderBy("features")) - 1)
    return plan.join(F.broadcast(sets), "features")


def prevalence_lists(shares: DataFrame, n_concepts: int, key: str = "global_spectrum") -> DataFrame:
    """key, prevalences (one for each concept), present (bits of all concepts that the spectrum has) from the wide shares."""
    present = F.lit(0).cast("long")
    for i in range(n_concepts):
        present = present.bitwiseOR(F.when(F.col(f"p{i}") > 0, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return shares.select(key, present.alias("present"), F.array(*[f"p{i}" for i in range(n_concepts)]).alias("prevalences"))


def correlated_masks(phis: DataFrame, threshold: float = 0.3) -> DataFrame:
    """concept_idx, mask, n_correlated: bits of the concepts whose |phi| with it is over a threshold."""
    near = phis.where((F.col("ci") != F.col("cj")) & (F.abs("phi") > threshold))
    return near.groupBy(F.col("ci").alias("concept_idx")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("cj").cast("int"))).alias("mask"), F.count("*").alias("n_correlated"))


def ablation_rows(plan: DataFrame, runs: DataFrame, prevalences: DataFrame, key: str = "global_spectrum") -> DataFrame:
    """A row for each planned set and spectrum: concept_idx, kind, replicate, delta_ce against the full reconstruction, prevalence, present.

    ``plan`` with set_idx; ``runs``: mode, set_idx, key, mean_ce, with modes sae and ablate. Spectra that any side lacks
    take no part. ``prevalences`` (of ``prevalence_lists``) and both runs meet by the spectrum alone, and a row for each
    planned set is made last, so what is moved grows with the runs and not with concepts.
    """
    moved = deltas(runs.where("mode = 'ablate'").select("set_idx", key, "mean_ce"), runs.where("mode = 'sae'"), [key])
    planned = F.broadcast(plan.select("concept_idx", "kind", "replicate", "set_idx"))
    shared = F.element_at("prevalences", F.col("concept_idx") + 1).alias("prevalence")
    return moved.join(prevalences, key).join(planned, "set_idx").select("concept_idx", "kind", "replicate", key, "delta_ce", shared, "present")


def causal_reports(rows: DataFrame, masks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Causal metrics of every concept's group of features, and of its single features, from ``ablation_rows``.

    All concepts come out of one aggregation: terciles of prevalence by concept, then the contrasts of every set;
    correlated concepts are told from the bits of a spectrum's concepts.
    """
    by = ["concept_idx"]
    group = rows.where("kind = 'group'")
    found = selectivity(rows, [*by, "kind", "replicate"], cuts=tercile_cuts(group, by), cut_keys=by)
    alone = group.join(F.broadcast(masks), "concept_idx", "left").where(F.col("present").bitwiseAND(F.coalesce("mask", F.lit(0).cast("long"))) == 0)
    orthogonal = selectivity(alone, by).select("concept_idx", F.col("selectivity").alias("orthogonalised_selectivity"), F.col("n").alias("n_orthogonal_spectra"))
    control = found.where("kind = 'control'").groupBy(*by).agg(
        F.avg("selectivity").alias("control_mean_selectivity"), F.stddev_samp("selectivity").alias("ss"), F.count("selectivity").alias("ns"),
        F.avg("mean_delta_ce").alias("control_mean_delta_ce"), F.stddev_samp("mean_delta_ce").alias("sm"), F.count("mean_delta_ce").alias("nm"),
    )
    z = lambda v, m, s, n: F.when((F.col(n) >= 2) & (F.col(s) > 1e-12), (F.col(v) - F.col(m)) / F.col(s))
    own = found.where("kind = 'group'").join(control, "concept_idx", "left").join(orthogonal, "concept_idx", "left").join(F.broadcast(masks.select("concept_idx", "n_correlated")), "concept_idx", "left")
    groups = own.select(
        "concept_idx", "mean_delta_ce", "selectivity", "orthogonalised_selectivity", "control_mean_delta_ce", "control_mean_selectivity",
        z("mean_delta_ce", "control_mean_delta_ce", "sm", "nm").alias("magnitude_z"), z("selectivity", "control_mean_selectivity", "ss", "ns").alias("selectivity_z"),
        F.col("n").alias("n_spectra"), F.coalesce("n_orthogonal_spectra", F.lit(0)).alias("n_orthogonal_spectra"), F.coalesce("nm", F.lit(0)).alias("matched_random_count"),
        F.coalesce("n_correlated", F.lit(0)).alias("n_correlated_controlled"),
    )
    return groups, found.where("kind = 'single'").select("concept_idx", "replicate", "mean_delta_ce", "selectivity")


def hypergeometric_null(pairs: DataFrame, draws: int = 100, seed: int = 42) -> DataFrame:
    """feature_idx, concept_idx, observed_chi2, empirical_p, asymptotic_p, discrepancy_ratio of pairs with counts.

    The null keeps both margins; each pair draws from its own seed, so results do not hang on partitioning.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, c, mf, mc, n, chi2, p = (b.column(k).to_numpy(zero_copy_only=False) for k in ("feature_idx", "concept_idx", "mf", "mc", "n", "chi2", "p_value"))
            out = []
            for i in range(len(f)):
                if not (mf[i] and mc[i] and n[i]):
                    out.append(None)
                    continue
                n11 = np.random.default_rng([seed, int(f[i]), int(c[i])]).hypergeometric(int(mc[i]), int(n[i] - mc[i]), int(mf[i]), draws).astype(float)
                n10, n01 = mf[i] - n11, mc[i] - n11
                n00 = n[i] - mf[i] - mc[i] + n11
                null = n[i] * (n11 * n00 - n10 * n01) ** 2 / np.maximum((n11 + n10) * (n00 + n01) * (n11 + n01) * (n00 + n10), 1e-12)
                out.append(float((null >= chi2[i]).mean()))
            ratio = [None if e is None else e / max(a, 1e-12) for e, a in zip(out, p, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("feature_idx"), b.column("concept_idx"), pa.array(chi2), pa.array(out, pa.float64()), pa.array(p), pa.array(ratio, pa.float64())], names=["feature_idx", "concept_idx", "observed_chi2", "empirical_p", "asymptotic_p", "discrepancy_ratio"])

    cast = pairs.select(F.col("feature_idx").cast("int"), F.col("concept_idx").cast("int"), *[F.col(k).cast("double") for k in ("mf", "mc", "n", "chi2", "p_value")])
    return cast.mapInArrow(run, "feature_idx int, concept_idx int, observed_chi2 double, empirical_p double, asymptotic_p double, discrepancy_ratio double")


def null_test(pairs: DataFrame, most: int = 120, draws: int = 100, seed: int = 42) -> DataFrame:
    """The null test on the best concept of the ``most`` features with the highest f1_dom and any rejected pair."""
    best = pairs.groupBy("feature_idx").agg(F.max_by(F.struct("concept_idx", "mf", "mc", "n", "chi2", "p_value"), F.struct("f1_dom", -F.col("concept_idx"))).alias("x"), F.max("f1_dom").alias("top"), F.bool_or("rejected").alias("any"))
    chosen = best.where("any").orderBy(F.col("top").desc(), "feature_idx").limit(most).select("feature_idx", "x.*")
    return hypergeometric_null(chosen, draws, seed)


def mean_selectivity_z(groups: DataFrame, concepts: DataFrame) -> DataFrame:
    """Mean selectivity_z over the concepts that are not diagnostic; undefined ones are left out."""
    known = F.nanvl(F.col("selectivity_z"), F.lit(None).cast("double"))
    return groups.join(F.broadcast(concepts.where("NOT diagnostic").select("concept_idx")), "concept_idx").agg(F.avg(known).alias("mean_selectivity_z"))


def best_causal_record(records: DataFrame) -> DataFrame:
    """The record of each feature with the largest |selectivity|; undefined ones come last, then the concept's name."""
    rank = F.struct(F.coalesce(F.abs(F.nanvl(F.col("selectivity"), F.lit(None).cast("double"))), d(-1)).alias("s"), F.col("concept").alias("c"))
    fields = [c for c in records.columns if c != "feature_idx"]
    return records.groupBy("feature_idx").agg(F.max_by(F.struct(*fields), rank).alias("x")).select("feature_idx", "x.*")
