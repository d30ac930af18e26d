"""The 50 concepts of a token as one bitmask, from its annotation and its spectrum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.proforma import ptm_name
from ..plans.registry import CHARGE_CAP, COVERED, INDEX_CAP, ION_TYPES, LENGTH_CUTS, LOSS_TYPES, MZ_CUTS, PTMS, bitmask, encode

PTM_NAMES = tuple(name for name, _ in PTMS.values())


def spectrum_flags(peptide: Column, ptms: Column, charge: Column) -> dict[str, Column]:
    """Concepts of the whole spectrum; ``ptms``: names of its tracked modifications."""
    n = F.length(peptide)
    short, long = LENGTH_CUTS
    return {
        **{f"precursor_charge_{z}": charge == z for z in (2, 3, 4)},
        "peptide_length_short": n < short,
        "peptide_length_medium": (n >= short) & (n < long),
        "peptide_length_long": n >= long,
        **{f"spectrum_contains_{p}": F.array_contains(ptms, p) for p in PTM_NAMES},
    }


def coverage(ion: Column, index: Column, end: Column, length: Column) -> tuple[Column, Column]:
    """First and last residue that an ion covers; null where it covers none (immonium, noise, no index)."""
    whole = ion.isin("precursor", "latent")
    lo = F.when(ion == "b", F.lit(1)).when(ion == "y", length - index + 1).when(ion == "internal", index).when(whole, F.lit(1))
    hi = F.when(ion == "b", index).when(ion == "y", length).when(ion == "internal", end).when(whole, length)
    return lo, hi


def cleavage_site(ion: Column, index: Column, length: Column) -> Column:
    """Residues before the broken bond, for b and y ions with 1 <= k < length."""
    return F.when((index >= 1) & (index < length), F.when(ion == "b", index).when(ion == "y", length - index))


def peak_flags(peptide: Column, mods: Column, ion: Column, index: Column, end: Column, residue: Column, charge: Column, loss: Column, mz: Column, intensity: Column, threshold: Column) -> dict[str, Column]:
    """Concepts of one peak. ``mods``: array of (position, ptm); noise peaks count as charge 1."""
    n = F.length(peptide)
    low, high = MZ_CUTS
    lo, hi = coverage(ion, index, end, n)
    backbone = F.when(index > 0, F.when(ion == "b", index).when(ion == "y", n - index))
    site = cleavage_site(ion, index, n)
    before, after = F.substring(peptide, site, F.lit(1)), F.substring(peptide, site + 1, F.lit(1))
    span = F.substring(peptide, F.greatest(lo, F.lit(1)), hi - F.greatest(lo, F.lit(1)) + 1)
    in_series = ion.isin("b", "y")
    flags = {
        "is_b_ion": ion == "b", "is_y_ion": ion == "y", "is_I_ion": ion == "I", "is_internal_fragment": ion == "internal", "is_precursor_related": ion == "precursor",
        "is_matched_peak": ~ion.isin("noise", "latent"), "is_noise_peak": ion == "noise", "is_latent_token": F.lit(False),
        "is_H2O_loss": F.contains(loss, F.lit("H2O")), "is_NH3_loss": F.contains(loss, F.lit("NH3")), "has_neutral_loss": F.length(loss) > 0,
        "is_fragment_charge_1": charge == 1, "is_fragment_charge_2": charge == 2,
        "position_Nterm": 3 * backbone < n, "position_middle": (3 * backbone >= n) & (3 * backbone < 2 * n), "position_Cterm": 3 * backbone >= 2 * n,
        "mz_low": mz < low, "mz_mid": (mz >= low) & (mz < high), "mz_high": mz >= high,
        "top_decile_intensity": intensity >= threshold,
        "is_first_ion": in_series & (index == 1), "is_last_ion": in_series & (index == n - 1) & (index > 0),
        "cleaves_C_to_Lys": before == "K", "cleaves_C_to_Arg": before == "R",
        "cleaves_N_to_Pro": after == "P", "cleaves_C_to_Asp": before == "D", "cleaves_C_to_Glu": before == "E",
    }
    flags |= {f"covers_{r}": F.when(ion == "I", residue == r).otherwise(F.contains(span, F.lit(r))) for r in COVERED}

    def contained(p: str) -> Column:
        return F.exists(mods, lambda m: F.coalesce((m["ptm"] == p) & m["position"].between(1, n) & m["position"].between(lo, hi), F.lit(False)))

    return flags | {f"ion_contains_{p}": contained(p) for p in PTM_NAMES}


def latent_flags(peptide: Column, mods: Column) -> dict[str, Column]:
    """Concepts of the latent token beside those of its spectrum; modifications count wherever they sit."""

    def anywhere(p: str) -> Column:
        return F.exists(mods, lambda m: F.coalesce(m["ptm"] == p, F.lit(False)))

    return {
        "is_latent_token": F.lit(True),
        **{f"covers_{r}": F.contains(peptide, F.lit(r)) for r in COVERED},
        **{f"ion_contains_{p}": anywhere(p) for p in PTM_NAMES},
    }


def tracked_mods(modifications: Column, peptide: Column, table: dict[str, int] | None = None) -> Column:
    """(position, ptm) of each modification; ptm is null for untracked ones."""
    return F.transform(modifications, lambda m: F.struct(m["position"].alias("position"), ptm_name(m, peptide, table).alias("ptm")))


def decile_threshold(peaks: DataFrame, keys: Sequence[str], intensity: str = "intensity") -> DataFrame:
    """Exact 90th percentile of each spectrum's intensities, interpolated: keys, threshold."""
    return peaks.groupBy(*keys).agg(F.percentile(F.col(intensity), F.lit(0.9)).alias("threshold"))


def with_decile_threshold(peaks: DataFrame, keys: Sequence[str], intensity: str = "intensity") -> DataFrame:
    """The same beside every peak, by a window over the spectrum's bounded rows."""
    return peaks.withColumn("threshold", F.percentile(F.col(intensity), F.lit(0.9)).over(W.partitionBy(*keys)))


def spectrum_mask(peptide: Column, charge: Column, mods: Column) -> Column:
    """Bits of the concepts of a whole spectrum; ``mods``: array of (position, ptm)."""
    ptms = F.array_distinct(F.filter(F.transform(mods, lambda m: m["ptm"]), lambda p: p.isNotNull()))
    return bitmask(spectrum_flags(peptide, ptms, charge))


def label_tokens(tokens: DataFrame, spectra: DataFrame | None, keys: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """Annotated tokens (peaks and latent) with their concepts bitmask and compact metadata, and ``more`` of their columns.

    ``tokens``: keys, position, mz, intensity, threshold, and the candidate columns, null for noise.
    ``spectra``: keys, peptide, precursor_charge, mods (position, ptm); none if the tokens carry peptide, mods and
    spectrum_mask themselves, which saves the join.
    """
    latent = F.col("position") == 0
    ion = F.when(latent, "latent").otherwise(F.coalesce("ion_type", F.lit("noise")))
    charge = F.when(latent, 0).otherwise(F.coalesce("fragment_charge", F.lit(1)))
    loss = F.when(latent, "").otherwise(F.coalesce("neutral_loss", F.lit("")))
    if spectra is not None:
        whole = spectra.withColumn("spectrum_mask", spectrum_mask(F.col("peptide"), F.col("precursor_charge"), F.col("mods")))
        tokens = tokens.join(whole.select(*keys, "peptide", "mods", "spectrum_mask"), list(keys))
    rows = tokens.withColumns({"ion": ion, "charge": charge, "loss": loss})
    peak = peak_flags(*[F.col(c) for c in ("peptide", "mods", "ion", "ion_index", "internal_end", "residue", "charge", "loss", "mz", "intensity", "threshold")])
    own = F.when(latent, bitmask(latent_flags(F.col("peptide"), F.col("mods")))).otherwise(bitmask(peak))
    return rows.select(
        *keys, "position", *more, own.bitwiseOR(F.col("spectrum_mask")).alias("concepts"),
        encode(F.col("ion"), ION_TYPES).cast("tinyint").alias("ion_type"), F.least(F.coalesce("ion_index", F.lit(-1)), F.lit(INDEX_CAP)).cast("smallint").alias("ion_index"),
        F.least("charge", F.lit(CHARGE_CAP)).cast("tinyint").alias("fragment_charge"), encode(F.col("loss"), LOSS_TYPES).cast("tinyint").alias("neutral_loss"),
        F.col("mz").cast("float").alias("peak_mz"), F.col("intensity").cast("float").alias("peak_intensity"),
    )


def annotate(spectra: DataFrame, peaks: DataFrame, keys: Sequence[str], tolerance: float = 20.0, mode: str = "ppm", series: str = "byIp", internal: bool = True) -> DataFrame:
    """Tokens with their best fragment where peaks are rows of their own: band join, choice of a candidate, noise for the rest.

    ``matching.match_spectra`` does the same without a join where each spectrum holds its peaks. ``spectra``: keys, peptide, precursor_charge, mods with mass; ``peaks``: keys, position, mz, intensity.
    """
    from .fragments import CANDIDATE, band_join, best_candidates, theoretical_ions
    from .tokens import with_latent

    ions = theoretical_ions(spectra.select(*keys, "peptide", "precursor_charge", "mods"), keys, series, internal)
    matches = band_join(peaks, ions, keys, "mz", "theory_mz", tolerance, mode)
    best = best_candidates(matches, [*keys, "position"])
    found = with_decile_threshold(peaks, keys).join(best, [*keys, "position"], "left")
    return with_latent(found.select(*keys, "position", "mz", "intensity", "threshold", *CANDIDATE[:-1]), spectra, keys)


