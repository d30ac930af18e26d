"""The concept registry, vocabularies and tracked modifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Families and their concepts, in the order that numbers them.
FAMILIES: dict[str, tuple[str, ...]] = {
    "ion_type": ("is_b_ion", "is_y_ion", "is_I_ion", "is_internal_fragment", "is_precursor_related", "is_matched_peak", "is_noise_peak", "is_latent_token"),
    "neutral_loss": ("is_H2O_loss", "is_NH3_loss", "has_neutral_loss"),
    "fragment_charge": ("is_fragment_charge_1", "is_fragment_charge_2"),
    "precursor_charge": ("precursor_charge_2", "precursor_charge_3", "precursor_charge_4"),
    "position": ("position_Nterm", "position_middle", "position_Cterm"),
    "mass_region": ("mz_low", "mz_mid", "mz_high"),
    "intensity": ("top_decile_intensity",),
    "first_last_ion": ("is_first_ion", "is_last_ion"),
    "cleavage_canonical": ("cleaves_C_to_Lys", "cleaves_C_to_Arg"),
    "cleavage_enhanced": ("cleaves_N_to_Pro", "cleaves_C_to_Asp", "cleaves_C_to_Glu"),
    "residue_cover": ("covers_K", "covers_R", "covers_W", "covers_F", "covers_Y", "covers_P", "covers_M", "covers_C", "covers_D", "covers_E", "covers_N"),
    "peptide_length": ("peptide_length_short", "peptide_length_medium", "peptide_length_long"),
    "ion_ptm": ("ion_contains_oxidation", "ion_contains_cam_cys", "ion_contains_deamidation"),
    "spectrum_ptm_diagnostic": ("spectrum_contains_oxidation", "spectrum_contains_cam_cys", "spectrum_contains_deamidation"),
}
DIAGNOSTIC = ("spectrum_ptm_diagnostic",)
# m/z and length cuts, tracked modifications (UNIMOD id: name, mass), losses, vocabularies, caps.
MZ_CUTS = (300.0, 1000.0)
LENGTH_CUTS = (7, 16)
PTMS = {35: ("oxidation", 15.994915), 4: ("cam_cys", 57.021464), 7: ("deamidation", 0.984016)}
PTM_TOLERANCE = 0.02
LOSSES = {"H2O": 18.010565, "NH3": 17.026549}
ION_TYPES = {"noise": 0, "latent": 1, "precursor": 2, "b": 3, "y": 4, "I": 5, "internal": 6, "a": 7, "c": 8, "x": 9, "z": 10}
LOSS_TYPES = {"": 0, "H2O": 1, "NH3": 2, "H2O+NH3": 3, "H3PO4": 4}
PRIORITY = {"b": 0, "y": 0, "a": 1, "c": 1, "x": 1, "z": 1, "I": 2, "internal": 3, "precursor": 4}
INDEX_CAP, CHARGE_CAP = 32_000, 127
# Monoisotopic residue masses, proton and water.
RESIDUES = {
    "G": 57.021464, "A": 71.037114, "S": 87.032028, "P": 97.052764, "V": 99.068414, "T": 101.047679, "C": 103.009185, "L": 113.084064, "I": 113.084064, "N": 114.042927,
    "D": 115.026943, "Q": 128.058578, "K": 128.094963, "E": 129.042593, "M": 131.040485, "H": 137.058912, "F": 147.068414, "R": 156.101111, "Y": 163.063329, "W": 186.079313,
}
PROTON, WATER, CARBONYL = 1.007276, 18.010565, 27.994915
# Other backbone series, as the series they start from and the mass added to it.
OTHER_SERIES = {"a": ("b", -27.994915), "c": ("b", 17.026549), "x": ("y", 25.979265), "z": ("y", -17.026549)}

CONCEPTS: tuple[str, ...] = tuple(c for family in FAMILIES.values() for c in family)
FAMILY_OF = {c: family for family, concepts in FAMILIES.items() for c in concepts}
BIT = {c: i for i, c in enumerate(CONCEPTS)}
COVERED = tuple(c.removeprefix("covers_") for c in FAMILIES["residue_cover"])


def concept_table(spark: SparkSession) -> DataFrame:
    """concept_idx, concept, family, diagnostic: one row for each of the 50 concepts."""
    rows = [(BIT[c], c, FAMILY_OF[c], FAMILY_OF[c] in DIAGNOSTIC) for c in CONCEPTS]
    return spark.createDataFrame(rows, "concept_idx int, concept string, family string, diagnostic boolean")


def bitmask(flags: dict[str, Column]) -> Column:
    """One long with the bit of every true concept; absent or null flags are false."""
    out = F.lit(0).cast("long")
    for concept, flag in flags.items():
        out = out + F.when(flag, F.lit(1 << BIT[concept]).cast("long")).otherwise(F.lit(0).cast("long"))
    return out


def has(mask: Column, concept: int | str) -> Column:
    """The bit of a concept as a boolean."""
    return F.getbit(mask, F.lit(concept if isinstance(concept, int) else BIT[concept])) == 1


def encode(value: Column, vocabulary: dict[str, int]) -> Column:
    """Number of a name; 0 for unknown ones."""
    return F.coalesce(F.element_at(_map(vocabulary), value), F.lit(0))


def decode(value: Column, vocabulary: dict[str, int]) -> Column:
    """Name of a number; ``unknown`` for others."""
    return F.coalesce(F.element_at(_map({v: k for k, v in vocabulary.items()}), value), F.lit("unknown"))


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
