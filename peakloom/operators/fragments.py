"""Theoretical fragments, the tolerance join with peaks, and the choice among candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.registry import CARBONYL, LOSSES, OTHER_SERIES, PRIORITY, PROTON, RESIDUES, WATER, _map


def residue_masses(peptide: Column, mods: Column) -> Column:
    """Mass of each residue with its modifications (array of position, mass; position 0 counts with the first)."""
    residue = _map(RESIDUES)
    extra = lambda i: F.aggregate(F.filter(mods, lambda m: F.greatest(m["position"], F.lit(1)) == i), F.lit(0.0), lambda a, m: a + m["mass"])
    each = lambda i: F.element_at(residue, F.substring(peptide, i, F.lit(1))) + extra(i)
    return F.when(F.length(peptide) > 0, F.transform(F.sequence(F.lit(1), F.length(peptide)), each)).otherwise(F.array().cast("array<double>"))


def theoretical_ions(spectra: DataFrame, keys: Sequence[str], series: str = "byIp", internal: bool = True, max_charge: Column | None = None) -> DataFrame:
    """Ions of each spectrum's peptide: keys, ion_type, ion_index, internal_end, residue, fragment_charge, neutral_loss, theory_mz.

    ``series``: letters of the ion types (a, b, c, x, y, z, I: immonium, p: precursor). ``spectra``: keys, peptide, precursor_charge, mods (position, mass). Backbone charges run to ``max_charge``, by
    default one less than the precursor's. Peptides with an unknown residue have no ions. Ions of one spectrum only
    depend on (peptide, mods, charge), so callers may pass distinct ones and join the result.
    """
    cum = F.aggregate("masses", F.array(F.lit(0.0)), lambda a, m: F.concat(a, F.array(F.element_at(a, -1) + m)))
    base = spectra.withColumn("masses", residue_masses(F.col("peptide"), F.col("mods")))
    base = base.where((F.size("masses") > 0) & ~F.exists("masses", lambda m: m.isNull())).withColumns({"cum": cum, "len": F.length("peptide")})
    base = base.withColumn("top", F.greatest(F.lit(1), max_charge if max_charge is not None else F.col("precursor_charge") - 1).cast("int")).select(*keys, "peptide", "masses", "cum", "len", "top", "precursor_charge")
    total = F.element_at("cum", -1)
    none_int, none_text = F.lit(None).cast("int"), F.lit(None).cast("string")
    fields = lambda kind, index, end, residue, neutral: F.struct(F.lit(kind).alias("ion_type"), index.alias("ion_index"), end.alias("internal_end"), residue.alias("residue"), neutral.alias("neutral"))
    inner = F.when(F.col("len") > 1, F.sequence(F.lit(1), F.col("len") - 1)).otherwise(F.array().cast("array<int>"))
    parts: list[DataFrame] = []
    losses = F.array(F.struct(F.lit("").alias("name"), F.lit(0.0).alias("mass")), *[F.struct(F.lit(n).alias("name"), F.lit(m).alias("mass")) for n, m in LOSSES.items()])

    def emit(ions: Column, charges: Column, with_loss: bool) -> None:
        rows = base.select(*keys, F.explode(ions).alias("ion"), charges.alias("charges")).select(*keys, "ion", F.explode("charges").alias("fragment_charge"))
        if with_loss:
            rows = rows.withColumn("loss", F.explode(losses))
        else:
            rows = rows.withColumn("loss", losses[0])
        z = F.col("fragment_charge")
        mz = (F.col("ion.neutral") - F.col("loss.mass") + z * PROTON) / z
        parts.append(rows.select(*keys, "ion.ion_type", "ion.ion_index", "ion.internal_end", "ion.residue", "fragment_charge", F.col("loss.name").alias("neutral_loss"), mz.alias("theory_mz")))

    one = F.array(F.lit(1))
    backbone = F.sequence(F.lit(1), F.col("top"))
    if "b" in series:
        emit(F.transform(inner, lambda k: fields("b", k, none_int, none_text, F.element_at("cum", k + 1))), backbone, True)
    if "y" in series:
        emit(F.transform(inner, lambda k: fields("y", k, none_int, none_text, total - F.element_at("cum", F.col("len") - k + 1) + WATER)), backbone, True)
    for kind, (origin, shift) in OTHER_SERIES.items():
        if kind in series:
            neutral = (lambda k: F.element_at("cum", k + 1)) if origin == "b" else (lambda k: total - F.element_at("cum", F.col("len") - k + 1) + WATER)
            emit(F.transform(inner, lambda k: fields(kind, k, none_int, none_text, neutral(k) + shift)), backbone, True)
    if "I" in series:
        places = F.sequence(F.lit(1), F.col("len"))
        emit(F.transform(places, lambda i: fields("I", none_int, none_int, F.substring("peptide", i, F.lit(1)), F.element_at("masses", i) - CARBONYL)), one, False)
    if internal:
        starts = F.when(F.col("len") > 3, F.sequence(F.lit(2), F.col("len") - 2)).otherwise(F.array().cast("array<int>"))
        spans = F.flatten(F.transform(starts, lambda a: F.transform(F.sequence(a + 1, F.col("len") - 1), lambda b: fields("internal", a, b, none_text, F.element_at("cum", b + 1) - F.element_at("cum", a)))))
        emit(spans, one, False)
    if "p" in series:
        emit(F.array(fields("precursor", none_int, none_int, none_text, total + WATER)), F.array(F.greatest(F.col("precursor_charge").cast("int"), F.lit(1))), True)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def within(measured: Column, theory: Column, tolerance: float, mode: str = "ppm") -> Column:
    return F.abs(measured - theory) / theory * 1e6 <= tolerance if mode == "ppm" else F.abs(measured - theory) <= tolerance


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], measured: str, theory: str, tolerance: float, mode: str = "ppm") -> DataFrame:
    """Rows of both sides with equal ``keys`` whose values lie within a tolerance, as an equi-join on bins.

    Bins are a little wider than the tolerance (of the logarithm for ppm); the left side is put into its own and the
    two next ones, so no pair is lost or found twice, and Spark may sort, hash or split the join as any other.
    """
    width = tolerance * 1.05e-6 if mode == "ppm" else tolerance * 1.05
    bin_of = (lambda c: F.floor(F.ln(c) / width)) if mode == "ppm" else (lambda c: F.floor(c / width))
    near = left.where(F.col(measured) > 0) if mode == "ppm" else left
    near = near.withColumn("_bin", F.explode(F.array(*[bin_of(F.col(measured)) + i for i in (-1, 0, 1)])))
    far = (right.where(F.col(theory) > 0) if mode == "ppm" else right).withColumn("_bin", bin_of(F.col(theory)))
    return near.join(far, [*keys, "_bin"]).where(within(F.col(measured), F.col(theory), tolerance, mode)).drop("_bin")


CANDIDATE = ("ion_type", "ion_index", "internal_end", "residue", "fragment_charge", "neutral_loss", "theory_mz")


def best_candidates(matches: DataFrame, token: Sequence[str], measured: str = "mz", isotope: str | None = None) -> DataFrame:
    """One candidate for each token: no isotope, no loss, series, charge, mass error, then all of its fields.

    A minimum over structs, so tasks keep one row for each token before the shuffle.
    """
    rank = F.coalesce(F.element_at(_map(PRIORITY), F.col("ion_type")), F.lit(5))
    error = F.round(F.abs(F.col(measured) - F.col("theory_mz")), 9)
    order = F.struct(
        (F.col(isotope) != 0 if isotope else F.lit(False)).alias("i"), (F.col("neutral_loss") != "").alias("l"), rank.alias("r"), F.col("fragment_charge").alias("z"), error.alias("e"),
        *[F.coalesce(F.col(c), F.lit("" if c in ("ion_type", "residue", "neutral_loss") else -1)).alias(f"t{i}") for i, c in enumerate(CANDIDATE)],
    )
    best = matches.groupBy(*token).agg(F.min_by(F.struct(*CANDIDATE), order).alias("best"))
    return best.select(*token, "best.*")
