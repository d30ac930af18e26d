"""Peptide notation: ProForma text, modifications and their identity, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.registry import PTM_TOLERANCE, PTMS, _map

TAG = r"([^\[]*)\[([^\]]+)\]"


def to_proforma(sequence: Column) -> Column:
    """``(+15.99)`` becomes ``[+15.99]`` and ``(+.98)`` becomes ``[+0.98]``."""
    dotted = F.regexp_replace(sequence, r"\(([+-])\.(\d+)\)", r"[$10.$2]")
    return F.regexp_replace(dotted, r"\(([+-])(\d*\.?\d+)\)", r"[$1$2]")


def bare_sequence(sequence: Column) -> Column:
    """Letters outside tags."""
    return F.regexp_replace(F.regexp_replace(sequence, r"\[[^\]]*\]", ""), "[^A-Za-z]", "")


def _tags(proforma: Column) -> Column:
    """Pairs of the text before a tag and the tag's own."""
    return F.arrays_zip(F.regexp_extract_all(proforma, F.lit(TAG), F.lit(1)), F.regexp_extract_all(proforma, F.lit(TAG), F.lit(2)))


def modifications(proforma: Column) -> Column:
    """Array of (position, mod_name, unimod_id): 1-based residue before the tag, 0 at the N-terminus; -1 without an id."""
    letters = lambda text: F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    unimod = lambda tag: F.coalesce(F.nullif(F.regexp_extract(tag, r"UNIMOD:(\d+)", 1), F.lit("")).cast("int"), F.lit(-1))
    empty = F.array().cast("array<struct<position:int,mod_name:string,unimod_id:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("mods"))

    def step(state: Column, x: Column) -> Column:
        at = state["at"] + letters(x["0"])
        mod = F.struct(at.alias("position"), x["1"].alias("mod_name"), unimod(x["1"]).alias("unimod_id"))
        return F.struct(at.alias("at"), F.concat(state["mods"], F.array(mod)).alias("mods"))

    return F.aggregate(_tags(proforma), start, step, lambda s: s["mods"])


def delta_mass(mod_name: Column) -> Column:
    """The number in a tag; null for UNIMOD tags and text without one."""
    number = F.regexp_extract(mod_name, r"([+-]?\d*\.?\d+)", 1)
    return F.when(~F.upper(mod_name).contains("UNIMOD"), number.try_cast("double"))


def tracked_by_mass(delta: Column) -> Column:
    """UNIMOD id of the tracked modification within 0.02 Da of a mass, sign aside; null for others."""
    out = None
    for unimod, (_, mass) in PTMS.items():
        near = F.abs(F.abs(delta) - mass) <= PTM_TOLERANCE
        out = F.when(near, unimod) if out is None else out.when(near, unimod)
    return out


def exact_mass(proforma: Column) -> Column:
    """Rounded masses of tracked modifications become exact ones with six decimals; other tags stay."""

    def rewritten(tag: Column) -> Column:
        whole = F.when(tag.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$"), F.trim(tag).try_cast("double"))
        known = tracked_by_mass(whole)
        mass = F.element_at(_map({k: f"{m:.6f}" for k, (_, m) in PTMS.items()}), known)
        return F.when(known.isNotNull(), F.concat(F.when(whole >= 0, "+").otherwise("-"), mass)).otherwise(tag)

    parts = F.transform(_tags(proforma), lambda x: F.concat(x["0"], F.lit("["), rewritten(x["1"]), F.lit("]")))
    rest = F.regexp_extract(proforma, r"^(?:[^\[]*\[[^\]]+\])*(.*)$", 1)
    return F.concat(F.array_join(parts, ""), rest)


def unimod_id(mod: Column, peptide: Column, table: dict[str, int] | None = None) -> Column:
    """Identity of one modification: its own id, then ``table`` on residue and tag, then its mass; -1 if unknown.

    ``table`` maps ``M(+15.99)``-like keys to ids. An N-terminal tag is looked up alone, then on the first residue.
    """
    inside = (mod["position"] >= 1) & (mod["position"] <= F.length(peptide))
    residue = F.when(inside, F.substring(peptide, mod["position"], F.lit(1)))
    tag = F.concat(F.lit("("), mod["mod_name"], F.lit(")"))
    known: list[Column] = [F.when(mod["unimod_id"] > 0, mod["unimod_id"])]
    if table:
        look = lambda key: F.element_at(_map(table), key)
        first = F.concat(F.substring(peptide, 1, 1), tag)
        known.append(F.when(inside, look(F.concat(residue, tag))).otherwise(F.coalesce(look(tag), look(first))))
    return F.coalesce(*known, tracked_by_mass(delta_mass(mod["mod_name"])), F.lit(-1))


def ptm_name(mod: Column, peptide: Column, table: dict[str, int] | None = None) -> Column:
    """Concept name of a tracked modification, null for others."""
    return F.element_at(_map({k: name for k, (name, _) in PTMS.items()}), unimod_id(mod, peptide, table))
