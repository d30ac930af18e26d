"""Ion names as other tools write them: ``b2``, ``y3``, ``IC``, ``m3:5``, ``p``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_ion(name: Column) -> Column:
    """Struct of ion_type, ion_index, internal_end, residue, as candidates have them; null for names that are none of these."""
    text = lambda pattern, group: F.nullif(F.regexp_extract(name, pattern, group), F.lit(""))
    series, internal, residue = r"^([abcxyz])(\d+)$", r"^m(\d+):(\d+)$", "^I([A-Z])"
    kind = F.coalesce(text(series, 1), F.when(text(residue, 1).isNotNull(), "I"), F.when(text(internal, 1).isNotNull(), "internal"), F.when(name == "p", "precursor"))
    index = F.coalesce(text(series, 2), text(internal, 1)).try_cast("int")
    return F.when(kind.isNotNull(), F.struct(kind.alias("ion_type"), index.alias("ion_index"), text(internal, 2).try_cast("int").alias("internal_end"), text(residue, 1).alias("residue")))
