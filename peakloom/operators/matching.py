"""Peaks matched with the fragments of their spectrum's peptide inside the spectrum's own row.

A spectrum that arrives with its peaks as an array needs no join: a task makes the sorted ions of each distinct peptide
of an Arrow batch, finds the ions within the tolerance of every peak by binary search, ranks all candidates of the
batch with one sort and yields a row for each token. ``fragments.band_join`` stays for peaks and ions that lie in
tables of their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.registry import CARBONYL, LOSSES, OTHER_SERIES, PRIORITY, PROTON, RESIDUES, WATER

TYPES = tuple(sorted(PRIORITY))
LOSS_NAMES = ("", *LOSSES)
LETTERS = tuple(sorted(RESIDUES))
LOSS_MASSES = np.array([0.0, *LOSSES.values()])
_RANK = np.array([PRIORITY[t] for t in TYPES])
_LOSS_ORDER = np.argsort(np.argsort(LOSS_NAMES))
#: Peptides whose ions a task remembers.
MEMO = 4096
#: Columns of a token's best fragment, null for noise.
FRAGMENT = "ion_type string, ion_index int, internal_end int, residue string, fragment_charge int, neutral_loss string"
Mods = tuple[tuple[int, float | None], ...]


@dataclass
class Ions:
    """Ions of one peptide by ascending m/z; -1 stands for no index, end or residue. ``group`` and ``tie`` rank equal masses."""

    mz: np.ndarray
    kind: np.ndarray
    index: np.ndarray
    end: np.ndarray
    residue: np.ndarray
    charge: np.ndarray
    loss: np.ndarray
    group: np.ndarray
    tie: np.ndarray


def masses_of(peptide: str | None, mods: Mods | None) -> np.ndarray | None:
    """Mass of each residue with its modifications (position 0 counts with the first); None where one is unknown."""
    if not peptide or mods is None or any(r not in RESIDUES for r in peptide):
        return None
    out = np.array([RESIDUES[r] for r in peptide])
    for position, mass in mods:
        at = max(position, 1) - 1 if position is not None else len(out)
        if at < len(out):
            if mass is None:
                return None
            out[at] += mass
    return out


def ions_of(peptide: str | None, charge: int | None, mods: Mods | None, series: str = "byIp", internal: bool = True) -> Ions | None:
    """All ions that ``fragments.theoretical_ions`` makes; None for a peptide without known masses."""
    masses = masses_of(peptide, mods)
    if masses is None:
        return None
    n, cum = len(masses), np.concatenate([[0.0], np.cumsum(masses)])
    inner, total = np.arange(1, n), cum[-1]
    parts: list[np.ndarray] = []  # rows of kind, index, end, residue, charge, loss, m/z

    def emit(kind: str, neutral: np.ndarray, charges: range, losses: int, index: np.ndarray | int = -1, end: np.ndarray | int = -1, residue: np.ndarray | int = -1) -> None:
        z, loss = np.repeat(np.array(charges), losses), np.tile(np.arange(losses), len(charges))
        mz = (neutral[:, None] - LOSS_MASSES[loss] + z * PROTON) / z
        columns = [np.full(1, TYPES.index(kind)), np.reshape(index, -1), np.reshape(end, -1), np.reshape(residue, -1)]
        parts.append(np.stack([*[np.broadcast_to(c[:, None], mz.shape).ravel() for c in columns], np.broadcast_to(z, mz.shape).ravel(), np.broadcast_to(loss, mz.shape).ravel(), mz.ravel()]))

    def neutral_of(origin: str) -> np.ndarray:
        return cum[inner] if origin == "b" else total - cum[n - inner] + WATER

    backbone, single, every = range(1, max(1, (charge or 1) - 1) + 1), range(1, 2), len(LOSS_NAMES)
    for kind, origin, shift in (("b", "b", None), ("y", "y", None), *((k, o, s) for k, (o, s) in OTHER_SERIES.items())):
        if kind in series:
            neutral = neutral_of(origin)
            emit(kind, neutral if shift is None else neutral + shift, backbone, every, inner)
    if "I" in series:
        emit("I", masses - CARBONYL, single, 1, residue=np.array([LETTERS.index(r) for r in peptide]))
    if internal and n > 3:
        first, last = (x + 2 for x in np.triu_indices(n - 2, 1))
        emit("internal", cum[last] - cum[first - 1], single, 1, first, last)
    if "p" in series:
        z = max(charge or 1, 1)
        emit("precursor", np.array([total + WATER]), range(z, z + 1), every)
    if not parts:
        return None
    rows = np.concatenate(parts, axis=1)
    rows = rows[:, np.argsort(rows[6], kind="stable")]
    kind, index, end, residue, z, loss = rows[:6].astype(np.int32)
    group = ((loss != 0) * 8 + _RANK[kind]) * 256 + z
    order = np.lexsort((rows[6], _LOSS_ORDER[loss], z, residue, end, index, kind))
    tie = np.empty(len(order), np.int64)
    tie[order] = np.arange(len(order))
    return Ions(rows[6], kind, index, end, residue, z, loss, group, tie)


def within(measured: np.ndarray, theory: np.ndarray, tolerance: float, mode: str) -> np.ndarray:
    difference = np.abs(measured - theory)
    return difference / theory * 1e6 <= tolerance if mode == "ppm" else difference <= tolerance


def windows(mz: np.ndarray, tolerance: float, mode: str) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the ions that may be near each peak, a hair wider than the tolerance."""
    if mode == "ppm":
        return mz / (1 + tolerance * 1e-6) * (1 - 1e-12), mz / max(1 - tolerance * 1e-6, 1e-9) * (1 + 1e-12)
    return mz - tolerance - 1e-9, mz + tolerance + 1e-9


class Matcher:
    """Best ion of every peak of a batch of spectra."""

    def __init__(self, tolerance: float, mode: str, series: str, internal: bool) -> None:
        self.tolerance, self.mode, self.series, self.internal = tolerance, mode, series, internal
        self.memo: dict[tuple, Ions | None] = {}

    def ions(self, key: tuple) -> Ions | None:
        if key not in self.memo:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[key] = ions_of(*key, self.series, self.internal)
        return self.memo[key]

    def best(self, keys: list[tuple], mz: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[Ions]]:
        """For each peak its ion's place in the concatenated tables, or -1; and the tables.

        ``keys``: peptide, charge and mods of each spectrum; ``ends``: where its peaks end in ``mz``.
        """
        tables: list[Ions] = []
        known: dict[tuple, int] = {}
        sizes = np.diff(ends, prepend=0)
        for key, n in zip(keys, sizes.tolist(), strict=True):
            if n and key not in known:
                own = self.ions(key)
                known[key] = -1 if own is None else len(tables)
                if own is not None:
                    tables.append(own)
        out = np.full(len(mz), -1, np.int64)
        if not tables:
            return out, tables
        table = np.repeat(np.array([known.get(key, -1) for key in keys], np.int64), sizes)
        theory, group, tie = (np.concatenate([getattr(t, c) for t in tables]) for c in ("mz", "group", "tie"))
        # every table has a stretch of one axis to itself, so that one binary search serves all spectra
        width = 2 * float(np.abs(theory).max()) + 10 + 2 * self.tolerance
        axis = theory + np.repeat(np.arange(len(tables)), [len(t.mz) for t in tables]) * width
        slack = 1e-9 + 4 * np.spacing(width * len(tables))
        low, high = windows(mz, self.tolerance, self.mode)
        usable = np.flatnonzero((table >= 0) & (mz > 0 if self.mode == "ppm" else ~np.isnan(mz)))
        inside = lambda x: np.clip(x[usable], -width / 4, width * 0.7) + table[usable] * width
        first = np.searchsorted(axis, inside(low) - slack, "left")
        n = np.searchsorted(axis, inside(high) + slack, "right") - first
        peak = np.repeat(usable, n)
        ion = np.arange(len(peak)) + np.repeat(first - (np.cumsum(n) - n), n)
        near = within(mz[peak], theory[ion], self.tolerance, self.mode)
        peak, ion = peak[near], ion[near]
        order = np.lexsort((tie[ion], np.round(np.abs(mz[peak] - theory[ion]), 9), group[ion], peak))
        own, at = np.unique(peak[order], return_index=True)
        out[own] = ion[order][at]
        return out, tables


def upper_decile(intensity: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Interpolated 90th percentile of each spectrum's intensities (nulls, as NaN, left out); NaN without any."""
    spectrum = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    real = ~np.isnan(intensity)
    spectrum, values = spectrum[real], intensity[real]
    values = values[np.lexsort((values, spectrum))]
    n = np.bincount(spectrum, minlength=len(ends))
    at = np.maximum(n - 1, 0) * 0.9
    low, high, start = np.floor(at), np.ceil(at), np.cumsum(n) - n
    if not len(values):
        return np.full(len(ends), np.nan)
    a, b = (values[np.minimum(start + x.astype(np.int64), len(values) - 1)] for x in (low, high))
    return np.where(n == 0, np.nan, np.where(low == high, a, (high - at) * a + (at - low) * b))


def _named(codes: np.ndarray, names: Sequence[str], none: np.ndarray) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(codes.astype(np.int32), mask=none), pa.array(names, pa.string())).cast(pa.string())


def match_spectra(spectra: DataFrame, keys: Sequence[str], tolerance: float = 20.0, mode: str = "ppm", series: str = "byIp", internal: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """A row for each token: keys, ``carry``, position (0: latent), mz, intensity, threshold and the best fragment.

    ``spectra``: keys, peptide, precursor_charge, mods (position, mass), mz_array, intensity_array, and the columns to
    carry along. Threshold: the spectrum's 90th percentile of intensity, null for latent tokens. Null arrays are empty;
    peaks without m/z are noise, as are all peaks of peptides with unknown residues or masses.
    """
    if mode not in ("ppm", "Da"):
        raise ValueError("the tolerance is in ppm or Da")
    peaks = F.arrays_zip(F.col("mz_array").cast("array<double>").alias("mz"), F.col("intensity_array").cast("array<double>").alias("intensity"))
    mods = F.transform("mods", lambda m: F.struct(m["position"].cast("int").alias("position"), m["mass"].cast("double").alias("mass")))
    kept = list(dict.fromkeys([*keys, *carry]))
    rows = spectra.select(*kept, F.col("peptide").alias("_peptide"), F.col("precursor_charge").cast("int").alias("_charge"), mods.alias("_mods"), peaks.alias("_peaks"))
    extra = "position int, mz double, intensity double, threshold double, " + FRAGMENT
    schema = StructType([*[spectra.schema[c] for c in kept], *StructType.fromDDL(extra).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(tolerance, mode, series, internal)
        for batch in batches:
            column = batch.column("_peaks")
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, flat = np.cumsum(sizes), column.flatten()
            mz, intensity = (pc.fill_null(flat.field(c), float("nan")).to_numpy(zero_copy_only=False) for c in (0, 1))
            mods_of = [None if m is None else tuple((x["position"], x["mass"]) for x in m) for m in batch.column("_mods").to_pylist()]
            place, tables = matcher.best(list(zip(batch.column("_peptide").to_pylist(), batch.column("_charge").to_pylist(), mods_of, strict=True)), mz, ends)
            # each spectrum's latent token comes before its peaks
            row = np.repeat(np.arange(len(sizes)), sizes + 1)
            latent = ends - sizes + np.arange(len(sizes))
            position = np.arange(len(row)) - np.repeat(latent, sizes + 1)
            peak = position > 0
            spread = lambda values, fill: _spread(values, peak, fill)
            ion = spread(place, -1)
            noise = ion < 0
            field = lambda c: np.concatenate([getattr(t, c) for t in tables] or [np.zeros(1, np.int32)])[np.where(noise, 0, ion)]
            kind, index, end, residue, z, loss = (field(c) for c in ("kind", "index", "end", "residue", "charge", "loss"))
            threshold = upper_decile(intensity, ends)[row]
            numbers = [pa.array(x.astype(np.int32), mask=noise | (x < 0)) for x in (index, end)]
            values = [
                pa.array(position.astype(np.int32)), _doubles(spread(mz, 0.0)), _doubles(spread(intensity, 0.0)), pa.array(threshold, mask=~peak | np.isnan(threshold)),
                _named(kind, TYPES, noise), *numbers, _named(residue, LETTERS, noise | (residue < 0)), pa.array(z.astype(np.int32), mask=noise), _named(loss, LOSS_NAMES, noise),
            ]
            own = pa.array(row)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(own) for c in kept], *values], names=schema.names)

    return rows.mapInArrow(run, schema)


def _spread(values: np.ndarray, where: np.ndarray, fill: float) -> np.ndarray:
    out = np.full(len(where), fill, values.dtype)
    out[where] = values
    return out


def _doubles(values: np.ndarray) -> pa.Array:
    return pa.array(values, mask=np.isnan(values))
