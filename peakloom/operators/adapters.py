"""Interfaces to what lies outside: the neural model and the language model, with deterministic stand-ins."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.registry import RESIDUES
from .dictionary import Dictionary

MODES = ("clean", "sae", "zero", "mean", "ablate")


class ModelAdapter(Protocol):
    """A frozen encoder-decoder. Instances are pickled to the workers and load what they need there."""

    def capture(self, spectra: list[dict], layers: Sequence[int]) -> list[dict[int, np.ndarray]]:
        """For each spectrum and layer, vectors of its latent token and peaks (tokens x d_model)."""
        ...

    def patched(self, layer: int, dictionary: Dictionary | None, mean: np.ndarray | None) -> ModelAdapter:
        """The same model with what a substitution at ``layer`` needs (see ``substituted``)."""
        ...

    def losses(self, spectra: list[dict], mode: str, ablated: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each spectrum, cross-entropy and top-1 hits of its real output tokens under a substitution."""
        ...


def substituted(x: np.ndarray, mode: str, dictionary: Dictionary | None = None, mean: np.ndarray | None = None, ablated: Sequence[int] = ()) -> np.ndarray:
    """What a layer hands on instead of its output ``x`` (tokens x d_model).

    clean: itself; sae: its reconstruction; ablate: that without the features ``ablated``; zero; mean: the layer's mean.
    """
    if mode == "clean":
        return x
    if mode == "zero":
        return np.zeros_like(x)
    if mode == "mean":
        if mean is None:
            raise ValueError("the mean of the layer is not known")
        return np.broadcast_to(mean, x.shape).astype(x.dtype)
    if mode not in MODES:
        raise ValueError(mode)
    if dictionary is None:
        raise ValueError("no dictionary to reconstruct with")
    f = dictionary.encode(x)
    if len(ablated):
        f[:, list(ablated)] = 0
    return dictionary.decode(f).astype(x.dtype)


def token_losses(logits: np.ndarray, targets: np.ndarray, pad: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy and top-1 hits of the real target tokens of one spectrum.

    ``logits`` (positions x vocabulary) have one position more than the targets, which is dropped; both sides are cut to
    the shorter one, and targets that are ``pad`` are left out.
    """
    n = min(max(len(logits) - 1, 0), len(targets))
    z, y = np.asarray(logits, float)[:n], np.asarray(targets)[:n].astype(np.int64)
    z = z - z.max(1, keepdims=True, initial=-np.inf) if n else z.reshape(0, 1)
    ce = np.log(np.exp(z).sum(1)) - z[np.arange(n), y] if n else np.empty(0)
    hit = z.argmax(1) == y if n else np.empty(0, bool)
    return ce[y != pad], hit[y != pad]


def usable_model(model: object) -> object:
    """The model, if its layers can be read and replaced: fused attention skips them, so nothing would be captured or patched.

    The packed fast path of its encoder is switched off, as it drops the padding that positions are counted by.
    """
    if getattr(model, "use_flash_attention", False):
        raise ValueError("the model uses fused attention, which bypasses the layers to capture and to patch")
    encoder = getattr(model, "encoder", None)
    for name in ("enable_nested_tensor", "use_nested_tensor"):
        if hasattr(encoder, name):
            setattr(encoder, name, False)
    return model


def residue_ids(notations: dict[str, str | int], known: dict[str, str | int] | None = None) -> dict[str, int]:
    """UNIMOD ids of the data set's notations (``M(+15.99)``) by a table of ids or of names with them (``M[UNIMOD:35]``).

    What the model brings itself overrides the table; names without an id are left out.
    """
    ids = {}
    for notation, name in {**notations, **(known or {})}.items():
        found = re.search(r"UNIMOD:(\d+)", name) if isinstance(name, str) else None
        if isinstance(name, int) or found:
            ids[notation] = name if isinstance(name, int) else int(found[1])
    return ids


class HashModel:
    """A small model with random weights: vectors from hashes of the peaks, a read-out of their sum, and losses by ``token_losses``.

    What a substitution changes at its layer is carried on to the read-out, so losses hang on which features are ablated.
    """

    def __init__(self, d_model: int = 16, layer: int = 0, dictionary: Dictionary | None = None, mean: np.ndarray | None = None) -> None:
        self.d_model, self.layer, self.dictionary, self.mean = d_model, layer, dictionary, mean

    def _rng(self, *parts: object) -> np.random.Generator:
        return np.random.default_rng(int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little"))

    def capture(self, spectra: list[dict], layers: Sequence[int]) -> list[dict[int, np.ndarray]]:
        return [{layer: np.stack([self._rng(layer, round(float(m), 4)).normal(size=self.d_model) for m in [0.0, *s["mz"]]]) for layer in layers} for s in spectra]

    def patched(self, layer: int, dictionary: Dictionary | None, mean: np.ndarray | None) -> HashModel:
        return HashModel(self.d_model, layer, dictionary, mean)

    def losses(self, spectra: list[dict], mode: str, ablated: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        out, head = [], self._rng("head").normal(size=(self.d_model, len(RESIDUES) + 1))
        for s, found in zip(spectra, self.capture(spectra, [0, self.layer]), strict=True):
            x = found[self.layer].astype(np.float32)
            state = found[0].sum(0) + (substituted(x, mode, self.dictionary, self.mean, ablated) - x).sum(0)
            targets = [1 + sorted(RESIDUES).index(c) if c in RESIDUES else 0 for c in s.get("peptide") or ""]
            places = np.stack([self._rng("place", i).normal(size=self.d_model) for i in range(len(targets) + 1)])
            out.append(token_losses(np.tanh(state + places) @ head, np.array(targets)))
        return out


def capture_activations(spectra: DataFrame, model: ModelAdapter, layers: Sequence[int], batch: int = 32) -> DataFrame:
    """global_spectrum, layer, position, activation of every token, by batches of ``batch`` spectra in the workers.

    A spectrum whose vectors are not one for the latent token and one for each peak is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for at in range(0, len(rows), batch):
                part = rows[at : at + batch]
                out: list[list] = [[], [], [], []]
                for s, found in zip(part, model.capture(part, layers), strict=True):
                    for layer, x in found.items():
                        if len(x) != len(s["mz"]) + 1:
                            raise ValueError(f"spectrum {s['global_spectrum']}: {len(x)} vectors for {len(s['mz'])} peaks")
                        out[0] += [s["global_spectrum"]] * len(x)
                        out[1] += [layer] * len(x)
                        out[2] += range(len(x))
                        out[3] += x.astype(np.float32).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.list_(pa.float32()))], names=["global_spectrum", "layer", "position", "activation"])

    return spectra.select("global_spectrum", "mz").mapInArrow(run, "global_spectrum long, layer int, position int, activation array<float>")


def capture_baseline(spectra: DataFrame, model: ModelAdapter, batch: int = 32) -> DataFrame:
    """chunk_idx, global_spectrum, target (place of the output token), ce, hit of the unpatched model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for at in range(0, len(rows), batch):
                part = rows[at : at + batch]
                out: list[list] = [[], [], [], [], []]
                for s, (ce, hit) in zip(part, model.losses(part, "clean", ()), strict=True):
                    for column, values in zip(out, ([s["chunk_idx"]] * len(ce), [s["global_spectrum"]] * len(ce), range(len(ce)), ce.tolist(), hit.tolist()), strict=True):
                        column += values
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.bool_()), strict=True)], names=["chunk_idx", "global_spectrum", "target", "ce", "hit"])

    return spectra.select("chunk_idx", "global_spectrum", "mz", "peptide").mapInArrow(run, "chunk_idx int, global_spectrum long, target int, ce double, hit boolean")


def spectrum_losses(spectra: DataFrame, model: ModelAdapter, modes: Sequence[str] = MODES[:4], sets: Sequence[Sequence[int]] = (), batch: int = 32) -> DataFrame:
    """mode, set_idx, global_spectrum, mean_ce, correct, valid: a forward for each spectrum and mode, and for each set of ablated features.

    All sets go through the spectra in one pass, each under its number with mode ``ablate``. ``spectra``:
    global_spectrum, mz, peptide, read from a table, as every run starts from it.
    """
    if odd := set(modes) - set(MODES[:4]):
        raise ValueError(f"no such modes: {sorted(odd)}")
    runs = [(m, 0, ()) for m in modes] + [("ablate", i, tuple(s)) for i, s in enumerate(sets)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for at in range(0, len(rows), batch):
                part = rows[at : at + batch]
                out: list[list] = [[], [], [], [], [], []]
                for mode, i, ablated in runs:
                    for s, (ce, hit) in zip(part, model.losses(part, mode, ablated), strict=True):
                        for column, value in zip(out, (mode, i, s["global_spectrum"], float(ce.sum()) / max(len(ce), 1), float(hit.sum()), float(len(ce))), strict=True):
                            column.append(value)
                types = (pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["mode", "set_idx", "global_spectrum", "mean_ce", "correct", "valid"])

    return spectra.select("global_spectrum", "mz", "peptide").mapInArrow(run, "mode string, set_idx int, global_spectrum long, mean_ce double, correct double, valid double")


class CompletionClient(Protocol):
    def complete(self, prompt: str) -> str: ...


class EchoClient:
    """Answers from the prompt alone: a description that quotes the best matched ion, predictions from intensities."""

    def complete(self, prompt: str) -> str:
        lines = [line.split(",") for line in prompt.splitlines()]
        head = next((x for x in lines if x[0] == "example_id"), [])
        rows = [x for x in lines if len(x) == len(head) and x[0].isdigit()]
        if "activation" in head or not rows:
            return f"DESCRIPTION: {len(rows)} examples were seen.\nSUMMARY: Fires on {rows[0][head.index('matched_ion')] if rows else 'nothing'}."
        at = head.index("rel_intensity")
        return "example_id,activation\n" + "\n".join(f"{x[0]},{x[at]}" for x in rows)


def call(client: CompletionClient, prompt: str, tries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """One completion, tried again with a longer wait each time."""
    for attempt in range(1, tries + 1):
        try:
            return client.complete(prompt)
        except Exception:
            if attempt == tries:
                raise
            sleep(wait * attempt)
    raise AssertionError


def interpret(prompts: DataFrame, client: CompletionClient, dry: bool = False) -> DataFrame:
    """feature_idx, reply of every (feature_idx, prompt); a dry run makes no call and replies with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            replies = ["" if dry else call(client, p) for p in b.column("prompt").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("feature_idx"), pa.array(replies, pa.string())], names=["feature_idx", "reply"])

    return prompts.select(F.col("feature_idx").cast("int"), "prompt").mapInArrow(run, "feature_idx int, reply string")
