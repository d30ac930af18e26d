"""Batched encoding with the tokenizers library, one call for each distinct unit of a Python worker's texts.

The library's ids of a text are those of its units (see ``units``), one after the other: its normaliser composes
nothing across a space or between ASCII characters, its pre-tokeniser drops white space and cuts between letters,
digits and punctuation, and no special string is cut. ``Encoder.checked`` tells whether a tokenizer file is of that
kind; others are encoded text by text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ragged, slices
from .units import UnitMemo

#: The cutting rule and the steps before it that make units safe.
RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STEPS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def unit_safe(spec: dict) -> bool:
    """True if a tokenizer file normalises and cuts by the rules that units are made for."""
    pre = spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    first, rest = (steps[0], steps[1:]) if steps else ({}, [])
    rule = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and first.get("pattern") == {"Regex": RULE}
    bytes_only = all(s.get("type") == "ByteLevel" and not s.get("add_prefix_space") and not s.get("use_regex") for s in rest)
    plain = all(x["content"].startswith("<") and not set(x["content"]) & set(" \t\n\v\f\r") and not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in spec.get("added_tokens", []))
    return bool(rule and bytes_only and plain and (spec.get("normalizer") or {}).get("normalizers") == STEPS)


class Encoder:
    """Ids of texts, with a memo of units as flat arrays."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.checked = unit_safe(json.load(f))
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.memo = UnitMemo(self._add, self._forget)

    def _forget(self) -> None:
        self.flat = np.empty(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 12, np.int64)  # ends[i + 1]: where unit i's ids end
        self.known = 0

    def _add(self, units: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum()))
        at, n = int(self.ends[self.known]), self.known + len(units)
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[at : at + len(ids)] = ids
        self.ends[self.known + 1 : n + 1] = at + np.cumsum(lengths)
        self.known = n

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (uint32) and the number of ids of each text; null texts are empty."""
        if not self.checked:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((i for x in found for i in x), np.uint32, int(counts.sum())), counts
        place, units = self.memo.numbers(texts)
        starts = self.ends[place]
        lengths = self.ends[place + 1] - starts
        total = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(units)
        return ragged(self.flat, starts, lengths), total[ends] - total[ends - units]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder: loaded once for each Python process, not for each task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to each text's ids."""
    if end_id is None:
        return ids, counts
    return np.insert(ids, np.cumsum(counts), np.uint32(end_id)), counts + 1


def encoded(batches: Iterable[pa.RecordBatch], path: str, end_id: int | None, text_col: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of bounded size, with their flat ids and counts."""
    own = encoder(path)
    for batch in batches:
        for part in slices(batch, text_col):
            yield part, *with_end(*own.encode(part.column(text_col)), end_id)


def id_bytes(ids: np.ndarray, counts: np.ndarray, dtype: str) -> pa.Array:
    """A binary column with each text's ids in little-endian ``dtype``."""
    data = ids.astype(dtype)
    ends = np.concatenate([[0], np.cumsum(counts)]) * data.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def id_dtype(path: str) -> str:
    """The narrowest of two little-endian types that holds every id of a tokenizer."""
    return "<u4" if encoder(path).vocab_size > 1 << 16 else "<u2"


def tokenize(docs: DataFrame, path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian uint16 or, for large vocabularies, uint32) of every text.

    Null texts are empty. Other columns are not carried, so their names cannot clash.
    """
    dtype = id_dtype(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, counts in encoded(batches, path, end_id):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), id_bytes(ids, counts, dtype)], names=["doc_id", "n_tokens", "ids"])

    two = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return two.mapInArrow(run, "doc_id long, n_tokens long, ids binary")
