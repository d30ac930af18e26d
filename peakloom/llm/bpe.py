"""Operator 9: BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words stand in one flat array. In each round every word's lowest-ranked pair is found by binary
search over sorted pair keys, and all its occurrences in the word are merged from left to right, or only the first
where a symbol that the merge makes also comes from an earlier merge (then a new pair may rank lower). The text is
normalised and cut into words by the tokenizer file's own rules; distinct units (see ``units``) only are encoded.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged, slices
from .tokens import id_bytes, unit_safe
from .units import UnitMemo

NONE = np.int64(1) << 40


class MergeTable:
    """Pair keys in order, their ranks and what they make."""

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        rank = np.arange(len(pairs), dtype=np.int64)
        first_use = np.full(max(vocab.values()) + 1, len(pairs), np.int64)
        np.minimum.at(first_use, left, rank)
        np.minimum.at(first_use, right, rank)
        self.all_at_once = first_use[made] > rank  # no pair with the new symbol ranks before this merge
        self.made = made
        keys = (left << 32) | right
        order = np.lexsort((rank, keys))
        self.keys, self.ranks = keys[order], rank[order]
        last = np.concatenate([self.keys[1:] != self.keys[:-1], [True]])  # of repeated pairs, the later rank counts, as in the library
        self.keys, self.ranks = self.keys[last], self.ranks[last]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every word of a flat symbol array until no pair is left; returns flat symbols and lengths."""
        words = np.repeat(np.arange(len(lengths)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = np.full(len(symbols), NONE)
            same = words[1:] == words[:-1]
            rank[:-1][same] = self.rank_of(symbols[:-1][same], symbols[1:][same])
            heads = np.flatnonzero(np.concatenate([[True], ~same]))
            size = np.diff(np.concatenate([heads, [len(symbols)]]))
            best = np.repeat(np.minimum.reduceat(rank, heads), size)
            ended = best == NONE
            if ended.any():
                done.append((words[ended], symbols[ended]))
                go = ~ended
                symbols, words, rank, best = symbols[go], words[go], rank[go], best[go]
                if not len(symbols):
                    break
            hit = rank == best
            at = np.flatnonzero(hit)
            chain = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (words[at[1:]] != words[at[:-1]])])  # of overlapping hits, every second counts
            start = np.maximum.accumulate(np.where(chain, np.arange(len(at)), 0))
            keep = (np.arange(len(at)) - start) % 2 == 0
            first = np.concatenate([[True], words[at[1:]] != words[at[:-1]]])
            at = at[keep & (first | self.all_at_once[rank[at]])]
            symbols = symbols.copy()
            symbols[at] = self.made[rank[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, words = symbols[stay], words[stay]
        if not done:
            return symbols, np.zeros(len(lengths), np.int64)
        words, symbols = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
        return symbols[np.argsort(words, kind="stable")], np.bincount(words, minlength=len(lengths))


class NumpyBpe:
    """Encoder and decoder for a BPE tokenizer file whose words end in a suffix and whose bytes all have symbols."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or spec.get("decoder"):
            raise ValueError("this kind of tokenizer file is not supported")
        if not unit_safe(spec):
            raise ValueError("the tokenizer cuts by other rules than units are made for")
        library = Tokenizer.from_file(path)
        self.normalizer, self.cutter = library.normalizer, library.pre_tokenizer
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.special_cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.names = {i: s for s, i in {**vocab, **self.special}.items()}
        suffix = model.get("end_of_word_suffix") or ""
        self.inner = {s: i for s, i in vocab.items() if len(s) == 1}
        self.final = {s[: len(s) - len(suffix)]: i for s, i in vocab.items() if s.endswith(suffix) and len(s) == 1 + len(suffix)}
        self.table = MergeTable(vocab, model["merges"])
        most = max(self.names) + 1
        self.id_names = pa.array([str(i) for i in range(most)], pa.string())
        self.token_names = pa.array([self.names.get(i, "") for i in range(most)], pa.string())
        self.memo = UnitMemo(self._add, self._forget)

    def _forget(self) -> None:
        self.flat = np.empty(0, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def _cut(self, chunk: str) -> list[str | int]:
        """Words (in byte symbols) and ids of special strings in a chunk."""
        out: list[str | int] = []
        at = 0
        for m in self.special_cut.finditer(chunk) if self.special_cut and "<|" in chunk else ():
            out += self._words(chunk[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._words(chunk[at:])

    def _words(self, text: str) -> list[str]:
        return [w for w, _ in self.cutter.pre_tokenize_str(self.normalizer.normalize_str(text))] if text else []

    def _merge_words(self, words: list[str]) -> list[np.ndarray]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        inner, final = self.inner, self.final
        symbols = np.fromiter((i for w in words for i in (*map(inner.__getitem__, w[:-1]), final[w[-1]])), np.int64, int(lengths.sum()))
        flat, counts = self.table.merge(symbols, lengths)
        return np.split(flat.astype(np.uint32), np.cumsum(counts)[:-1])

    def _add(self, units: list[str]) -> None:
        cuts = [self._cut(u) for u in units]
        words = list({w for cut in cuts for w in cut if isinstance(w, str)})
        ids = dict(zip(words, self._merge_words(words), strict=True)) if words else {}
        parts = [[ids[w] if isinstance(w, str) else np.array([w], np.uint32) for w in cut] for cut in cuts]
        sizes = np.fromiter((sum(map(len, p)) for p in parts), np.int64, len(parts))
        self.flat = np.concatenate([self.flat, *(x for p in parts for x in p)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def decode(self, ids: list[int]) -> str:
        """As the library decodes without a decoder: the symbols' names, joined by spaces."""
        return " ".join(map(self.names.__getitem__, ids))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text; null texts are empty."""
        place, units = self.memo.numbers(texts)
        starts = self.ends[place]
        lengths = self.ends[place + 1] - starts
        total = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(units)
        return ragged(self.flat, starts, lengths), total[ends] - total[ends - units]

    def joined(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Number of ids, decimal ids joined by spaces, and decoded text, of each text."""
        ids, counts = self.encode(texts)
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        index = pa.array(ids)
        return counts, *(pc.binary_join(pa.ListArray.from_arrays(ends, names.take(index)), " ") for names in (self.id_names, self.token_names))


_OWN: dict[str, NumpyBpe] = {}


def numpy_bpe(path: str) -> NumpyBpe:
    if path not in _OWN:
        _OWN[path] = NumpyBpe(path)
    return _OWN[path]


def _two(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian uint32) of every whole text; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = numpy_bpe(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, counts = own.encode(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), id_bytes(ids, counts, "<u4")], names=["doc_id", "n_tokens", "ids"])

    return _two(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def bpe_decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, text of ids rows; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = numpy_bpe(path)
        for b in batches:
            texts = [own.decode(np.frombuffer(v.as_buffer(), "<u4").tolist()) if v.is_valid else None for v in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and sha256 of the decimal ids and of the decoded text of every whole text."""

    def sha(values: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(v.as_buffer()).hexdigest() for v in values], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = numpy_bpe(path)
        for batch in batches:
            for part in slices(batch, "text"):
                counts, ids, decoded = own.joined(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), sha(ids), sha(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _two(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
