"""Cutting texts into units that a word-level BPE tokenizer encodes on its own, and a memo of what they encode to.

A unit is a run of ASCII and Latin-1 letters, one ASCII digit, or a run of ASCII punctuation; a chunk between white
space that holds anything else (an apostrophe, ``<``, control and other non-ASCII characters) is one unit as it
stands. Letters are lower-cased in the key. Everything is done on the bytes of many texts at once in numpy; units are
told apart by a 64-bit hash of their bytes, so a Python string is made only for units not met before.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE, LETTER, DIGIT, MARK, OTHER = range(5)
#: Units that a Python worker remembers before it starts anew: bounds its memory, whatever the corpus holds.
MEMO = 500_000


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[33:127] = MARK
    for a, b, c in ((9, 14, SPACE), (32, 33, SPACE), (48, 58, DIGIT), (65, 91, LETTER), (97, 123, LETTER)):
        out[a:b] = c
    out[[ord("'"), ord("<")]] = OTHER
    return out


CLASS = _classes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0][:n], _POWERS[1][:n]


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (letters lower-cased), starts and ends of units, their hashes, and the number of units of each text."""
    texts = pc.fill_null(texts, "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    one = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "\n")
    data = np.frombuffer(one[0].as_buffer(), np.uint8) if len(texts) else np.empty(0, np.uint8)
    row_ends = np.cumsum(sizes + 1) - 1
    n = len(data)
    if not n:
        empty = np.empty(0, np.int64)
        return data, empty, empty, np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    kind, low = CLASS[data], LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    tail = data[lead + 1]
    plain = (tail != 0x97) & (tail != 0xB7)
    lead, tail = lead[plain], tail[plain]
    kind[lead] = kind[lead + 1] = LETTER
    low[lead + 1] = np.where(tail < 0x9F, tail + 32, tail)
    if (kind == OTHER).any():
        solid = kind != SPACE
        head = np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1]]))
        last = np.flatnonzero(solid & np.concatenate([~solid[1:], [True]]))
        odd = np.add.reduceat(kind == OTHER, head) > 0
        inside = np.zeros(n + 1, np.int8)
        inside[head[odd]] += 1
        inside[last[odd] + 1] -= 1
        whole = np.cumsum(inside[:-1]) > 0
        kind[whole] = OTHER
        low[whole] = data[whole]
    change = kind[1:] != kind[:-1]
    solid, digit = kind != SPACE, kind == DIGIT
    starts = np.flatnonzero(solid & (np.concatenate([[True], change]) | digit))
    ends = np.flatnonzero(solid & (np.concatenate([change, [True]]) | digit)) + 1
    up, down = _powers(n)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[low] * up)])
    keys = (prefix[ends] - prefix[starts]) * down[starts]
    keys ^= keys >> np.uint64(29)
    keys *= np.uint64(0xBF58476D1CE4E5B9)
    keys ^= keys >> np.uint64(32)
    keys[keys == 0] = 1
    before = np.searchsorted(starts, row_ends)
    return low, starts, ends, keys, np.diff(before, prepend=0)


class UnitMemo:
    """Hash table from unit to a number, kept in numpy arrays; ``add`` is called with the strings of new units."""

    def __init__(self, add: Callable[[list[str]], None], forget: Callable[[], None]) -> None:
        self.add, self.forgotten = add, forget
        self.bits = (2 * MEMO).bit_length()
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.zeros(1 << self.bits, np.int32)
        self.known = 0
        self.forgotten()

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for new ones."""
        mask = np.uint64((1 << self.bits) - 1)
        at = keys & mask
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        going = np.flatnonzero((found != keys) & (found != 0))
        while len(going):
            at[going] = (at[going] + np.uint64(1)) & mask
            found = self.keys[at[going]]
            hit = found == keys[going]
            out[going[hit]] = self.values[at[going[hit]]]
            going = going[~hit & (found != 0)]
        return out

    def _insert(self, keys: np.ndarray) -> None:
        """Distinct new keys get the next numbers."""
        mask = np.uint64((1 << self.bits) - 1)
        numbers = np.arange(self.known, self.known + len(keys), dtype=np.int32)
        at = keys & mask
        while len(keys):
            free = self.keys[at] == 0
            _, first = np.unique(at[free], return_index=True)
            own = np.flatnonzero(free)[first]
            self.keys[at[own]], self.values[at[own]] = keys[own], numbers[own]
            rest = np.ones(len(keys), bool)
            rest[own] = False
            keys, numbers, at = keys[rest], numbers[rest], (at[rest] + np.uint64(1)) & mask

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of every unit, in order, and the number of units of each text."""
        low, starts, ends, keys, counts = cut(texts)
        found = self._find(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh, first = np.unique(keys[new], return_index=True)
            if self.known + len(fresh) > MEMO and self.known:
                self.clear()
                return self.numbers(texts)
            raw = low.tobytes()
            where = new[first]
            self.add([raw[a:b].decode() for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
            if len(fresh) * 2 > len(self.keys):  # one slice with more units than the memo was made for
                self.bits = int(4 * len(fresh)).bit_length()
                self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._insert(fresh)
            self.known += len(fresh)
            found[new] = self._find(keys[new])
        return found, counts
