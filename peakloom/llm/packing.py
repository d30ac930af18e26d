"""Operator 2: best-fit decreasing over every document of the table.

Best-fit decreasing only looks at lengths, so it is planned on the count of each length (at most ``capacity``
numbers, whatever the corpus holds): lengths come longest first, a segment tree over remaining capacities finds the
tightest open bins in logarithmic time, and all bins of one history are filled in one step. The plan names, for each
length, which ranks go to which sequences; every piece finds its rank from the counts of the partitions before it,
so no group of equal lengths meets in one task. The result is that of the sequential algorithm on the whole table.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged
from .tokens import encoded

RANKS = 44  # bits for a rank beside its length in one search key


class CapacityTree:
    """Counts of open bins by remaining capacity, with the first non-empty capacity at or above a need."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.total = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        node = capacity + self.size
        while node:
            self.total[node] += n
            node >>= 1

    def tightest(self, need: int) -> int | None:
        node = need + self.size
        if self.total[node]:
            return need
        while node > 1:
            if not node & 1 and self.total[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.total[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Runs (length, first rank, items, first sequence, items in each sequence, offset of the first), by length and rank."""
    tree, open_bins, runs, fresh = CapacityTree(capacity), defaultdict(list), [], 0

    def opened(left: int, first: int, n: int) -> None:
        if left and n:
            open_bins[left].append((first, n))
            tree.add(left, n)

    def fill(length: int, rank: int, n: int, left: int, first: int, bins: int) -> int:
        """Put up to ``n`` items into ``bins`` bins of one history with ``left`` free; returns how many went in."""
        each = left // length
        full = min(bins, n // each)
        if full:
            runs.append((length, rank, full * each, first, each, capacity - left))
            opened(left - full // full * each * length, first, full)
        rest = min(n - full * each, each - 1) if full < bins else 0
        if rest:
            runs.append((length, rank + full * each, rest, first + full, rest, capacity - left))
            opened(left - rest * length, first + full, 1)
        if left < capacity:
            opened(left, first + full + bool(rest), bins - full - bool(rest))
        return full * each + rest

    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        while n:
            left = tree.tightest(length)
            if left is None:
                bins = -(-n // (capacity // length))
                put = fill(length, rank, n, capacity, fresh, bins)
                fresh += bins
            else:
                first, bins = open_bins[left].pop()
                tree.add(left, -bins)
                put = fill(length, rank, n, left, first, bins)
            rank, n = rank + put, n - put
    return np.array(sorted(runs), np.int64).reshape(-1, 6)


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int | None, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's partition and rank among its lengths there.

    A null text is empty; without ``end_id`` an empty text has no piece. ``keep_ids`` adds the ids (uint32, binary).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for part, ids, counts in encoded(batches, path, end_id):
            cut = -(-counts // capacity)
            owner = np.repeat(np.arange(len(counts)), cut)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(cut) - cut, cut)
            start = number * capacity
            length = np.minimum(counts[owner] - start, capacity)
            at = (np.cumsum(counts) - counts)[owner] + start
            raw = memoryview(ids.astype("<u4").tobytes())
            data = [raw[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(ranked)) - np.searchsorted(ranked, ranked) + seen[ranked]
            seen += np.bincount(length, minlength=capacity + 1)
            columns = [part.column("doc_id").take(pa.array(owner)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(d) for d in data], pa.int64()), pa.array(np.full(len(rank), task), pa.int32()), pa.array(rank)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
            if keep_ids:
                columns, names = [*columns, pa.array([bytes(d) for d in data], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    two = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return two.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids binary" * keep_ids)


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int | None = 1, keep_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and its offset there; sequences are gapless from 0.

    Documents are cut only where longer than ``capacity``. Rows with equal or null doc_id are documents of their own.
    """
    cut = staged(pieces(docs, path, capacity, end_id, keep_ids), "pieces")
    held = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    runs = plan(counts, capacity)
    keys = (runs[:, 0] << RANKS) | runs[:, 1]
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    bases = held.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("rank").to_numpy() + b.column("base").to_numpy()
            run = runs[np.searchsorted(keys, (length << RANKS) | rank, "right") - 1] if len(length) else runs[:0]
            item = rank - run[:, 1]
            out = b.select([n for n in b.schema.names if n not in ("task", "rank", "base")])
            sequence, offset = run[:, 3] + item // run[:, 4], run[:, 5] + item % run[:, 4] * length
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(sequence), pa.array(offset)], names=[*out.schema.names, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long"
    joined = cut.join(bases, ["task", "length"]).select(*[c for c in cut.columns], "base")
    return joined.mapInArrow(place, schema)
