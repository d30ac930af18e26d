"""The geometry of a table of directions of any length: near-duplicates, rank by a Gram matrix.

``pairs_over`` finds every pair: blocks of rows meet where they lie, without a shuffle, and each meeting is a product
of matrices. Its work grows with the square of the rows, but for blocks that planes prove to be apart.

``near_duplicate_pairs`` takes random hyperplanes and a stated recall instead. A hyperplane parts two directions with odds that hang on their angle alone, so the number of tables that a wanted
recall takes follows from the cosine and the number of bits; candidates are verified exactly. The number of bits grows
with the logarithm of the rows, so that buckets stay small while the table grows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import dot
from ..staging import staged
from .dictionary import WEIGHT_BYTES, matrix
from .steps import add_pieces, in_pieces, joined

LEAST_BITS, MOST_BITS = 8, 60
#: Groups in which the partial matrices of tasks meet first.
FAN = 32
#: Bits that tell whether a candidate's vectors are worth moving.
SKETCH = 128
#: Of ``pairs_over``: bytes and rows of a block, blocks of a file, blocks that a task orders at once, rows of a block that meet another at once.
BLOCK_BYTES, BLOCK_ROWS, FILE_BLOCKS, ORDERED, SLICE = 2 << 20, 4096, 4, 8, 256
TINY = 1e-12


@dataclass
class NearPairs:
    """``pairs``: a, b, cosine of different directions; ``members``: key, representative of equal ones."""

    pairs: DataFrame
    members: DataFrame
    bits: int
    tables: int

    def count(self) -> int:
        """Pairs of rows, equal ones included, without making them."""
        sizes = staged(self.members.groupBy("representative").agg(F.count("*").alias("n")), "sizes")
        same = sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
        a, b = (sizes.select(F.col("representative").alias(c), F.col("n").alias(f"n{c}")) for c in "ab")
        return int(same + (self.pairs.join(a, "a").join(b, "b").agg(F.sum(F.col("na") * F.col("nb"))).first()[0] or 0))


def tables_for(cosine: float, bits: int, recall: float) -> int:
    """Tables of ``bits`` hyperplanes after which a pair at ``cosine`` has met with odds of ``recall``."""
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-together)))


def sketch_limit(cosine: float, odds: float) -> int:
    """Of ``SKETCH`` further hyperplanes, the most that may part a pair at ``cosine`` so that more do so with ``odds`` at most."""
    p, over, limit = math.acos(cosine) / math.pi, 1.0, -1
    while over > odds and limit < SKETCH:
        limit += 1
        over = sum(math.comb(SKETCH, i) * p**i * (1 - p) ** (SKETCH - i) for i in range(limit + 1, SKETCH + 1))
    return limit


def unit_rows(rows: DataFrame, key: str = "feature_idx", vector: str = "w_dec") -> DataFrame:
    """key, v: vectors over their lengths. Null vectors, those of length 0 and those with a null are left out."""
    x = rows.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c)))
    size = F.sqrt(dot(F.col("v"), F.col("v")))
    return x.withColumn("size", size).where((F.col("size") > 0) & (F.col("size") < float("inf"))).select("key", F.transform("v", lambda c: c / F.col("size")).alias("v"))


def block_rows(width: int) -> int:
    return max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, width))))


def products_over(ka: np.ndarray, a: np.ndarray, kb: np.ndarray, b: np.ndarray, over: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys and product of the rows of ``a`` and ``b`` with a product over ``over``; NaN is over any number, as in SQL.

    Rough products are in 32 bits, where the components allow it; all that their rounding cannot rule out is added up
    in 64 bits, component by component.
    """
    with np.errstate(all="ignore"):
        most = max(float(np.nan_to_num(np.abs(x), posinf=np.inf).max(initial=0)) for x in (a, b))
        kind = np.float32 if most < 1e15 else np.float64
        norms = [float(np.sqrt((x * x).sum(1)).max(initial=0, where=~np.isnan(x).any(1))) for x in (a, b)]
        limit = over - (a.shape[1] + 8) * float(np.finfo(kind).eps) * norms[0] * norms[1]
        limit = limit if limit == limit else -np.inf
        fa, fb = a.astype(kind), b.astype(kind)
        for at in range(0, len(a), SLICE):
            first = at if same else 0
            rough = fa[at : at + SLICE] @ fb[first:].T
            near = np.flatnonzero(~(rough.max(1) <= limit))  # a NaN is the most of its row
            if not len(near):
                continue
            may = ~(rough[near] <= limit)
            if same:
                may &= np.arange(may.shape[1]) > near[:, None]
            i, j = np.divmod(np.flatnonzero(may), may.shape[1])
            i, j = near[i] + at, j + first
            other = ka[i] != kb[j]
            i, j = i[other], j[other]
            if not len(i):
                continue
            total = np.zeros(len(i))
            for c in range(a.shape[1]):
                total += a[i, c] * b[j, c]
            keep = ~(total <= over)
            i, j = ka[i[keep]], kb[j[keep]]
            if len(i):
                yield np.minimum(i, j), np.maximum(i, j), total[keep]


def pairs_over(rows: DataFrame, over: float, key: str = "key", vector: str = "v", seed: int = 0) -> DataFrame:
    """a, b, cosine: every pair of rows of different keys a < b with a product of their vectors over ``over``, copies included.

    Vectors hold no nulls and are of one length; cosines are the products of those over their lengths. Rows lie in
    blocks of a few thousand, a row each of a stored table, and every block meets every other, or itself, once. A group
    of copies fills blocks like any other rows. A pair over the limit lies less than twice ``apart`` from each other, so
    blocks of which one is wholly over ``apart`` and the other wholly under -``apart`` along any of 128 planes hold none.
    """
    first = rows.select(F.size(vector)).first()
    width = first[0] if first else 1
    few = max(1, math.ceil(rows.count() / block_rows(width)))
    apart = math.sqrt(max(0.0, (1 - over) / 2)) + 1e-6

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        planes = np.random.default_rng([seed, 1]).normal(size=(width, SKETCH))
        planes /= np.linalg.norm(planes, axis=0)
        size, at = block_rows(width), TaskContext.get().partitionId() << 32

        def cut(keys: list[np.ndarray], vectors: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """Rows of like signs lie together, so that planes part blocks where the rows form clusters."""
            nonlocal at
            k, x = np.concatenate(keys), np.concatenate(vectors)
            with np.errstate(all="ignore"):
                along = x @ planes
                within = np.sqrt((x * x).sum(1)) <= 1 + 1e-9
            order = np.argsort(np.packbits(along > 0, axis=1).view(">u8")[:, 0], kind="stable")
            for i in range(0, len(k), size):
                part = order[i : i + size]
                masks = [np.packbits(m & within[part].all()).view(np.int64) for m in ((along[part] > apart).all(0), (along[part] < -apart).all(0))]
                yield pa.RecordBatch.from_pydict({"block": [at], "keys": [k[part].tobytes()], "vectors": [x[part].tobytes()]} | {f"{n}{w}": [int(m[w])] for n, m in zip(("high", "low"), masks, strict=True) for w in (0, 1)})
                at += 1

        keys, vectors, held = [], [], 0
        for b in batches:
            if not b.num_rows:
                continue
            keys.append(b.column("key").to_numpy())
            vectors.append(matrix(b.column("v")))
            held += b.num_rows
            if held >= ORDERED * size:
                yield from cut(keys, vectors)
                keys, vectors, held = [], [], 0
        if held:
            yield from cut(keys, vectors)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                read = lambda name, kind, r=r, batch=batch: np.frombuffer(batch.column(name)[r].as_buffer(), kind)
                sides = [x for s in "ab" for x in (read(f"keys_{s}", np.int64), read(f"vectors_{s}", np.float64).reshape(-1, width))]
                for found in products_over(*sides, over, batch.column("block_a")[r] == batch.column("block_b")[r]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b", "cosine"])

    masks = [f"{n}{w}" for n in ("high", "low") for w in (0, 1)]
    packed = rows.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v")).coalesce(few).mapInArrow(pack, "block long, keys binary, vectors binary, " + ", ".join(f"{m} long" for m in masks))
    blocks = staged(packed, "blocks", maxRecordsPerFile=str(FILE_BLOCKS))
    a, b = (blocks.select(*[F.col(c).alias(f"{c}_{s}") for c in ("block", "keys", "vectors", *masks)]) for s in "ab")
    proofs = sum((F.bit_count(F.col(f"high{w}_{x}").bitwiseAND(F.col(f"low{w}_{y}"))) for w in (0, 1) for x, y in ("ab", "ba")), F.lit(0))
    i, j = F.col("block_a"), F.col("block_b")
    once = (i == j) | ((i < j) == ((i + j) % 2 == 0))  # one order of each two blocks, half of any two files' meetings
    met = a.join(b, once & (proofs == 0))
    return met.select("block_a", "block_b", *[f"{c}_{s}" for s in "ab" for c in ("keys", "vectors")]).mapInArrow(meet, "a long, b long, cosine double")


def near_duplicate_pairs(rows: DataFrame, cosine: float = 0.95, recall: float = 0.995, seed: int = 0, key: str = "feature_idx", vector: str = "w_dec") -> NearPairs:
    """All pairs of directions with a cosine over ``cosine``, but for one in 1 / (1 - recall) at the limit itself.

    A candidate brings a sketch of 128 bits with it, and only pairs whose sketches are near enough meet their vectors;
    the sketch adds a hundredth to the odds of a miss. Equal directions are one row from the start and listed as members, so copies are never paired with each other.
    Null vectors, those of length 0 and those with a null are left out.
    """
    if not 0 < cosine < 1 or not 0 < recall < 1:
        raise ValueError("cosine and recall lie between 0 and 1")
    unit = staged(unit_rows(rows, key, vector), "directions")
    own = staged(unit.groupBy("v").agg(F.min("key").alias("representative")), "representatives")
    members = unit.join(own, "v").select("key", "representative")
    n = own.count()
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(n, 2)))))
    tables = tables_for(cosine, bits, recall)
    limit = sketch_limit(cosine, (1 - recall) / 100)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        weights = np.int64(1) << np.arange(bits, dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            v = matrix(b.column("v"))
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(tables, v.shape[1], bits))
                more = np.random.default_rng([seed, 1]).normal(size=(v.shape[1], SKETCH))
            sketch = np.packbits(v @ more > 0, axis=1).view(np.int64)
            sketch = [pa.array(np.ascontiguousarray(sketch[:, i])) for i in (0, 1)]
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([b.column("representative"), pa.array(np.full(len(v), t, np.int32)), pa.array((v @ planes[t] > 0) @ weights), *sketch], names=["k", "t", "code", "s0", "s1"])

    placed = staged(own.select("representative", "v").mapInArrow(codes, "k long, t int, code long, s0 long, s1 long"), "codes")
    a, b = (placed.withColumnsRenamed({"k": c, "s0": f"{c}0", "s1": f"{c}1"}) for c in "ab")
    parted = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in (0, 1)), F.lit(0))
    met = a.join(b, ["t", "code"]).where((F.col("a") < F.col("b")) & (parted <= limit)).select("a", "b").distinct()
    va, vb = (own.select(F.col("representative").alias(c), F.col("v").alias(f"v{c}")) for c in "ab")
    pairs = met.join(va, "a").join(vb, "b").select("a", "b", dot(F.col("va"), F.col("vb")).alias("cosine")).where(F.col("cosine") > cosine)
    return NearPairs(pairs, members, bits, tables)


def gram(rows: DataFrame, vector: str = "w_dec") -> np.ndarray:
    """Sum of outer products of all rows. Tasks add up their own, these meet in groups; one d x d matrix comes to the driver."""
    first = rows.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    width = first[0] if first else 0
    if 8 * width * width > WEIGHT_BYTES:
        raise ValueError(f"a matrix of {width} x {width} is too large for the driver")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, n = np.zeros((width, width)), 0
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("v"))
                total += x.T @ x
                n += len(x)
        if n:
            yield from in_pieces({str(TaskContext.get().partitionId() % FAN): total}, n)

    partial = rows.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "name string, at long, tokens long, piece binary")
    few = partial.groupBy("name", "at").applyInArrow(add_pieces, "name string, at long, piece binary")
    one = few.select(F.lit("all").alias("name"), "at", "piece").groupBy("name", "at").applyInArrow(add_pieces, "name string, at long, piece binary")
    found = joined(one.orderBy("at").collect())
    return found["all"].reshape(width, width) if found else np.zeros((width, width))


def effective_rank(rows: DataFrame, vector: str = "w_dec") -> float:
    """Exponential of the entropy of the singular values, which are the roots of the Gram matrix's eigenvalues."""
    values = np.linalg.eigvalsh(gram(rows, vector))
    s = np.sqrt(np.maximum(values, 0))
    s = s[s > s.max() * 1e-7] if len(s) and s.max() > 0 else s[:0]  # the rest is rounding
    p = s / max(s.sum(), TINY)
    return float(np.exp(-(p * np.log(p + TINY)).sum()))
