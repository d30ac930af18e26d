"""Operator 7: approximate nearest neighbours by an inverted multi-index.

Both halves of the vectors are quantised by k-means fitted on a bounded sample; a cell is a pair of centroids. A
query visits cells in order of the summed squared distances of its halves, found with a heap, until they hold a share
of all distinct vectors and enough rows for its neighbours, and their entries are reranked by the exact distance. The
share is fitted: on the sample, it is what catches ``recall`` of the true neighbours. Neighbours in a sample are
farther than in the whole table and so lie in later cells, so the share holds for the table; it is small where vectors
form clusters, and large where they have no structure. Copies do not use up the share, so a hot cell takes no other
from a query. All rows are indexed. Cells are laid into blocks of bounded size, a cell of more rows into several, so
that equal vectors that hold a third of all rows fill many blocks; a query goes to the blocks of its cells only, in
blocks of queries, and each block gives its ten best.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, staged

#: Rows on which the centroids are fitted, queries that fit the share, rows of a block, and queries that meet it at once.
SAMPLE, PROBES, BLOCK, QUERY_BLOCK = 8192, 256, 32768, 8192
#: Components over this are scaled down before they are squared.
LARGE = 1e100


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, vector (doubles) of the rows that take part: no null id or vector, all finite, not all zero."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("vector"))


def _matrix(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(values)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def kmeans(x: np.ndarray, k: int, seed: int = 0, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = squared(x, centres).argmin(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray, need: int, rows: np.ndarray | None = None, least: int = 0) -> list[tuple[int, int]]:
    """Cells by summed distance until they hold ``need`` of ``counts`` and ``least`` of ``rows`` (multi-sequence algorithm with a heap)."""
    rows = counts if rows is None else rows
    by1, by2 = first.argsort(kind="stable"), second.argsort(kind="stable")
    heap = [(first[by1[0]] + second[by2[0]], 0, 0)]
    reached = np.zeros(len(by1), np.int64)  # cells pushed so far in each row
    reached[0] = 1
    held, held_rows, out = 0, 0, []
    while heap and (held < need or held_rows < least):
        _, i, j = heapq.heappop(heap)
        cell = (int(by1[i]), int(by2[j]))
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
            held_rows += int(rows[cell])
        if j + 1 < len(by2) and reached[i] == j + 1 and (i == 0 or reached[i - 1] > j + 1):
            reached[i] = j + 2
            heapq.heappush(heap, (first[by1[i]] + second[by2[j + 1]], i, j + 1))
        if i + 1 < len(by1) and reached[i + 1] == j and (j == 0 or reached[i] > j):
            reached[i + 1] = j + 1
            heapq.heappush(heap, (first[by1[i + 1]] + second[by2[j]], i + 1, j))
    return out


def distances(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances from the differences themselves; very large and very small ones are scaled before squaring."""
    with np.errstate(over="ignore"):
        diff = rows - q
    most = np.abs(diff).max(1, initial=0)
    odd = ((most > LARGE) | (most < 1 / LARGE)) & (most > 0) & np.isfinite(most)
    with np.errstate(over="ignore"):
        out = np.sqrt((diff * diff).sum(1))
    if odd.any():
        out[odd] = most[odd] * np.sqrt(((diff[odd] / most[odd][:, None]) ** 2).sum(1))
    return out


def best(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, allowed: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: places of its k nearest allowed rows and their exact distances; ties to smaller ids.

    Rough distances come from products of centred vectors; every row that they cannot rule out, by a bound of their
    rounding, is measured exactly.
    """
    if not len(vectors):
        return
    most = max(float(np.abs(vectors).max()), float(np.abs(queries).max(initial=0)))
    if most < LARGE:
        centre = vectors.mean(0)
        a, b = queries - centre, vectors - centre
        rough = squared(a, b)
        norm = (a * a).sum(1) + float((b * b).sum(1).max())
        slack = 64 * np.finfo(float).eps * (vectors.shape[1] + 8) * (norm + most * np.sqrt(norm))
    else:
        rough, slack = np.zeros((len(queries), len(vectors))), np.zeros(len(queries))
    for q in range(len(queries)):
        may = allowed[q] & (ids != own[q])
        near = np.flatnonzero(may)
        if len(near) > k:
            row = rough[q, near]
            near = near[row <= np.partition(row, k - 1)[k - 1] + slack[q]]
        d = distances(vectors[near], queries[q])
        top = np.lexsort((ids[near], d))[:k]
        yield q, near[top], d[top]


def fitted_share(x: np.ndarray, c1: np.ndarray, c2: np.ndarray, k: int, recall: float) -> float:
    """Least share of the distinct rows of ``x`` in visited cells that holds ``recall`` of the k nearest of some of them."""
    x = np.unique(x, axis=0)
    half = x.shape[1] // 2
    cell = squared(x[:, :half], c1).argmin(1) * len(c2) + squared(x[:, half:], c2).argmin(1)
    counts = np.bincount(cell, minlength=len(c1) * len(c2))
    probes = x[np.linspace(0, len(x) - 1, min(PROBES, len(x))).astype(int)]
    at = np.linspace(0, len(x) - 1, min(PROBES, len(x))).astype(int)
    d1, d2 = squared(probes[:, :half], c1), squared(probes[:, half:], c2)
    needed = []
    for q, near, _ in best(probes, np.arange(len(x)), x, at, np.ones((len(probes), len(x)), bool), k):
        order = np.argsort((d1[q][:, None] + d2[q][None]).ravel(), kind="stable")
        held = np.empty(len(order), np.int64)
        held[order] = np.cumsum(counts[order])
        needed.append(held[cell[near]] / len(x))
    values = np.concatenate(needed) if needed else np.empty(0)
    return float(np.quantile(values, recall)) if len(values) else 1.0


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, centroids: int = 64, share: float | None = None, recall: float = 0.97, seed: int = 0) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest rows, those of its own id left out; ``usable`` rows on both sides.

    ``share``: of the distinct vectors that a query visits, fitted to ``recall`` if not given. Vectors of another length
    than most (of the longer one, if two are as frequent) take no part, as no distance is defined. Repeated vec_ids are
    rows of their own on the indexed side; equal query rows have one list, rows of one id and other vectors a list each.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    largest = F.max(F.array_max(F.transform("vector", lambda c: F.abs(c)))).alias("most")
    width = vectors.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"), largest).orderBy(F.col("n").desc(), F.col("size").desc()).first()
    if not width:
        return spark.createDataFrame([], schema)
    total, wide = width["n"], F.size("vector") == width["size"]
    vectors = vectors.where(wide)
    asked = queries.where(wide).select("vec_id", "vector").withColumn("query", F.xxhash64("vec_id", "vector")).dropDuplicates(["vec_id", "query"])
    scale = 1.0 if width["most"] < LARGE else 2.0 ** -int(np.ceil(np.log2(width["most"])))
    sample = vectors.where(F.pmod(F.xxhash64("vec_id", "vector", F.lit(seed)), F.lit(1 << 30)) < min(1.0, 1.2 * SAMPLE / total) * (1 << 30)).select("vector").limit(2 * SAMPLE).toArrow()
    x = (_matrix(sample.column("vector")) if sample.num_rows else _matrix(vectors.select("vector").limit(SAMPLE).toArrow().column("vector"))) * scale
    half = x.shape[1] // 2
    c1, c2 = kmeans(x[:, :half], centroids, seed), kmeans(x[:, half:], centroids, seed + 1)
    share = fitted_share(x, c1, c2, k, recall) if share is None else share

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("vector")) * scale
            if len(v):
                cell = squared(v[:, :half], c1).argmin(1) * len(c2) + squared(v[:, half:], c2).argmin(1)
                salt = np.arange(len(v), dtype=np.int32)  # written with the row, so that it stays when a task runs again
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(salt)], names=["vec_id", "vector", "cell", "salt"])

    index = staged(vectors.select("vec_id", "vector").mapInArrow(assign, "vec_id long, vector array<double>, cell int, salt int"), "multi-index")
    counts, distinct = np.zeros((2, len(c1) * len(c2)), np.int64)
    each = index.groupBy("cell", F.xxhash64("vector").alias("h")).agg(F.count("*").alias("n"))
    for r in each.groupBy("cell").agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect():  # at most centroids ** 2 rows
        counts[r["cell"]], distinct[r["cell"]] = r["n"], r["d"]
    size = int(min(max(total // (4 * partitions(spark)), 256), BLOCK))
    # Cells in order, whole ones together while they fit into a block; a cell of more rows has blocks of its own.
    base, blocks, at, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for c, n in enumerate(counts.tolist()):
        if held and held + n > size:
            at, held = at + 1, 0
        base[c], blocks[c] = at, max(1, -(-n // size))
        at, held = (at + int(blocks[c]), 0) if n > size else (at, held + n)
    need, n_queries = int(np.ceil(share * distinct.sum())), asked.count()
    sides = max(1, -(-n_queries // QUERY_BLOCK))
    # A query leaves out all rows of its own id, so it must hold as many beside its neighbours.
    own = index.groupBy("vec_id").agg(F.count("*").alias("own"))
    asked = asked.join(own, "vec_id", "left").withColumns({"own": F.coalesce("own", F.lit(0)), "side": F.pmod(F.xxhash64("query"), F.lit(sides)).cast("int")})
    grid, per_cell = distinct.reshape(len(c1), len(c2)), counts.reshape(len(c1), len(c2))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("vector")) * scale
            d1, d2 = (squared(v[:, :half], c1), squared(v[:, half:], c2)) if len(v) else ((), ())
            rows, blocks_of, cells_of = [], [], []
            for i, n in enumerate(b.column("own").to_pylist()):
                seen: dict[int, list[int]] = {}
                for one, two in traverse(d1[i], d2[i], grid, need, per_cell, k + n):
                    c = one * len(c2) + two
                    for block in range(base[c], base[c] + blocks[c]):
                        seen.setdefault(block, []).append(c)
                rows += [i] * len(seen)
                blocks_of += seen.keys()
                cells_of += seen.values()
            took = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(blocks_of, pa.int32()), *(took.column(c) for c in ("side", "vec_id", "query", "vector")), pa.array(cells_of, pa.list_(pa.int32()))], names=["block", "side", "vec_id", "query", "vector", "cells"])

    of = lambda values: F.element_at(F.lit([int(n) for n in values]), F.col("cell") + 1)
    dealt = index.withColumn("block", (of(base) + F.pmod(F.col("salt"), of(blocks))).cast("int"))
    dealt = dealt.withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))).select("block", "side", "vec_id", "vector", "cell")
    sent = asked.select("side", "vec_id", "query", "vector", "own").repartition(partitions(spark))
    sent = sent.mapInArrow(visits, "block int, side int, vec_id long, query long, vector array<double>, cells array<int>")

    def rerank(rows: pa.Table, askers: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if rows.num_rows and askers.num_rows:
            ids, vs, cell = rows.column("vec_id").to_numpy(), _matrix(rows.column("vector")), rows.column("cell").to_numpy()
            step = max(1, (1 << 22) // len(ids))
            for start in range(0, askers.num_rows, step):
                part = askers.slice(start, step)
                mine, query, q = part.column("vec_id").to_numpy(), part.column("query").to_numpy(), _matrix(part.column("vector"))
                allowed = np.zeros((len(mine), len(counts)), bool)
                for i, cells in enumerate(part.column("cells").to_pylist()):
                    allowed[i, cells] = True
                for i, near, d in best(q, ids, vs, mine, allowed[:, cell], k):
                    for column, values in zip(out, ([int(mine[i])] * len(near), [int(query[i])] * len(near), ids[near].tolist(), d.tolist()), strict=True):
                        column += values
        return pa.table([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.float64())], names=["query_id", "query", "vec_id", "score"])

    found = dealt.groupBy("block", "side").cogroup(sent.groupBy("block", "side")).applyInArrow(rerank, "query_id long, query long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id", "query").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
