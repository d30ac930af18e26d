"""Operator 11: compression of vectors to codes of small integer codebooks, one for each part of a vector.

Components become whole numbers. Every part position has a codebook; it travels to the tasks with each round. A task
takes Arrow batches as one integer matrix, gets all squared distances of a part from |x|^2 - 2 x.e + |e|^2 in exact
64-bit products, takes the first nearest entry and keeps one sum for each entry and place, so a round shuffles at most
parts x entries x width numbers from each task, whatever the rows and however hot an entry is.

Rows whose vector is null, empty or holds null or non-finite components are dropped, and so are vectors of another
length than the one of the smallest kept id. Components of over 2 ** 27 after scaling are taken as that number, so
that distances fit 64 bits. Repeated rows count each; equal ids are ordered by their vectors; null ids come last. A
table with fewer rows than entries has as many entries as rows, an empty one gives no rows. Lengths that the parts do
not divide are filled up with zeros.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

MOST = 1 << 27
#: Labels whose sums are broadcast; beyond, rows and sums meet by label and a salt.
BROADCAST_LABELS, SALTS = 100_000, 32
#: Components of one slice: bounds the distances that a task holds.
SLICE = 1 << 20


@dataclass(frozen=True)
class CodeConfig:
    """``scale``: a component x becomes floor(scale * x)."""

    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: float = 4096.0


def whole_numbers(vectors: DataFrame, config: CodeConfig, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, x (array of whole numbers) of the usable vectors."""
    x = vectors[vector].cast("array<double>")
    fine = (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    scaled = F.transform("x", lambda v: F.floor(F.least(F.greatest(v * config.scale, F.lit(float(-MOST))), F.lit(float(MOST)))).cast("int"))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label].alias("label"), x.alias("x"), fine.alias("fine"))
    return rows.where("fine").select("vec_id", "label", scaled.alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of one length as an integer matrix, filled up with zeros to ``width``."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)
    return flat if flat.shape[1] == width else np.pad(flat, ((0, 0), (0, width - flat.shape[1])))


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each row and part; ``books``: (parts, entries, width), ties to the lower entry.

    Products may wrap around 2 ** 64; distances do not reach it, so they come out exact.
    """
    parts, _, width = books.shape
    rows = x.reshape(len(x), parts, width)
    codes, distances = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.int64)
    for p in range(parts):
        own, book = np.ascontiguousarray(rows[:, p]), books[p]
        all_of = np.einsum("ij,ij->i", own, own)[:, None] - 2 * (own @ book.T) + np.einsum("ij,ij->i", book, book)
        codes[:, p] = all_of.argmin(1)
        distances[:, p] = np.take_along_axis(all_of, codes[:, p, None], 1)[:, 0]
    return codes, distances


def _pieces(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    step = max(1, SLICE // max(1, width))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def assigned_sums(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, place, total, n: sums of the parts nearest to each entry, over all rows."""
    parts, entries, width = books.shape
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for piece in _pieces(batch, parts * width):
                x = matrix(piece.column(0), parts * width)
                codes, _ = nearest(x, sent.value)
                cut = x.reshape(len(x), parts, width)
                for p in range(parts):
                    order = np.argsort(codes[:, p], kind="stable")
                    used, first = np.unique(codes[order, p], return_index=True)
                    totals[p, used] += np.add.reduceat(cut[order, p], first, axis=0)
                    counts[p] += np.bincount(codes[:, p], minlength=entries)
        part, entry = np.nonzero(counts)
        if len(part):
            place = np.tile(np.arange(width), len(part))
            columns = [np.repeat(part, width), np.repeat(entry, width), place, totals[part, entry].ravel(), np.repeat(counts[part, entry], width)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, ("i4", "i4", "i4", "i8", "i8"), strict=True)], names=["part", "entry", "place", "total", "n"])

    partial = rows.select("x").mapInArrow(run, "part int, entry int, place int, total long, n long")
    return partial.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def of_one_length(rows: DataFrame) -> DataFrame:
    """The rows of ``whole_numbers`` whose vectors are as long as that of the smallest id."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select(F.size("x")).first()
    return rows.where(F.size("x") == first[0]) if first else rows


def first_books(rows: DataFrame, config: CodeConfig) -> np.ndarray:
    """The codebooks before the first round: the parts of the rows with the smallest ids; no entries without rows."""
    first = [r["x"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(config.entries).collect()]
    if not first:
        return np.empty((config.parts, 0, 0), np.int64)
    width = -(-len(first[0]) // config.parts)
    x = np.pad(np.array(first, np.int64), ((0, 0), (0, config.parts * width - len(first[0]))))
    return np.ascontiguousarray(x.reshape(len(first), config.parts, width).transpose(1, 0, 2))


def learn(rows: DataFrame, config: CodeConfig) -> np.ndarray:
    """The final codebooks (parts, entries, width) from ``whole_numbers``; only they come to the driver, once a round."""
    books = first_books(rows, config)
    for _ in range(config.rounds if books.size else 0):
        books = books.copy()  # the last round's may still be on its way to the tasks
        for r in assigned_sums(rows, books).collect():  # at most parts x entries x width numbers
            books[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return books


def books_sha256(books: np.ndarray) -> str:
    """Digest of all components in decimal by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits for each part), error (squared distances added up)."""
    parts, _, width = books.shape
    sent = rows.sparkSession.sparkContext.broadcast(books)
    label_type = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, parts * width):
                codes, distances = nearest(matrix(piece.column(2), parts * width), sent.value)
                text = codes.astype(np.uint8).tobytes().hex()
                step = 2 * parts
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()), pa.array(distances.sum(1))], names=["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "x").mapInArrow(run, f"vec_id long, label {label_type}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray, scale: float = 4096.0) -> DataFrame:
    """vec_id and the vector that a code stands for: the middle of the cells of its entries' components."""
    flat = ((books + 0.5) / scale).astype(np.float64)
    sent = codes.sparkSession.sparkContext.broadcast(flat)
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digits = np.frombuffer(bytes.fromhex("".join(batch.column(1).to_pylist())), np.uint8).reshape(-1, parts)
            found = sent.value[np.arange(parts), digits].reshape(batch.num_rows, -1)
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * found.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))], names=["vec_id", "vector"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, vector array<double>")


def with_label_error(rows: DataFrame, limit: int = BROADCAST_LABELS) -> DataFrame:
    """Adds label_error: the errors of rows of an equal label added up, null labels together.

    Sums are made in the tasks first. They go to all tasks if there are at most ``limit`` labels; otherwise rows are
    dealt by label and a salt, each label's sum once for each salt, so that a hot label fills several tasks.
    """
    sums = staged(rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    same = rows["label"].eqNullSafe(F.col("_label"))
    if sums.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(sums), same).drop("_label")
    many = sums.withColumn("_there", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALTS)).cast("int"))
    return dealt.join(many, dealt["label"].eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_there"))).drop("_label", "_salt", "_there")


def compress(vectors: DataFrame, config: CodeConfig | None = None, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable vector."""
    config = config or CodeConfig()
    if not 0 < config.entries <= 256 or config.parts < 1:
        raise ValueError("from 1 to 256 entries and at least one part")
    rows = of_one_length(staged(whole_numbers(vectors, config, id_col, vector, label), "whole-numbers"))
    books = learn(rows, config)
    out = staged(encode(rows, books), "codes")
    return with_label_error(out).select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def oracle(config: CodeConfig, dims: int) -> str:
    """DuckDB SQL of the same for the ``embeddings`` table: every round is a pair of common table expressions."""
    width = dims // config.parts
    head = f"""WITH x AS MATERIALIZED (
  SELECT vec_id, label, CAST((i - 1) // {width} AS INTEGER) AS part, CAST((i - 1) % {width} AS INTEGER) AS place, CAST(floor({int(config.scale)} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS v
  FROM embeddings, range(1, {dims + 1}) r(i)
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), e0 AS MATERIALIZED (
  SELECT part, entry, place, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT DISTINCT vec_id FROM x)) USING (vec_id) WHERE entry < {config.entries}
)"""
    assigned = "{a} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT x.vec_id, x.part, e.entry, CAST(sum((x.v - e.v) * (x.v - e.v)) AS BIGINT) AS d FROM x JOIN {e} e ON e.part = x.part AND e.place = x.place GROUP BY ALL) GROUP BY 1, 2)"
    moved = "{n} AS MATERIALIZED (SELECT e.part, e.entry, e.place, coalesce(m.v, e.v) AS v FROM {e} e LEFT JOIN (SELECT x.part, a.entry, x.place, CAST(floor(sum(x.v) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS v FROM x JOIN {a} a ON a.vec_id = x.vec_id AND a.part = x.part GROUP BY ALL) m ON m.part = e.part AND m.entry = e.entry AND m.place = e.place)"
    rounds = [text for r in range(config.rounds) for text in (assigned.format(a=f"a{r}", e=f"e{r}"), moved.format(n=f"e{r + 1}", e=f"e{r}", a=f"a{r}"))]
    last = f"e{config.rounds}"
    tail = f"""{assigned.format(a="fin", e=last)},
o AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM fin GROUP BY 1),
l AS (SELECT o.*, x.label FROM o JOIN (SELECT DISTINCT vec_id, label FROM x) x USING (vec_id))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, place)) FROM {last}) AS codebooks_sha256 FROM l"""
    return ",\n".join([head, *rounds, tail])
