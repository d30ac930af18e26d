"""Operator 4: quality rules by gradient-boosted trees over document statistics.

Statistics of whole texts are taken on the bytes of many texts at once. Trees of fixed depth are boosted on the
logistic loss over binned statistics; a split on a constrained feature is taken only if its children keep the order,
and the bound between them is handed down, so the score is monotone in that feature. Trained trees lie in flat numpy
arrays, and a batch goes down all of them level by level.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .units import _VALUES, _powers

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "bang_share", "pipe_share", "distinct_share", "line_words")
#: Sign by feature: -1 where more must never raise the score.
MONOTONE = (0, 0, -1, -1, -1, -1, 0, 0, -1, -1, 0, 0)


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SPACE, SYMBOL, UPPER, DIGIT = _flags(b" \t\n\v\f\r"), _flags(b"#*$%&|<>"), _flags(bytes(range(65, 91))), _flags(bytes(range(48, 58)))
MARK = _flags(bytes(c for c in range(33, 127) if not chr(c).isalnum()))


def _hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, down: np.ndarray) -> np.ndarray:
    h = (prefix[ends] - prefix[starts]) * down[starts]
    return (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


def statistics(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts of each text, and its features (texts x FEATURES). Null and empty texts have zeros."""
    texts = pc.fill_null(texts, "")
    rows = len(texts)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), texts), "\n")[0].as_buffer(), np.uint8) if rows else np.empty(0, np.uint8)
    row_ends = np.cumsum(sizes + 1) - 1
    row_starts = row_ends - sizes

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[row_ends] - total[row_starts]

    n = len(data)
    solid = ~SPACE[data]
    starts = np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1]])) if n else np.empty(0, np.int64)
    ends = np.flatnonzero(solid & np.concatenate([~solid[1:], [True]])) + 1 if n else starts
    n_words = np.diff(np.searchsorted(starts, row_ends), prepend=0) if rows else np.empty(0, np.int64)
    up, down = _powers(n + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * up[:n])])
    words = _hashes(prefix, starts, ends, down)
    owner = np.repeat(np.arange(rows), n_words)
    # lines: cut at \n, and at the \n that joins two texts; those with a word count
    breaks = np.flatnonzero(data == 10)
    line_starts, line_ends = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [n]])
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_owner = np.searchsorted(row_ends, line_starts)
    order = np.lexsort((_line := _hashes(prefix, line_starts, line_ends, down), line_owner))
    same = (line_owner[order][1:] == line_owner[order][:-1]) & (_line[order][1:] == _line[order][:-1])
    n_dup = np.bincount(line_owner[order][1:][same], minlength=rows)
    n_lines = np.bincount(line_owner, minlength=rows)
    # windows of three words found twice or more
    m = len(words) - 2
    covered = np.zeros(len(words) + 3, np.int64)
    if m > 0:
        inside = np.flatnonzero(owner[2:] == owner[:-2])
        h = words[inside] * np.uint64(0x9E3779B97F4A7C15) + (words[inside + 1] ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xC2B2AE3D27D4EB4F) + words[inside + 2] * np.uint64(0x165667B19E3779F9)
        by = np.lexsort((h, owner[inside]))
        again = (h[by][1:] == h[by][:-1]) & (owner[inside][by][1:] == owner[inside][by][:-1])
        twice = np.zeros(len(by), bool)
        twice[1:] |= again
        twice[:-1] |= again
        at = inside[by[twice]]
        covered[at] += 1
        covered[at + 3] -= 1
    n_repeat = np.bincount(owner[np.cumsum(covered)[: len(words)] > 0], minlength=rows)
    by = np.lexsort((words, owner))
    n_distinct = np.bincount(owner[by][np.concatenate([[True], (words[by][1:] != words[by][:-1]) | (owner[by][1:] != owner[by][:-1])])] if len(by) else owner, minlength=rows)
    chars = per_row(solid & ((data & 0xC0) != 0x80))
    base = {"n_words": n_words, "word_chars": chars, "n_symbols": per_row(SYMBOL[data]), "n_dup_lines": n_dup, "n_repeat_words": n_repeat}
    w, c = np.maximum(n_words, 1), np.maximum(chars, 1)
    columns = [np.log1p(n_words), chars / w, base["n_symbols"] / w, n_dup / np.maximum(n_lines, 1), n_repeat / w, per_row(UPPER[data]) / c, per_row(DIGIT[data]) / c, per_row(MARK[data]) / c, per_row(data == 33) / w, per_row(data == 124) / w, n_distinct / w, n_words / np.maximum(n_lines, 1)]
    return base, np.stack([np.asarray(x, np.float64) for x in columns], 1) if rows else np.empty((0, len(FEATURES)))


@dataclass
class Trees:
    """Complete trees of one depth: inner nodes by level, then leaves. x > cut goes right."""

    depth: int
    feature: np.ndarray  # trees x (2 ** depth - 1)
    cut: np.ndarray
    leaf: np.ndarray  # trees x 2 ** depth
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros((len(x), len(self.leaf)), np.int64)
        tree, row = np.arange(len(self.leaf))[None], np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.cut[tree, node])
        z = self.leaf[tree, node - (2**self.depth - 1)].sum(1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, monotone: Sequence[int] = MONOTONE, trees: int = 60, depth: int = 3, rate: float = 0.2, l2: float = 1.0, bins: int = 64, least: int = 10) -> Trees:
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)  # bin > i means x > cuts[i]
    p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    bias = float(np.log(p / (1 - p)))
    z, inner = np.full(len(y), bias), 2**depth - 1
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        prob = 1 / (1 + np.exp(-z))
        g, h = y - prob, prob * (1 - prob)
        rows = {0: np.arange(len(y))}
        bound = {0: (-np.inf, np.inf)}
        for node in range(inner):
            own, (low, high) = rows[node], bound[node]
            best, chosen = 1e-6, None
            gs, hs = g[own].sum(), h[own].sum()
            for f, edges in enumerate(cuts):
                if not len(edges) or len(own) < 2 * least:
                    continue
                k = len(edges) + 1
                gl = np.cumsum(np.bincount(binned[own, f], g[own], k))[:-1]
                hl = np.cumsum(np.bincount(binned[own, f], h[own], k))[:-1]
                nl = np.cumsum(np.bincount(binned[own, f], minlength=k))[:-1]
                left, right = np.clip(gl / (hl + l2), low, high), np.clip((gs - gl) / (hs - hl + l2), low, high)
                gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                ok = (nl >= least) & (len(own) - nl >= least) & (monotone[f] * (right - left) >= 0)
                if ok.any() and (top := np.where(ok, gain, -1).argmax()) is not None and gain[top] > best:
                    best, chosen = gain[top], (f, int(top), left[top], right[top])
            down = {2 * node + 1: own, 2 * node + 2: own[:0]}
            bounds = {2 * node + 1: (low, high), 2 * node + 2: (low, high)}
            if chosen:
                f, top, left, right = chosen
                feature[t, node], cut[t, node] = f, cuts[f][top]
                right_side = binned[own, f] > top
                down = {2 * node + 1: own[~right_side], 2 * node + 2: own[right_side]}
                mid = (left + right) / 2
                if monotone[f] > 0:
                    bounds = {2 * node + 1: (low, mid), 2 * node + 2: (mid, high)}
                elif monotone[f] < 0:
                    bounds = {2 * node + 1: (mid, high), 2 * node + 2: (low, mid)}
            rows |= down
            bound |= bounds
        for i in range(inner + 1):
            own = rows[inner + i]
            if len(own):
                leaf[t, i] = rate * np.clip(g[own].sum() / (h[own].sum() + l2), *bound[inner + i])
                z[own] += leaf[t, i]
    return Trees(depth, feature, cut, leaf, bias)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, seed: int = 4) -> Trees | None:
    """Train on the statistics of about ``sample`` labelled texts, drawn by a hash of the id; None without two classes.

    A doc_id labelled both ways counts as good; of the texts of one doc_id the one with the least hash is taken. The
    ids drawn are bounded by ``sample`` and sent to the tasks that read the texts, and one row of numbers for each id
    comes back, however many rows carry it.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    total = known.count()
    if not total:
        return None
    unit = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    drawn = known.where(unit < min(1.0, sample / total)).limit(2 * sample)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("hash")).join(F.broadcast(drawn), "doc_id").select("doc_id", "quality", "hash", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = statistics(part.column("text"))[1]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(c) for c in x.T)], names=["doc_id", "quality", "hash", *FEATURES])

    found = rows.mapInArrow(run, "doc_id long, quality int, hash long, " + ", ".join(f"{f} double" for f in FEATURES))
    one = found.groupBy("doc_id", "quality").agg(F.min_by(F.struct(*FEATURES), "hash").alias("x"))
    got = one.orderBy("doc_id").select("quality", "x.*").toArrow()
    y = got.column("quality").to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return None
    return train(np.stack([got.column(f).to_numpy() for f in FEATURES], 1), y)


def judge(docs: DataFrame, model: Trees | None, limit: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, score (probability of quality 1; 1 without a model) and kept of every whole text.

    Null texts have no words and fail the base rules. ``kept``: the base rules hold and the score is at least ``limit``.
    A row for each row of ``docs``: null and repeated doc_ids stay as they are. Words and lines are told apart by 64-bit
    hashes: among the w words of a text two that differ fall together with odds of about w ** 2 / 2 ** 65.
    """
    packed = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Trees | None = pickle.loads(packed)
        for batch in batches:
            for part in slices(batch, "text"):
                base, x = statistics(part.column("text"))
                failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
                score = own.scores(x) if own else np.ones(len(x))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(base[k].astype(np.int64)) for k in BASE), pa.array(failed), pa.array(score), pa.array(~failed & (score >= limit))], names=["doc_id", *BASE, "base_failed", "score", "kept"])

    two = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return two.mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in BASE) + ", base_failed boolean, score double, kept boolean")
