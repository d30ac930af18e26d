"""Operator 5: language identification by a byte convolutional network, trained and run in numpy.

Bytes map to symbols (letters without case, one each for digits, space and marks, every non-ASCII byte) with learned
embeddings; filters of several widths, max pooling over a window and a softmax follow. Whole texts are read as
windows of fixed length, many texts at once; a text's class has the highest log probability summed over its windows,
each weighted by its bytes. At inference a filter is a sum of table rows, one for each pair of neighbouring symbols.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

WINDOW = 256
WIDTHS = (2, 3, 4)
UNKNOWN = "und"


def _symbols() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[33:127] = 1
    out[48:58] = 2
    for i in range(26):
        out[65 + i] = out[97 + i] = 3 + i
    out[128:] = 29 + np.arange(128)
    return out


SYMBOL = _symbols()
N_SYMBOLS = int(SYMBOL.max()) + 1


@dataclass
class ByteCnn:
    langs: list[str]
    embed: np.ndarray  # symbols x width
    filters: list[np.ndarray]  # window places x width x filters
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """For each width: sums of filter parts for pairs of symbols, for its first two places and the rest."""
        found = []
        for w, b in zip(self.filters, self.bias, strict=True):
            part = [(self.embed @ w[i]).astype(np.float32) for i in range(len(w))]
            pair = lambda x, y: (x[:, None] + y[None]).reshape(-1, x.shape[1])
            rest = None if len(w) == 2 else part[2] if len(w) == 3 else pair(part[2], part[3])
            found.append((pair(part[0], part[1]) + b.astype(np.float32), rest))
        return found

    def log_probabilities(self, windows: np.ndarray, tables: list) -> np.ndarray:
        """windows: n x WINDOW symbols; returns n x langs."""
        windows = windows.astype(np.int32)
        pairs = windows[:, :-1] * N_SYMBOLS + windows[:, 1:]
        pooled = []
        for w, (first, rest) in zip(self.filters, tables, strict=True):
            n = windows.shape[1] - len(w) + 1
            z = np.take(first, pairs[:, :n], axis=0)
            if rest is not None:
                z += np.take(rest, windows[:, 2 : n + 2] if len(w) == 3 else pairs[:, 2 : n + 2], axis=0)
            pooled.append(np.maximum(z.max(1), 0))
        z = np.concatenate(pooled, 1) @ self.out.astype(np.float32) + self.out_bias.astype(np.float32)
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def windows_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols in rows of WINDOW, the text of each row and its bytes; the last row of a text is filled with spaces."""
    texts = pc.fill_null(texts, "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), rows)
    data = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "")[0].as_buffer(), np.uint8) if len(texts) else np.empty(0, np.uint8)
    place = np.zeros(int(rows.sum()) * WINDOW, np.uint8)
    shift = np.repeat((np.cumsum(rows) - rows) * WINDOW - (np.cumsum(sizes) - sizes), sizes)
    place[np.arange(len(data)) + shift] = SYMBOL[data]
    number = np.arange(len(owner)) - np.repeat(np.cumsum(rows) - rows, rows)
    return place.reshape(-1, WINDOW), owner, np.minimum(sizes[owner] - number * WINDOW, WINDOW)


def drawn(texts: pa.Array, most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` windows of each text, drawn over its whole length, and the text of each.

    Ends of under 16 bytes are left out, unless they are all of their text.
    """
    x, owner, size = windows_of(texts)
    if not len(x):
        return x, owner
    order = np.random.default_rng(seed).permutation(len(x))
    order = order[np.argsort(owner[order], kind="stable")]
    own = owner[order]
    first = np.maximum.accumulate(np.where(np.concatenate([[True], own[1:] != own[:-1]]), np.arange(len(own)), 0))
    keep = order[(np.arange(len(own)) - first < most) & ((size[order] >= 16) | (np.bincount(owner)[own] == 1))]
    return x[keep], owner[keep]


def train(texts: list[str], labels: list[str], per_text: int = 6, seed: int = 5, **options) -> ByteCnn:
    """Train on windows of labelled texts."""
    x, owner = drawn(pa.array(texts, pa.string()), per_text, seed)
    return train_windows(x, [labels[i] for i in owner], seed=seed, **options)


def train_windows(x: np.ndarray, labels: list[str], filters: int = 16, width: int = 8, epochs: int = 6, rate: float = 0.01, seed: int = 5) -> ByteCnn:
    """Adam on cross-entropy over windows of symbols."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    y = np.array([langs.index(v) for v in labels])
    parts = [rng.normal(0, 0.5, (N_SYMBOLS, width))] + [rng.normal(0, 1 / np.sqrt(w * width), (w, width, filters)) for w in WIDTHS] + [np.zeros(filters) for _ in WIDTHS] + [rng.normal(0, 0.1, (filters * len(WIDTHS), len(langs))), np.zeros(len(langs))]
    moment, second, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    k = len(WIDTHS)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            if not len(at):
                continue
            model = ByteCnn(langs, parts[0], parts[1 : 1 + k], parts[1 + k : 1 + 2 * k], parts[-2], parts[-1])
            rows = x[at].astype(np.int64)
            grads = [np.zeros_like(p) for p in parts]
            pooled, where = [], []
            for i, w in enumerate(WIDTHS):
                n = WINDOW - w + 1
                z = sum((model.embed @ model.filters[i][j])[rows[:, j : j + n]] for j in range(w)) + model.bias[i]
                top = z.argmax(1)
                where.append(top)
                pooled.append(np.maximum(np.take_along_axis(z, top[:, None], 1)[:, 0], 0))
            h = np.concatenate(pooled, 1)
            z = h @ model.out + model.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(at)), y[at]] -= 1
            p /= len(at)
            grads[-2], grads[-1] = h.T @ p, p.sum(0)
            back = (p @ model.out.T) * (h > 0)
            for i, w in enumerate(WIDTHS):
                g = back[:, i * filters : (i + 1) * filters]
                grads[1 + k + i] = g.sum(0)
                for j in range(w):
                    sym = np.take_along_axis(rows, where[i] + j, 1)  # batch x filters
                    grads[1 + i][j] = np.einsum("bfd,bf->df", model.embed[sym], g)
                    np.add.at(grads[0], sym, g[:, :, None] * model.filters[i][j].T[None])
            step += 1
            for q in range(len(parts)):
                moment[q] = 0.9 * moment[q] + 0.1 * grads[q]
                second[q] = 0.999 * second[q] + 0.001 * grads[q] ** 2
                parts[q] = parts[q] - rate * (moment[q] / (1 - 0.9**step)) / (np.sqrt(second[q] / (1 - 0.999**step)) + 1e-8)
    return ByteCnn(langs, parts[0], parts[1 : 1 + k], parts[1 + k : 1 + 2 * k], parts[-2], parts[-1])


def fit(docs: DataFrame, per_lang: int = 600, per_text: int = 6, most_langs: int = 1000, seed: int = 5) -> ByteCnn | None:
    """Train on windows of about ``per_lang`` texts of each language, drawn by a hash of the row; None without labelled texts.

    ``docs``: doc_id, text, lang, with the training rows only. The ``most_langs`` most frequent languages are learned.
    The tasks draw ``per_text`` windows of each text, so what comes to the driver hangs neither on the table's size nor
    on the texts' lengths. Equal rows are drawn together, but what is trained on is bounded by ``per_lang`` all the
    same. Rows come in any order and are put into a fixed one before training.
    """
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND text != ''").select("doc_id", "lang", F.col("text").cast("string"))
    frequent = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(most_langs)
    counts = {r["lang"]: r["n"] for r in frequent.collect()}
    if not counts:
        return None
    unit = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    share = F.element_at(F.create_map(*[F.lit(v) for c, n in counts.items() for v in (c, min(1.0, per_lang / n))]), F.col("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x, owner = drawn(part.column("text"), per_text, seed)
                yield pa.RecordBatch.from_arrays([part.column("lang").take(pa.array(owner)), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "window"])

    some = rows.where(F.coalesce(unit < share, F.lit(False))).select("lang", "text")
    got = some.mapInArrow(run, "lang string, window binary").limit(2 * per_text * per_lang * len(counts)).toArrow()
    windows = sorted(zip(got.column("window").to_pylist(), got.column("lang").to_pylist(), strict=True))
    if not windows:
        return None
    x = np.frombuffer(b"".join(w for w, _ in windows), np.uint8).reshape(-1, WINDOW)
    return train_windows(x, [c for _, c in windows], seed=seed)


def lettered(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def classify(texts: pa.Array, own: ByteCnn | None, tables: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language and score of each text, and the largest mean probability of any language; ``und`` and 0 for null texts and those without a letter."""
    known = lettered(texts)
    names, scores, peaks = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts))
    if own and len(texts):
        x, owner, size = windows_of(texts)
        logs, probs = np.zeros((len(texts), len(own.langs))), np.zeros((len(texts), len(own.langs)))
        for at in range(0, len(x), 64):
            p = own.log_probabilities(x[at : at + 64], tables)
            np.add.at(logs, owner[at : at + 64], p * size[at : at + 64, None])
            np.add.at(probs, owner[at : at + 64], np.exp(p) * size[at : at + 64, None])
        best = logs.argmax(1)
        total = np.maximum(np.bincount(owner, size, len(texts)), 1)
        names[known] = np.array(own.langs, object)[best[known]]
        scores[known] = np.clip(probs[np.arange(len(texts)), best] / total, 0, 1)[known]
        peaks[known] = (probs.max(1) / total)[known]
    return names, scores, peaks


def predict(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """doc_id, lang_pred, score of every whole text.

    The score is the mean probability of the class over the text's windows, weighted by their bytes. Without a model
    (no labelled text to learn from) every text is ``und``. A row for each row of ``docs``: null and repeated doc_ids
    stay as they are.
    """
    packed = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: ByteCnn | None = pickle.loads(packed)
        tables = own.tables() if own else []
        for batch in batches:
            for part in slices(batch, "text"):
                names, scores, _ = classify(part.column("text"), own, tables)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    two = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return two.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: ByteCnn | None, chance: float = 1.1) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has a language.

    A text goes if it has no letter, or if the mean probability of no language reaches ``chance`` times that of a guess
    among the learned ones: the network then says nothing of it. Without a model texts with letters are kept, as nothing speaks
    against them.
    """
    packed = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: ByteCnn | None = pickle.loads(packed)
        tables = own.tables() if own else []
        for batch in batches:
            for part in slices(batch, "text"):
                text = part.column("text")
                if own is None:
                    known = lettered(text)
                else:
                    names, _, peaks = classify(text, own, tables)
                    known = (names != UNKNOWN) & (peaks >= min(1.0, chance / len(own.langs)) - 1e-9)
                yield part.filter(pa.array(known))

    return docs.mapInArrow(run, docs.schema)
