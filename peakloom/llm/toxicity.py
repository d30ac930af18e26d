"""Operator 6: toxicity by a counterfactual-regularised classifier.

Features are the distinct units (words, without case) of a text and the beginnings of longer ones, hashed; those that
tell the classes apart on a bounded labelled sample are kept, with the identity terms and their beginnings. Each
labelled text gives counterfactuals: the identity term that it holds is swapped for every other term of its language
and left out; where it holds none, terms take the place of one of its words. A swap takes all features with it, the
beginnings too, but for those that other words of the text have. The loss is logistic, over the texts and over one
counterfactual of each with the text's label, with an L2 term and the variance of the scores among the counterfactuals
of a text (logit pairing): so neither the mention of a group nor the choice of the group moves a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, slices, staged
from .units import cut

#: Terms that name groups, by language, each one unit; a parameter of ``fit``.
IDENTITY: tuple[tuple[str, ...], ...] = (
    ("women", "men", "muslims", "christians", "jews", "gays", "lesbians", "immigrants", "foreigners", "blacks", "whites", "asians", "disabled", "elderly"),
    ("frauen", "männer", "muslime", "christen", "juden", "schwule", "lesben", "migranten", "ausländer", "schwarze", "behinderte"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "gays", "lesbiennes", "immigrés", "étrangers", "noirs", "handicapés"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "gays", "lesbianas", "inmigrantes", "extranjeros", "negros", "discapacitados"),
)
BITS = 38
#: Beginnings of words, in bytes, that are features beside the words themselves: they carry over to unseen forms.
STEMS = (4, 6)
#: Least chi-squared statistic of a feature that is kept: p < 0.001.
CHI = 10.83
Terms = Sequence[Sequence[str]]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed units, then hashed beginnings of longer units, with the number of their text; each may stand several times."""
    low, starts, ends, keys, counts = cut(texts)
    hashed, unit = _of_units(low, starts, ends, keys)
    return hashed, np.repeat(np.arange(len(counts)), counts)[unit]


def _of_units(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of all units, and the unit of each."""
    hashed, unit = [keys], [np.arange(len(keys))]
    for n in STEMS:
        own = np.flatnonzero(ends - starts > n)
        value = np.full(len(own), n, np.uint64)
        for i in range(n):
            value = (value + low[starts[own] + i]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        hashed.append(value * np.uint64(0xBF58476D1CE4E5B9))
        unit.append(own)
    return (np.concatenate(hashed) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(unit)


def parts_of(identity: Terms) -> list[list[list[int]]]:
    """For each language and term: the feature of the word, then those of its beginnings."""
    return [[features(pa.array([t]))[0].tolist() for t in group] for group in identity]


@dataclass
class Examples:
    """Labelled texts and what a counterfactual changes in each."""

    full: list[np.ndarray]  # distinct features of the text
    gone: list[np.ndarray]  # those that go with the word or term that is swapped
    group: np.ndarray  # language of the terms, -1 where the text has no word to swap
    term: np.ndarray  # the term that comes in the counterfactual with the text's label


def examples(texts: pa.Array, parts: list[list[list[int]]]) -> Examples:
    """What hangs on chance hangs on the text's own hash, so equal texts give equal examples."""
    low, starts, ends, keys, counts = cut(texts)
    hashed, unit = _of_units(low, starts, ends, keys)
    owner = np.repeat(np.arange(len(counts)), counts)
    term_of = {t[0]: (g, i) for g, group in reversed(list(enumerate(parts))) for i, t in enumerate(group)}  # of the first language
    word = hashed[: len(keys)]
    named = np.isin(word, np.array(list(term_of), np.int64))
    letters = (low[starts] > 96) & (ends - starts > 2) if len(starts) else np.empty(0, bool)
    first = np.cumsum(counts) - counts
    by_owner = np.argsort(owner[unit], kind="stable")
    edges = np.searchsorted(owner[unit][by_owner], np.arange(len(counts) + 1))
    out = Examples([], [], np.full(len(counts), -1), np.zeros(len(counts), np.int64))
    for i, n in enumerate(counts.tolist()):
        own = slice(first[i], first[i] + n)
        chance = int((np.bitwise_xor.reduce(keys[own]) if n else np.uint64(0)) >> np.uint64(5))
        f, u = hashed[by_owner[edges[i] : edges[i + 1]]], unit[by_owner[edges[i] : edges[i + 1]]]
        gone = np.zeros(n, bool)
        if named[own].any():
            t = int(word[own][np.argmax(named[own])])
            gone = word[own] == t
            out.group[i], here = term_of[t]
            size = len(parts[out.group[i]])
            out.term[i] = (here + 1 + chance % max(size - 1, 1)) % size
        elif len(free := np.flatnonzero(letters[own])) and parts:
            gone[free[chance % len(free)]] = True
            out.group[i] = (chance >> 16) % len(parts)
            out.term[i] = (chance >> 24) % len(parts[out.group[i]])
        full = np.unique(f)
        out.full.append(full)
        out.gone.append(np.setdiff1d(full, f[~gone[u - first[i]]], assume_unique=False))
    return out


@dataclass
class Classifier:
    index: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1; each feature counts once in a text. Null and empty texts get the bias alone."""
        hashed, owner = features(texts)
        at = np.minimum(np.searchsorted(self.index, hashed), len(self.index) - 1) if len(self.index) else np.zeros(len(hashed), np.int64)
        hit = self.index[at] == hashed if len(self.index) else np.zeros(len(hashed), bool)
        pair = np.unique(owner[hit] * len(self.index) + at[hit]) if hit.any() else np.empty(0, np.int64)
        z = np.bincount(pair // max(1, len(self.index)), self.weights[pair % max(1, len(self.index))], len(texts)) if len(pair) else np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -40, 40)))


def placed(values: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Places in the sorted ``index`` of those ``values`` that it holds."""
    if not len(index):
        return np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(index, values), len(index) - 1)
    return at[index[at] == values]


def chi_squared(n: np.ndarray, n1: np.ndarray, total: float, pos: float) -> np.ndarray:
    """Statistic (with Yates' correction) of features held by ``n`` of ``total`` texts, ``n1`` of them among ``pos`` of label 1."""
    a, b, c = n1, n - n1, pos - n1
    d = total - a - b - c
    return total * np.maximum(np.abs(a * d - b * c) - total / 2, 0) ** 2 / np.maximum(n * (total - n) * pos * (total - pos), 1e-9)


def train(index: np.ndarray, y: np.ndarray, found: Examples, parts: list[list[list[int]]], fair: float = 10.0, mixed: float = 0.5, l2: float = 3e-5, rounds: int = 600, rate: float = 0.1, shift: float = 0.0) -> Classifier:
    """Full-batch Adam. ``found`` holds places in ``index``, ``parts`` feature hashes.

    ``fair`` weighs the variance of scores among counterfactuals, ``mixed`` the loss of one labelled counterfactual of
    each text; ``shift`` is added to the bias in the end, for a sample whose classes are drawn at different rates.
    """
    terms = [[set(placed(np.array(t, np.int64), index).tolist()) for t in group] for group in parts]
    of_group = [set().union(*group) for group in terms]
    rest = [set(full.tolist()) - set(gone.tolist()) for full, gone in zip(found.full, found.gone, strict=True)]
    swap = np.flatnonzero(found.group >= 0)
    patterns: Counter[tuple[int, frozenset[int]]] = Counter((int(found.group[i]), frozenset(rest[i] & of_group[found.group[i]])) for i in swap.tolist())
    # Counterfactuals of a pattern: one with each term, and one without; what matters is what each adds to the rest.
    member, feature, of_pattern = [], [], []
    for p, (g, stay) in enumerate(patterns):
        for t in [set(), *terms[g]]:
            more = sorted(t - stay)
            member += [len(of_pattern)] * len(more)
            feature += more
            of_pattern.append(p)
    member, feature, of_pattern = (np.array(x, np.int64) for x in (member, feature, of_pattern))
    times = np.array(list(patterns.values()), float) / max(1, patterns.total())
    size = np.bincount(of_pattern, minlength=len(times)) if len(times) else np.empty(0)

    sets = [*found.full, *(np.array(sorted(rest[i] | terms[found.group[i]][found.term[i]]), np.int64) for i in swap.tolist())]
    label, weight = np.concatenate([y, y[swap]]), np.concatenate([np.ones(len(y)), np.full(len(swap), mixed)])
    weight /= weight.sum()
    row, col = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate([np.asarray(s, np.int64) for s in sets])
    w, p1 = np.zeros(len(index)), float((weight * label).sum())
    bias = float(np.log((p1 + 1e-3) / (1 - p1 + 1e-3)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = np.bincount(row, w[col], len(sets)) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label) * weight
        grad = np.bincount(col, g[row], len(w)) + l2 * w
        if len(times):
            moved = np.bincount(member, w[feature], len(of_pattern))
            mean = np.bincount(of_pattern, moved, len(times)) / size
            d = 2 * fair * (times / size)[of_pattern] * (moved - mean[of_pattern])
            grad += np.bincount(feature, d[member], len(w))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.999 * vb + 0.001 * g.sum() ** 2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return Classifier(index, w, float(bias + shift))


def train_texts(texts: Sequence[str | None], y: Sequence[float], identity: Terms = IDENTITY, most: int = 4096, least: int = 3, **options) -> Classifier:
    """The same from texts in memory."""
    y, parts = np.asarray(y, float), parts_of(identity)
    found = examples(pa.array(texts, pa.string()), parts)
    flat, label = np.concatenate(found.full), np.repeat(y, [len(f) for f in found.full])
    values, inverse = np.unique(flat, return_inverse=True)
    n = np.bincount(inverse).astype(float)
    chi = chi_squared(n, np.bincount(inverse, label), len(y), y.sum())
    good = np.flatnonzero((n >= least) & (chi > CHI))
    index = index_of(values[good[np.lexsort((values[good], -chi[good]))[:most]]], parts)
    inside = Examples([placed(f, index) for f in found.full], [placed(f, index) for f in found.gone], found.group, found.term)
    return train(index, y, inside, parts, **options)


def index_of(chosen: np.ndarray, parts: list[list[list[int]]]) -> np.ndarray:
    return np.unique(np.concatenate([chosen, np.array([f for group in parts for t in group for f in t], np.int64)]).astype(np.int64))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000, identity: Terms = IDENTITY, seed: int = 6, most: int = 4096, least: int = 3, **options) -> Classifier:
    """Train on about ``per_class`` labelled texts of each class, drawn by a hash of the id.

    ``docs``: doc_id, text; ``labels``: doc_id, toxic, with the training rows only. A doc_id labelled both ways counts as
    toxic; of the texts of one doc_id the one with the least hash is taken, so no id brings more than one text, however
    many rows carry it. The labels drawn are bounded by ``per_class`` and sent to the tasks that read the texts. Features
    are counted and chosen (the ``most`` with the largest chi-squared statistic, in ``least`` texts or more) in the
    tasks; the driver gets those, and their places in each text. Classes drawn at different rates are set right in the bias.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    empty = Classifier(np.empty(0, np.int64), np.empty(0), -2.0)
    if len(counts) < 2:
        return empty
    unit = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    rates = {c: min(1.0, per_class / n) for c, n in counts.items()}
    drawn = known.where(unit < F.when(F.col("toxic") == 1, rates[1]).otherwise(rates[0])).limit(4 * per_class)
    parts = parts_of(identity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = examples(part.column("text"), parts)
                columns = [part.column("toxic"), _arrays(found.full), _arrays(found.gone), pa.array(found.group), pa.array(found.term)]
                yield pa.RecordBatch.from_arrays(columns, names=["toxic", "features", "gone", "group", "term"])

    two = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = two.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("toxic", "text")
    rows = staged(rows.mapInArrow(run, "toxic int, features array<long>, gone array<long>, group long, term long"), "labelled-features")
    total = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).first()
    if not total["n"] or not 0 < total["k"] < total["n"]:
        return empty
    held = rows.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.count("*").cast("double").alias("n"), F.sum("toxic").cast("double").alias("n1")).where(F.col("n") >= least)
    a, b, c = F.col("n1"), F.col("n") - F.col("n1"), total["k"] - F.col("n1")
    cross = F.abs(a * (total["n"] - a - b - c) - b * c) - total["n"] / 2
    chi = total["n"] * F.pow(F.greatest(cross, F.lit(0.0)), 2) / F.greatest(F.col("n") * (total["n"] - F.col("n")) * F.lit(float(total["k"] * (total["n"] - total["k"]))), F.lit(1e-9))
    chosen = held.withColumn("chi", chi).where(F.col("chi") > CHI).orderBy(F.col("chi").desc(), "f").limit(most).select("f").toArrow()
    index = index_of(chosen.column("f").to_numpy(), parts)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [pa.array([placed(f, index).astype(np.int32) for f in _lists(b.column(c))], pa.list_(pa.int32())) for c in ("features", "gone")]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), *lists, b.column("group"), b.column("term")], names=["toxic", "features", "gone", "group", "term"])

    got = rows.mapInArrow(inside, "toxic int, features array<int>, gone array<int>, group long, term long").orderBy("features", "toxic", "gone").toArrow()
    drop_staged(rows)
    found = Examples(_lists(got.column("features").combine_chunks()), _lists(got.column("gone").combine_chunks()), got.column("group").to_numpy(), got.column("term").to_numpy())
    return train(index, got.column("toxic").to_numpy().astype(float), found, parts, shift=float(np.log(rates[0] / rates[1])), **options)


def _arrays(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(v) for v in values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else np.empty(0, np.int64), pa.int64()))


def _lists(column: pa.Array) -> list[np.ndarray]:
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy().astype(np.int64)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def score(docs: DataFrame, model: Classifier, limit: float = 0.3) -> DataFrame:
    """doc_id, score, predicted (score >= ``limit``) of every whole text.

    A row for each row of ``docs``: null and repeated doc_ids stay as they are, null texts score as empty ones.
    """
    index, weights, bias = model.index, model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(index, weights, bias)
        for batch in batches:
            for part in slices(batch, "text"):
                s = own.scores(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= limit).astype(np.int32))], names=["doc_id", "score", "predicted"])

    two = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return two.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Classifier, limit: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below ``limit``."""
    index, weights, bias = model.index, model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(index, weights, bias)
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(own.scores(part.column("text")) < limit))

    return docs.mapInArrow(run, docs.schema)
