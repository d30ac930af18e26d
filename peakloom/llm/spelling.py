"""Operator 12: spelling variants, grouped under the more frequent word next to each.

Words are counted in the tasks, text by text, and added up by word. Then the full neighbourhood of every word is
generated: each distinct deletion, replacement and insertion over the alphabet that the vocabulary holds, for many
words of a length at once in numpy. A repeat cannot arise, as a letter is deleted only where its neighbour before
differs, and inserted only where it does not follow itself. A neighbour's hash comes from its word's by one product, so
a bounded Bloom filter of the vocabulary sifts the neighbourhood before any string is made; what is left goes into a
hash join with the vocabulary, on the strings themselves, and what that finds is at distance one by construction. A
word's form is its most frequent neighbour if that is frequent enough; forms are followed to their root by pointer
doubling, which ends as counts grow along every step.

Null and empty texts have no words; a null id counts as an empty one; repeated rows count each; an empty table gives no
rows. Texts of any length are cut piece by piece.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, partitions, slices, staged

#: Fixed values of the query: what a run is made of, how many ids and runs lose a letter, shortest and rarest word.
RUN, DAMAGE, SHORTEST, RAREST, MARGIN = "[A-Za-zÀ-ÿ]+", 97, 5, 3, 2
#: Distinct words that a task counts before it hands them on, and bytes of a text that are cut at once; a piece of more than ``LONG`` bytes is one run.
HELD, PIECE, LONG = 400_000, 1 << 20, 1 << 23
#: Words of a vocabulary that is broadcast (some 40 MB); beyond, candidates and words meet in a shuffled hash join.
BROADCAST_WORDS = 300_000
#: Neighbours that are hashed at once; bits of the filter at most (16 MB), bits for each word, and places of each.
BLOCK, MOST_BITS, BITS, PLACES = 1 << 18, 27, 24, 4
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LATIN_LEAD = 0xC3  # all of U+00C0 to U+00FF are this byte and one more


def _letters() -> np.ndarray:
    out = np.zeros(256, bool)
    out[65:91] = out[97:123] = out[_LATIN_LEAD] = True
    return out


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = x >> np.uint32(1) ^ np.where(x & 1, np.uint32(0xEDB88320), np.uint32(0))
    return x


LETTER, CRC = _letters(), _crc_table()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces that end where no run does."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        while end < len(text) and (LETTER[text[end]] or text[end] >= 128):
            end += 1
        yield text[at:end]
        at = end


def damaged(word: str, head: int) -> str:
    """The word, without one of its letters if its checksum (carried on from ``head``) says so."""
    h = zlib.crc32(word.encode(), head)
    return word if h % DAMAGE else word[: h % len(word)] + word[h % len(word) + 1 :]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def checksums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """crc32 of many stretches of bytes, each carried on from its head, byte by byte of all at once."""
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order], lengths[order]
    crc = heads[order] ^ np.uint32(0xFFFFFFFF)
    active = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1), side="right") if len(left) else []
    for j, n in enumerate(active):
        crc[:n] = CRC[(crc[:n] ^ data[at[:n] + j]) & 255] ^ crc[:n] >> np.uint32(8)
    out = np.empty_like(crc)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def counted(held: Counter, texts: list[bytes], heads: np.ndarray, shortest: int) -> None:
    """Add the words of texts, none very long, whose ids have the checksums ``heads``."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lead = raw == _LATIN_LEAD
    letter = LETTER[raw]
    letter[1:] |= lead[:-1]
    change = np.flatnonzero(np.diff(letter, prepend=False))
    starts, ends = change[::2], change[1::2]
    leads = np.concatenate([[0], np.cumsum(lead)])
    points = ends - starts - (leads[ends] - leads[starts])
    keep = points >= shortest
    starts, ends, points = starts[keep], ends[keep], points[keep]
    if not len(starts):
        return
    low = np.where(lead | np.concatenate([[False], lead[:-1]]), raw, LOWER[raw])
    rows = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    h = checksums(low, starts, ends - starts, heads[rows])
    flat = low.tobytes()
    hurt = h % np.uint32(DAMAGE) == 0
    for a, b, n, x in zip(starts[hurt].tolist(), ends[hurt].tolist(), points[hurt].tolist(), h[hurt].tolist(), strict=True):
        if n > shortest:
            word = flat[a:b].decode()
            held[word[: x % n] + word[x % n + 1 :]] += 1
    starts, ends = starts[~hurt], ends[~hurt]
    up = powers(len(low) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(low.astype(np.uint64) + np.uint64(1)) * up[:-1])])
    keys = (sums[ends] - sums[starts]) * up[len(low) - starts]
    _, first, counts = np.unique(keys, return_index=True, return_counts=True)
    for a, b, n in zip(starts[first].tolist(), ends[first].tolist(), counts.tolist(), strict=True):
        held[flat[a:b].decode()] += n


def word_counts(docs: DataFrame, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n over all texts: runs of letters with A-Z lower-cased, some without a letter, of at least ``shortest``.

    Equal runs of a slice of a megabyte are told by 64-bit hashes, from then on by themselves.
    """
    two = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("doc_id"), docs[text_col].cast("string").alias("text")).where("text IS NOT NULL")

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                heads = [zlib.crc32(key.encode() + b":") for key in part.column("doc_id").to_pylist()]
                short, own = [], []
                for head, text in zip(heads, part.column("text").to_pylist(), strict=True):
                    raw = text.encode()
                    for piece in pieces(raw) if len(raw) > PIECE else (raw,):
                        if len(piece) <= LONG and len(raw) <= PIECE:
                            short.append(piece)
                            own.append(head)
                        elif len(piece) <= LONG:
                            counted(held, [piece], np.array([head], np.uint32), shortest)
                        else:
                            for word in re.findall(RUN, piece.decode()):
                                if len(word) >= shortest and len(done := damaged(word.translate(_LOWER), head)) >= shortest:
                                    held[done] += 1
                        if len(held) > HELD:
                            yield batch_of(held)
                            held = Counter()
                counted(held, short, np.array(own, np.uint32), shortest)
        if held:
            yield batch_of(held)

    return two.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def alphabet_of(words: DataFrame) -> np.ndarray:
    """The distinct code points of a vocabulary, ascending; there are no more than Unicode has."""
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).distinct().where("letter != ''")
    return np.array(sorted(ord(r["letter"]) for r in letters.collect()), np.uint32)


def _strings(points: np.ndarray) -> pa.Array:
    """Rows of code points as strings. None may be NUL, as numpy drops it at the end of a string."""
    if not points.shape[1]:
        return pa.array([""] * len(points), pa.string())
    return pa.array(np.ascontiguousarray(points.astype("<u4")).view(f"<U{points.shape[1]}").ravel(), pa.string())


def hashed(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the letters' values times powers of a base, over each word's first 0, 1, ... letters; and the values."""
    values = mixed(points.astype(np.uint64) + np.uint64(1))
    sums = np.zeros((len(points), points.shape[1] + 1), np.uint64)
    np.cumsum(values * powers(points.shape[1]), axis=1, out=sums[:, 1:])
    return sums, values


def places(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The filter's places of a hash, one after the other."""
    h = mixed(hashes)
    step = h >> np.uint64(32) | np.uint64(1)
    for _ in range(PLACES):
        yield h & np.uint64((1 << bits) - 1)
        h = h + step


def held_by(bloom: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Flat indices of the hashes that the filter may hold."""
    bits = (64 * len(bloom)).bit_length() - 1
    left, flat = None, hashes.ravel()
    for i in range(PLACES):  # later places are looked up for what is left only
        h = mixed(flat)
        at = (h + np.uint64(i) * (h >> np.uint64(32) | np.uint64(1))) & np.uint64((1 << bits) - 1)
        on = np.flatnonzero(bloom[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1))
        left, flat = on if left is None else left[on], flat[on]
    return left


def vocabulary_filter(words: DataFrame, rows: int) -> np.ndarray:
    """A Bloom filter of the words' hashes in 64-bit numbers; its bits are set in the tasks, and at most 2 ** 21 numbers come to the driver."""
    bits = min(MOST_BITS, max(12, (BITS * rows).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(0).to_pylist()
            marks = np.concatenate([np.concatenate(list(places(hashed(points)[0][:, -1], bits))) for _, points in by_length(text)])
            at = np.unique(marks)
            group, first = np.unique(at >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
            yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int64)), pa.array(value.view(np.int64))], names=["w", "v"])

    got = words.select("word").mapInArrow(run, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got.column("w").to_numpy()] = got.column("v").to_numpy().view(np.uint64)
    return out


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and code points of the words of each length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == length)
        flat = "".join(words[i] for i in own).encode("utf-32-le")
        yield own, np.frombuffer(flat, "<u4").reshape(len(own), length)


def neighbourhood(points: np.ndarray, alphabet: np.ndarray, bloom: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Strings at distance one from words of one length that a filter may hold, each once: row of its word, code points.

    ``points``: (words, length). All deletions, replacements and insertions are hashed; strings may use the letters of
    ``alphabet`` and what the words hold themselves.
    """
    n, length = points.shape
    sums, values = hashed(points)
    whole, up, letters = sums[:, -1:], powers(length + 1), mixed(alphabet.astype(np.uint64) + np.uint64(1))
    if length:
        rows, at = np.divmod(held_by(bloom, sums[:, :-1] + (whole - sums[:, 1:]) * _BACK), length)
        first = (at == 0) | (points[rows, at] != points[rows, at - 1])
        rows, at = rows[first], at[first]
        rest = np.arange(length - 1)
        yield rows, points[rows[:, None], rest + (rest >= at[:, None])]
        found = held_by(bloom, whole[:, :, None] + (letters - values[:, :, None]) * up[:-1, None])
        rows, at, letter = np.unravel_index(found, (n, length, len(letters)))
        other = points[rows, at] != alphabet[letter]
        rows, at, letter = rows[other], at[other], letter[other]
        made = points[rows]
        made[np.arange(len(rows)), at] = alphabet[letter]
        yield rows, made
    found = held_by(bloom, (sums + (whole - sums) * _BASE)[:, :, None] + letters * up[:, None])
    rows, at, letter = np.unravel_index(found, (n, length + 1, len(letters)))
    other = at == 0
    other[~other] = points[rows[~other], at[~other] - 1] != alphabet[letter[~other]]
    rows, at, letter = rows[other], at[other], letter[other]
    rest = np.arange(length + 1)
    made = np.concatenate([points, np.zeros((n, 1), points.dtype)], 1)[rows[:, None], rest - (rest > at[:, None])]
    made[np.arange(len(rows)), at] = alphabet[letter]
    yield rows, made


def candidates(words: DataFrame, alphabet: np.ndarray, bloom: np.ndarray) -> DataFrame:
    """word, n, near: of the full neighbourhood of every word what the filter may hold."""
    sent = words.sparkSession.sparkContext.broadcast((alphabet, bloom))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, held = sent.value
        for batch in batches:
            for own, points in by_length(batch.column(0).to_pylist()):
                step = max(1, BLOCK // ((points.shape[1] + 1) * (len(letters) + 1)))
                for at in range(0, len(own), step):
                    for which, made in neighbourhood(points[at : at + step], letters, held):
                        if len(which):
                            place = pa.array(own[at + which])
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(place), batch.column(1).take(place), _strings(made)], names=["word", "n", "near"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, near string")


def near_words(words: DataFrame, limit: int = BROADCAST_WORDS) -> DataFrame:
    """word, n, near, near_n: all pairs of words of a vocabulary (word, n) at distance one, in both orders."""
    rows = words.count()
    tasks = max(words.sparkSession.sparkContext.defaultParallelism, partitions(words.sparkSession) if rows > limit else 1)
    dealt = words.repartition(tasks, "word").sortWithinPartitions(F.length("word"))
    made = candidates(dealt, alphabet_of(words), vocabulary_filter(words, rows))
    right = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return made.join(F.broadcast(right) if rows <= limit else right.hint("shuffle_hash"), "near").select("word", "n", "near", "near_n")


def best_forms(pairs: DataFrame, margin: int = MARGIN) -> DataFrame:
    """word, n_near, form, form_n of words with neighbours: the one of largest count (ties: first in code-point order)
    if that is at least ``margin`` times the word's own."""
    found = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("n"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    fits = -F.col("best.less") >= margin * F.col("n")
    return found.select("word", "n_near", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of all words of ``forms`` (word, form or null): the end of its chain of forms.

    Each round lets a word skip to what its root's root is, so chains of any length take logarithmically many; no
    chain is a ring, as counts grow along it. Rounds are written, and the last is the one that changes nothing.
    """
    now = staged(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        moving = now.where("root != word")
        ends = now.where("root != word").select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = staged(moving.join(ends, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        before, now = now, staged(now.where("root = word").unionByName(stepped.select("word", "root")), "roots")
        drop_staged(before)
        if not stepped.where("moved").limit(1).count():
            return now


def group_variants(words: DataFrame, margin: int = MARGIN) -> DataFrame:
    """word, form, root, n, n_near, form_n for a vocabulary (word, n) of distinct words."""
    words = staged(words.select("word", "n"), "vocabulary")
    forms = staged(words.join(best_forms(near_words(words), margin), "word", "left"), "forms")
    return forms.join(roots(forms), "word").select("word", "form", "root", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def spelling_query(docs: DataFrame) -> DataFrame:
    """The groups of the words of ``docs`` that occur often enough."""
    return group_variants(word_counts(docs).where(F.col("n") >= RAREST))


def oracle() -> str:
    """DuckDB SQL of the same for the ``documents`` table. Neighbours: words that are equal without one letter each at
    the same place, or of which one is the other without a letter."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(str(i))
    step = "xor(acc >> 8, t[CAST(xor(acc, b) & 255 AS BIGINT) + 1])"
    return rf"""WITH RECURSIVE tab AS (SELECT [{", ".join(table)}]::BIGINT[] AS t),
r0 AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents WHERE text IS NOT NULL),
r1 AS MATERIALIZED (SELECT doc_id, run, count(*) AS c FROM r0 WHERE length(run) >= {SHORTEST} GROUP BY ALL),
r2 AS (SELECT doc_id, run, c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM r1),
r3 AS (SELECT run, c, list_transform(range(0, CAST(length(x) / 2 AS BIGINT)), lambda k: CAST(instr('0123456789ABCDEF', substr(x, 2 * k + 1, 1)) * 16 + instr('0123456789ABCDEF', substr(x, 2 * k + 2, 1)) - 17 AS BIGINT)) AS bytes FROM r2),
r4 AS (SELECT run, c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda acc, b: {step}), 4294967295) AS h FROM r3, tab),
r5 AS (SELECT CASE WHEN h % {DAMAGE} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM r4),
v AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM r5 WHERE length(word) >= {SHORTEST} GROUP BY 1 HAVING sum(c) >= {RAREST}),
cut AS MATERIALIZED (SELECT DISTINCT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM v, range(1, 500) k(i) WHERE i <= length(word)),
near AS MATERIALIZED (SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT cut.word, v.word FROM cut JOIN v ON v.word = cut.rest UNION SELECT v.word, cut.word FROM cut JOIN v ON v.word = cut.rest),
ranked AS (SELECT near.word, near.near, b.n AS near_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY b.n DESC, near.near) AS r FROM near JOIN v b ON b.word = near.near),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {MARGIN} * v.n THEN near END AS form, CASE WHEN near_n >= {MARGIN} * v.n THEN near_n END AS form_n FROM v LEFT JOIN ranked ON ranked.word = v.word AND r = 1),
chain AS (SELECT word, word AS root FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN chain c ON c.word = f.word JOIN f e ON e.word = c.root AND e.form IS NULL"""
