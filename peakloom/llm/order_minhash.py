"""Operator 3: near-duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its shingles of five words (lower-cased runs of letters and digits; shorter texts: one
shingle). Each of ``HASHES`` hash functions picks the ``TAKE`` shingles, labelled by occurrence, with the least values;
their hashes in text order make one key, so a key is shared only where the same shingles stand in the same order. Two
texts are similar if m / (n1 + n2 - m) >= 0.8, with m the longest common subsequence of their shingle sequences,
found by an alignment within the band that this allows. At 0.8 a key is shared with probability of about 0.51, none
of 20 with less than 1e-6.

Texts of equal words are one node. First every text of a bucket is verified against one leader, the text that shares
most buckets with others, as an original does with its copies. Then every pair of texts that share a bucket and are
still in different components is settled, with no bound on partners: the mixed buckets are cut into blocks of texts of
like length, and each pair of blocks whose lengths allow a link is a group that counts the shingles common to its texts
and aligns those pairs that have enough. A pair that shares several keys is settled in the bucket of the least of them.
So a pair that shares a key is either in one component or found not to be similar.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, slices, staged, tasks_for
from .components import components
from .units import _VALUES, LOWER, _powers

WORDS, HASHES, TAKE, SIMILARITY = 5, 20, 3, 0.8
#: Shingles in a block of a mixed bucket; a pair of blocks is held in memory at once.
BLOCK = 1 << 18
#: Texts of a group from which on their keys are made again to settle a pair in one bucket only; fewer cost less than that.
MANY = 64
_RNG = np.random.default_rng(33)
_ODD = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the number of words of each; null texts have none."""
    texts = pc.fill_null(texts, "")
    rows = len(texts)
    if not rows:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), texts), "\n")[0].as_buffer(), np.uint8)
    row_ends = np.cumsum(sizes + 1) - 1
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(rows, np.int64)
    word, low = _WORD[data], LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    low[lead] = np.where((data[lead] < 0x9F) & (data[lead] != 0x97), data[lead] + 32, data[lead])
    starts = np.flatnonzero(word & np.concatenate([[True], ~word[:-1]]))
    ends = np.flatnonzero(word & np.concatenate([~word[1:], [True]])) + 1
    up, down = _powers(len(data) + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[low] * up[: len(data)])])
    return _mix((prefix[ends] - prefix[starts]) * down[starts]), np.diff(np.searchsorted(starts, row_ends), prepend=0)


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of one text, in order."""
    if not len(words):
        return words
    k = min(WORDS, len(words))
    n = len(words) - k + 1
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total += words[i : i + n] * _PLACE[i]
    return _mix(total + np.uint64(k))


def labelled(s: np.ndarray) -> np.ndarray:
    """Hashes of shingles with the number of equal ones before them."""
    by = np.argsort(s, kind="stable")
    ordered = s[by]
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    occurrence = np.arange(len(s)) - np.maximum.accumulate(np.where(head, np.arange(len(s)), 0))
    out = np.empty_like(s)
    out[by] = _mix(ordered + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def keys_of(s: np.ndarray) -> np.ndarray:
    """The HASHES keys of one text's shingles."""
    take = min(TAKE, len(s))
    values = labelled(s)[None] * _ODD[:, None]
    least = np.argpartition(values, take - 1, axis=1)[:, :take] if take < len(s) else np.tile(np.arange(len(s)), (HASHES, 1))
    picked = s[np.sort(least, axis=1)]
    return _mix((picked * _PLACE[:take]).sum(1, dtype=np.uint64) + _ODD)


def digests(texts: pa.Array) -> tuple[list[bytes | None], list[np.ndarray]]:
    """A digest of each text's words and its shingles. Texts without words: of the text itself; empty ones: null."""
    words, counts = words_of(texts)
    out: list[bytes | None] = []
    found = []
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        own = words[at : at + n]
        at += n
        found.append(shingles(own))
        if n:
            out.append(hashlib.md5(own.tobytes()).digest())
        else:
            raw = text.as_py()
            out.append(hashlib.md5(b"raw" + raw.encode()).digest() if raw else None)
    return out, found


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n (shingles), keys, mark (md5 of the text itself) of every whole text; no keys for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                names, found = digests(part.column("text"))
                sizes = [HASHES if len(s) else 0 for s in found]
                flat = np.concatenate([keys_of(s) for s in found if len(s)]) if any(sizes) else np.empty(0, np.uint64)
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.binary()), pa.array([len(s) for s in found], pa.int64()), keys, part.column("mark")], names=["doc_id", "digest", "n", "keys", "mark"])

    two = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), mark_of().alias("mark"))
    return two.mapInArrow(run, "doc_id long, digest binary, n long, keys array<long>, mark binary")


def mark_of():
    return F.unhex(F.md5(F.col("text").cast("string")))


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """True if the alignment of two shingle sequences reaches ``similarity``.

    As many shingles may go unmatched as that leaves, so matches lie within that band of diagonals. Rows of the
    alignment are bit vectors over the band's columns, no wider than twice the band; the matched head and tail are cut
    off first.
    """
    n1, n2 = len(a), len(b)
    if not n1 or not n2:
        return False
    need = int(np.ceil((n1 + n2) * similarity / (1 + similarity) - 1e-9))
    if min(n1, n2) < need or len(np.intersect1d(labelled(a), labelled(b), assume_unique=True)) < need:
        return False
    most = min(n1, n2)
    differ = np.flatnonzero(a[:most] != b[:most])
    head = int(differ[0]) if len(differ) else most
    a, b = a[head:], b[head:]
    most = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:most] != b[::-1][:most])
    tail = int(differ[0]) if len(differ) else most
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if head + tail >= need or not len(a) or not len(b):
        return head + tail >= need
    band = n1 + n2 - 2 * need
    places: dict[int, list[int]] = {}
    for j, c in enumerate(b.tolist()):
        places.setdefault(c, []).append(j)
    # Columns in the window [low, high) of a row; those that fall out of it keep their count.
    row = low = high = found = 0
    for i, c in enumerate(a.tolist()):
        if i > band:
            found += 1 - (row & 1)
            row >>= 1
            low += 1
        end = min(len(b), i + band + 1)
        row |= ((1 << (end - high)) - 1) << (high - low) if end > high else 0
        high = max(high, end)
        own = places.get(c)
        if own:
            hit = 0
            for j in own[bisect_left(own, low) : bisect_left(own, high)]:
                hit |= 1 << (j - low)
            if hit:
                x = row & hit
                row = ((row + x) | (row & ~hit)) & ((1 << (high - low)) - 1)
        if i > band and low >= high:
            break
    return head + tail + found + (high - low) - row.bit_count() >= need


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows a, b (digests) of ``pairs`` whose texts are similar; ``texts``: digest, text."""
    first = texts.select(F.col("digest").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("digest").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in batches:
            for part in slices(batch, "text_a"):
                names, found = digests(part.column("text_a"))
                keep = []
                for i, (name, b) in enumerate(zip(names, part.column("b").to_pylist(), strict=True)):
                    if b != last[0]:  # rows come sorted by b from the join, so a leader's text is cut once
                        own, s = digests(part.column("text_b").slice(i, 1))
                        last = (own[0], s[0])
                    keep.append(name == part.column("a")[i].as_py() and b == last[0] and aligned(found[i], last[1], similarity))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # Texts are sorted by their digest at every size: a plan that broadcasts small pairs would not show how it grows.
    joined = pairs.join(first.hint("merge"), "a").join(second.hint("merge"), "b").select("a", "text_a", "b", "text_b")
    return joined.mapInArrow(run, "a binary, b binary")


def linked(sequences: list[np.ndarray], roots: np.ndarray, sides: np.ndarray, similarity: float = SIMILARITY, bucket: int | None = None) -> list[tuple[int, int]]:
    """Links (places of two texts) that join the components ``roots`` as all similar pairs of different components do.

    With two ``sides`` only pairs across them count. Lengths and the number of common labelled shingles rule out pairs
    that no alignment could link; a pair already joined by links found here needs none. Of ``MANY`` texts or more of a
    ``bucket``, pairs that share a lesser key as well are left to the bucket of that key.
    """
    lengths = np.array([len(s) for s in sequences])
    by = np.argsort(lengths, kind="stable")
    lengths, root, side = lengths[by], roots[by].copy(), sides[by]
    values, flat = np.unique(np.concatenate([labelled(sequences[i]) for i in by]), return_inverse=True)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    has = np.zeros(len(values), np.int32)
    two = side.min() != side.max()
    keys = np.stack([keys_of(sequences[i]) for i in by]).view(np.int64) if bucket is not None and len(by) >= MANY else None
    out = []
    for t in range(len(by) - 1):
        last = int(np.searchsorted(lengths, lengths[t] / similarity + 1e-6, "right"))
        open_ = root[t + 1 : last] != root[t]
        if two:
            open_ &= side[t + 1 : last] != side[t]
        if keys is not None and open_.any():
            others = keys[t + 1 : last]
            open_ &= ~((others == keys[t]) & (others < bucket)).any(1)
        near = np.flatnonzero(open_) + t + 1
        if not len(near):
            continue
        theirs = np.concatenate([flat[starts[u] : ends[u]] for u in near.tolist()]) if 4 * len(near) < last - t - 1 else None
        if theirs is None:
            near, theirs = np.arange(t + 1, last), flat[ends[t] : ends[last - 1]]
        has[flat[starts[t] : ends[t]]] = 1
        common = np.add.reduceat(has[theirs], np.cumsum(lengths[near]) - lengths[near])
        has[flat[starts[t] : ends[t]]] = 0
        need = np.ceil((lengths[t] + lengths[near]) * similarity / (1 + similarity) - 1e-9)
        for u in near[open_[near - t - 1] & (common >= need)].tolist():
            if root[u] != root[t] and aligned(sequences[by[t]], sequences[by[u]], similarity):
                out.append((int(by[t]), int(by[u])))
                root[root == root[u]] = root[t]
    return out


def blocks_of(own: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """bucket, digest, root, side, others of the members of mixed buckets in ``own`` (bucket, digest, n, root).

    A bucket of more than BLOCK shingles is cut by classes of length, so wide that similar texts lie in one class or in
    neighbouring ones, and each class into blocks of about BLOCK shingles. ``side``: a text's block; ``others``: those of
    its own and the neighbouring classes.
    """
    mixed = own.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.sum("n").alias("all")).where("r0 != r1")
    mixed = staged(mixed.select("bucket", (F.col("all") > BLOCK).alias("wide")), "mixed")
    step = max(float(np.log(1 / similarity)), 0.01) * (1 + 1e-6)  # over the rounding of lengths at the very limit
    classed = own.withColumn("class", F.floor(F.log("n") / step))
    parts = classed.join(mixed.where("wide").select("bucket"), "bucket").groupBy("bucket", "class").agg(F.ceil(F.sum("n") / BLOCK).alias("parts"))
    parts = parts.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("class", "parts"))).alias("parts"))  # at most 100 classes
    placed = classed.join(mixed.select("bucket"), "bucket").join(parts, "bucket", "left")

    def block(at: Column, place: Column) -> Column:
        return F.shiftleft(at, 32) + place

    def blocks(at: Column) -> Column:
        n = F.coalesce(F.element_at("parts", at), F.lit(0).cast("long"))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: block(at, i))).otherwise(F.array().cast("array<long>"))

    near = F.concat(*[blocks(F.col("class") + i) for i in (-1, 0, 1)])
    whole = F.col("parts").isNull()
    side = F.when(whole, F.lit(0).cast("long")).otherwise(block(F.col("class"), F.pmod(F.xxhash64("digest"), F.element_at("parts", F.col("class")))))
    others = F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(near)
    placed = staged(placed.select("bucket", "digest", "root", side.alias("side"), others.alias("others")), "placed")
    drop_staged(mixed)
    return placed


def across(placed: DataFrame, bodies: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links a, b of roots for the similar pairs that share a bucket in ``placed`` (see ``blocks_of``) and differ in root."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                names, found = digests(part.column("text"))
                keep = [i for i, (name, d) in enumerate(zip(names, part.column("digest").to_pylist(), strict=True)) if name == d and len(found[i])]
                sizes = np.cumsum([0] + [len(found[i]) for i in keep])
                flat = np.concatenate([found[i] for i in keep]) if keep else np.empty(0, np.uint64)
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("digest").take(pa.array(keep, pa.int64())), lists], names=["digest", "s"])

    def settle(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        roots, sides = group.column("root").to_pylist(), group.column("side").to_numpy()
        number = {r: i for i, r in enumerate(dict.fromkeys(roots))}
        links = []
        if len(number) > 1:
            lists = group.column("s").combine_chunks()
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            sequences = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            links = linked(sequences, np.array([number[r] for r in roots]), sides, similarity, group.column("bucket")[0].as_py())
        return pa.table([pa.array([roots[x] for x, _ in links], pa.binary()), pa.array([roots[y] for _, y in links], pa.binary())], names=["a", "b"])

    wanted = placed.select("digest").distinct()
    known = bodies.join(wanted.hint("merge"), "digest").select("digest", "text").mapInArrow(cut, "digest binary, s array<long>")
    each = placed.join(known.hint("merge"), "digest").withColumn("other", F.explode("others"))
    each = each.select("bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "root", "s")
    return each.groupBy("bucket", "i", "j").applyInArrow(settle, "a binary, b binary")


def sieve(ids: DataFrame, column: str, rows: int) -> np.ndarray:
    """A Bloom filter of a column of longs: about ten bits for each row, but never more than 2 ** 26 bits.

    Its bits are set and joined in the tasks; at most 2 ** 20 words of 64 bits come to the driver.
    """
    bits = min(26, max(12, int(10 * rows).bit_length()))
    place = F.explode(F.array(*[F.pmod(F.xxhash64(column, F.lit(i)), F.lit(1 << bits)) for i in range(3)]))
    words = ids.select(place.alias("p")).groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.element_at(F.lit([1 << i for i in range(32)]), F.pmod("p", F.lit(32)).cast("int") + 1)).alias("v"))
    got = words.toArrow()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[got.column("w").to_numpy()] = got.column("v").to_numpy()
    return out


def sifted(docs: DataFrame, column: str, bloom: np.ndarray) -> DataFrame:
    """Rows that may be among the filter's ids, before they are shuffled; the hashes are Spark's own.

    A row that a task has met before, by ``column`` and mark, is left out, as far as it remembers them.
    """
    bits = (len(bloom) * 32).bit_length() - 1
    places = [F.pmod(F.xxhash64(column, F.lit(i)), F.lit(1 << bits)).alias(f"_{i}") for i in range(3)]
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, bytes]] = set()
        for b in batches:
            ok = np.ones(b.num_rows, bool)
            for i in range(3):
                p = b.column(f"_{i}").to_numpy()
                ok &= (bloom[p >> 5] >> (p & 31).astype(np.uint32)) & 1 > 0
            part = b.select(names).filter(pa.array(ok))
            keep = []
            for i, key in enumerate(zip(part.column(column).to_pylist(), part.column("mark").to_pylist(), strict=True)):
                if key not in seen:
                    keep.append(i)
                    if len(seen) < 1 << 19:
                        seen.add(key)
            yield part.take(pa.array(keep, pa.int64()))

    return docs.select("*", *places).mapInArrow(run, docs.schema)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), kept (it is that document) for every row of ``docs``.

    Empty and null texts are classes of their own. Rows without doc_id are linked by their text as all others; a class
    that has no doc_id at all has a null class_id, and one of its rows is kept. Rows of equal doc_id and text fall
    together; a doc_id with several texts has a row, and maybe a class, for each. Words, shingles
    and keys are told apart by 64-bit hashes: two of m that differ are taken for equal with odds of about m * m / 2 ** 65,
    and a clash of single shingles moves a similarity by one shingle only. Texts are equal by 128-bit digests.
    """
    sketches, known = _classes(docs, similarity)
    row = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("row")
    out = sketches.select("doc_id", "digest", row).join(known.select("digest", "root", "class_id"), "digest", "left")
    named = out.where("class_id IS NOT NULL OR digest IS NULL").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    unnamed = out.where("class_id IS NULL AND digest IS NOT NULL")
    first = staged(unnamed.groupBy("root").agg(F.min("row").alias("first")), "nameless")
    rest = unnamed.join(first, "root").select("doc_id", "class_id", (F.col("row") == F.col("first")).alias("kept"))
    kept = F.col("class_id").eqNullSafe(F.col("doc_id"))  # null for both: an empty text without id, a class of its own
    return named.select("doc_id", "class_id", kept.alias("kept")).unionByName(rest)


def representatives(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, mark, n (rows that have both) of one row for each class: the least doc_id, null ids last, then the least mark.

    Empty and null texts are left out.
    """
    sketches, known = _classes(docs, similarity)
    rows = sketches.where("digest IS NOT NULL").groupBy("digest", "doc_id", "mark").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "n")
    return rows.join(known.select("digest", "root"), "digest").groupBy("root").agg(F.min(order).alias("x")).select("x.doc_id", "x.mark", "x.n")


def _whose(doc_id: Column) -> tuple[Column, Column, Column]:
    """first_id, nameless, mark: where a text lies. One that has no row with an id goes by a hash of its mark."""
    return F.coalesce(doc_id, F.xxhash64("mark")).alias("first_id"), doc_id.isNull().alias("nameless"), F.col("mark")


def _classes(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The sketches of ``docs``, and digest, root and class_id of each distinct text."""
    spark = docs.sparkSession
    sketches = staged(sketch(docs), "sketches")
    files = tasks_for(spark, sketches.count(), 200)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("x")
    texts = sketches.where("digest IS NOT NULL").groupBy("digest").agg(least, F.first("keys").alias("keys"), F.first("n").alias("n"))
    texts = staged(texts.select("digest", F.col("x.doc_id").alias("first_id"), F.col("x.mark").alias("mark"), "keys", "n"), "texts", files=files)
    entries = texts.select("digest", "n", F.explode("keys").alias("bucket"))
    buckets = staged(entries.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets", files=files)
    members = staged(entries.join(buckets, "bucket").select("bucket", "digest", "n", "size"), "members", files=files)
    drop_staged(buckets)
    weights = staged(members.groupBy("digest").agg(F.sum("size").alias("weight")), "weights", files=files)
    heavy = members.join(weights, "digest").groupBy("bucket").agg(F.max(F.struct("weight", "digest")).alias("x"))
    leaders = staged(heavy.select("bucket", F.col("x.digest").alias("leader")), "leaders", files=files)
    wanted = staged(weights.join(texts.select("digest", "first_id", "mark"), "digest").select(*_whose(F.col("first_id")), "digest"), "wanted", files=files)
    drop_staged(weights)
    found = docs.withColumn("mark", mark_of()).select(*_whose(F.col("doc_id").cast("long")), F.col("text").cast("string"))
    n = wanted.count()
    found = sifted(found, "first_id", sieve(wanted, "first_id", n))
    by = ["first_id", "nameless", "mark"]
    bodies = found.join(wanted.hint("shuffle_hash"), by).select(*by, "digest", "text")
    if sketches.groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        bodies = bodies.dropDuplicates(by)  # by the join's own partitioning
    bodies = staged(bodies.select("digest", "text"), "bodies", files=tasks_for(spark, n, 4096))
    drop_staged(wanted)

    tried = staged(members.join(leaders, "bucket").where("digest != leader").select(F.col("digest").alias("a"), F.col("leader").alias("b")).distinct(), "pairs", files=files)
    drop_staged(leaders)
    links = staged(verified(tried, bodies, similarity), "links", files=files)
    labels = components(links, files)
    drop_staged(tried)
    drop_staged(links)
    of = labels.select(F.col("node").alias("digest"), "root")
    own = staged(members.join(of, "digest", "left").select("bucket", "digest", "n", F.coalesce("root", "digest").alias("root")), "own", files=files)
    drop_staged(members)
    placed = blocks_of(own, similarity)
    more = staged(across(placed, bodies, similarity).distinct(), "links", files=files)
    for table in (own, placed, bodies):
        drop_staged(table)
    # Only the components' roots are linked anew, so the old links are not walked again.
    up = components(more, files)
    single = up.select("node", F.col("node").alias("root")).join(labels.select("node"), "node", "left_anti")
    above = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
    top = staged(labels.unionByName(single).join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "labels", files=files)
    for table in (more, up, labels):
        drop_staged(table)
    classes = texts.select("digest", "first_id").join(top.select(F.col("node").alias("digest"), "root"), "digest", "left").select("digest", "first_id", F.coalesce("root", "digest").alias("root"))
    classes = staged(classes, "classes", files=files)
    drop_staged(texts)
    drop_staged(top)
    firsts = staged(classes.groupBy("root").agg(F.min("first_id").alias("class_id")), "least", files=files)
    known = staged(classes.join(firsts, "root").select("digest", "root", "class_id"), "classes", files=files)
    drop_staged(classes)
    drop_staged(firsts)
    return sketches, known
