"""Vector codes, spelling variants and media columns against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import compare, connect
from peakloom.llm import ogg, queries, spelling, vector_codes

FOLDERS = ("/root/testdata/sf0.001", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_spelling_variants"])
@pytest.mark.parametrize("folder", FOLDERS)
def test_queries_equal_their_sql(spark, name, folder):
    assert compare(spark, connect(folder), queries.queries()[name], queries.oracle_sql()[name], folder) == ""


# vector codes ------------------------------------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<double>, label int, x array<double>, code string, part int"


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """The same in Python's own numbers."""
    kept = sorted((r[0], [math.floor(4096 * v) for v in r[1]], r[2]) for r in rows if r[1] and all(v is not None and math.isfinite(v) for v in r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[cut[i][p] for i in range(min(entries, len(kept)))] for p in range(parts)]

    def assign(p, v):
        d = [sum((a - b) ** 2 for a, b in zip(v, e, strict=True)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for row in cut:
                groups.setdefault(assign(p, row[p])[0], []).append(row[p])
            books[p] = [[sum(c) // len(groups[i]) for c in zip(*groups[i], strict=True)] if i in groups else e for i, e in enumerate(books[p])]
    found = [[assign(p, row[p]) for p in range(parts)] for row in cut]
    errors = [sum(d for _, d in f) for f in found]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((i, "".join(f"{c:02x}" for c, _ in f), e, by_label[label], digest) for (i, _, label), f, e in zip(kept, found, errors, strict=True))


def vectors(spark, rows):
    return spark.createDataFrame([(*r, [1.0], "ff", 9) for r in rows], VECTORS)


def test_codes_equal_the_plain_version(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).tolist(), [None, 1, 2][i % 3]) for i in range(60)]
    rows += [(100 + i, rows[0][1], 2) for i in range(40)]  # a hot vector
    rows += [(200, None, 1), (201, [], 1), (202, [1.0] * 15 + [None], 1), (203, [float("nan")] * 16, 1), (204, [float("inf")] * 16, 1), (205, [0.0] * 16, None)]
    got = sorted(tuple(r) for r in vector_codes.compress(vectors(spark, rows)).collect())
    assert got == plain_codes(rows)


def test_codes_of_few_ties_null_ids_and_odd_lengths(spark):
    few = [(2, [0.5] * 8, 1), (1, [0.5] * 8, 1), (3, [-0.5] * 8, 1)]
    got = sorted(tuple(r)[:4] for r in vector_codes.compress(vectors(spark, few)).collect())
    assert got == [r[:4] for r in plain_codes(few)] == [(1, "00" * 8, 0, 0), (2, "00" * 8, 0, 0), (3, "02" * 8, 0, 0)]
    odd = [(1, [1.0] * 10, 1), (None, [1.0] * 10, None), (5, [1.0] * 9, 1), (6, [1e30] * 10, 1), (6, [1e30] * 10, 1)]
    got = sorted((r["vec_id"] or -1, r["code"], r["error"]) for r in vector_codes.compress(vectors(spark, odd)).collect())
    assert [g[0] for g in got] == [-1, 1, 6, 6] and all(g[2] == 0 for g in got)
    assert vector_codes.compress(vectors(spark, [])).collect() == []
    assert vector_codes.compress(vectors(spark, [(1, None, 1)])).collect() == []


def test_sums_of_many_labels_are_salted(spark):
    rows = spark.createDataFrame([(i, i % 7 if i % 3 else None, f"{i:02x}", i) for i in range(300)], "vec_id long, label int, code string, error long")
    many = {r["vec_id"]: r["label_error"] for r in vector_codes.with_label_error(rows, 3).collect()}
    assert many == {r["vec_id"]: r["label_error"] for r in vector_codes.with_label_error(rows).collect()} and len(many) == 300


def test_decoded_vectors_are_near(spark):
    config = vector_codes.CodeConfig()
    rows = vector_codes.of_one_length(vector_codes.whole_numbers(spark.read.parquet(f"{FOLDERS[0]}/embeddings.parquet"), config)).cache()
    books = vector_codes.learn(rows, config)
    found = vector_codes.encode(rows, books)
    back = {r["vec_id"]: np.array(r["vector"]) for r in vector_codes.decode(found, books).collect()}
    for r in rows.join(found.select("vec_id", "error"), "vec_id").collect():
        distance = ((np.array(r["x"]) + 0.5) / 4096 - back[r["vec_id"]]) @ ((np.array(r["x"]) + 0.5) / 4096 - back[r["vec_id"]])
        assert abs(distance - r["error"] / 4096**2) < 1e-9


# spelling ----------------------------------------------------------------------------------------------------------
def plain_groups(docs):
    """Counting and all pairs of words by their edits."""
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, close = {}, {}
    for w in words:
        close[w] = [v for v in words if near(w, v)]
        best = min(close[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(close[w]), None if form[w] is None else words[form[w]]))
    return sorted(out)


def spelled(spark, docs):
    schema = "doc_id long, text string, word string, n long, near string, root string"
    return spelling.spelling_query(spark.createDataFrame([(k, t, "w", 1, "x", "r") for k, t in docs], schema))


def test_groups_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = ["letter", "Ärger", "straße", "noon×naïve", "banana", "aaaaa", "committee"]
    docs = [(None, None), (1, ""), (2, "a b c"), (None, "letter " * 9)]
    for i in range(300):
        words = []
        for _ in range(20):
            w = list(base[rng.integers(len(base))])
            for _ in range(rng.integers(3)):
                at = rng.integers(len(w))
                w[at : at + rng.integers(2)] = ["", "a", "é", "t"][rng.integers(4)]
            words.append("".join(w))
        docs.append((i % 250, " ".join(words)))  # repeated ids
    docs.append((7, "letters, " * 40_000))
    docs.append((8, "é, Banana straße× " * 90_000 + "ß" * 2000))  # cut in pieces
    got = sorted((tuple(r) for r in spelled(spark, docs).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])
    want = plain_groups(docs)
    assert got == want and any(r[2] not in (r[0], r[1]) for r in want)


def test_a_filter_holds_all_hashes_and_few_others(spark):
    words = spark.createDataFrame([(f"word{i}é",) for i in range(3000)], "word string")
    bloom = spelling.vocabulary_filter(words, 3000)
    hashes = np.concatenate([spelling.hashed(p)[0][:, -1] for _, p in spelling.by_length([r[0] for r in words.collect()])])
    assert len(spelling.held_by(bloom, hashes)) == 3000
    assert len(spelling.held_by(bloom, spelling.mixed(np.arange(100_000, dtype=np.uint64)))) < 200


def test_a_run_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 40)
    monkeypatch.setattr(spelling, "LONG", 90)
    docs = [(i, f"{'Abcde' * 9} letter  letter é {'xyz' * 60} ende") for i in range(4)]
    got = sorted((tuple(r) for r in spelled(spark, docs).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])
    held = spelling.Counter()
    for key, text in docs:
        for piece in spelling.pieces(text.encode()):
            spelling.counted(held, [piece], np.array([zlib.crc32(f"{key}:".encode())], np.uint32), 5)
    assert got == plain_groups(docs) and {w: n for w, n in held.items() if n >= 3} == {r[0]: r[3] for r in got}


def test_nothing_to_group(spark):
    assert spelled(spark, []).collect() == [] and spelled(spark, [(1, None), (2, "one two")]).collect() == []


def test_neighbourhood_is_full_and_without_repeats():
    alphabet = np.array([ord(c) for c in "abe"], np.uint32)
    for word in ("aab", "abba", "bbbb", "e"):
        points = np.array([[ord(c) for c in word]] * 2, np.uint32)
        everything = np.full(64, 2**64 - 1, np.uint64)
        made = [("".join(map(chr, r)), w) for rows, strings in spelling.neighbourhood(points, alphabet, everything) for w, r in zip(rows, strings, strict=True)]
        want = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in "abe"} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in "abe"}
        for which in (0, 1):
            own = [s for s, w in made if w == which]
            assert len(own) == len(set(own)) and set(own) == want - {word}


def test_pairs_are_the_same_with_and_without_broadcast(spark):
    words = spark.createDataFrame([(w, i + 1) for i, w in enumerate(["", "a", "ab", "abc", "日本語", "日本", "b"])], "word string, n long")
    few, many = (sorted(tuple(r) for r in spelling.near_words(words, n).collect()) for n in (100, 2))
    assert few == many and ("日本", 6, "日本語", 5) in few and ("", 1, "a", 2) in few


def test_long_chains_reach_their_root(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}" if i < 60 else None) for i in range(61)], "word string, form string")
    assert {r["root"] for r in spelling.roots(forms).collect()} == {"w60"}


# media -------------------------------------------------------------------------------------------------------------
def plain_checksum(data):
    value = 0
    for byte in data:
        value ^= byte << 24
        for _ in range(8):
            value = (value << 1 ^ 0x04C11DB7 if value >> 31 else value << 1) & 0xFFFFFFFF
    return value


def plain_pages(data):
    """Header fields, lacing and body of every page, read by position."""
    at, out = 0, []
    while at < len(data):
        assert data[at : at + 5] == b"OggS\0"
        n = data[at + 26]
        lacing = list(data[at + 27 : at + 27 + n])
        end = at + 27 + n + sum(lacing)
        blank = data[at : at + 22] + bytes(4) + data[at + 26 : end]
        number = lambda a, b: int.from_bytes(data[at + a : at + b], "little", signed=a == 6)  # noqa: E731,B023
        out.append({"flags": data[at + 5], "granule": number(6, 14), "serial": number(14, 18), "number": number(18, 22), "sum": number(22, 26), "blank": blank, "lacing": lacing, "body": data[at + 27 + n : end]})
        at = end
    return out


def plain_tracks(data):
    tracks = {}
    for p in plain_pages(data):
        tracks.setdefault(p["serial"], [[], b""])
        done, rest = tracks[p["serial"]]
        at = 0
        for value in p["lacing"]:
            rest += p["body"][at : at + value]
            at += value
            if value < 255:
                done.append(rest)
                rest = b""
        tracks[p["serial"]][1] = rest
    return {s: done for s, (done, _) in tracks.items()}


@pytest.mark.parametrize("size", [64, 128, 2 * 255, 2 * 510, 4096, 32768, 32768 + 64, 300_032])
def test_containers_hold_what_the_format_says(size):
    payload = np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8).tobytes()
    data = ogg.container(payload)
    found = plain_pages(data)
    for p in found if size < 40_000 else found[::3]:
        assert p["sum"] == plain_checksum(p["blank"])
    assert [p["serial"] for p in found[:4]] == [1, 2, 1, 2] and [p["flags"] for p in found[:4]] == [2, 2, 0, 0]
    for serial in (1, 2):
        own = [p for p in found if p["serial"] == serial]
        assert [p["number"] for p in own] == list(range(len(own))) and own[-1]["flags"] & 4 and own[-1]["granule"] == size // 2
        ends = [p["granule"] for p in own if p["granule"] >= 0]
        assert ends == sorted(ends)
        assert all(bool(b["flags"] & 1) == (a["lacing"][-1] == 255) for a, b in zip(own, own[1:], strict=False))
    tracks = {s: b"".join(packets[2:]) for s, packets in plain_tracks(data).items()}
    assert bytes(x for pair in zip(tracks[1], tracks[2], strict=True) for x in pair) == payload
    streams, bad = ogg.demultiplexed(data)
    assert bad == 0 and ogg.merged(streams) == payload and not any(s.torn for s in streams.values())


def test_damage_is_seen_and_kept_apart():
    payload = bytes(range(256)) * 1200
    data = ogg.container(payload)
    cuts = [m.start() for m in re.finditer(b"OggS", data)]
    hurt = bytearray(data)
    hurt[cuts[5] + 400] ^= 1
    streams, bad = ogg.demultiplexed(bytes(hurt))
    assert bad == 1 and sorted(s.torn > 0 for s in streams.values()) == [False, True]
    lost = data[: cuts[5]] + data[cuts[6] :]
    streams, bad = ogg.demultiplexed(lost)
    assert bad == 0 and sorted(s.torn > 0 for s in streams.values()) == [False, True]
    with pytest.raises(ValueError, match="missing"):
        ogg.merged(streams)
    for junk in (None, b"", b"OggS", b"no media here", data[:30]):
        assert not ogg.demultiplexed(junk)[0] and ogg.demultiplexed(junk)[1] <= 1
    streams, bad = ogg.demultiplexed(b"junk" + data + b"OggSjunk")
    assert bad == 1 and ogg.merged(streams) == payload


def test_media_of_texts(spark, edge, edge_texts):
    rows = {r["doc_id"]: r for r in ogg.media_query(edge).collect()}
    for i, text in enumerate(edge_texts):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        data = ogg.container(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(data), hashlib.sha256(data).hexdigest())
        assert f"sum={sum(payload)} low=0 " in r["feature"] + " " or min(payload) > 0
        assert f"packets={sum(map(len, plain_tracks(data).values()))} end_us={len(payload) // 2 * 125} " in r["feature"]
    assert rows[3]["feature"] == rows[4]["feature"]
    assert ogg.media_query(edge.limit(0)).count() == 0


def test_packets_have_times(spark):
    payload = bytes(100_000)
    media = spark.createDataFrame([("a", ogg.container(payload)), ("b", None), ("c", b"x")], "name string, blob binary").withColumn("serial", F.lit("clash"))
    rows = [tuple(r) for r in ogg.packets(media, "name", "blob").orderBy("serial", "packet").select("id", "serial", "packet", "start_us", "end_us").collect()]
    times = [(0, 2_048_000), (2_048_000, 4_096_000), (4_096_000, 6_144_000), (6_144_000, 6_250_000)]
    assert rows == [("a", s, i, *([None, None] if i < 2 else times[i - 2])) for s in (1, 2) for i in range(6)]


def test_media_of_a_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDERS[0]}/documents.parquet")
    want = {r["doc_id"]: hashlib.sha256(ogg.padded((r["text"] or "").encode())).hexdigest() for r in docs.collect()}
    assert {r["doc_id"]: r["payload_sha256"] for r in queries.op13_ogg_media(spark, FOLDERS[0]).collect()} == want
