"""Token files, packing, BPE and counts against the libraries, and a sequential packing."""

import bisect
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from peakloom.llm import bpe, packing, queries, token_counts, token_files
from peakloom.llm.tokens import Encoder, tokenizer_path
from peakloom.llm.common import shared_dir


@pytest.fixture(scope="module")
def library(word_bpe):
    return Tokenizer.from_file(word_bpe)


@pytest.fixture(scope="module")
def expected(library, edge_texts):
    return [library.encode(t or "", add_special_tokens=False).ids for t in edge_texts]


def test_encoders_equal_the_library(word_bpe, library, edge_texts, expected):
    for own in (Encoder(word_bpe), bpe.NumpyBpe(word_bpe)):
        ids, counts = own.encode(pa.array(edge_texts, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == expected


PARTS = st.sampled_from([*"aehinst AEXé É'<|>endoftx-!.12 \n\t", "<|endoftext|>", "\u0301", "ß", "—", "ﬁ", "İ", "日"])
TEXTS = st.lists(st.lists(PARTS, max_size=40).map("".join), min_size=1, max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_units_are_safe_to_encode_alone(texts):
    path = tokenizer_path("word_bpe_49k.json")
    own, numpy_own = _kept(path)
    want = [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for e in (own, numpy_own):
        ids, counts = e.encode(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


_OWN = {}


def _kept(path):
    if path not in _OWN:
        _OWN[path] = Encoder(path), bpe.NumpyBpe(path)
    return _OWN[path]


def test_bpe_digests(spark, edge, word_bpe, library, expected):
    rows = {r["doc_id"]: r for r in bpe.bpe_digests(edge, word_bpe).collect()}
    for i, ids in enumerate(expected):
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in bpe.bpe_decode(bpe.bpe_encode(edge, word_bpe), word_bpe).collect()}
    assert back == {i: library.decode(ids, skip_special_tokens=False) for i, ids in enumerate(expected)}


def test_token_files_round_trip(spark, edge, word_bpe, expected):
    rows = token_files.token_file_query(spark, edge, word_bpe).orderBy("start").collect()
    start = 0
    for r, ids in zip(rows, expected, strict=True):
        ids = [*ids, 1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_of_null_ids_repeats_and_nothing(spark, make_docs, word_bpe):
    docs = make_docs(["b", "a", "a", "c"], [None, 5, 5, None])
    got = token_files.token_file_query(spark, docs, word_bpe).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 5, 5] and [r["start"] for r in got] == [0, 2, 4, 6]
    hot = token_files.token_file_query(spark, make_docs(["b a"] * 300 + ["c"] * 300, [7] * 300 + [None] * 300), word_bpe).orderBy("start").collect()
    assert [r["doc_id"] for r in hot] == [None] * 300 + [7] * 300 and [r["start"] for r in hot] == np.cumsum([0, *(r["n_tokens"] for r in hot)])[:-1].tolist()
    assert token_files.token_file_query(spark, docs.where("false"), word_bpe).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=900), st.integers(7, 14))
def test_huffman_round_trip(values, limit):
    ids = np.array(values, np.uint32)
    counts = np.bincount(ids)
    lengths = token_files.code_lengths(counts, limit)
    assert lengths.max() <= limit and sum(2.0 ** -n for n in lengths if n) <= 1
    table, most = token_files.decode_table(lengths)
    n = np.array([len(ids)])
    docs, sizes, back = token_files.read_block(token_files.block_bytes([7], n, ids, token_files.canonical(lengths), lengths), table, most)
    assert docs == [7] and sizes.tolist() == [len(ids)] and back.tolist() == values


def test_unlimited_huffman_is_optimal():
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45, 0, 1])
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert int((token_files.code_lengths(counts, 18) * counts).sum()) == cost


def sequential(lengths, capacity):
    """Best-fit decreasing, a document at a time: the number of bins and the sorted fills."""
    free, bins = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(free, n)
        left = capacity if i == len(free) else free.pop(i)
        bins += left == capacity and True
        bisect.insort(free, left - n)
    return sorted(free)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 32), min_size=1, max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs = packing.plan(counts, 32)
    used = {}
    for length, rank, n, first, each, offset in runs.tolist():
        for i in range(n):
            used.setdefault(first + i // each, []).append((offset + i % each * length, length))
    assert sum(len(v) for v in used.values()) == len(lengths)
    for items in used.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 32
    assert sorted(32 - sum(n for _, n in v) for v in used.values()) == sequential(lengths, 32)


def test_packing_pieces(spark, edge, word_bpe, expected):
    rows = packing.pack(edge, word_bpe, keep_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, ids in enumerate(expected):
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        joined = b"".join(r["ids"] for r in own)
        assert np.frombuffer(joined, "<u4").tolist() == [*ids, 1]
        assert [r["start"] for r in own] == list(range(0, len(ids) + 1, 4096))
        assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in own)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert packing.pack(edge.where("false"), word_bpe).count() == 0


def test_digests_and_counts_of_null_and_repeated_ids_and_nothing(spark, make_docs, edge, word_bpe, library):
    docs = make_docs(["b", "b", None, "c d"], [None, 5, 5, None])
    rows = bpe.bpe_digests(docs, word_bpe).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in rows) == sorted([("None", 1), ("5", 1), ("5", 0), ("None", len(library.encode("c d", add_special_tokens=False).ids))])
    path = tokenizer_path("piece_bpe_32k.model")
    found = token_counts.count_tokens(docs, path, shared_dir(spark, "cache")).collect()
    assert sorted(str(r["doc_id"]) for r in found) == ["5", "5", "None", "None"] and sum(r["n_bytes"] for r in found) == 5
    nothing = edge.where("false")
    assert bpe.bpe_digests(nothing, word_bpe).count() == 0 and token_counts.count_tokens(nothing, path, shared_dir(spark, "cache")).count() == 0


@pytest.mark.parametrize("name", ["op1_token_files", "op9_bpe", "op10_token_counts", "op2_best_fit_packing"])
def test_queries_on_a_whole_table(spark, library, word_bpe, name):
    """Every document of a table against the libraries, one text at a time."""
    import sentencepiece

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.queries()[name](spark, folder).collect()
    ids = {d: library.encode(t, add_special_tokens=False).ids for d, t in texts.items()}
    crc = lambda part: zlib.crc32(np.array(part, "<u4").tobytes())
    if name == "op1_token_files":
        start = 0
        for r in sorted(rows, key=lambda r: r["doc_id"]):
            own = [*ids[r["doc_id"]], 1]
            assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(own), crc(own))
            start += len(own)
    elif name == "op2_best_fit_packing":
        assert sum(r["length"] for r in rows) == sum(len(x) + 1 for x in ids.values())
        assert all(r["ids_crc32"] == crc([*ids[r["doc_id"]], 1][r["start"] : r["start"] + r["length"]]) for r in rows)
        lengths = [n for x in ids.values() for n in [4096] * ((len(x) + 1) // 4096) + [(len(x) + 1) % 4096] if n]
        assert len({r["sequence_id"] for r in rows}) == len(sequential(lengths, 4096))
    elif name == "op9_bpe":
        for r in rows:
            own = ids[r["doc_id"]]
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(own), hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(library.decode(own, skip_special_tokens=False).encode()).hexdigest())
    else:
        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
        for r in rows:
            n = len(model.encode(texts[r["doc_id"]]))
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 4096)
    assert {r["doc_id"] for r in rows} == texts.keys()


def test_token_counts_use_and_fill_the_cache(spark, make_docs, edge, edge_texts):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    cache = shared_dir(spark, "cache")
    got = {r["doc_id"]: r for r in token_counts.count_tokens(edge, path, cache).collect()}
    for i, t in enumerate(edge_texts):
        n = len(model.encode(t or ""))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 4096)
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for t in edge_texts})
    more = make_docs([*edge_texts, "something new"])
    assert token_counts.count_tokens(more, path, cache).count() == len(edge_texts) + 1
    assert spark.read.parquet(cache).count() == stored + 1
