"""Near-duplicates, search and URL rules against brute force; the pipeline's stages."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oracle import compare, connect
from peakloom.llm import language_id, multi_index, order_minhash, queries, toxicity, url_filters
from peakloom.llm.common import fold
from peakloom.llm.components import components
from peakloom.llm.tokens import tokenizer_path

SF = "/root/testdata/sf0.001"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute_classes(texts, ids):
    """All pairs, plain alignment."""
    _, found = order_minhash.digests(pa.array(texts, pa.string()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = found[i].tolist(), found[j].tolist()
            same = texts[i] == texts[j] and bool(texts[i])
            if same or (a and b and (m := lcs(a, b)) / (len(a) + len(b) - m) >= 0.8):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(texts)):
        least.setdefault(find(i), []).append(ids[i])
    return {ids[i]: min(least[find(i)]) for i in range(len(texts))}


def near_copies():
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    passage = rng.choice(vocabulary, 60).tolist()
    for _ in range(6):
        base = rng.choice(vocabulary, 150).tolist()
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 8):
            copy = base.copy()
            for at in rng.choice(150, edits, replace=False):
                copy[at] = "new"
            texts.append(" ".join(copy).upper() if edits == 2 else ", ".join(copy))
        texts.append(" ".join(base[75:] + base[:75]))  # the same words in another order
        texts.append(" ".join(rng.choice(vocabulary, 40).tolist() + passage))
    return [*texts, texts[0], "", None, "!!!", "!!!", "one two", "One, two!", "one three"]


def test_classes_equal_brute_force(make_docs):
    texts = near_copies()
    ids = [(7 * i) % 101 for i in range(len(texts))]
    rows = order_minhash.near_duplicates(make_docs(texts, ids)).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == brute_classes(texts, ids)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in rows)


@pytest.mark.parametrize("block", [1 << 18, 20000])
def test_no_link_of_a_large_group_is_lost(make_docs, monkeypatch, block):
    """Each text is close to the one it was copied from, but to few others of one class."""
    rng = np.random.default_rng(3)
    copies = [[f"v{i}" for i in range(160)]]
    for c in range(1, 600):
        copy = copies[int(rng.integers(0, c))].copy()
        for at in rng.choice(32, 3, replace=False) * 5:
            copy[at] = f"c{c}e{at}"
        copies.append(copy)
    monkeypatch.setattr(order_minhash, "BLOCK", block)
    rows = order_minhash.near_duplicates(make_docs([" ".join(c) for c in copies])).collect()
    assert len(rows) == 600 and {r["class_id"] for r in rows} == {0}


@pytest.mark.parametrize("many", [2, 64])
def test_lengths_at_the_limit_meet(make_docs, monkeypatch, many):
    """Heads of a few texts, in chains of lengths at 0.8 of the next and just under, in blocks of a few texts each."""
    texts = []
    for b in range(4):
        words = [f"b{b}w{i % 150 if b == 3 else i}" for i in range(260)]
        texts += [" ".join(words[: n + 4]) for n in (1, 2, 4, 5, 8, 10, 16, 20, 25, 32, 40, 51, 64, 80, 101, 127, 160, 200, 250)]
        texts += [" ".join(words[at : at + 104]) for at in range(0, 60, 6)]
    ids = [(11 * i) % 211 for i in range(len(texts))]
    monkeypatch.setattr(order_minhash, "BLOCK", 64)
    monkeypatch.setattr(order_minhash, "MANY", many)
    rows = order_minhash.near_duplicates(make_docs(texts, ids)).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == brute_classes(texts, ids)


def test_blocks_of_like_lengths(spark, monkeypatch):
    """Every pair that could be similar meets in one pair of blocks; lengths that are far apart do not meet."""
    monkeypatch.setattr(order_minhash, "BLOCK", 300)
    rows = [(1, bytes([i]), n, bytes([i])) for i, n in enumerate([1, 4, 5, 8, 10, 64, 80, 81, 100, 100, 100, 125, 156, 500, 625, 626] * 2)]
    rows += [(2, b"x", 5, b"x"), (2, b"y", 500, b"y"), (3, b"p", 5, b"same"), (3, b"q", 5, b"same")]
    own = spark.createDataFrame(rows, "bucket long, digest binary, n long, root binary")
    length = {(r[0], bytes(r[1])): r[2] for r in rows}
    groups = {}
    placed = order_minhash.blocks_of(own).collect()
    assert len(placed) == 34 and {r["bucket"] for r in placed} == {1, 2}  # bucket 3 has one component only
    for r in placed:
        assert r["side"] in r["others"] and len(set(r["others"])) == len(r["others"])
        for other in r["others"]:
            groups.setdefault((r["bucket"], min(r["side"], other), max(r["side"], other)), []).append((bytes(r["digest"]), r["side"]))
    met = {}
    for (bucket, i, j), group in groups.items():
        for x, (a, s) in enumerate(group):
            for b, t in group[:x]:
                if i == j or s != t:
                    met[bucket, min(a, b), max(a, b)] = met.get((bucket, min(a, b), max(a, b)), 0) + 1
    assert set(met.values()) == {1}
    for a in range(32):
        for b in range(a):
            low, high = sorted((length[1, bytes([a])], length[1, bytes([b])]))
            there = (1, bytes([b]), bytes([a])) in met
            assert there or low < 0.8 * high
            assert not there or low > 0.63 * high


def test_banded_alignment_equals_the_whole_one():
    """Random sequences around the limit: edits, moves, repeats and few symbols."""
    rng = np.random.default_rng(11)
    seen = {True: 0, False: 0}
    for case in range(1500):
        n, symbols = int(rng.integers(1, 60)), int(rng.choice([2, 5, 1000]))
        a = rng.integers(0, symbols, n).astype(np.uint64)
        b = a.copy()
        for _ in range(int(rng.integers(0, max(2, n // 4)))):
            at = int(rng.integers(0, len(b))) if len(b) else 0
            kind = rng.integers(0, 4)
            if kind == 0 and len(b):
                b[at] = rng.integers(0, symbols)
            elif kind == 1 and len(b) > 1:
                b = np.delete(b, at)
            elif kind == 2:
                b = np.insert(b, at, rng.integers(0, symbols))
            else:
                b = np.roll(b, int(rng.integers(0, 3)))
        m = lcs(a.tolist(), b.tolist())
        for similarity in (0.5, 0.8, 0.95):
            want = m / (len(a) + len(b) - m) >= similarity - 1e-12 if len(a) and len(b) else False
            assert order_minhash.aligned(a, b, similarity) == want, (case, similarity)
            seen[want] += 1
    assert min(seen.values()) > 500


def test_texts_of_one_id_and_repeated_rows(make_docs):
    """Several texts under an id are compared each; rows that are there often are cut once."""
    texts = near_copies()[:7]
    near = [t + " tail" for t in texts]
    docs = make_docs([*texts, *near, *([texts[0]] * 50)], [1] * 7 + list(range(10, 17)) + [1] * 50)
    rows = order_minhash.near_duplicates(docs).collect()
    assert len(rows) == 64 and all(r["class_id"] == 1 for r in rows)


def test_near_duplicates_of_edge_cases(edge, make_docs):
    rows = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(edge).collect()}
    assert rows[3] == rows[4] == 3 and rows[5] == rows[6] == 5 and rows[0] == 0 and rows[1] == 1 and len(rows) == edge.count()
    odd = order_minhash.near_duplicates(make_docs(["a b c d e f", "a b c d e f", "a b c d e f"], [None, 4, 4])).collect()
    assert {(r["doc_id"], r["class_id"], r["kept"]) for r in odd} == {(4, 4, True), (None, 4, False)} and len(odd) == 3
    assert order_minhash.near_duplicates(edge.where("false")).count() == 0


def test_rows_without_id_lose_no_link(make_docs):
    """Brute force over all pairs, ids for some rows only; a class without any id keeps one of its rows, copies included."""
    texts = near_copies()
    rng = np.random.default_rng(2)
    ids = [None if rng.random() < 0.5 else 10 + i for i in range(len(texts))]
    ids[:5] = [None] * 5  # a class of near copies without any id
    texts, ids = [*texts, texts[1], texts[1], texts[7], texts[7]], [*ids, None, None, None, None]
    keys = list(range(len(texts)))
    groups = {}
    for i, c in brute_classes(texts, keys).items():
        groups.setdefault(c, []).append(i)
    want = {}
    for own in groups.values():
        named = [ids[i] for i in own if ids[i] is not None]
        for i in own:
            alone = not texts[i]  # empty and null texts stand alone
            c = ids[i] if alone else min(named, default=None)
            want.setdefault((texts[i], ids[i], c), []).append(i)
    rows = order_minhash.near_duplicates(make_docs(texts, ids)).collect()
    assert len(rows) == len(texts)
    got = {}
    for r in rows:
        got[r["doc_id"], r["class_id"]] = got.get((r["doc_id"], r["class_id"]), 0) + 1
    expected = {}
    for (_, i, c), own in want.items():
        expected[i, c] = expected.get((i, c), 0) + len(own)
    assert got == expected
    full = [own for own in groups.values() if texts[own[0]]]
    empty = sum(not t for t in texts)
    assert sum(r["kept"] for r in rows) == len(full) + empty
    picked = order_minhash.representatives(make_docs(texts, ids)).collect()
    assert len(picked) == len(full)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components(links, 4).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def nearest(x, ids, asked, k=10):
    """query_id, vec_id of the true neighbours, from the differences of all pairs."""
    out = []
    for q in np.flatnonzero(asked):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        other = np.flatnonzero(ids != ids[q])
        out += [(int(ids[q]), int(ids[j])) for j in other[np.lexsort((ids[other], d[other]))][:k]]
    return out


def recall(rows, want):
    got = {(r["query_id"], r["vec_id"]) for r in rows}
    return len(got & set(want)) / len(want)


def test_search_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(900, 8)), np.ones((40, 8))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0] * 7 + [None]), (None, [1.0] * 8), (2004, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"vector": F.lit("clash"), "cell": F.lit(1), "query": F.lit("clash")})
    vectors = multi_index.usable(table)
    assert vectors.count() == len(x)
    got = multi_index.search(vectors, vectors.where("vec_id % 20 = 0 OR vec_id = 905"), centroids=8).collect()
    ids = np.arange(len(x))
    assert recall(got, nearest(x, ids, (ids % 20 == 0) | (ids == 905))) >= 0.9
    same = sorted((r for r in got if r["query_id"] == 905), key=lambda r: r["rank"])
    assert [r["vec_id"] for r in same] == [i for i in range(900, 912) if i != 905][:10] and all(r["score"] == 0 for r in same)
    assert multi_index.search(vectors.where("false"), vectors.where("false")).count() == 0
    few = vectors.where("vec_id < 4")
    assert multi_index.search(few, few, centroids=2, share=1.0).count() == 12
    for r in got[:50]:
        assert r["score"] == np.sqrt(((x[r["vec_id"]] - x[r["query_id"]]) ** 2).sum())


def test_search_of_few_rows_finds_all_that_are_asked_for(spark):
    x = np.random.default_rng(5).normal(size=(16, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    for n in (1, 4, 15, 16):
        few = spark.createDataFrame(rows[:n], "vec_id long, vector array<double>")
        assert multi_index.search(few, few).count() == n * min(10, n - 1)
        assert multi_index.search(few, few, share=0.01).count() == n * min(10, n - 1)
    repeated = spark.createDataFrame(rows + [(0, rows[0][1])] * 9, "vec_id long, vector array<double>")
    assert multi_index.search(repeated, repeated.where("vec_id = 0").limit(1)).count() == 10


def test_vectors_of_other_lengths_take_no_part(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 6)))]
    odd = [(100, [1.0, 2.0]), (101, [1.0] * 5), (102, [1.0] * 7), (103, [2.0])]
    vectors = multi_index.usable(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"))
    got = multi_index.search(vectors, vectors.where("vec_id % 10 = 0"), share=1.0).collect()
    assert {r["query_id"] for r in got} == {0, 10, 20, 30} and max(r["vec_id"] for r in got) < 100 and len(got) == 40


@pytest.mark.parametrize(("offset", "factor"), [(1e7, 1.0), (0.0, 1e200), (0.0, 1e-200), (-3e9, 1.0)])
def test_neighbours_far_from_the_origin_and_at_any_scale(spark, offset, factor):
    x = (np.random.default_rng(7).normal(size=(120, 8)) + offset) * factor
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<double>")
    got = multi_index.search(vectors, vectors.where("vec_id % 10 = 0"), centroids=4, share=1.0).collect()
    scaled, ids = x / factor, np.arange(len(x))
    assert len(got) == 120 and recall(got, nearest(scaled, ids, ids % 10 == 0)) == 1
    assert all(np.isclose(r["score"] / factor, np.sqrt(((scaled[r["vec_id"]] - scaled[r["query_id"]]) ** 2).sum()), rtol=1e-12) for r in got)


def test_each_row_of_a_repeated_query_id_has_its_list(spark):
    x = np.random.default_rng(8).normal(size=(60, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, (x[0] + 5).tolist()), (0, x[0].tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = multi_index.search(vectors, vectors.where("vec_id = 0"), share=1.0).collect()
    assert sorted(r["rank"] for r in got) == sorted([*range(1, 11)] * 2) and all(r["vec_id"] != 0 for r in got)
    want = set()
    for q in (x[0], x[0] + 5):
        d = np.sqrt(((x - q) ** 2).sum(1))
        d[0] = np.inf
        want |= {(int(j), float(d[j])) for j in np.argsort(d)[:10]}
    assert {(r["vec_id"], r["score"]) for r in got} == want


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_search_recall_on_the_query_itself(spark, folder):
    frame = multi_index.usable(spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")).toPandas()
    x, ids = np.array(frame.vector.tolist()), frame.vec_id.to_numpy()
    got = queries.queries()["op7_multi_index"](spark, f"/root/testdata/{folder}").collect()
    assert len(got) == 10 * (ids % 100 == 0).sum() and recall(got, nearest(x, ids, ids % 100 == 0)) >= 0.9


def test_clustered_vectors_need_few_cells():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(100, 16))
    x = centres[rng.integers(0, 100, 4000)] + 0.1 * rng.normal(size=(4000, 16))
    c1, c2 = multi_index.kmeans(x[:, :8], 64), multi_index.kmeans(x[:, 8:], 64)
    assert multi_index.fitted_share(x, c1, c2, 10, 0.97) < 0.05


def test_copies_do_not_use_up_the_share(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = multi_index.usable(table)
    copies = vectors.where("vec_id = 7").crossJoin(spark.range(vectors.count() // 2)).select((F.col("id") + 1000000).alias("vec_id"), "vector")
    all_ = vectors.unionByName(copies)
    got = multi_index.search(all_, vectors.where("vec_id % 100 = 0")).collect()
    frame = all_.toPandas().sort_values("vec_id")
    x, ids = np.array(frame.vector.tolist()), frame.vec_id.to_numpy()
    assert recall(got, nearest(x, ids, (ids % 100 == 0) & (ids < 1000000))) >= 0.93


def test_heap_visits_cells_in_order():
    rng = np.random.default_rng(3)
    a, b = rng.random(9), rng.random(7)
    counts = rng.integers(0, 3, (9, 7))
    cells = multi_index.traverse(a, b, counts, int(counts.sum()))
    sums = [a[i] + b[j] for i, j in cells]
    assert sums == sorted(sums) and set(cells) == {(i, j) for i in range(9) for j in range(7) if counts[i, j]}


def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.COM/en/7?x=1", "https://example.com/en/5#t", "ftp://x.net/de/1", "example.net/de", None, "", "http://example.net/de/81", "http://org", "x://y.notcom/en/", "http://a.org/es/://b"]
    pages = spark.createDataFrame([(i, u, "h", "z") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    rows = {r["page_id"]: tuple(r[c] for c in ("host", "path", "rule", "verdict")) for r in url_filters.judge(pages, url_filters.reputation(url_filters.counted(pages, none)), url_filters.QUERY_RULES).collect()}
    assert rows == {
        0: ("a.example.com", "/en/7", "example.com/en/7", "allow"), 1: ("example.com", "/en/5", "com/en/", "block"), 2: ("x.net", "/de/1", "net/de/", "allow"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"),
        6: ("example.net", "/de/81", "example.net/de/8", "block"), 7: ("org", "", None, "allow"), 8: ("y.notcom", "/en/", None, "allow"), 9: ("a.org", "/es/://b", "org/es/", "block"),
    }
    nothing = pages.where("false")
    assert url_filters.judge(nothing, url_filters.reputation(url_filters.counted(nothing, none)), ()).count() == 0


def test_bad_hosts_are_blocked_and_small_ones_shrunk(spark):
    pages = [(i, f"http://bad.a.com/{i}") for i in range(60)] + [(100 + i, f"http://good{i % 5}.b.com/{i}") for i in range(100)] + [(300, "http://tiny.c.org/")]
    bad = [(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(100)] + [(300, 1)]
    p, o = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad int")
    known = url_filters.reputation(url_filters.counted(p, o))
    rows = {r["host"]: r for r in known.collect()}
    assert rows["bad.a.com"]["bound"] > 0.5 > rows["good1.b.com"]["bound"]
    assert rows["tiny.c.org"]["mean"] < 1
    verdicts = {r["host"]: r["verdict"] for r in url_filters.judge(p, known, ()).collect()}
    assert verdicts["bad.a.com"] == "block" and verdicts["good0.b.com"] == "allow"


def test_outcomes_by_key_and_by_seed(spark):
    """Repeated pages, keys and labels count each; null keys and urls have no outcome."""
    pages = [(1, "http://x.com/", "a"), (1, "http://x.com/", "a"), (2, "http://x.com/", "b"), (None, "http://my-spam.x.com/", None), (3, None, "a"), (4, "http://spammy.com/", None)]
    p = spark.createDataFrame(pages, "page_id long, url string, k string").withColumn("n", F.lit("clash"))
    o = spark.createDataFrame([("a", 1), ("a", 0), ("b", None), (None, 1)], "k string, bad int")
    rows = {r["host"]: (r["n"], r["k"]) for r in url_filters.counted(p, o, "k", url_filters.seeded(F.col("host"), ("spam",))).collect()}
    assert rows == {"x.com": (4, 2), "my-spam.x.com": (1, 1), "": (2, 1), "spammy.com": (0, 0)}


def test_reputation_decides_pages_of_the_query(spark):
    rows = queries.queries()["op8_url_filters"](spark, "/root/testdata/sf0.1").where("rule IS NULL").groupBy("verdict").count().collect()
    assert {r["verdict"] for r in rows} == {"allow", "block"}


def test_url_query_equals_its_sql(spark):
    assert compare(spark, connect(SF), queries.queries()["op8_url_filters"], queries.oracle_sql()["op8_url_filters"], SF) == ""


def similar_classes(texts):
    """The least key of each text's class, from the alignment of all pairs of texts by key."""
    keys = sorted(texts)
    _, found = order_minhash.digests(pa.array([texts[k] for k in keys], pa.string()))
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for j, b in enumerate(keys[:i]):
            if texts[a] and (texts[a] == texts[b] or order_minhash.aligned(found[i], found[j])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def test_near_duplicates_of_a_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = {r["doc_id"]: r["class_id"] for r in queries.queries()["op3_order_minhash"](spark, SF).collect()}
    assert rows == similar_classes(texts)


def test_the_pipeline_equals_plain_stages(spark):
    """Every stage a text at a time: the score of each model, the alignment of all pairs, the library's ids."""
    import zlib

    from tokenizers import Tokenizer

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = language_id.fit(docs.where(~fold()))
    names, _, peaks = language_id.classify(pa.array(list(texts.values())), model, model.tables())
    texts = {d: t for (d, t), n, s in zip(texts.items(), names, peaks, strict=True) if n != "und" and s >= 1.1 / len(model.langs)}
    known = docs.join(spark.createDataFrame([(d,) for d in texts], "doc_id long"), "doc_id")
    judge = toxicity.fit(known, labels.where(~fold()))
    weights = dict(zip(judge.index.tolist(), judge.weights.tolist(), strict=True))
    toxic = lambda t: 1 / (1 + np.exp(-(judge.bias + sum(weights.get(f, 0.0) for f in set(toxicity.features(pa.array([t]))[0].tolist()))))) >= 0.3
    texts = {d: t for d, t in texts.items() if not toxic(t)}
    texts = {d: texts[d] for d, c in similar_classes(texts).items() if c == d}
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = set()
    for d, t in texts.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        want |= {(d, i // 4096, i, len(ids[i : i + 4096]), zlib.crc32(np.array(ids[i : i + 4096], "<u4").tobytes())) for i in range(0, len(ids), 4096)}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    assert 0 < len(texts) < len(names)


@pytest.mark.parametrize("name", ["op3_order_minhash", "op4_quality_rules", "op5_language_id", "op6_toxicity"])
def test_queries_give_a_row_for_each_document(spark, name):
    rows = queries.queries()[name](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows.count() == docs.count() and rows.select("doc_id").distinct().count() == docs.count()


def test_rows_are_kept_by_id_and_text(spark, make_docs):
    text = " ".join(f"w{i}" for i in range(150))
    near, other, third = text.replace("w9 ", "new "), "quite another text of some words here", "and one more that no other row has"
    docs = make_docs([text, other, near, third, third, text, text], [1, 2, 2, None, None, 2, 1])
    rows = corpus_pipeline.distinct(spark, docs, SF)
    assert rows.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in rows.collect()) == sorted([(1, text), (2, other), (0, third)])


def test_pipeline_stages(spark, make_docs):
    docs = make_docs(["One two three four five six seven eight."] * 3 + ["Another text of quite other words here today.", None, "123 !!!", ""], [0, 1, 1, 3, 4, 5, 6])
    known = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, known, SF)
        assert found.columns == docs.columns
        known = found
    assert sorted(r["doc_id"] for r in known.collect()) == [0, 3]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_duplicates", "packing"]
    pieces = corpus_pipeline.STAGES[-1][1](spark, known, SF).collect()
    assert sorted(r["doc_id"] for r in pieces) == [0, 3] and len({r["sequence_id"] for r in pieces}) == 1
