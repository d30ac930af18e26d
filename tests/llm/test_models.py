"""Quality, language and toxicity: held-out accuracy, brute force for the counts, and edge cases."""

import collections
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from peakloom.llm import language_id, quality, queries, toxicity
from peakloom.llm.common import fold

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(edge_texts):
    rows = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' WHERE doc_id % 5 = 0").fetchall()]
    texts = [*edge_texts, "a b c a b c", "a\n\na\n a\n", "x y x y x y x y", *rows]
    base, features = quality.statistics(pa.array(texts, pa.string()))
    assert list(zip(*(base[k].tolist() for k in quality.BASE), strict=True)) == [counts(t) for t in texts]
    assert features.shape == (len(texts), len(quality.FEATURES)) and np.isfinite(features).all()


def test_trees_learn_and_keep_the_order():
    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality.FEATURES)))
    y = (x[:, 2] + 0.2 * rng.random(600) < 0.6).astype(float)
    model = quality.train(x[:400], y[:400], trees=20)
    assert ((model.scores(x[400:]) > 0.5) == y[400:]).mean() > 0.9
    for f, sign in enumerate(quality.MONOTONE):
        if sign:
            more = x.copy()
            more[:, f] += 0.3
            assert (sign * (model.scores(more) - model.scores(x)) >= -1e-12).all()


def test_quality_of_edge_cases(spark, edge):
    rows = {r["doc_id"]: r for r in quality.judge(edge, None).collect()}
    assert len(rows) == edge.count() and rows[0]["base_failed"] and not rows[0]["kept"] and rows[11]["n_words"] == 18000
    assert quality.judge(edge.where("false"), None).count() == 0
    assert quality.fit(edge, spark.createDataFrame([], "doc_id long, quality int, toxic int")) is None


def test_quality_on_held_out_documents(docs, labels):
    model = quality.fit(docs, labels.where(~fold()))
    rows = quality.judge(docs, model).join(labels, "doc_id").where(fold()).select("quality", "score", "base_failed", "kept").collect()
    assert np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in rows]) > 0.9
    bad = [r["score"] < 0.5 for r in rows if r["quality"] == 0]
    assert np.mean(bad) > 0.5 and all(r["kept"] == (not r["base_failed"] and r["score"] >= 0.5) for r in rows)


def test_quality_query_equals_a_walk_down_each_tree(spark, docs, labels):
    """The verdict of every whole text, a text, a tree and a node at a time."""
    model = quality.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    rows = {r["doc_id"]: r for r in queries.queries()["op4_quality_rules"](spark, SF).collect()}
    assert rows.keys() == texts.keys()
    for doc_id, text in texts.items():
        n_words, *rest, n_repeat = counts(text)
        x = quality.statistics(pa.array([text]))[1][0]
        z = model.bias
        for t in range(len(model.leaf)):
            node = 0
            while node < len(model.feature[t]):
                node = 2 * node + (2 if x[model.feature[t][node]] > model.cut[t][node] else 1)
            z += model.leaf[t][node - len(model.feature[t])]
        failed = n_words < 50 or 100 * n_repeat > 50 * n_words
        r = rows[doc_id]
        assert (r["n_words"], r["n_repeat_words"], r["base_failed"]) == (n_words, n_repeat, failed)
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-9 and r["kept"] == (not failed and r["score"] >= 0.5)


def test_a_doc_id_brings_one_text_to_training(spark, make_docs):
    """Repeated and null ids, labels both ways and labels of one class only."""
    docs = make_docs(["a text of five words", "another one", None] * 30 + ["x y z"], [1, 1, 1] * 30 + [None])
    both = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, 0, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, both) is None and len(toxicity.fit(docs, both).index) == 0
    assert quality.judge(docs, None).count() == 91
    two = make_docs(["good words here"] * 40 + ["bad ||| words"] * 40, [1] * 40 + [2] * 40)
    model = toxicity.fit(two, both, least=1)
    assert 0 < model.scores(pa.array(["bad"]))[0] < 1


def test_language_accuracy_on_held_out(docs):
    model = language_id.fit(docs.where(~fold()))
    rows = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(fold()).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_tables_equal_the_convolution():
    rng = np.random.default_rng(1)
    model = language_id.train(["abc def " * 80, "xyz uvw " * 80], ["a", "b"], epochs=1)
    x = rng.integers(0, language_id.N_SYMBOLS, (3, language_id.WINDOW)).astype(np.uint8)
    pooled = []
    for w, b in zip(model.filters, model.bias, strict=True):
        n = language_id.WINDOW - len(w) + 1
        z = sum(model.embed[x[:, j : j + n]] @ w[j] for j in range(len(w))) + b
        pooled.append(np.maximum(z.max(1), 0))
    z = np.concatenate(pooled, 1) @ model.out + model.out_bias
    p = np.exp(z - z.max(1, keepdims=True))
    assert np.allclose(np.exp(model.log_probabilities(x, model.tables())), p / p.sum(1, keepdims=True), atol=1e-4)


def test_language_of_edge_cases(edge, edge_texts):
    model = language_id.train(["abc def " * 80, "xyz uvw " * 80], ["a", "b"], epochs=1)
    rows = {r["doc_id"]: r for r in language_id.predict(edge, model).collect()}
    for i, t in enumerate(edge_texts):
        assert (rows[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or ""))
    assert {r["lang_pred"] for r in language_id.predict(edge, None).collect()} == {"und"}
    kept = language_id.keep_known(edge, model)
    assert kept.columns == edge.columns
    peaks = language_id.classify(pa.array(edge_texts, pa.string()), model, model.tables())[2]
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if r["lang_pred"] != "und" and peaks[i] >= 0.55}


def test_texts_that_the_network_cannot_tell_are_rejected(edge, docs):
    model = language_id.train(["abc def " * 80, "xyz uvw " * 80], ["a", "b"], epochs=1)
    model.out[:], model.out_bias[:] = 0, 0
    assert language_id.keep_known(edge, model).count() == 0
    fitted = language_id.fit(docs.where(~fold()))
    assert language_id.keep_known(docs, fitted).count() == docs.where("text RLIKE '[^\\\\W\\\\d_]'").count() == docs.count()


def test_texts_with_letters_are_kept_without_a_model(edge, edge_texts):
    kept = [r["doc_id"] for r in language_id.keep_known(edge, None).collect()]
    assert sorted(kept) == [i for i, t in enumerate(edge_texts) if any(c.isalpha() for c in t or "")]


def test_short_texts_are_learned(make_docs):
    """Labelled texts of under 16 bytes only: each has letters, so each gets a learned language."""
    docs = make_docs(["abc abc", "abc ab", "xyz xy", "xyz xyz", "", None], [1, 2, 3, 4, 5, None]).withColumn("lang", F.expr("CASE WHEN text LIKE 'abc%' THEN 'a' WHEN text LIKE 'xyz%' THEN 'x' END"))
    model = language_id.fit(docs)
    rows = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, model).collect()}
    assert rows[1] in ("a", "x") and rows[3] in ("a", "x") and rows[5] == rows[None] == "und"


def test_language_of_whole_texts_by_a_plain_convolution(docs):
    """The vote of all windows of a text, a window and a filter at a time."""
    model = language_id.fit(docs.where(~fold()), per_lang=20)
    rows = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    for r in docs.orderBy("doc_id").limit(12).collect():
        data = (r["text"] or "").encode()
        logs, probs, total = np.zeros(len(model.langs)), np.zeros(len(model.langs)), 0
        for at in range(0, len(data), language_id.WINDOW):
            part = data[at : at + language_id.WINDOW]
            x = language_id.SYMBOL[np.frombuffer(part.ljust(language_id.WINDOW), np.uint8)]
            pooled = []
            for w, b in zip(model.filters, model.bias, strict=True):
                z = [sum(model.embed[x[i + j]] @ w[j] for j in range(len(w))) + b for i in range(len(x) - len(w) + 1)]
                pooled.append(np.maximum(np.max(z, 0), 0))
            z = np.concatenate(pooled) @ model.out + model.out_bias
            z -= z.max()
            log = z - np.log(np.exp(z).sum())
            logs, probs, total = logs + len(part) * log, probs + len(part) * np.exp(log), total + len(part)
        assert rows[r["doc_id"]]["lang_pred"] == model.langs[int(logs.argmax())]
        assert abs(rows[r["doc_id"]]["score"] - probs[int(logs.argmax())] / total) < 1e-3


def test_models_of_empty_tables(spark, edge):
    nothing, none = edge.where("false"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert language_id.fit(nothing) is None and quality.fit(nothing, none) is None
    assert language_id.predict(nothing, None).count() == 0 and toxicity.score(nothing, toxicity.fit(nothing, none)).count() == 0
    assert language_id.keep_known(nothing, None).count() == 0 and toxicity.keep_clean(nothing, toxicity.fit(nothing, none)).count() == 0


def test_models_keep_null_and_repeated_ids(make_docs):
    docs = make_docs(["some words", None, "some words", "other"], [None, None, 7, 7])
    for rows in (language_id.predict(docs, None), toxicity.score(docs, toxicity.train_texts(["a b", "c d"], [0, 1]))):
        assert sorted(str(r["doc_id"]) for r in rows.collect()) == ["7", "7", "None", "None"]


@pytest.mark.parametrize(("folder", "least"), [(SF, 0.6), ("/root/testdata/sf0.1", 0.88)])
def test_toxicity_on_held_out(spark, folder, least):
    """Recall of toxic texts, and false alarms, on rows that the query does not learn from."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = queries.queries()["op6_toxicity"](spark, folder).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] for r in rows if r["toxic"] == 0]) < 0.02
    assert np.mean([r["predicted"] for r in rows if r["toxic"] == 1]) > least


def plain_score(model, text):
    """A unit at a time: the distinct features that the model knows."""
    hashed, _ = toxicity.features(pa.array([text]))
    known = dict(zip(model.index.tolist(), model.weights.tolist(), strict=True))
    return 1 / (1 + np.exp(-(model.bias + sum(known.get(f, 0.0) for f in set(hashed.tolist())))))


def test_toxicity_query_equals_plain_sums(spark, docs, labels):
    model = toxicity.fit(docs, labels.where(~fold()))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    for r in queries.queries()["op6_toxicity"](spark, SF).collect():
        assert abs(r["score"] - plain_score(model, texts[r["doc_id"]])) < 1e-9 and r["predicted"] == int(r["score"] >= 0.3)


def test_training_in_tasks_equals_training_in_memory(docs, labels):
    rows = docs.join(labels.where(~fold()), "doc_id").select("text", "toxic").collect()
    local = toxicity.train_texts([r["text"] for r in rows], [r["toxic"] for r in rows])
    model = toxicity.fit(docs, labels.where(~fold()))
    assert np.array_equal(model.index, local.index) and np.allclose(model.weights, local.weights, atol=1e-2)


SENTENCES = ("the {} of here", "die {} gehen heute nach Hause", "les {} sont ici aujourd hui", "las {} están aquí")


def spread(model, group=range(len(toxicity.IDENTITY))):
    """Largest difference of scores between any two terms of a language, or a term and none."""
    found = []
    for g in group:
        texts = [SENTENCES[g].format(t) for t in toxicity.IDENTITY[g]] + [SENTENCES[g].replace("{} ", "")]
        s = model.scores(pa.array(texts))
        found.append(float(s.max() - s.min()))
    return max(found)


def test_the_penalty_acts_in_the_query(docs, labels):
    """No labelled text of the table names a group, so terms are swapped in for words."""
    own = toxicity.fit(docs, labels.where(~fold()))
    free = toxicity.fit(docs, labels.where(~fold()), fair=0.0)
    assert np.abs(own.weights - free.weights).max() > 0.1
    assert spread(free) > 0.05 and spread(own) < 0.01


@pytest.mark.parametrize("term", ["women", "immigrants", "muslims", "elderly"])
def test_counterfactual_penalty_evens_out_identity_terms(term):
    """One group stands in toxic texts only; its whole word and its beginnings must not carry the score."""
    texts = [f"the {term} are idiot and bad {i}" for i in range(40)] + [f"the {g} went home today {i}" for i in range(40) for g in ("men", "asians")]
    y = [1.0] * 40 + [0.0] * 80
    gap = {fair: spread(toxicity.train_texts(texts, y, fair=fair, mixed=0.0), [0]) for fair in (0.0, 10.0)}
    assert gap[0.0] > 0.2 and gap[10.0] < 0.05
    assert toxicity.train_texts(texts, y).scores(pa.array(["such an idiot and bad"]))[0] > 0.3


def test_what_a_swap_takes_with_it():
    parts = toxicity.parts_of(toxicity.IDENTITY)
    texts = ["christians, Christians", "christians at christmas", "Chris and christians", "no group here", "1 !", "", None]
    found = toxicity.examples(pa.array(texts), parts)
    word, four, six = parts[0][toxicity.IDENTITY[0].index("christians")]
    assert [sorted(g.tolist()) for g in found.gone[:3]] == [sorted([word, four, six]), sorted([word]) if six in _stems("christmas") else sorted({word, four, six} - _stems("christmas")), sorted({word, four, six} - _stems("chris"))]
    assert found.group.tolist()[:3] == [0, 0, 0] and found.group[3] >= 0 and found.group.tolist()[4:] == [-1, -1, -1]
    assert len(found.gone[3]) and set(found.gone[3].tolist()) <= set(found.full[3].tolist())
    assert all(0 <= t < len(toxicity.IDENTITY[g]) for g, t in zip(found.group, found.term, strict=True) if g >= 0)


def _stems(word):
    return set(toxicity.features(pa.array([word]))[0].tolist())


def test_sampled_classes_keep_their_odds():
    """A class drawn at half the rate moves the bias by as much."""
    texts, y = [f"word{i % 7} thing{i % 5}" for i in range(60)], [float(i % 3 == 0) for i in range(60)]
    plain, moved = toxicity.train_texts(texts, y), toxicity.train_texts(texts, y, shift=np.log(0.5))
    assert np.isclose(moved.bias - plain.bias, np.log(0.5)) and np.array_equal(moved.weights, plain.weights)


def test_toxicity_of_edge_cases(spark, edge):
    none = toxicity.fit(edge, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    rows = toxicity.score(edge, none).collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 for r in rows)
    kept = toxicity.keep_clean(edge, none)
    assert kept.columns == edge.columns and kept.count() == edge.count()
