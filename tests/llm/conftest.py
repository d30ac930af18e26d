import pytest

from peakloom.llm.tokens import tokenizer_path

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, rank int"


@pytest.fixture(scope="session")
def word_bpe():
    return tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names clash with those that operators add."""

    def make(texts, ids=None, lang="en"):
        ids = list(range(len(texts))) if ids is None else ids
        return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 0.5, "x", 3) for i, t in zip(ids, texts, strict=True)], DOC_SCHEMA)

    return make


LONG = " ".join(f"word{i % 977} thing{i % 31}," for i in range(9000))
EDGE = [None, "", "   ", "a", "a", "One two three four five six seven.", "One two three four five six seven.", "it's <|endoftext|> we'll!! 12,345", "ÀÉÎ Straße ﬁ é İstanbul 日本語 😀 a\x1cb", "x" * 3000, "!" * 999, LONG]


@pytest.fixture(scope="session")
def edge(make_docs):
    return make_docs(EDGE)


@pytest.fixture(scope="session")
def edge_texts():
    return EDGE
