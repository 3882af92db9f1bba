import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, i long, t string, h boolean, k long, score double, n long"


def words(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioubcdfglmnrst") for _ in range(r.randint(2, 8))) for _ in range(n))


def rows_of(texts, first=1):
    """Rows of documents with columns whose names clash with the operators' own."""
    return [(first + k, t, "en", "s", len(t) if t is not None else None, 7, "x", True, 1, 0.5, 3) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    def make(texts, more=(), first=1):
        return spark.createDataFrame(rows_of(texts, first) + list(more), SCHEMA)

    return make


@pytest.fixture(scope="session")
def edge_docs(docs):
    """Null and empty texts, a null id, odd white space, a very long text, a repeated row, copies."""
    texts = [None, "", " \t\n", "one", "Two words", words(40), words(40), "é ü 日本   x\x00y", words(30_000, 5), "a" * 120_000]
    none = (None, "text without id", None, None, None, None, None, None, None, None, None)
    return docs(texts, more=[none, rows_of(texts)[5]])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def thue_morse():
    def make(bits):
        """The word of 2^bits letters and its complement: equal under any polynomial modulo 2^64 with an odd base."""
        word = "a"
        for _ in range(bits):
            word += word.translate(str.maketrans("ab", "ba"))
        return word, word.translate(str.maketrans("ab", "ba"))

    return make
