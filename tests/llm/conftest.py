import re

import pytest

WORDS = r"[^\x20\x09-\x0D]+"


def words(text, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(WORDS, text)


def shingles(text):
    w = words(text, True)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def table(spark, sf_dir):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with a column that clashes with names the operators use."""
    def make(rows):
        rows = [(i, t, "en", s, len(t) if t else None, "x") for i, t, s in rows]
        return spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, n_chars long, size string")
    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, blanks, short, long and repeated texts, ties and a null doc_id."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    body = " ".join(f"a{i}" for i in range(60))
    return make_docs([
        (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one", "b"), (5, "one two", "b"), (6, body, "a"),
        (7, body, "a"), (8, body + " tail", None), (9, long, "c"), (10, long + " end", "c"), (11, "x " * 400, "c"),
        (None, body, "b"), (None, None, None), (6, body, "a"), (12, "été ß   naïve", "d")])


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
