import pytest

#: Nulls, empty and white-space texts, ties, repeated rows and a long text, beside columns whose names clash with those used inside.
ODD = [
    (1, "Alpha beta gamma delta epsilon zeta."), (2, "Alpha beta gamma delta epsilon zeta."), (2, "Alpha beta gamma delta epsilon zeta."), (None, "no id here"), (None, None),
    (3, None), (4, ""), (5, " \n\t "), (6, "x" * 500), (7, "one  two \n\n three\x1cfour <|endoftext|> 1,234.50 don't DON'T ümlaut 日本語 😀 é"), (8, "word " * 30_000), (9, "!!! ??? ..."), (-10, "negative id"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en" if k % 2 else None, None, k, "clash", 0, 1.5) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, n long, score double").repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
