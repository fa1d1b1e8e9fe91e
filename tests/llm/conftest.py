import pytest

#: Awkward rows that every text operator must bear: nulls, empty and odd texts, repeated rows.
ODD_TEXTS = [
    None, "", " ", "\n", "a", "a b", "  two  spaces  ", "tabs\tand\r\nlines\n\n", "é ñ ß ×÷ … “q”", "İſK",
    "word " * 3000, "x" * 50_000, "same words here again", "same words here again", "<|endoftext|> b", "1.2.3.4.5", "+1 (234) 555-1234",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i if i % 5 else None, t, "en" if i % 3 else None, "s", None) for i, t in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows + rows[:4], "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
