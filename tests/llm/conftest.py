import pytest

SF = "/root/testdata/sf0.001"

#: Rows that every operator over documents must take: nulls, empty and blank texts, ties,
#: repeated rows, a very long text, and columns whose names clash with the operators' own.
ODD_TEXTS = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (None, "a null id with a text of its own"),
    (None, None),
    (6, "mail x@y.org or +1 (283) 555-6500 now, host 10.0.0.1, card 4111 1111 1111 1111"),
    (7, "Ünï çødé ÉÈ 日本語 \U0001f600 x@y.org"),
    (8, "short"),
    (9, "word " * 30_000),
]




@pytest.fixture
def odd_docs(spark):
    rows = [(i, t, "x", 1, 2.0, "k") for i, t in ODD_TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, length double, block string")


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
