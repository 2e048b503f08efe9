import pytest

LONG = "lorem ipsum Dolor " * 8000
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog"), (2, "the QUICK brown fox jumps over the lazy dog"), (3, None), (4, ""), (5, LONG), (6, LONG),
    (7, "ÀÉ straße  double\tspace\n\nlines\u00a0nbsp "), (7, "ÀÉ straße  double\tspace\n\nlines\u00a0nbsp "), (None, "no key"), (None, "no key"),
    (8, "one"), (9, "a b c d e f g"), (10, "<|endoftext|> it's 12345 \x1c odd"), (11, "The quick brown fox jumps over the lazy dog"), (12, "日本語 テキスト 𝒳"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators might use themselves."""
    rows = [(i, t, "x", "y", 1, 2, 3) for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, text_sha256 string, _row string, rank int, shard int, fp int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
