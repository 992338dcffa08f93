import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, kept boolean, ids string, members string"
ODD = [
    "", None, " ", "\n\t", "a", "a  b", "a b", "'s it's ''ll x'", "\U0001f600 été １²", "x" * 5000, "ab " * 3000,
    "the quick brown fox", "the quick brown fox", "the  quick brown\nfox", "The quick brown fox", "<|endoftext|> <|startoftext|>",
    "one", "one two", "one two three", "a\n\nb \n c  \td", "　 x\u0085y\x1cz", "İΣς ́e",
]


def frame(spark, rows):
    """Rows of (doc_id, text, lang) with further columns whose names operators use too."""
    return spark.createDataFrame([(i, t, lang, None, None, 0.5, 7, True, "x", None) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns."""
    rows = [(i, t, "en" if i % 3 else None) for i, t in enumerate(ODD)]
    return frame(spark, [*rows, rows[11], rows[11], (None, "the quick brown fox", None), (None, None, None)]).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
