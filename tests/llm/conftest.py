import pytest

#: Rows every document operator must survive: nulls, empty, blank, repeated, one very long text.
EDGE_TEXTS = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (4, "one two"), (None, "one two"), (5, "word " * 40000), (6, "x" * 150000),
              (7, "Ünï çødé 中文 \U0001F600 <|endoftext|> don't"), (8, "1 2 3")]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Edge rows with extra columns whose names clash with the operators' own."""
    rows = [(i, t, None, "s", 9, "x", 0.5, "en", 1) for i, t in EDGE_TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "sid string, score double, lang_pred string, shard int")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
