import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, node string, size string, keep string, rank string"


def doc(doc_id, text, lang=None, source=None):
    return (doc_id, text, lang, source, None, "a", "b", "c", "d", "e")


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns with clashing names."""
    long_text = " ".join(f"word{i % 977} talk{i % 31}" for i in range(30_000))
    rows = [doc(1, None), doc(2, ""), doc(3, " \t\n"), doc(4, "1 2 3 ..."), doc(5, long_text, "en", "a"), doc(5, long_text, "en", "a"),
            doc(6, "one", "de", "a"), doc(7, "one", "de", "b"), doc(8, "two words", "de", None), doc(None, "an id is missing here", "en", "b"),
            doc(None, None), doc(9, "Ünïcode wörds and \U0001F600 faces — here", "fr", "b"), doc(10, "<|endoftext|> MIT license", "en", "b"),
            doc(10, "another text of the same id", None, "c")]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        return spark.createDataFrame([doc(*r) for r in rows], DOC)
    return make
