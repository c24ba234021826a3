import pytest

LONG = "lorem ipsum dolor sit amet " * 8000

#: (doc_id, text, source): nulls, empty and white texts, a very long one, copies, near copies, repeated rows, a null id.
ROWS = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one two", "b"), (5, "one two", "b"), (6, "One\tTWO", None),
    (7, LONG, "a"), (8, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf again", "b"),
    (8, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf again", "b"),
    (None, "a row without an id", None), (10, "x", "c"), (11, "émile ÉCOLE naïve 日本語 !!! ### a|b", "c"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd rows, and columns with names that operators use inside."""
    clash = ["id", "n", "size", "key", "node", "a", "b", "u", "copies", "place", "y", "x", "score", "text_digest", "tie", "held", "of", "source_size"]
    schema = "doc_id long, text string, source string, lang string, " + ", ".join(f"{c} string" for c in clash)
    return spark.createDataFrame([(*r, r[2], *["?"] * len(clash)) for r in ROWS], schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def by_id(df):
    """Rows with an id, by it; those of a repeated id must agree."""
    out = {}
    for r in df.collect():
        d = r.asDict()
        key = d.pop("doc_id")
        assert out.setdefault(key, d) == d
    return out
