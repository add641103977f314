import pytest

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))

#: Ids and texts that every operator must take: null, empty, blank, very long, repeated rows.
ODD = [
    (1, None, None), (2, "", "a"), (3, " \t\n\x0b\f\r ", "a"), (4, "one two", "b"), (5, "one two", "b"),
    (5, "one two", "b"), (6, LONG, "a"), (7, LONG, "b"), (8, "Über \x85 ß 日本 <|endoftext|> it's", "c"),
    (9, "x" * 200_000, "c"), (None, "one two", None),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents from rows of doc_id, text and source, with more columns of clashing names."""

    def make(rows):
        frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
        clashing = ("id", "digest", "_id", "kept", "size", "start", "rank", "length", "lists", "fp", "norm", "label", "n", "h")
        return frame.selectExpr("*", "'en' AS lang", "cast(length(text) AS long) AS n_chars",
                                *[f"'{c}' AS `{c}`" for c in clashing])

    return make


@pytest.fixture(scope="session")
def odd(docs):
    return docs(ODD).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs([])


def by_id(frame, column):
    return {r["doc_id"]: r[column] for r in frame.collect()}
