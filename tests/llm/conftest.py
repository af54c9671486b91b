import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes a table like ``documents`` from (doc_id, text) or (doc_id, text, source)."""

    def make(rows, extra=""):
        full = [
            (r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows
        ]
        df = spark.createDataFrame(full, DOCS)
        for name in extra.split():
            df = df.selectExpr("*", f"'kept' AS {name}")
        return df

    return make


@pytest.fixture
def label_table(spark):
    """Makes a table like ``labels`` from (doc_id, quality, toxic)."""
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# Texts that every operator has to take: no text, nothing, blanks, one word, a long word,
# a long text, and letters outside the basic plane.
ODD = [None, "", " \n\t ", "word", "x" * 5000, "many words " * 4000, "é中🙂   \x85 z"]
