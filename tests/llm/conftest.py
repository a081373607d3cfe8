import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang[, source]]) tuples, with a column whose name may clash."""

    def build(rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("fp", "size", "source_size", "component_id", "code", "sha", "keep_id", "score", "body", "_id", "leaf"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return build


#: Null, empty, blank, very long, repeated and tied rows.
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, "one two three"), (6, "one two three"),
    (7, "ONE  two\nthree"), (None, "loose row"), (None, None), (8, "word " * 60000), (9, "ünï cödé " * 50), (10, "one two three"),
]


@pytest.fixture(scope="session")
def odd_rows():
    return ODD
