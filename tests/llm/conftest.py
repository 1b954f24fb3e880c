import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text) rows, with the columns of the table."""

    def make(rows, extra=()):
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
        for name in extra:
            df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make
