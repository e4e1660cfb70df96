import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents from (doc_id, text) or (doc_id, text, source) rows, with an extra
    column whose name operators use themselves."""

    def make(rows):
        rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x") for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
        return spark.createDataFrame(rows, schema).repartition(3)

    return make


@pytest.fixture(autouse=True, scope="session")
def package(spark):
    from firnline.llm.common import workers_see_package

    workers_see_package(spark)
