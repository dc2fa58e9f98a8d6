import pytest

from sheetwise.llm.common import prepare

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, size int, u int"


@pytest.fixture(scope="session")
def llm(spark):
    prepare(spark)
    return spark


@pytest.fixture(scope="session")
def documents(llm):
    """Documents from (doc_id, text[, lang[, source]]) rows, with extra columns whose names the
    operators use inside."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), "x", 1, 2) for r in rows]
        return llm.createDataFrame(full, DOCS)
    return make
