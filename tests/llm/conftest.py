import pytest

from ledgerline.sources.packages import send_package

#: Columns that an input may have besides its own, named like the operators' results and inner columns.
CLASHES = ["text_key", "n_words", "simhash", "start", "removed", "n_removed", "n_lines", "base", "lang_pred", "items", "ids", "_found"]


@pytest.fixture(scope="session", autouse=True)
def sent(spark):
    send_package(spark)


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text[, lang]) as a table with clashing extra columns."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, *["?"] * len(CLASHES)) for r in rows]
        shape = "doc_id long, text string, lang string, " + ", ".join(f"{name} string" for name in CLASHES)
        return spark.createDataFrame(full, shape)

    return make
