import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, source]) rows, with columns whose names operators use inside."""

    def made(rows, parts=3):
        full = [(r[0], r[1], "xx", r[2] if len(r) > 2 else "s", 0, -1, "k", 5, "h", 9.0) for r in rows]
        names = f"{DOCUMENTS}, node int, key string, n int, judged_host string, score double"
        return spark.createDataFrame(full, names).repartition(parts)

    return made
