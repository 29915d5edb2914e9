import pytest
from made_texts import prose


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and blank texts, copies, near copies, repeated rows, a null id, a long text, and extra columns whose names clash with those operators add."""
    long_ = prose(1, 20_000)
    near = prose(2, 120)
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, near), (7, near.replace("market", "harbor", 1)), (8, near), (9, long_), (10, prose(3, 400)),
        (11, "é ü 漢字 😀 " * 30), (12, prose(4, 60) + ". " + prose(5, 60)), (13, prose(6, 50) + ".\n" + prose(4, 60)), (14, prose(3, 400)), (14, prose(3, 400)), (None, prose(7, 30)), (16, "a" * 300),
    ]
    data = [(i, t, "en", "s1" if i and i % 3 else None, len(t or ""), "x", 0, 1, "y", 2.0) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, row string, same int, copy int, shuffle_key string, score double")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}
