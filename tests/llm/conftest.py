import pytest

from quillgraph.llm import common


@pytest.fixture(scope="session", autouse=True)
def tuned(spark):
    common.tune(spark)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy string, row string, fp string, label int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows and ids, and columns of clashing names."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    texts = ["", " ", None, "a", "Ä ß ü", "the quick brown fox jumps over the lazy dog " * 3, "the quick brown fox jumps over the lazy dog " * 3, long, long + " end", "\x00\x01 \n\n", "👍" * 40, "x" * 500]
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 2 else None, None if t is None else len(t), "c", "r", "f", i) for i, t in enumerate(texts)]
    rows += [rows[5], (5, "another text of the same id", "de", "t", 1, None, None, None, None), (None, "no id at all", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(8)] + [(None, 1, 1), (3, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
