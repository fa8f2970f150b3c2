import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture
def docs_of(spark):
    """Documents from texts, or from (id, text) pairs, beside columns with clashing names."""

    def build(*texts, extra=True):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        if not extra:
            return spark.createDataFrame(rows, "doc_id long, text string")
        rows = [(*row, "a", "b", 1, 2, "c") for row in rows]
        return spark.createDataFrame(
            rows,
            "doc_id long, text string, row string, digest string, place long, size long, source string",
        )

    return build
