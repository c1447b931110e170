import pytest

LONG = " ".join(f"word{i % 5000} of the long text" for i in range(40_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with results and temporaries."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "b"), (2, None, "en", "a"), (3, "", None, None),
        (4, " \t\n", "en", "a"), (5, LONG, "en", "c"), (6, "one two three", "de", None), (6, "one two three", "de", None),
        (None, "the quick brown fox jumps over the lazy dog", "en", "a"), (None, None, None, None),
        (7, "The Quick brown fox jumps over the lazy dog", "en", "b"), (8, "!!! ??? ***", "fr", "b"), (-9, "é ü ñ 日本語 \u0000 x", "es", ""),
    ]
    clash = ", ".join(f"{n} string" for n in ("score", "held_out", "predicted", "size", "position", "node", "key", "label",
                                              "component_id", "part", "rejected", "lang_pred", "taken", "license", "cluster"))
    return spark.createDataFrame([(*r, *["x"] * 15) for r in rows], f"doc_id bigint, text string, lang string, source string, {clash}")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, None), (3, 1, 1), (5, 0, 1), (None, 1, 1), (99, 0, 1), (6, 1, 0), (8, 0, 1)],
                                 "doc_id bigint, quality int, toxic int")
