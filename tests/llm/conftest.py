import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid long, score double, shard int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names operators use."""
    long_text = " ".join(f"w{i % 997}x{i % 89}" for i in range(30_000))
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
    rows = [
        (1, base), (2, base), (2, base), (3, base + " upsilon"), (4, None), (5, ""), (6, "  \n\t "), (None, base), (None, None),
        (7, long_text), (8, "one two"), (9, "one two"), (10, "a line here\nanother line\nthird\n\nx"), (11, "q\na line here\nanother line\nthird"), (12, "Ünï çödé 例え テスト <|endoftext|> it's"), (13, "é" * 50),
    ]
    return spark.createDataFrame([(d, t, "en" if d else None, "s", None, 7, 0.1, 3) for d, t in rows], DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
