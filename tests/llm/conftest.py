import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, key string, at long, n long, id long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    rows = [
        (1, "a b c d e f g\nsecond line here\nthird line is here\nfourth line too", "en", "src1"), (2, "a b c d e f g\nsecond line here\nthird line is here\nfourth line too", "en", "src1"),
        (3, None, None, None), (4, "", "de", "src2"), (5, " \n \t ", "fr", None), (6, long, "en", "src0"), (7, long, "en", "src0"), (7, long, "en", "src0"), (None, "no id at all", None, "src3"), (8, "x" * 3000, "es", "src2"),
        (9, "word " * 60, "en", "src1"), (10, "日本語 テキスト 𝄞 ümläut\n\n  two  spaces ", "ja", "src1"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), "h", "k", 1, 2, 3) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
