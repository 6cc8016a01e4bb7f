import pytest

LOREM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def words(n: int, seed: int = 0) -> str:
    """n words that differ by seed."""
    return " ".join(f"{LOREM[(i * 7 + seed * 3) % len(LOREM)]}{(i * 31 + seed * 17) % 97}" for i in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows of every awkward kind: nulls, empty and long texts, repeated rows and ids, clashing columns."""
    rows = [
        (1, "Hello world\nsecond line", "en", 0.1), (2, "Hello world\nsecond line", "en", 0.2), (2, "Hello world\nsecond line", "en", 0.2), (3, "", None, None), (4, None, "fr", None),
        (5, words(400, 1), "en", None), (6, words(400, 1), "en", None), (7, words(400, 1).replace("alpha", "omega", 3), "en", None), (8, "x" * 50_000, "de", None),
        (9, "Été À la plage", "fr", None), (None, "no id", "en", None), (10, "tab\there\r\n\n!!!", None, None), (11, "😀 emoji   separators", "en", None), (2, "other text of the same id", "en", None),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double")
    from pyspark.sql import functions as F

    return df.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long"), "th": F.lit(1), "node": F.lit("n"), "ids": F.lit("i"), "_id": F.lit(0), "word": F.lit("w"), "kept_text": F.lit("k")})
