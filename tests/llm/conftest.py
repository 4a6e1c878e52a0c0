import pytest


@pytest.fixture(scope="session")
def rows(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows, and columns whose names clash with the operators'."""
    from pyspark.sql import Row

    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(6000))
    texts = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base + " tail", "en", None), (4, None, None, "b"), (5, "", "de", "b"),
        (6, "  \n\t ", None, "b"), (7, "12 34 !!", "en", "c"), (8, long, "fr", "c"), (9, long + " more words here", "fr", "c"),
        (10, "Prefix " + base.upper() + " suffix", "en", "a"), (11, "a b c", "en", None), (11, "a b c", "en", None),
        (None, base, "en", "a"), (None, "only here été naïve", "fr", "d"), (12, "x " * 400, "en", "d"), (13, "é" * 300, "fr", "d"),
    ]
    made = [Row(doc_id=i, text=t, lang=g, source=s, n_chars=len(t or ""), score=0.5, size=7, g=3, bucket=1, h=9, part=2) for i, t, g, s in texts]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, score double, size int, g int, bucket int, h long, part int")


@pytest.fixture(scope="session")
def none(rows):
    return rows.where("false")
