import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def texts(spark):
    """Rows with nulls, empty and long texts, ties, repeated rows and a clashing extra column."""
    words = " ".join(f"w{i % 97}x{i // 7}" for i in range(4000))
    rows = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa."), (2, None), (3, ""), (4, words), (5, "Alpha beta gamma delta epsilon zeta eta theta iota kappa."), (5, "Alpha beta gamma delta epsilon zeta eta theta iota kappa."), (6, " \n\t "), (7, "Één naïve test <|endoftext|> 日本 🙂"), (None, "no key here at all")]
    return spark.createDataFrame([(k, t, "x", 0) for k, t in rows], "doc_id long, text string, _key string, n int")


@pytest.fixture
def no_texts(texts):
    return texts.limit(0)
