import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and odd columns."""
    import random

    r = random.Random(7)
    texts = [" ".join(r.choices(WORDS, k=r.randint(1, 60))) for _ in range(40)]
    rows = [(i, t, "en", f"src{i % 5 if i % 3 else 0}", len(t), "x") for i, t in enumerate(texts)]
    rows += [(100, None, None, None, None, None), (101, "", "en", "src1", 0, ""), (102, texts[3], "en", "src2", 1, ""), (102, texts[3], "en", "src2", 1, "")]
    rows += [(None, texts[4], "de", "src3", 2, ""), (None, "only here", None, "src3", 2, ""), (103, " ".join(r.choices(WORDS, k=30_000)), "en", "src4", 3, "")]
    rows += [(104, "Ünï © Çödé tail \x1c sep <|endoftext|>  two", "fr", "src4", 3, ""), (105, texts[5] + " changed", "en", "src1", 3, "")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, piece string")


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)
