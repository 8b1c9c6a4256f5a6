import random

import pytest

ODD = [None, "", " ", "\n\n", "a", "a", "a b", "A  B c d", "x" * 30_000, "word " * 3_000, "é \U0001f600 \x00\x1c\x85 end", "1234 5678 9012 3456", "<|endoftext|> <|end"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [(i, t, "en", "s%d" % (i % 3) if i % 4 else None, None) for i, t in enumerate(ODD)]
    rows += [(None, "null id", None, None, 3), (None, None, None, None, None), rows[6], rows[6], (2, "same id, other text", "en", "s1", 5)]
    rows = [(*r, "clash", 1, b"x") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, failures int, raw binary").repartition(3)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def save(spark, tmp_path):
    """Writes a table as documents (or another name) of a fresh folder and gives the folder."""

    def write(df, name="documents"):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


@pytest.fixture
def prose():
    """A maker of random texts."""
    r = random.Random(5)
    words = ["".join(r.choice("aeinorst") for _ in range(r.randint(1, 7))) for _ in range(400)]

    def make(n, seed=None):
        q = random.Random(seed) if seed is not None else r
        return " ".join(q.choice(words) for _ in range(n))

    return make
