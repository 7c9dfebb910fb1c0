import random

import pytest

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gram string, spans string, score double, _text string"


def words(rng, count, stock=None):
    stock = stock or ["".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    return " ".join(rng.choice(stock) for _ in range(count))


def corpus():
    """Odd rows: nulls, empty and long texts, copies, near copies, repeated and clashing rows."""
    rng = random.Random(5)
    stock = ["".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    base, passage = words(rng, 120, stock), words(rng, 60, stock)
    texts = [None, "", " \t\n", "one", "One  ONE\none", "é😀 ü", base, base.replace(" ", "\n"), base + " more", base.upper()]
    for k in range(25):  # near copies of one text, most within reach of some, not of all
        parts = base.split()
        for _ in range(k // 3):
            parts[rng.randrange(len(parts))] = rng.choice(stock)
        texts.append(" ".join(parts))
    texts += [words(rng, rng.randint(1, 80), stock) for _ in range(30)]
    texts += [words(rng, 20, stock) + " " + passage + " " + words(rng, 20, stock) for _ in range(8)]
    texts += ["ab" * 300, "x" * 4000, words(rng, 6000, stock)]
    texts += ["password: hunter22 token=abc", "key AKIA" + "Q1" * 8 + " " + "0af9" * 8, "secret=token: abcdefgh"]
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, base), (None, "no id " + passage), (8, "same id, another text"), (7, "same id, another text")]
    return [(i, t, ["en", "de", None][k % 3], "s", None, "x", "y", 0.5, "z") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def odd_rows():
    return corpus()


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
