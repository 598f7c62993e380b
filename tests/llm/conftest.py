import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


#: doc_id, text, lang, source, n_chars, and columns whose names operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, h long, `count` int, path string"


def rows_of(texts):
    return [(k, t, None if k % 4 == 3 else "en", [None, "b", "a"][k % 3], None if t is None else len(t), "x", 1, 2, None, "p") for k, t in texts]


@pytest.fixture(scope="session")
def texts():
    """Texts with nulls, blanks, repeats, near copies, a long one and unusual signs."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    out = [base, base, " ".join(near), None, "", "  \n", "one two", prose(2, 20_000), "A\x1cB \x85 é字\U0001f600 'll <|endoftext|> ▁ \x00 x" * 3, base.upper(), prose(3, 4), prose(4, 5)]
    return list(enumerate(out + [prose(k, 30 + k) for k in range(10, 40)]))


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts) + rows_of(texts[:2]), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
