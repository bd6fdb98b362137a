import pytest

from tsweave.llm.queries import table

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon".split()
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, row_key string, score string, kept string, evidence string"


def prose(seed: int, n: int) -> str:
    """Words from a fixed recurrence, so that texts differ and stay the same between runs."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + "abcdefghij"[(x >> 16) % 10])
    return " ".join(out)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from ``(doc_id, text)`` or longer tuples, with columns whose names clash with the operators' own."""

    def make(rows):
        full = [(*r, *(None, "en", "src", 0)[len(r) - 1 :])[:5] for r in rows]
        full = [(r[0], r[1], r[2] or "en", r[3] or "src", 0, "x", "y", "z", "w") for r in full]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and very long texts, repeated rows and ids."""
    long = prose(5, 30_000)
    same = prose(1, 60)
    return make_docs(
        [(1, same), (1, same), (1, prose(2, 60)), (None, same), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, "one"), (7, "éß 語\n\né")]
    )


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (None, 1, 0), (3, None, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def small(spark, folder):
    return lambda name: table(spark, folder, name)
