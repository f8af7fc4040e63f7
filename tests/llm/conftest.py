import pytest

SCHEMA = "doc_id long, text string, hash string, size int, node long, key long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with extra columns whose names operators use inside, from {doc_id: text} or a list of pairs."""

    def make(rows):
        rows = rows.items() if isinstance(rows, dict) else rows
        return spark.createDataFrame([(i, t, "h", 1, 2, 3) for i, t in rows], SCHEMA)

    return make


WORDS = "amber birch cedar delta ember flint grove hazel indigo juniper kelp lotus maple nectar olive pearl quartz raven sage tulip umber violet willow yarrow zinnia".split()


@pytest.fixture(scope="session")
def prose():
    """Random text of n words, the same for the same seed."""
    import random

    def make(seed, n, stop=0):
        r = random.Random(seed)
        words = [r.choice(WORDS) + r.choice("aeiou") + str(r.randint(0, 30)) for _ in range(n)]
        return " ".join(w + "." if stop and k % stop == stop - 1 else w for k, w in enumerate(words))

    return make
