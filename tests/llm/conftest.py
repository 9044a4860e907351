import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of amber basin copper delta ember fjord garnet harbor island jasper kelp lagoon meadow nectar orchid prairie quartz river summit tundra umber valley willow yonder zephyr".split()


def prose(seed, n):
    """Words that differ by seed; deterministic."""
    x, found = seed * 2654435761 + 12345, []
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        found.append(WORDS[(x >> 33) % len(WORDS)] + ("s" if (x >> 50) % 5 == 0 else "") + str((x >> 40) % 50 if (x >> 55) % 3 == 0 else ""))
    return " ".join(found)


@pytest.fixture(scope="session")
def docs(spark):
    def make(rows):
        """Rows of doc_id and text, with source if given."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd(docs):
    """Nulls, empty and long texts, ties, repeated rows."""
    return [(1, None), (2, ""), (3, "   \n\t"), (None, "a lonely row of words"), (4, prose(1, 40)), (5, prose(1, 40)), (5, prose(1, 40)), (6, "é" * 30), (7, prose(2, 4000)), (8, "x"), (4, prose(3, 30))]
