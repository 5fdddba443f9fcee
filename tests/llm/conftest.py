import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
EXTRA = ["key", "_key", "doc", "copies", "score", "predicted", "node", "sha", "n", "_row", "size", "target", "taken", "words"]


@pytest.fixture
def make(spark):
    def build(rows, extra=False):
        full = [(i, text, "en", source, None if text is None else len(text)) for i, text, source in ((*r, "s")[:3] for r in rows)]
        table = spark.createDataFrame(full, SCHEMA)
        return table.selectExpr("*", *(f"'x{k}' AS `{name}`" for k, name in enumerate(EXTRA))) if extra else table

    return build


@pytest.fixture(scope="session")
def words():
    """A text of ``n`` pseudo-random words."""
    import random

    def text(n, seed):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))

    return text
