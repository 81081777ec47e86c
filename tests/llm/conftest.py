import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text) or longer rows."""

    def build(rows, schema=DOCS):
        full = [tuple(r) + ("en", "s", len(r[1] or ""))[len(r) - 2 :] if len(r) < 5 else r for r in rows]
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture
def vocabulary():
    rng = random.Random(7)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(600)]
