import random

import pytest

WORDS = "alpha beta gamma delta river stone house light paper wind cloud green seven music table glass north garden silver window market island".split()


@pytest.fixture
def prose():
    """Random sentences, the same for a seed."""

    def make(seed: int, count: int, lines: int = 3) -> str:
        r = random.Random(seed)
        each = max(1, count // lines)
        return "\n".join(" ".join(r.choice(WORDS) + r.choice(["", "s", "ed", str(r.randrange(1000))]) for _ in range(each)) for _ in range(lines))

    return make


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def docs(spark):
    return lambda rows: docs_of(spark, rows)
