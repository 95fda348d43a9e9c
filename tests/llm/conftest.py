from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, h1 string, position int"


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang); further columns have names that operators use inside."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, len(r[1] or ""), 7, "x", 1) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def prose():
    """A maker of invented sentences."""

    def make(seed: int, n: int) -> str:
        r = random.Random(seed)
        parts = ["an", "er", "th", "ou", "in", "le", "st", "é", "ö", "ing"]
        return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def corpus(prose):
    """Null, empty, short, long and repeated texts, copies, near copies, shared passages."""
    base = [prose(k, 60) for k in range(12)]
    shared = prose(99, 40)
    near = base[3].split()
    near[30] = "changed"
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(20, base[0]), (21, base[0]), (22, " ".join(near)), (23, base[5] + "\n" + shared), (24, shared + "\n" + base[6]), (25, None), (26, ""), (27, " \t\n"), (28, "one"), (29, "A b c"), (30, "a B C")]
    rows += [(31, prose(7, 4000)), (32, prose(8, 50) + " " + prose(8, 50)), (33, "x" * 5000), (1, base[1]), (None, base[2]), (None, None), (None, prose(50, 50))]
    return rows
