from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empty and blank texts, ties, repeated rows and ids, a long text.
TEXTS = [
    (1, "one two three four five six seven eight nine ten"),
    (2, "one two three four five six seven eight nine ten"),
    (2, "one two three four five six seven eight nine ten"),
    (2, "another text under the same id"),
    (3, ""),
    (4, None),
    (None, "a text without an id"),
    (None, None),
    (5, " \t\n\r \x0b\x0c"),
    (6, "ÄÖ naïve word gap 漢字 👩‍👧"),
    (7, " ".join(f"w{k % 977}" for k in range(30_000))),
    (8, "x"),
    (-9, "one two\nthree four\n\none two\n"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with columns whose names results use as well."""
    rows = [(i, t, "en", None if k % 3 == 0 else f"s{k % 3}", None, "x", 1.5) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA + ", n_words string, score double")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
