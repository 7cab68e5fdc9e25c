from __future__ import annotations

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """documents([(id, text), (id, text, lang, source), ...]) as a DataFrame."""

    def make(rows, schema=DOCUMENT):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture
def awkward(spark):
    """Nulls in every column, empty and blank and very long texts, ties and repeated
    rows, and extra columns whose names operators use inside."""
    long_text = " ".join(f"w{i * i % 7919}" for i in range(60_000))
    base = "the same words stand here in the same order for a whole while and then some more of them follow after that again"
    rows = [
        (1, base, "en", "a"), (1, base, "en", "a"), (2, base, None, "a"), (3, None, "en", None), (4, "", None, None),
        (5, " \t\n ", "en", "b"), (6, long_text, "en", "b"), (7, long_text + " tail", "en", "b"), (None, base + " x", "en", "a"), (None, None, None, None),
        (8, "one", "fr", "c"), (9, "ÉÀ ünï 😀 code \x00 point", "fr", "c"), (10, "a b", "fr", "c"),
    ]
    extra = "n_words long, component_id long, copies string, kept boolean, key binary, cell long, _doc string, token double"
    return spark.createDataFrame([(*r, None, 7, -1, "x", None, b"k", 3, "d", 0.5) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
