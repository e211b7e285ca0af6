from __future__ import annotations

import pytest


@pytest.fixture
def documents(spark):
    """Makes a documents table of (doc_id, text) rows, with extra columns whose names operators use inside."""

    def make(rows, **more):
        full = [(i, t, "en", more.get("source", "s"), len(t) if t is not None else None, "x", 1) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, digest string, row int")

    return make
