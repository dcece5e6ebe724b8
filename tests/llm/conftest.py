from __future__ import annotations

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Makes a documents table of texts; doc_ids count from 1 unless pairs are given."""

    def make(texts, lang="en"):
        rows = [x if isinstance(x, tuple) else (k, x) for k, x in enumerate(texts, 1)]
        return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in rows], DOCS)

    return make
