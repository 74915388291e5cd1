"""Small tables in the shape of documents, and the driver's tables at the smallest size."""

from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A function that makes a documents table from (doc_id, text) or (doc_id, text, source) rows, with columns that clash."""

    def make(rows, extra: bool = True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "web", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if extra:  # names that the operators use for columns of their own
            df = df.selectExpr("*", "'x' as size", "'y' as score", "7 as component_id", "'z' as kept", "'s' as spans", "'t' as n_tokens", "'b' as block", "'n' as node", "'l' as label")
        return df

    return make


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
