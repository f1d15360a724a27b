from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns whose names the operators use themselves."""

    def make(texts, start=1):
        rows = [(*(t if isinstance(t, tuple) else (start + i, t)), "en" if i % 2 else None, f"s{i % 3}", None) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


CLASHES = "unit id g bucket hash ids gaps spans window items kept score key u v c n text_hash lines words held bands label toxicity decoded verdict rule host path html range prints".split()


@pytest.fixture(scope="session")
def clash():
    """df with more columns, named as the operators name theirs."""
    from pyspark.sql import functions as F

    return lambda df: df.withColumns({c: F.lit("x") for c in CLASHES if c not in df.columns})
