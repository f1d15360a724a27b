from __future__ import annotations

import pytest

from kinfold.llm.queries import ORACLES, QUERIES

from ..oracle import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == duck_rows(ORACLES[name], sf_dir)


TABLE = {"op2_html_text": "pages", "op3_url_filter": "pages"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_one_row_for_each_of_the_table(spark, sf_dir, name):
    table = spark.read.parquet(f"{sf_dir}/{TABLE.get(name, 'documents')}.parquet")
    df = QUERIES[name](spark, sf_dir)
    assert df.count() == table.count() and df.columns[0] in ("doc_id", "page_id")
