"""Every query with SQL gives what DuckDB gives; every other one runs; plans hold no products of tables."""

from __future__ import annotations

import os

import pytest

from kinfold.plans.queries import ORACLES, QUERIES

from .oracle import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    names, rows = spark_rows(QUERIES[name](spark, sf_dir))
    expected_names, expected = duck_rows(ORACLES[name], sf_dir)
    assert names == expected_names
    assert len(rows) == len(expected)
    for a, b in zip(rows, expected, strict=True):
        assert a == pytest.approx(b, abs=1e-6) if all(isinstance(x, (int, float)) for x in a) else a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= 0


#: These join single-row tables on purpose, or bind one row a query.
ONE_ROW = {"referential_coverage"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ONE_ROW))
def test_plan_has_no_product(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not any(x in plan for x in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"))


def test_reachability_from_every_entity(spark, sf_dir):
    from kinfold.plans.base import register
    from kinfold.plans.queries import catalog

    steps = {}
    for r in catalog(spark, sf_dir)["gleif_relationships"].where("relationship_status = 'ACTIVE'").collect():
        steps.setdefault(r["start_node_id"], set()).add(r["end_node_id"])
    expected = set()
    for (root,) in register(spark, sf_dir).select("lei").collect():
        hops, front = {root: 0}, {root}
        for hop in range(1, 5):
            front = {b for a in front for b in steps.get(a, ())} - hops.keys()
            hops |= dict.fromkeys(front, hop)
        expected |= {(root, node, n) for node, n in hops.items()}
    got = [(r["root"], r["node"], r["hops"]) for r in QUERIES["recursive_reachability"](spark, sf_dir).collect()]
    assert len(got) == len(expected) and set(got) == expected
    assert len({x[0] for x in got}) == register(spark, sf_dir).count()


def test_evaluation_takes_the_default_sample(spark):
    from kinfold.config import Benchmark
    from kinfold.operators import evaluation
    from kinfold.plans.queries import catalog, register

    sf_dir = "/root/testdata/sf0.01"
    if not os.path.isdir(sf_dir):
        pytest.skip("no test data")
    entries = register(spark, sf_dir)
    positives = evaluation.positives(entries, catalog(spark, sf_dir)["isin_lei"])
    expected = evaluation.evaluation_pairs(positives, evaluation.confusable_pairs(entries), Benchmark()).count()
    assert QUERIES["evaluation_pairs"](spark, sf_dir).count() == expected > 120


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and df.schema["top"].dataType.typeName() == "array"
