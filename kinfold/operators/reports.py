"""Reports that leave the engine: validation with its exit code, evaluation, JUnit, reviews as CSV."""

from __future__ import annotations

import csv
import json
from collections.abc import Mapping
from typing import TextIO
from xml.etree import ElementTree

from pyspark.sql import DataFrame

from kinfold.catalog import Catalog

from . import evaluation

#: Checks that must be zero.
HARD = {"malformed_lei", "duplicate_lei", "missing_name", "malformed_isin"}


def validation_report(c: Catalog) -> tuple[dict, int]:
    """Figures of each table there is, and 1 if a hard check failed, else 0."""
    out: dict[str, dict] = {}
    entities = c.get("gleif_entities")
    if entities is not None:
        out["gleif_entities"] = {r["check"]: r["value"] for r in evaluation.validate_entities(entities).collect()}
        for name, check in (("gleif_relationships", evaluation.validate_relationships), ("gleif_relationship_exceptions", evaluation.validate_exceptions), ("isin_lei", evaluation.validate_isins)):
            if name in c:
                out[name] = check(c[name], entities).first().asDict()
    failed = any(v for t in out.values() for k, v in t.items() if k in HARD)
    return out, int(failed)


def evaluation_report(rows: DataFrame, slices: tuple[str, ...] = ("difficulty", "case_type", "conflict_type")) -> dict:
    """Metrics over all rows and by each slice, and the shares of failure categories."""
    out = {"overall": evaluation.metrics(rows).first().asDict(), "failures": {r["category"]: r["share"] for r in evaluation.failure_breakdown(rows).collect()}}
    for s in slices:
        if s in rows.columns:
            out[s] = {str(r[s]): {k: v for k, v in r.asDict().items() if k != s} for r in evaluation.metrics(rows, [s]).collect()}
    return out


def junit(cases: Mapping[str, Mapping[str, str]], name: str = "answers") -> str:
    """JUnit XML of cases, each with its failed checks."""
    suite = ElementTree.Element("testsuite", name=name, tests=str(len(cases)), failures=str(sum(bool(f) for f in cases.values())))
    for case, failed in cases.items():
        node = ElementTree.SubElement(suite, "testcase", name=case, classname=name)
        for check, message in failed.items():
            ElementTree.SubElement(node, "failure", message=f"{check}: {message}")
    return ElementTree.tostring(suite, encoding="unicode")


def export_reviews(reviews: DataFrame, out: TextIO) -> int:
    """Reviews in a fixed order, a line each; people write them, so they are few."""
    columns = ["node_id", "lei", "outcome", "reviewer", "reviewed_at", "rationale"]
    writer = csv.writer(out)
    writer.writerow(columns)
    n = 0
    for r in reviews.select(*columns).orderBy(*columns).toLocalIterator():
        writer.writerow([x if x is not None else "" for x in r])
        n += 1
    return n


def write_json(value: dict, out: TextIO) -> None:
    json.dump(value, out, indent=1, sort_keys=True, default=str)
