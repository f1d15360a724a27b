"""python -m kinfold.cli COMMAND --data FOLDER ...: the library's entry points over a folder of Parquet tables."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from kinfold.catalog import Catalog
from kinfold.operators import entities, evaluation, family, graph, hierarchy, matching, reads, reports, serving
from kinfold.operators.publication import Publisher
from kinfold.session import get_spark


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinfold", description=__doc__)
    p.add_argument("--data", required=True)
    commands = p.add_subparsers(dest="command", required=True)
    named = {}
    for name in ("match", "search", "family"):
        c = named[name] = commands.add_parser(name)
        c.add_argument("--name", required=True)
        c.add_argument("--country")
    for name in ("match", "search"):
        named[name].add_argument("--country-mode", choices=["soft", "strict"], default="soft")
    for option in ("--postcode", "--city", "--registration-id"):
        named["match"].add_argument(option)
    named["search"].add_argument("--size", type=int, default=10)
    c = commands.add_parser("hierarchy")
    c.add_argument("--lei", required=True)
    c.add_argument("--direction", choices=["parents", "children", "all"], default="all")
    c.add_argument("--depth", type=int, default=1)
    c = commands.add_parser("entity")
    c.add_argument("--lei", required=True)
    for name in ("validate", "benchmark", "build-entities", "build-graph", "crosswalk"):
        commands.add_parser(name)
    c = commands.add_parser("publish")
    c.add_argument("--to", required=True)
    c.add_argument("--only", nargs="*")
    c.add_argument("--rollback")
    return p


def show(df) -> None:
    for row in df.toJSON().toLocalIterator():
        print(row)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = get_spark(app="kinfold")
    c = Catalog(spark, a.data)
    one = lambda: spark.createDataFrame([("q", a.name, a.country, getattr(a, "postcode", None), getattr(a, "city", None), getattr(a, "registration_id", None))], "query_id string, name string, country string, postcode string, city string, registration_id string")
    if a.command == "match":
        asked = matching.build_queries(one(), "name", "country", "postcode", "city", "registration_id")
        show(matching.match_batch(asked, c["gleif_entities"], country_mode=a.country_mode))
    elif a.command == "search":
        asked = matching.build_queries(one(), "name", "country")
        show(matching.search(asked, c["gleif_entities"], matching.build_index(c["gleif_entities"]), a.size, a.country_mode).orderBy("retrieval_rank"))
    elif a.command == "family":
        show(family.discover_family(one(), c["gleif_entities"], c.get("gleif_relationships")).orderBy("tier", "retrieval_rank"))
    elif a.command == "hierarchy":
        from dataclasses import asdict

        print(json.dumps(asdict(hierarchy.hierarchy_tree(c["gleif_relationships"], c["entities"], a.lei, a.depth, a.direction)), indent=1))
    elif a.command == "entity":
        show(reads.entity_profile(serving.entity_documents(c), serving.filer_documents(c), serving.nport_fund_documents(c), a.lei))
    elif a.command == "validate":
        report, code = reports.validation_report(c)
        reports.write_json(report, sys.stdout)
        return code
    elif a.command == "benchmark":
        found, hard = evaluation.positives(c["gleif_entities"], c["isin_lei"]), evaluation.confusable_pairs(c["gleif_entities"])
        for name, df in (("positives", found), ("hard_negatives", hard), ("evaluation_pairs", evaluation.evaluation_pairs(found, hard))):
            c.write(name, df)
    elif a.command == "build-entities":
        c.write("entities", entities.build_entities(c["gleif_entities"]))
        if (ids := entities.build_identifiers(c)) is not None:
            c.write("entity_identifiers", ids)
    elif a.command == "build-graph":
        for kind, df in graph.build_graph(c).items():
            c.write(f"knowledge_{kind}", df)
    elif a.command == "crosswalk":
        c.write("crosswalk_sec_13f_gleif", matching.crosswalk(c["sec_13f_filings"].where(F.col("cik").isNotNull()), c["gleif_entities"]))
    elif a.rollback:
        Publisher(spark, a.to).rollback(a.rollback)
    else:
        print(Publisher(spark, a.to).publish(c, serving.BUILDERS, a.only))
    return 0


if __name__ == "__main__":
    sys.exit(main())
