"""Canonical entities and their identifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.catalog import Catalog

from .relational import union_by_name

#: Columns of an entity by the register's names.
ENTITY_COLUMNS = {
    "entity_id": "lei", "primary_lei": "lei", "canonical_name": "legal_name", "entity_type": "entity_category", "jurisdiction": "jurisdiction", "legal_country": "legal_country",
    "entity_status": "entity_status", "entity_creation_date": "entity_creation_date", "initial_registration_date": "initial_registration_date", "last_update_date": "last_update_date",
    "next_renewal_date": "next_renewal_date", "registration_status": "registration_status", "gleif_snapshot_date": "snapshot_date",
}


def build_entities(register: DataFrame) -> DataFrame:
    return register.select(*[F.col(old).alias(new) for new, old in ENTITY_COLUMNS.items()])


def _identifiers(t: DataFrame, kind: str, value: str, confidence: str, source: str, key: str = "lei") -> DataFrame:
    return t.select(F.col(key).alias("entity_id"), F.expr(kind).alias("identifier_type"), F.col(value).alias("identifier_value"), F.expr(confidence).alias("confidence"), F.lit(source).alias("source"), "source_file", "snapshot_date", "ingested_at")


def isin_identifiers(c: Catalog) -> DataFrame | None:
    t = c.get("isin_lei")
    return None if t is None else _identifiers(t, "'ISIN'", "isin", "'SOURCE'", "gleif_isin")


def mapping_identifiers(c: Catalog) -> DataFrame | None:
    t = c.get("gleif_external_identifiers")
    return None if t is None else _identifiers(t, "identifier_type", "identifier_value", "'SOURCE'", "gleif_mapping")


def crosswalk_identifiers(c: Catalog) -> DataFrame | None:
    """CIKs that were matched, also those left to review."""
    t = c.get("crosswalk_sec_13f_gleif")
    return None if t is None else _identifiers(t.where("lei IS NOT NULL AND decision IN ('AUTO_MATCH', 'REVIEW')"), "'CIK'", "cik", "decision", "sec_13f_crosswalk")


#: Sources of identifiers; a new one is a function here.
IDENTIFIER_SOURCES: list[Callable[[Catalog], DataFrame | None]] = [isin_identifiers, mapping_identifiers, crosswalk_identifiers]


def build_identifiers(c: Catalog) -> DataFrame | None:
    found = [t for source in IDENTIFIER_SOURCES if (t := source(c)) is not None]
    return union_by_name(found) if found else None
