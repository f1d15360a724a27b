"""Brand families: the set of legal entities that share a brand, with evidence, instead of one winner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions import names

from .matching import build_index, build_queries, search
from .relational import cut_lineage, tasks, union_by_name


def discover_family(queries: DataFrame, register: DataFrame, relationships: DataFrame | None = None, index: DataFrame | None = None, pool_size: int = 100, key: str = "query_id") -> DataFrame:
    """Members of each query's family (query_id, name, country?): lei, tier (high, possible), role, graph_confirmed.

    The pool is what a search for the brand finds; an active relationship between two of its members confirms both.
    """
    asked = cut_lineage(queries.withColumn("brand", names.brand_core("name")))
    country = "country" if "country" in asked.columns else None
    records = build_queries(asked.withColumn("brand_name", F.col("brand")), "brand_name", country, key=key)
    pool = cut_lineage(search(records, register, build_index(register) if index is None else index, pool_size))
    # the same names are found by many queries; each loses its tail once
    brands = pool.select("legal_name").distinct().repartition(tasks(pool), "legal_name").withColumn("brand_core", names.brand_core("legal_name"))
    pool = pool.join(asked.select(F.col(key).alias("query_id"), "brand"), "query_id").join(cut_lineage(brands), "legal_name")
    tier = names.brand_tier("brand", "brand_core")
    role = names.guess_role("legal_name_norm", "fund_number", "is_master", "is_feeder")
    members = pool.withColumn("tier", tier).where("tier IS NOT NULL").select("query_id", "lei", "legal_name", "jurisdiction", "brand_core", "tier", role.alias("role"), "retrieval_rank")
    if relationships is None:
        return members.withColumn("graph_confirmed", F.lit(False))
    members = cut_lineage(members)
    sure = family_evidence(members, relationships)
    confirmed = union_by_name([sure.select("query_id", F.col(end).alias("lei")) for end in ("start_node_id", "end_node_id")]).distinct().withColumn("graph_confirmed", F.lit(True))
    return members.join(confirmed, ["query_id", "lei"], "left").withColumn("graph_confirmed", F.coalesce("graph_confirmed", F.lit(False)))


def family_evidence(members: DataFrame, relationships: DataFrame) -> DataFrame:
    """Active relationships of which both ends are members of the same query's family."""
    active = relationships.where("relationship_status = 'ACTIVE'")
    ends = members.select("query_id", "lei")
    out = active.join(ends.select("query_id", F.col("lei").alias("start_node_id")), "start_node_id")
    return out.join(ends.select("query_id", F.col("lei").alias("end_node_id")), ["query_id", "end_node_id"]).select("query_id", "start_node_id", "end_node_id", "relationship_type", "relationship_status")
