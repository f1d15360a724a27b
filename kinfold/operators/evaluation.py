"""A labelled benchmark made from the register, quality metrics over its rows, and validation of source tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.config import Benchmark
from kinfold.functions import names
from kinfold.functions.places import is_isin, is_lei

from .relational import cut_lineage, null_rates, sample, sample_per_group, surplus_rows, text_hash, union_by_name


def positives(register: DataFrame, isins: DataFrame) -> DataFrame:
    """Entities with a security, their least ISIN and how many they have."""
    held = isins.groupBy("lei").agg(F.min("isin").alias("sample_isin"), F.count("isin").alias("isin_count"))
    return register.select("lei", "legal_name", "legal_name_norm", "legal_name_core", "jurisdiction", "legal_country", "entity_status").join(held, "lei")


def confusable_pairs(register: DataFrame, cfg: Benchmark | None = None) -> DataFrame:
    """Pairs of entities alike but for a number or structure, in groups of 2 to max_group.

    A pair is left out if a third entity bears the stripped name itself, as that would be the right answer. Group
    sizes are checked before the pairs are made, so their number is bounded by max_group for each entity.
    """
    cfg = cfg or Benchmark()
    rows = register.where("legal_name_core IS NOT NULL").select("lei", "legal_name_core", "jurisdiction", "fund_number", "is_master", "is_feeder", names.aggressive_core("legal_name_core").alias("aggressive_core"))
    rows = rows.where((F.col("aggressive_core") != "") & (names.word_count("aggressive_core") >= cfg.min_core_words))
    groups = rows.groupBy("aggressive_core").agg(F.count("*").alias("n")).where(F.col("n").between(2, cfg.max_group)).select("aggressive_core")
    rows = rows.join(groups, "aggressive_core").drop("legal_name_core")
    other = rows.select("aggressive_core", *[F.col(c).alias(f"{c}_b") for c in ("lei", "fund_number", "is_master", "is_feeder")])
    pairs = rows.join(other, "aggressive_core").where("lei < lei_b")
    conflict = F.when((F.col("fund_number") != F.col("fund_number_b")), "fund_number").when((F.col("is_master") != F.col("is_master_b")) | (F.col("is_feeder") != F.col("is_feeder_b")), "master_feeder").otherwise("other_same_core")
    bearers = register.select(F.col("legal_name_core").alias("_core"), F.col("lei").alias("_lei"))
    third = (F.col("_core") == F.col("aggressive_core")) & (F.col("_lei") != F.col("lei")) & (F.col("_lei") != F.col("lei_b"))
    return pairs.join(bearers, third, "left_anti").select(
        F.col("lei").alias("lei_a"), "lei_b", "aggressive_core", "jurisdiction", F.col("fund_number").alias("fund_number_a"), "fund_number_b", F.col("is_master").alias("is_master_a"), F.col("is_feeder").alias("is_feeder_a"), "is_master_b", "is_feeder_b", conflict.alias("conflict_type"),
    )


def name_variant(key: str, name: str, core: str) -> tuple[Column, Column]:
    """Query text and difficulty by a checksum of the key: the name, its core, or its core without spaces."""
    bucket = F.crc32(F.col(key).cast("binary")) % 3
    return F.when(bucket == 0, F.col(name)).when(bucket == 1, F.col(core)).otherwise(names.compact(core)), F.when(bucket == 0, "easy").otherwise("medium")


def evaluation_pairs(found: DataFrame, hard: DataFrame, cfg: Benchmark | None = None) -> DataFrame:
    """sample_size positives, capped by jurisdiction and topped up, and a fifth as many confusable pairs.

    Samples follow hashes of the keys, so they are the same on every run.
    """
    cfg = cfg or Benchmark()
    found = cut_lineage(found)  # read again for the number of jurisdictions, by both samples and by the rows
    n = max(1, found.select("jurisdiction").distinct().count())
    capped = sample_per_group(found, "jurisdiction", "lei", max(1, cfg.sample_size // n), cfg.seed).select("lei").withColumn("first", F.lit(0))
    rest = found.join(capped, "lei", "left_anti").select("lei").withColumn("first", F.lit(1))
    order = Window.orderBy("first", text_hash(F.lit(cfg.seed), "lei"), "lei")  # over one row an entity in the sample at most
    chosen = capped.unionByName(sample(rest, "lei", cfg.sample_size, cfg.seed).select("lei", "first"))
    chosen = chosen.orderBy("first", text_hash(F.lit(cfg.seed), "lei"), "lei").limit(cfg.sample_size).withColumn("i", F.row_number().over(order) - 1)
    query, difficulty = name_variant("lei", "legal_name", "legal_name_core")
    none = F.lit(None).cast("string")
    easy = found.join(F.broadcast(chosen), "lei").select(  # sample_size rows at most
        F.format_string("pos_%07d", "i").alias("pair_id"), query.alias("query_name"), F.col("legal_country").alias("query_country"), F.col("lei").alias("expected_lei"), none.alias("confusable_lei"),
        F.lit("isin_confirmed").alias("case_type"), difficulty.alias("difficulty"), none.alias("conflict_type"), F.lit("positives").alias("source"),
    )
    pairs = hard.withColumn("_key", F.concat("lei_a", "lei_b"))
    pairs = sample(pairs, "_key", max(1, cfg.sample_size // 5), cfg.seed).withColumn("i", F.row_number().over(Window.orderBy(text_hash(F.lit(cfg.seed), "_key"), "_key")) - 1)
    tough = pairs.select(
        F.format_string("neg_%07d", "i").alias("pair_id"), F.col("aggressive_core").alias("query_name"), F.col("jurisdiction").alias("query_country"), F.col("lei_a").alias("expected_lei"), F.col("lei_b").alias("confusable_lei"),
        F.lit("confusable_pair").alias("case_type"), F.lit("hard").alias("difficulty"), "conflict_type", F.lit("hard_negatives").alias("source"),
    )
    return easy.unionByName(tough).withColumn("query_name_norm", names.normalize_name("query_name"))


CATEGORIES = ["success", "retrieval_miss", "wrong_auto", "under_confident", "deferred"]


def outcomes(rows: DataFrame) -> DataFrame:
    """rows (expected, ranked: array of ids, decision, chosen) with rank, hit flags and failure category."""
    rank = F.nullif(F.array_position("ranked", F.col("expected")).cast("int"), F.lit(0))
    auto = F.col("decision") == "AUTO_MATCH"
    right = F.coalesce(F.col("chosen") == F.col("expected"), F.lit(False))
    out = rows.withColumns({"rank": rank, "auto": auto, "right": right})
    category = F.when(auto & right, "success").when(auto, "wrong_auto").when(F.col("rank").isNull(), "retrieval_miss").when(F.col("rank") == 1, "under_confident").otherwise("deferred")
    return out.withColumn("category", category)


def metrics(rows: DataFrame, by: Sequence[str] = (), k: int = 20) -> DataFrame:
    """Recall at k, top-1, MRR, decision rates, precision of automatic matches (null if none), coverage, dangerous rate."""
    done = outcomes(rows)
    share = lambda c: F.round(F.avg(c.cast("double")), 4)
    confused = F.coalesce(F.col("chosen") == F.col("confusable"), F.lit(False)) if "confusable" in rows.columns else F.lit(False)
    return done.groupBy(*by).agg(
        F.count("*").alias("n"),
        share(F.coalesce(F.col("rank") <= k, F.lit(False))).alias("recall"),
        share(F.coalesce(F.col("rank") == 1, F.lit(False))).alias("top1"),
        F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 4).alias("mrr"),
        share(F.col("auto")).alias("auto_rate"),
        share(F.col("decision") == "REVIEW").alias("review_rate"),
        F.round(F.avg(F.when(F.col("auto"), F.col("right").cast("double"))), 4).alias("auto_precision"),
        share(F.col("auto") & F.col("right")).alias("coverage"),
        share(F.col("auto") & (confused | ~F.col("right"))).alias("dangerous_rate"),
    )


def failure_breakdown(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of each category among all rows (of each slice); the shares add up to 1."""
    counts = outcomes(rows).groupBy(*by, "category").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    return counts.select(*by, "category", "n", F.round(F.col("n") / total, 4).alias("share"))


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def validate_entities(t: DataFrame) -> DataFrame:
    """(check, value): rows, malformed and duplicate keys, missing names, and the null rate of every column."""
    head = t.agg(F.count("*").alias("rows"), _count(~is_lei("lei")).alias("malformed_lei"), _count(F.coalesce(F.trim("legal_name"), F.lit("")) == "").alias("missing_name"), F.count_distinct("lei").alias("distinct_lei"))
    checks = head.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("double").alias("value")) for c in head.columns])).alias("c")).select("c.*")
    more = surplus_rows(t, ["lei"]).select(F.lit("duplicate_lei").alias("check"), F.col("duplicates").cast("double").alias("value"))
    nulls = null_rates(t).select(F.concat(F.lit("null_rate:"), "column_name").alias("check"), F.col("null_rate").alias("value"))
    return union_by_name([checks, more, nulls])


def coverage_of(t: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """(total, known, coverage): how many rows' key occurs among the parents."""
    ids = parents.select(F.col(parent_key).alias("_id")).where("_id IS NOT NULL").distinct()
    return t.join(ids, t[key] == ids["_id"], "left").agg(F.count("*").alias("total"), F.count("_id").alias("known"), F.round(F.try_divide(F.count("_id"), F.count("*")), 6).alias("coverage"))


def validate_relationships(t: DataFrame, entities: DataFrame) -> DataFrame:
    ends = union_by_name([t.select(F.col(c).alias("lei")) for c in ("start_node_id", "end_node_id")])
    return coverage_of(ends, "lei", entities, "lei").crossJoin(surplus_rows(t, ["start_node_id", "end_node_id", "relationship_type"]))  # one row each


def validate_exceptions(t: DataFrame, entities: DataFrame) -> DataFrame:
    return coverage_of(t, "lei", entities, "lei").crossJoin(surplus_rows(t, ["lei", "exception_category", "exception_reason"]))


def validate_isins(t: DataFrame, entities: DataFrame) -> DataFrame:
    bad = t.agg(_count(~is_isin("isin")).alias("malformed_isin"))
    return coverage_of(t, "lei", entities, "lei").crossJoin(bad)


def run_benchmark(pairs: DataFrame, register: DataFrame, cfg=None, country_mode: str = "soft") -> DataFrame:
    """The matcher's answers to evaluation pairs, as rows for metrics and failure_breakdown; one plan for all pairs."""
    from kinfold.config import Matching
    from kinfold.functions.columns import descending, nested_list

    from . import matching

    cfg = cfg or Matching()
    pairs = cut_lineage(pairs)
    asked = cut_lineage(matching.build_queries(pairs, "query_name", "query_country", key="pair_id"))
    found = matching.search(asked, register, matching.build_index(register), cfg.candidate_pool_size, country_mode).join(asked, "query_id")
    scored = cut_lineage(matching.score(found, cfg))
    ranked = scored.groupBy("query_id").agg(nested_list([*descending("score"), F.col("retrieval_rank")], F.col("lei")).alias("ranked"))
    decided = matching.decide(scored, cfg).select("query_id", "decision", F.col("lei").alias("chosen"))
    out = pairs.withColumnRenamed("pair_id", "query_id").join(ranked, "query_id", "left").join(decided, "query_id", "left")
    return out.select(
        F.col("query_id").alias("pair_id"), F.col("expected_lei").alias("expected"), F.col("confusable_lei").alias("confusable"), "case_type", "difficulty", "conflict_type",
        F.coalesce("ranked", F.array().cast("array<string>")).alias("ranked"), F.coalesce("decision", F.lit("UNMATCHED")).alias("decision"), "chosen",
    )
