"""The cleaning pipeline over documents: each stage reads what the stage before it kept.

All stages but the last return the columns of documents. A null doc_id is kept or dropped by its text like others,
except that near duplicates are only sought among documents with an id.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import bpe, decontam, linededup, minhash, queries, toxicity
from kinfold.llm.common import broadcast_if_few, drop_stash, stash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: So many dropped ids at most are broadcast.
FEW_IDS = 2_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5; it learns from the labelled ones that are not held out."""
    docs = docs.select(COLUMNS)
    scored = toxicity.score_toxicity(docs, queries.toxicity_model(docs, spark, sf_dir))
    return scored.where("toxicity < 0.5").select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of runs of 50 words or more; documents of which nothing is left go."""
    done = linededup.line_dedup(docs.select(COLUMNS), min_words=50, keep=("lang", "source"))
    done = done.where(r"n_deleted = 0 OR text RLIKE '[^\\x20\\x09-\\x0D]'")
    return done.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document of least id."""
    docs = docs.select(COLUMNS)
    found = minhash.near_duplicates(docs, size=5, percent=80)
    copies = broadcast_if_few(found.where("component <> doc_id").select("doc_id").distinct(), FEW_IDS)
    return docs.join(copies, "doc_id", "left_anti").select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    marked = decontam.mark_contaminated(docs.select(COLUMNS), items, keep=("lang", "source", "n_chars"))
    return marked.where(F.size("items") == 0).select(COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, as unsigned 32-bit little-endian integers, and the text decoded from them."""
    return bpe.bpe(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]
#: SQL cannot express the classifier and the tokenizer; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        kept = stash(stage(spark, docs, sf_dir), name)
        if i:
            drop_stash(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
