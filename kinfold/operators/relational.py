"""Relational building blocks: latest per key, top k, unions, unpivots, a filter contract, samples, profiles."""

from __future__ import annotations

import tempfile
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.columns import col


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, written below spark.checkpoint.dir; a folder of our own only where none is set and all tasks run in this process."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="kinfold-"))
    return df.checkpoint()


def tasks(df: DataFrame) -> int:
    """As many parts as keep every core busy, for work that costs more than the size of its rows says."""
    session = df.sparkSession
    return max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)


def union_by_name(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def first_per_key(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column]) -> DataFrame:
    """One row a key, the first in order."""
    return top_per_key(df, keys, order, 1)


def top_per_key(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each key, with their rank if a name is given. Row numbers are cut off before the shuffle."""
    name = rank or "_row"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def dedupe_latest(df: DataFrame, keys: Sequence[str], by: str = "snapshot_date", ties: Sequence[str] = ()) -> DataFrame:
    """The row of latest by for each key; nulls come last and ties break by the columns given."""
    return first_per_key(df, keys, [F.col(by).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties]])


def unpivot(df: DataFrame, keep: Sequence[str], facts: Sequence[Mapping[str, Column]]) -> DataFrame:
    """A row for each fact, a mapping that must have value, whose value is not null. Facts of a row share one scan."""
    rows = F.array(*[F.struct(*[c.alias(k) for k, c in fact.items()]) for fact in facts])
    out = df.select(*keep, F.explode(F.filter(rows, lambda r: r["value"].isNotNull())).alias("_fact"))
    return out.select(*keep, "_fact.*")


def find(
    df: DataFrame,
    where: Mapping[str, object] | None = None,
    either: Sequence[Mapping[str, object]] = (),
    missing: Sequence[str] = (),
    sort: Sequence[tuple[str, str]] = (),
    collapse: str | None = None,
    size: int | None = None,
    offset: int = 0,
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """The document filter: all of where, one of either, null in all of missing; then order, one row a key, a page, columns.

    A list as value means any of its members; an array column matches if it holds one. Nulls sort last either way.
    """

    def one(name: str, value: object) -> Column:
        values = list(value) if isinstance(value, (list, tuple, set)) else [value]
        if df.schema[name].dataType.typeName() == "array":
            return F.arrays_overlap(F.col(name), F.lit(values))
        return F.col(name).isin(values)

    def every(conditions: Mapping[str, object]) -> Column:
        return reduce(lambda a, b: a & b, [one(k, v) for k, v in conditions.items()], F.lit(True))

    out = df.where(every(where or {}))
    if either:
        out = out.where(reduce(lambda a, b: a | b, [every(c) for c in either]))
    for name in missing:
        out = out.where(F.col(name).isNull())
    order = [F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_last() for c, way in sort]
    if collapse:
        out = first_per_key(out, [collapse], order or [F.lit(0)])
    if order:
        out = out.orderBy(*order)
    if offset:
        out = out.offset(offset)
    if size is not None:
        out = out.limit(size)
    return out.select(*fields) if fields else out


def exists_in(df: DataFrame, key: str, other: DataFrame, other_key: str, flag: str) -> DataFrame:
    """df with a flag whether its key occurs in other; a null key does not."""
    keys = other.select(F.col(other_key).alias("_key")).where("_key IS NOT NULL").distinct()
    return df.join(keys, df[key] == keys["_key"], "left").withColumn(flag, F.col("_key").isNotNull()).drop("_key")


def text_hash(*parts: Column | str) -> Column:
    """A hash that other engines have too: the MD5 of the parts, joined by colons."""
    return F.md5(F.concat_ws(":", *[col(p).cast("string") for p in parts]))


def sample_per_group(df: DataFrame, group: str, key: str, per_group: int, seed: int) -> DataFrame:
    """Up to per_group rows of each group in the order of a hash, the same on every run and cluster."""
    return top_per_key(df, [group], [text_hash(F.lit(seed), key), F.col(key)], per_group)


def sample(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    return df.orderBy(text_hash(F.lit(seed), key), key).limit(size)


def null_rates(df: DataFrame) -> DataFrame:
    """(column_name, null_rate) of every column, in one pass, to four places."""
    rates = df.agg(*[F.round(F.avg(F.col(c).isNull().cast("int")), 4).alias(c) for c in df.columns])
    return rates.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_rate")) for c in df.columns])).alias("r")).select("r.*")


def surplus_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows repeat a key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def top_values(tables: Sequence[DataFrame], column: str, k: int) -> DataFrame:
    """The k most frequent values over all tables; ties by value."""
    counts = union_by_name([t.select(column) for t in tables]).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col(column)).limit(k)


def phrase_rows(df: DataFrame, text: str, phrase: str) -> DataFrame:
    return df.where(F.contains(F.lower(F.col(text)), F.lit(phrase.lower())))


def snippet(text: Column | str, phrase: str, before: int = 180, after: int = 900) -> Column:
    """(start, end, snippet) around the first occurrence of phrase; offsets count characters from 0."""
    text = col(text)
    at = F.instr(F.lower(text), phrase.lower()) - 1
    start = F.greatest(F.lit(0), at - before)
    end = F.least(F.length(text), at + after)
    return F.when(at >= 0, F.struct(start.alias("start"), end.alias("end"), F.substring(text, start + 1, end - start).alias("snippet")))
