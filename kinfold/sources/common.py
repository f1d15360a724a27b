"""Readers that the sources share. Zip archives cannot be split, so they are unpacked before Spark reads them."""

from __future__ import annotations

import zipfile
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.columns import blank_to_null


class SourceError(ValueError):
    pass


def unpack(archive: str, folder: str, members: list[str] | None = None) -> dict[str, str]:
    """Unpack members (all, if none are named) into a folder; a named one that is missing is an error."""
    with zipfile.ZipFile(archive) as z:
        wanted = members or z.namelist()
        if missing := set(wanted) - set(z.namelist()):
            raise SourceError(f"{archive} lacks {sorted(missing)}")
        return {name: z.extract(name, folder) for name in wanted}


def newest(folder: str, pattern: str) -> str:
    """The last file by name."""
    found = sorted(Path(folder).glob(pattern))
    if not found:
        raise SourceError(f"no {pattern} in {folder}")
    return str(found[-1])


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated text without quoting; all columns are strings."""
    return spark.read.csv(path, sep="\t", header=True, quote="", inferSchema=False)


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Comma-separated text with quoting; header names lose blanks and # around them."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', encoding=encoding, inferSchema=False, multiLine=False)
    return df.toDF(*[c.strip(" #﻿\"") for c in df.columns])


def pick(df: DataFrame, columns: Mapping[str, str | Column]) -> DataFrame:
    """Columns by new name; a text names an input column, blanks become null, and one that is missing is null."""
    have = {c.lower(): c for c in df.columns}

    def one(c: str | Column) -> Column:
        if not isinstance(c, str):
            return c
        return blank_to_null(F.col(f"`{have[c.lower()]}`")) if c.lower() in have else F.lit(None).cast("string")

    return df.select(*[one(c).alias(n) for n, c in columns.items()])


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """df; the first row with a null in a required column stops the job with its name."""
    for c in columns:
        df = df.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is required"))).otherwise(F.col(c)))
    return df
