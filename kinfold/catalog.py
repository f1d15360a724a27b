"""Tables by name, each of which may be missing."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Catalog:
    """Named tables: DataFrames given, or functions that make them when first asked for, else Parquet below root."""

    def __init__(self, spark: SparkSession, root: str | None = None, tables: Mapping[str, DataFrame | Callable[[], DataFrame]] | None = None) -> None:
        self.spark, self.root, self._tables = spark, root, dict(tables or {})

    def get(self, name: str) -> DataFrame | None:
        if name not in self._tables and self.root:
            try:
                self._tables[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
            except AnalysisException as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        table = self._tables.get(name)
        if callable(table):
            table = self._tables[name] = table()
        return table

    def __getitem__(self, name: str) -> DataFrame:
        table = self.get(name)
        if table is None:
            raise KeyError(name)
        return table

    def __contains__(self, name: str) -> bool:
        return self.get(name) is not None

    def put(self, name: str, table: DataFrame) -> None:
        self._tables[name] = table

    def write(self, name: str, table: DataFrame) -> None:
        """Replace the table's Parquet below root."""
        table.write.mode("overwrite").parquet(f"{self.root}/{name}.parquet")
        self._tables.pop(name, None)

    def fingerprints(self) -> dict[str, str]:
        """Of each table read so far: a hash of its schema and of its files' names, sizes and times."""
        found = {}
        for name, table in sorted((n, t) for n, t in self._tables.items() if not callable(t)):
            files: list[tuple[str, int, int]] = []
            if self.root:
                target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}.parquet")
                fs = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
                if fs.exists(target):
                    files = sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(target))
            found[name] = hashlib.sha256(f"{table.schema.json()} {files}".encode()).hexdigest()[:16]
        return found


def optional(df: DataFrame, name: str, kind: str = "string"):
    """The column, or typed nulls where a table of an older shape lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def with_provenance(df: DataFrame, source_file: str, snapshot_date: str, ingested_at: str) -> DataFrame:
    return df.withColumns({"source_file": F.lit(source_file), "snapshot_date": F.lit(snapshot_date), "ingested_at": F.lit(ingested_at)})
