"""What several corpus operators share: intermediate tables, sizes, shipping of Python code."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []


def ship_by_value(module: str | ModuleType) -> None:
    """Pickle the module's functions with their code, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module] if isinstance(module, str) else module)


ship_by_value(__name__)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    A folder of our own only where none is set and all tasks run in the driver's own process; elsewhere each executor
    would write to its own disk, so that is an error.
    """
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        return configured.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="kinfold-"))
    return _own_dir[0]


#: Tables stashed by the operators that are running, the innermost last.
_scopes: list[dict[str, DataFrame]] = []


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, and a lost executor costs no rerun.

    Within a function marked by scratch the files go when it ends, if its result does not read them; else when the
    driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinfold/{label}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    if _scopes:
        _scopes[-1][path] = df
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(df: DataFrame, paths: set[str]) -> None:
    sc = df.sparkSession.sparkContext
    for path in paths:
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def _read_by(df: DataFrame) -> set[str]:
    """The stashed tables that df reads, by the folders that its plan names."""
    leaves, found = df._jdf.queryExecution().analyzed().collectLeaves(), set()
    for i in range(leaves.size()):
        if leaves.apply(i).getClass().getSimpleName() == "LogicalRelation":
            roots = leaves.apply(i).relation().location().rootPaths()
            found |= {path for k in range(roots.size()) if "/kinfold/" in (path := roots.apply(k).toString())}
    return found


def scratch(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Delete, at the function's end and also on failure, the tables stashed in it that its result does not read."""

    @wraps(function)
    def run(*args: object, **named: object) -> DataFrame:
        _scopes.append({})
        result = None
        try:
            result = function(*args, **named)
        finally:
            mine = _scopes.pop()
            needed = {os.path.basename(p) for p in _read_by(result)} if mine and result is not None else set()
            for path, df in mine.items():
                if os.path.basename(path) not in needed:
                    _delete(df, {path})
                elif _scopes:  # the caller's result decides
                    _scopes[-1][path] = df
        return result

    return run


def drop_stash(df: DataFrame) -> None:
    """Delete a stashed table that no later step reads."""
    _delete(df, _read_by(df))


#: Estimates beyond this are those of sources without statistics, or products of joins.
LARGEST_ESTIMATE = 1 << 50


def size_estimate(df: DataFrame, column: str, inflation: int) -> int:
    """About the bytes of a string or binary column. Only partition and group counts may depend on it, never results.

    Catalyst's estimate of df's stored bytes times inflation, or, where it has none to speak of, a count.
    """
    stored = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if stored <= LARGEST_ESTIMATE:
        return stored * inflation
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def text_slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many bytes of text each, so that a batch is never unpacked as a whole."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    edges = [0, *edges.tolist(), len(sizes)] if len(sizes) else [0]
    yield from ((a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b)


def broadcast_if_few(df: DataFrame, most: int) -> DataFrame:
    """df written out and counted; marked for broadcast if it has no more rows than most."""
    df = stash(df, "few")
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
