"""Generations of documents: written aside, counted, switched to at once, kept for rollback."""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from kinfold.catalog import Catalog


class PublicationError(RuntimeError):
    pass


class Publisher:
    """Below root: <generation>/<name> in Parquet, <generation>/manifest.json, and numbered pointers in current/.

    The readable pointer of highest number names the current generation. Pointers are created and never replaced, so
    there is always a current one, and of two publications that end at the same time one fails; neither needs a lock
    that a killed run would leave behind. All files go through the cluster's file system, so root may be in any store
    that Spark writes.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def _read(self, name: str) -> dict | None:
        if not self._exists(name):
            return None
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return json.loads(bytes(self._io.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _write(self, name: str, value: dict) -> None:
        """Create a file; fails if there is one."""
        target = self._path(f"{self.root}/{name}")
        self._fs.mkdirs(target.getParent())
        try:
            stream = self._fs.create(target, False)
        except Py4JJavaError as e:
            raise PublicationError(f"{name} exists") from e
        try:
            stream.write(bytearray(json.dumps(value, sort_keys=True, indent=1).encode()))
        finally:
            stream.close()

    def _pointers(self) -> list[int]:
        """Numbers of all pointers, the highest first."""
        if not self._exists("current"):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/current"))]
        return sorted((int(n.removesuffix(".json")) for n in names if re.fullmatch(r"\d+\.json", n)), reverse=True)

    def _pointer(self) -> tuple[int, dict]:
        """The highest number, and the highest pointer that is whole; one cut short by a crash is passed over."""
        numbers = self._pointers()
        for n in numbers:
            try:
                return numbers[0], self._read(f"current/{n:010d}.json") or {}
            except ValueError:
                continue
        return (numbers or [0])[0], {}

    def _switch(self, generation: str, previous: str | None, after: int) -> None:
        self._write(f"current/{after + 1:010d}.json", {"generation": generation, "previous": previous})

    def current(self) -> str | None:
        return self._pointer()[1].get("generation")

    def manifest(self, generation: str) -> dict | None:
        return self._read(f"{generation}/manifest.json")

    def read(self, name: str) -> DataFrame | None:
        """Documents of the current generation."""
        current = self.manifest(self.current()) if self.current() else None
        return self.spark.read.parquet(f"{self.root}/{current['indexes'][name]['generation']}/{name}") if current and name in current["indexes"] else None

    def publish(self, catalog: Catalog, builders: dict[str, Callable[[Catalog], DataFrame | None]], only: Iterable[str] | None = None) -> str:
        """Build, count and switch. With only, the other documents stay those of the current generation.

        A failure at any point leaves the current generation in place and removes what was written, as do inputs that
        change while they are read.
        """
        generation = time.strftime("%Y%m%d%H%M%S") + "-" + uuid.uuid4().hex[:8]
        number, pointer = self._pointer()
        before, inputs = pointer.get("generation"), catalog.fingerprints()
        try:
            names = list(only) if only is not None else list(builders)
            if unknown := set(names) - builders.keys():
                raise PublicationError(f"no such documents: {sorted(unknown)}")
            indexes = dict((self.manifest(before) or {}).get("indexes", {})) if before and only is not None else {}
            for name in names:
                df = builders[name](catalog)
                inputs = catalog.fingerprints() | inputs  # those of the first reading stay
                if df is None:
                    continue
                path = f"{self.root}/{generation}/{name}"
                df.write.parquet(path)
                written = self.spark.read.parquet(path)
                schema = hashlib.sha256(df.schema.json().encode()).hexdigest()[:12]
                old = (self.manifest(before) or {}).get("indexes", {}).get(name) if before else None
                indexes[name] = {"generation": generation, "rows": written.count(), "schema": schema, "schema_changed": bool(old and old["schema"] != schema)}
            if changed := sorted(n for n, x in catalog.fingerprints().items() if inputs.get(n, x) != x):
                raise PublicationError(f"inputs have changed meanwhile: {changed}")
            self._write(f"{generation}/manifest.json", {"generation": generation, "partial": only is not None, "previous": before, "indexes": indexes, "inputs": inputs})
            self._switch(generation, before, number)
            return generation
        except BaseException:
            if self.current() != generation:
                self._fs.delete(self._path(f"{self.root}/{generation}"), True)
            raise

    def rollback(self, generation: str) -> None:
        """Switch to a kept generation, if all its documents are there and count as they did."""
        kept = self.manifest(generation) if generation else None
        if not kept:
            raise PublicationError(f"no generation {generation}")
        for name, index in kept["indexes"].items():
            path = f"{index['generation']}/{name}"
            if not self._exists(path) or self.spark.read.parquet(f"{self.root}/{path}").count() != index["rows"]:
                raise PublicationError(f"{path} is missing or incomplete")
        number, pointer = self._pointer()
        self._switch(generation, pointer.get("generation"), number)
