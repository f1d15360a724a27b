"""Durable jobs: a revision is a file of its own that is created once, so writers that race cannot both win.

A job is queued, running under a lease, succeeded, failed or canceled. A worker claims the job that waits longest; a
job whose lease ran out is claimed again, up to max_attempts. Files go through the cluster's file system.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

ACTIVE, ENDED = ("queued", "running"), ("succeeded", "failed", "canceled")


class JobConflict(RuntimeError):
    pass


@dataclass(frozen=True)
class JobRules:
    lease_seconds: float = 120
    max_attempts: int = 3
    max_turns: int = 20
    max_events: int = 200


class Jobs:
    def __init__(self, spark: SparkSession, root: str, rules: JobRules | None = None, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.root, self.rules, self.clock = spark, root.rstrip("/"), rules or JobRules(), clock
        jvm = spark.sparkContext._jvm
        self._path, self._io = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _revisions(self, job_id: str) -> list[int]:
        folder = self._path(f"{self.root}/{job_id}")
        if not self._fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName().split(".")[0]) for f in self._fs.listStatus(folder) if f.getPath().getName().endswith(".json"))

    def get(self, job_id: str) -> dict | None:
        found = self._revisions(job_id)
        if not found:
            return None
        stream = self._fs.open(self._path(f"{self.root}/{job_id}/{found[-1]}.json"))
        try:
            return json.loads(bytes(self._io.toByteArray(stream)).decode())
        finally:
            stream.close()

    def put(self, job: dict, revision: int | None) -> bool:
        """Write job as the revision after the one given (the first, if None); False if another writer did so before."""
        number = 0 if revision is None else revision + 1
        if self._revisions(job["id"])[-1:] != ([] if revision is None else [revision]):
            return False
        aside = self._path(f"{self.root}/{job['id']}/{number}.json.{time.time_ns()}")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(json.dumps({**job, "revision": number}).encode()))
        stream.close()
        target = self._path(f"{self.root}/{job['id']}/{number}.json")
        lock = self._path(f"{self.root}/{job['id']}/{number}.claim")
        won = self._fs.createNewFile(lock) and self._fs.rename(aside, target)
        if not won:
            self._fs.delete(aside, False)
        return won

    def ids(self) -> list[str]:
        root = self._path(self.root)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(root)) if self._fs.exists(root) else []

    def all(self) -> list[dict]:
        """Newest first."""
        return sorted(filter(None, map(self.get, self.ids())), key=lambda j: j["updated_at"], reverse=True)

    def _save(self, job: dict, **changes) -> dict:
        new = {**job, **changes, "updated_at": self.clock()}
        if not self.put(new, job["revision"]):
            raise JobConflict(f"{job['id']} has changed meanwhile")
        return {**new, "revision": job["revision"] + 1}

    def enqueue(self, question: str, request_id: str, job_id: str | None = None, entity_id: str | None = None) -> dict:
        """A new job, or a follow-up of a succeeded one; the same request twice is one."""
        if not (question := question.strip()):
            raise ValueError("a question is needed")
        old = self.get(job_id or request_id)
        if old is None:
            job = {"id": job_id or request_id, "title": question[:120], "question": question, "request_id": request_id, "entity_id": entity_id, "status": "queued", "attempts": 0, "turns": [], "events": [], "error": None, "owner": None, "lease_until": 0.0, "created_at": self.clock(), "updated_at": self.clock()}
            if self.put(job, None):
                return {**job, "revision": 0}
            old = self.get(job["id"])
        if old["request_id"] == request_id:
            if old["question"] != question or old["entity_id"] != entity_id:
                raise JobConflict("the request id stands for another question")
            return old
        if old["status"] != "succeeded":
            raise JobConflict("the current question is not answered yet")
        if old["entity_id"] != entity_id:
            raise JobConflict("a follow-up keeps its entity")
        if len(old["turns"]) >= self.rules.max_turns:
            raise JobConflict("no more questions fit")
        return self._save(old, question=question, request_id=request_id, status="queued", attempts=0, events=[], error=None, owner=None, lease_until=0.0)

    def claim(self, owner: str) -> dict | None:
        for job in reversed(self.all()):
            if job["status"] not in ACTIVE or job["status"] == "running" and job["lease_until"] > self.clock():
                continue
            try:
                if job["attempts"] >= self.rules.max_attempts:
                    self._save(job, status="failed", error="interrupted too often", owner=None, lease_until=0.0)
                    continue
                return self._save(job, status="running", attempts=job["attempts"] + 1, owner=owner, lease_until=self.clock() + self.rules.lease_seconds, events=[], error=None)
            except JobConflict:
                continue
        return None

    def _owned(self, job_id: str, owner: str, change: Callable[[dict], dict]) -> dict:
        """Change a job that owner runs, again if another change comes between."""
        for _ in range(5):
            job = self.get(job_id)
            if job is None or job["status"] != "running" or job["owner"] != owner:
                raise JobConflict(f"{owner} does not run {job_id}")
            try:
                return self._save(job, **change(job))
            except JobConflict:
                continue
        raise JobConflict(f"{job_id} changes too often")

    def heartbeat(self, job_id: str, owner: str, event: dict | None = None) -> dict:
        events = lambda j: (j["events"] + ([event] if event else []))[-self.rules.max_events :]
        return self._owned(job_id, owner, lambda j: {"events": events(j), "lease_until": self.clock() + self.rules.lease_seconds})

    def succeed(self, job_id: str, owner: str, result: dict) -> dict:
        return self._owned(job_id, owner, lambda j: {"status": "succeeded", "turns": [*j["turns"], {"question": j["question"], "result": result}], "owner": None, "lease_until": 0.0})

    def fail(self, job_id: str, owner: str, error: str) -> dict:
        return self._owned(job_id, owner, lambda j: {"status": "failed", "error": error, "owner": None, "lease_until": 0.0})

    def _when(self, job_id: str, allowed: tuple[str, ...], **changes) -> dict:
        job = self.get(job_id)
        if job is None or job["status"] not in allowed:
            raise JobConflict(f"{job_id} is not {' or '.join(allowed)}")
        return self._save(job, **changes)

    def cancel(self, job_id: str) -> dict:
        return self._when(job_id, ACTIVE, status="canceled", owner=None, lease_until=0.0)

    def retry(self, job_id: str) -> dict:
        return self._when(job_id, ("failed", "canceled"), status="queued", attempts=0, error=None, events=[], owner=None, lease_until=0.0)

    def rename(self, job_id: str, title: str) -> dict:
        if not title.strip():
            raise ValueError("a title is needed")
        return self._when(job_id, (*ACTIVE, *ENDED), title=title.strip())

    def backup(self, path: str) -> int:
        """All jobs as JSON in Parquet; an existing backup is not replaced."""
        rows = [(1, json.dumps(j)) for j in self.all()]
        self.spark.createDataFrame(rows, "version int, document string").write.mode("error").parquet(path)
        return len(rows)

    def restore(self, path: str) -> tuple[int, int]:
        """(restored, skipped): jobs that exist stay; active ones are queued anew. Nothing is written if any is invalid."""
        rows: DataFrame = self.spark.read.parquet(path)
        jobs = []
        for r in rows.toLocalIterator():
            job = json.loads(r["document"])
            if r["version"] != 1 or job.get("status") not in (*ACTIVE, *ENDED) or not job.get("id") or not job.get("request_id") or not isinstance(job.get("turns"), list) or not isinstance(job.get("question"), str):
                raise ValueError("not a backup of jobs")
            again = {"status": "queued", "attempts": 0, "events": []} if job["status"] in ACTIVE else {}
            jobs.append({**job, **again, "owner": None, "lease_until": 0.0, "updated_at": self.clock()})
        done = sum(self.put(j, None) for j in jobs)
        return done, len(jobs) - done
