from __future__ import annotations

import io
import json

import pytest
from pyspark.sql import functions as F

from kinfold.catalog import Catalog
from kinfold.cli import main
from kinfold.operators import answers, reads, reports
from kinfold.operators.jobs import JobConflict, JobRules, Jobs


@pytest.fixture
def jobs(spark, tmp_path):
    now = [1000.0]
    j = Jobs(spark, f"file://{tmp_path}/jobs", JobRules(lease_seconds=10, max_attempts=2), clock=lambda: now[0])
    j.now = now
    return j


def test_requests_are_idempotent(jobs):
    a = jobs.enqueue(" Why? ", "request-1")
    assert jobs.enqueue("Why?", "request-1")["id"] == a["id"] and len(jobs.all()) == 1
    with pytest.raises(JobConflict, match="another question"):
        jobs.enqueue("What?", "request-1")
    with pytest.raises(JobConflict, match="not answered"):
        jobs.enqueue("Next?", "request-2", job_id="request-1")
    with pytest.raises(ValueError, match="question"):
        jobs.enqueue(" ", "request-3")


def test_leases_and_attempts(jobs):
    jobs.enqueue("Why?", "r1")
    job = jobs.claim("w1")
    assert job["status"] == "running" and jobs.claim("w2") is None
    jobs.now[0] += 11
    assert jobs.claim("w2")["attempts"] == 2
    with pytest.raises(JobConflict, match="does not run"):
        jobs.succeed("r1", "w1", {})
    jobs.heartbeat("r1", "w2", {"step": 1})
    jobs.now[0] += 11
    assert jobs.claim("w3") is None and jobs.get("r1")["status"] == "failed"
    assert jobs.retry("r1")["status"] == "queued"
    jobs.claim("w4")
    assert jobs.succeed("r1", "w4", {"answer": "x"})["turns"][0]["result"] == {"answer": "x"}
    assert jobs.enqueue("More?", "r2", job_id="r1")["status"] == "queued"
    assert jobs.cancel("r1")["status"] == "canceled" and jobs.rename("r1", " T ")["title"] == "T"


def test_of_two_writers_one_wins(jobs):
    a = jobs.enqueue("Why?", "r1")
    assert jobs.put({**a, "title": "x"}, a["revision"]) and not jobs.put({**a, "title": "y"}, a["revision"])
    assert jobs.get("r1")["title"] == "x"


def test_backup_creates_only(jobs, spark, tmp_path):
    jobs.enqueue("Why?", "r1")
    jobs.claim("w")
    assert jobs.backup(f"file://{tmp_path}/b") == 1
    with pytest.raises(Exception, match="exists"):
        jobs.backup(f"file://{tmp_path}/b")
    other = Jobs(spark, f"file://{tmp_path}/other")
    assert other.restore(f"file://{tmp_path}/b") == (1, 0) and other.get("r1")["status"] == "queued"
    assert other.restore(f"file://{tmp_path}/b") == (0, 1)


def test_payloads_and_verdicts():
    value = {"a": list(range(500)), "b": "x" * 3000}
    small, cut = answers.fit(value, 2600)
    assert cut and small["a"][-1].endswith("left out)") and small["b"].endswith("(cut)")
    assert answers.fit({"a": 1}, 100) == ({"a": 1}, False) and answers.fit(value, 10) == (None, True)
    good = dict.fromkeys(answers.CHECKS, 0.9)
    assert answers.classify(good, "supported") == "verified" and answers.classify({**good, "grounded": 0.1}, "supported") == "partial"
    assert answers.classify({**good, "not_contradicted": 0.4}, "supported") == "unverified" and answers.classify({}, "supported") == "unavailable"


def test_answers(spark):
    answer = {"citations": ["e1"], "evidence": {"e1": "gleif"}, "facts": {"f1": {"predicate": "p", "value": "1", "evidence": "e1"}, "f2": {"predicate": "q", "value": "2", "evidence": "e2"}}, "derivations": {"f1": ["f2"]}, "gates": {"dated": True}}
    assert answers.check_answer(answer, {"p": "1"}, ("gleif",), {"p": "1"}) == {}
    bad = answers.check_answer({**answer, "citations": ["e9"], "gates": {}}, {"p": "3"}, ("nport",), {"q": "9"})
    assert set(bad) == {"citations_resolve", "facts_cited", "gates_passed", "expected_facts", "expected_sources", "baseline_drift"}
    assert 'failures="1"' in reports.junit({"a": {}, "b": bad})


def test_reports_and_commands(spark, tmp_path, sf_dir, capsys):
    from kinfold.plans.base import catalog

    c = catalog(spark, sf_dir)
    report, code = reports.validation_report(c)
    assert code == 0 and report["gleif_entities"]["rows"] > 0
    broken = c["gleif_entities"].limit(3).withColumn("lei", F.lit("bad"))
    assert reports.validation_report(Catalog(spark, tables={"gleif_entities": broken}))[1] == 1
    out = io.StringIO()
    reviews = reads.record_review(c["match_reviews"].limit(2), "n", "l", "confirmed", "r", "2024")
    assert reports.export_reviews(reviews, out) == 3 and out.getvalue().startswith("node_id,lei")
    data = Catalog(spark, str(tmp_path / "d"))
    for name in ("gleif_entities", "gleif_relationships", "isin_lei"):
        data.write(name, c[name])
    lei = c["gleif_entities"].first()["lei"]
    base = ["--data", str(tmp_path / "d")]
    for command in (["build-entities"], ["build-graph"], ["benchmark"], ["publish", "--to", f"file://{tmp_path}/pub", "--only", "relationships"], ["search", "--name", "red widget", "--size", "3"], ["hierarchy", "--lei", lei], ["entity", "--lei", lei]):
        assert main([*base, *command]) == 0
    assert lei in capsys.readouterr().out
    assert main([*base, "match", "--name", c["gleif_entities"].first()["legal_name"], "--country", "UK"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["query_id"] == "q"
    assert main([*base, "validate"]) == 0
    found = reads.search_entities(lei.lower(), "lei", c["gleif_entities"]).collect()
    assert len(found) == 1
    with pytest.raises(ValueError, match="kind"):
        reads.search_entities("x", "odd", c["gleif_entities"])
