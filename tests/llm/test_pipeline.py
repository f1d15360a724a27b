"""The stages against what brute force keeps of each stage's own input."""

from __future__ import annotations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from kinfold.llm import queries, toxicity

from . import test_decontam, test_linededup, test_minhash


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """(rows before, rows after) of each stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = []
    for name, stage in C.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs.collect(), after.collect()))
        docs = after
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in C.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]
    assert all(list(after[0].asDict()) == C.COLUMNS for _, after in stages[:-1])


def test_toxicity(spark, sf_dir, stages):
    before, after = stages[0]
    model = queries.toxicity_model(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark, sf_dir)
    scores = toxicity.score(model, [r["text"] for r in before], model.weights != 0)
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r, s in zip(before, scores, strict=True) if s < 0.5)


def test_line_dedup(stages):
    before, after = stages[1]
    expected = [(i, t) for i, t, _, gone, _ in test_linededup.brute([(r["doc_id"], r["text"]) for r in before], 50) if not gone or t.strip(" \t\n\x0b\x0c\r")]
    assert sorted((r["doc_id"], r["text"]) for r in after) == sorted(expected)
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_near_dedup(stages):
    before, after = stages[2]
    groups = test_minhash.brute([(r["doc_id"], r["text"]) for r in before], 5)
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, _, c in groups if i == c)


def test_decontamination(spark, sf_dir, stages):
    before, after = stages[3]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    held = test_decontam.brute([(r["doc_id"], r["text"]) for r in before], items)
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if not held[r["doc_id"]])


def test_bpe(stages):
    before, after = stages[4]
    library, texts = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {r["doc_id"]: r["text"] for r in before}
    assert len(after) == len(before)
    for r in after:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert bytes(r["ids"]) == b"".join(i.to_bytes(4, "little") for i in ids) and r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_run(spark, sf_dir, stages):
    assert sorted(r["doc_id"] for r in C.run(spark, sf_dir).select("doc_id").collect()) == sorted(r["doc_id"] for r in stages[-1][1])


def test_empty_documents(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0


def test_odd_documents(spark, sf_dir, tmp_path, clash):
    """Null ids, null and empty texts, repeated rows and clashing names: nothing clean is lost, repeats under one id stay."""
    lines = ["\n".join(" ".join(f"w{seed}x{k}y{i}" for i in range(12)) for k in range(8)) for seed in range(4)]
    rows = [(1, lines[0]), (1, lines[0]), (2, None), (3, ""), (None, lines[1]), (None, None), (4, lines[2]), (5, lines[3]), (6, lines[3].replace("\n", " ").replace("y3", "y3 z", 1)), (7, "word " * 20_000)]
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    clash(docs).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    got = sorted(((r["doc_id"] or 0), r["n_tokens"] > 0) for r in C.run(spark, str(tmp_path)).collect())
    ids = [i for i, _ in got]
    assert {0, 1, 2, 3, 4, 5, 7} <= set(ids) and got.count((0, True)) == 1 and (2, False) in got and (3, False) in got
    assert 6 not in ids  # a near copy of 5 on one line, which line_dedup cannot see
