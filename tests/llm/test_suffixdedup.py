from __future__ import annotations

import random

import numpy as np
import pytest

from kinfold.llm import suffixdedup as S

SIZE = 50


def order(i):
    return S.LAST_ID if i is None else i


def brute(docs):
    """(id, bytes, spans, kept) by looking every string up."""
    docs = [(i, (t or "").encode()) for i, t in docs]
    first = {}
    for i, b in docs:
        for k in range(len(b) - SIZE + 1):
            w = b[k : k + SIZE]
            first[w] = min(first.get(w, S.LAST_ID + 1), order(i))
    out = []
    for i, b in docs:
        gone = bytearray(len(b))
        for k in range(len(b) - SIZE + 1):
            if first[b[k : k + SIZE]] < order(i):
                gone[k : k + SIZE] = b"\1" * SIZE
        spans, k = [], 0
        while k < len(b):
            end = k
            while end < len(b) and gone[end] == gone[k]:
                end += 1
            if gone[k]:
                spans.append((k, end))
            k = end
        out.append((i, len(b), tuple(spans), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def cases():
    rnd = random.Random(5)
    docs = [(1, None), (2, ""), (3, "a" * 3000), (4, "b" + "a" * 300 + "c"), (5, "ab" * 400), (6, "x" * 49), (7, "x" * 49), (8, "y" * 50), (9, "y" * 50), (9, "y" * 80), (None, "y" * 60), (None, "y" * 60), (10, "é" * 40), (11, "zé" + "é" * 40)]
    base = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    for k in range(60):
        a = rnd.randrange(2900)
        docs.append((100 + k, "".join(rnd.choice("abc") for _ in range(rnd.randrange(80))) + base[a : a + rnd.randrange(20, 600)] + "".join(rnd.choice("xyz") for _ in range(rnd.randrange(80)))))
    return docs + [(500 + k, docs[20][1]) for k in range(5)]


def rows(df):
    return sorted(((r["doc_id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["spans"]), bytes(r["kept"])) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("group", "bucket", "hot"), [(S.GROUP_BYTES, S.BUCKET_BYTES, S.HOT_SHARE), (200, 300, 0.01)])
def test_equals_brute_force(spark, clash, monkeypatch, group, bucket, hot):
    monkeypatch.setattr(S, "GROUP_BYTES", group)
    monkeypatch.setattr(S, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(S, "HOT_SHARE", hot)
    docs = cases()
    df = clash(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows(S.suffix_dedup(df)) == brute(docs)


def test_empty_table_and_bad_size(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.suffix_dedup(df).count() == 0
    with pytest.raises(ValueError, match="min_bytes"):
        S.suffix_dedup(df, min_bytes=10)


def test_runs_do_not_depend_on_segments(monkeypatch):
    texts = S.gather([1, 2], [b"the quick brown fox " * 30, b"a" * 500])
    whole = S.find_runs(texts, SIZE)
    monkeypatch.setattr(S, "SEGMENT", 97)
    cut = S.find_runs(texts, SIZE)
    strings = lambda r: {(s, p) for a, b, p in zip(r.first, r.last, r.token, strict=True) for s in range(a, b + 1)}
    assert strings(whole) == strings(cut)
    assert len(strings(whole)) == (600 - 49) + (500 - 49)


def test_multikey_classes_and_packing():
    rnd = np.random.default_rng(1)
    keys = rnd.integers(0, 3, (200, 4)).astype(np.uint64)
    got = S.multikey_classes(200, lambda level, item: keys[item, level], 4)
    assert 0 <= got.min() and got.max() < 200
    assert all((got[i] == got[j]) == bool((keys[i] == keys[j]).all()) for i in range(200) for j in range(0, 200, 7))
    arrays = [np.arange(5, dtype=np.uint32), np.zeros(0, np.int64), np.array([1 << 60, 3], np.int64), np.frombuffer(b"abc", np.uint8)]
    for a, b in zip(arrays, S.unpack(S.pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()
