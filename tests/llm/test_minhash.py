from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest

from kinfold.llm import minhash as M
from kinfold.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_sets(texts, size):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        out.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    return out


def brute(docs, size, percent=80):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    sets = word_sets([t for _, t in docs], size)
    for a in range(len(docs)):
        for b in range(a):
            if docs[a][0] is not None and docs[b][0] is not None and (x := len(sets[a] & sets[b])) and 100 * x >= percent * (len(sets[a]) + len(sets[b]) - x):
                p, q = find(docs[a][0]), find(docs[b][0])
                parent[max(p, q)] = min(p, q)
    return collections.Counter((i, len(s), None if i is None else find(i)) for (i, _), s in zip(docs, sets, strict=True))


@pytest.mark.parametrize(("size", "edits"), [(4, 6), (5, 14)])
def test_equals_brute_force(spark, clash, size, edits):
    rnd = random.Random(size)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for k in range(160):
        w = base[:]
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(150)] = f"x{rnd.randrange(99)}"
        docs.append((100 + k, " ".join(w)))
    docs += [(k, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 9)))) for k in range(60)]
    docs += [(900, None), (901, ""), (902, "one two"), (903, "ONE \t two"), (904, "É é"), (905, "é é"), (5, "one two"), (None, "one two"), (902, "one two")]
    df = clash(spark.createDataFrame(docs, "doc_id long, text string"))
    assert collections.Counter(map(tuple, M.near_duplicates(df, size=size).collect())) == brute(docs, size)


def test_texts_that_share_an_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = lambda t: t + " more"
    docs = [(1, a), (1, b), (2, near(b)), (3, near(a)), (4, c), (5, near(c)), (5, "x y z w v")]
    got = collections.Counter(map(tuple, M.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()))
    assert got == brute(docs, 5)


def test_empty_table(spark):
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sets_signatures_and_common_counts():
    texts = ["a b c d e f", "A  b\tc d e f", "a b", "", "f e d c b a " * 40]
    hashes, offsets = M.shingle_sets([t.encode() for t in texts], 3)
    assert np.diff(offsets).tolist() == [len(s) for s in word_sets(texts, 3)]
    sets = [hashes[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert (sets[0] == sets[1]).all()
    full = [s for s in sets if len(s)]
    where = np.r_[0, np.cumsum([len(s) for s in full])]
    signature = M.signatures(np.concatenate(full), where)
    assert (signature[0] == signature[1]).all() and signature.shape == (4, M.COORDINATES)
    common = M.common_shingles(sets, np.arange(5), np.arange(5))
    assert all(common[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(5) for j in range(5))


def test_signatures_estimate_similarity():
    rnd = np.random.default_rng(1)
    shared, own = rnd.integers(0, 1 << 62, 900).astype(np.uint64), rnd.integers(0, 1 << 62, (2, 100)).astype(np.uint64)
    a, b = (np.unique(np.r_[shared, x]) for x in own)
    s = M.signatures(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]))
    assert abs((s[0] == s[1]).mean() - 900 / 1100) < 0.12


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("edits", [6, 14])
def test_large_buckets_are_cut_up_without_losing_links(spark, monkeypatch, edits):
    """Every open bucket is cut up by rarest shingles, and no pivot round helps."""
    monkeypatch.setattr(M, "LARGE", 0)
    monkeypatch.setattr(M, "BLOCK", 8)
    monkeypatch.setattr(M, "PIVOT_ROUNDS", 0)
    rnd = random.Random(edits)
    docs = []
    for k in range(160):
        w = [f"w{i}" for i in range(150)]
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(150)] = f"x{rnd.randrange(40)}"
        docs.append((100 + k, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert collections.Counter(map(tuple, M.near_duplicates(df, size=4).collect())) == brute(docs, 4)


def test_texts_of_one_template_give_no_candidates(spark):
    """Similar beyond chance but unlinked: the shingles that they share are not among their rarest, so work is linear."""
    template = [f"t{i}" for i in range(100)]
    rows = []
    for k in range(1500):
        text = " ".join(template + [f"own{k}x{i}" for i in range(40)])
        rows.append((1, k, k, text))
    df = spark.createDataFrame(rows, "bucket long, unit long, c long, text string")
    assert M._by_rarest(df.drop("text"), df.select("unit", "text"), 5, 80).count() == 0
    alike = spark.createDataFrame([(1, k, k, r[3] + " tail" * (k > 1)) for k, r in enumerate(rows[:1] * 3)], "bucket long, unit long, c long, text string")
    assert M._by_rarest(alike.drop("text"), alike.select("unit", "text"), 5, 80).select("unit").distinct().count() == 3
