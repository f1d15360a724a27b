from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import quality as Q

WORD = re.compile("[^\x20\x09-\x0d]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    again = {j for k in range(len(w) - 2) if grams[w[k], w[k + 1], w[k + 2]] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_counts_equal_brute_force(spark, clash):
    rnd = random.Random(6)
    texts = [None, "", " \t\n", "a b", "a b c a b c a b", "x\n\nx\n x\nx", "é#*$%&|<> 😀", "f\x0bg\x0ch\r\ni", "a " * 5000] + ["".join(rnd.choice("ab c#\n") for _ in range(rnd.randint(0, 80))) for _ in range(400)]
    df = clash(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string"))
    rows = {r["doc_id"]: r for r in Q.judge_quality(df).collect()}
    for i, t in enumerate(texts):
        r, c = rows[i], counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == c
        assert r["base_failed"] == (c[0] < 50 or 100 * c[4] > 50 * c[0])
        assert not (r["base_failed"] and r["kept"])
    assert Q.judge_quality(df.limit(0)).count() == 0


def good(rnd):
    return ".\n".join(" ".join("".join(rnd.choice("aeiounrstl") for _ in range(rnd.randint(2, 9))).capitalize() if i == 0 else "".join(rnd.choice("aeiounrstl") for _ in range(rnd.randint(2, 9))) for i in range(rnd.randint(8, 20))) for _ in range(rnd.randint(6, 12)))


def test_outliers_go_and_good_texts_stay(spark):
    rnd = random.Random(7)
    texts = [(good(rnd), 1) for _ in range(300)] + [(good(rnd).upper(), 0) for _ in range(20)] + [(good(rnd).replace(" ", "*** "), 0) for _ in range(20)]
    df = spark.createDataFrame([(i, t, "en", "s", y) for i, (t, y) in enumerate(texts)], "doc_id long, text string, lang string, source string, y int")
    out = Q.judge_quality(df).join(df.select("doc_id", "y"), "doc_id").groupBy("y").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    shares = {r["y"]: r["kept"] for r in out.collect()}
    assert shares[1] > 0.99 and shares[0] == 0


def test_small_groups_are_not_judged_and_rows_order_does_not_matter(spark):
    rnd = random.Random(8)
    df = spark.createDataFrame([(i, good(rnd), "en", f"s{i}") for i in range(30)] + [(99, good(rnd).upper(), None, None)], "doc_id long, text string, lang string, source string")
    rows = Q.judge_quality(df).collect()
    assert all(r["kept"] and r["distance"] is None for r in rows)
    a = sorted(map(tuple, Q.judge_quality(df, least_rows=5).collect()))
    assert a == sorted(map(tuple, Q.judge_quality(df.orderBy(F.rand(1)).repartition(5), least_rows=5).collect()))


def test_chi_squared():
    assert Q.chi2_quantile(0.95, 1) == pytest.approx(3.841, abs=1e-3) and Q.chi2_quantile(0.9999, 5) == pytest.approx(25.745, abs=1e-2)


def vectors(texts):
    """The statistics, on their grid, by plain Python."""
    out = []
    for t in texts:
        words, chars, symbols, dup, repeated = counts(t)
        lines = sum(bool(WORD.search(x)) for x in t.split("\n"))
        out.append([math.log(1 + 100 * symbols / chars), math.log(chars / words), math.sqrt(repeated / words), math.sqrt(dup / lines), math.sqrt(sum(c.isupper() for c in t) / chars)])
    return np.round(np.array(out) * Q.GRID) / Q.GRID


def brute_mcd(x, rng):
    """Of many random starts, each followed until its subset stays, the estimate of least determinant; and all distances."""
    n = math.ceil(Q.SHARE * len(x))
    floor = np.diag([spread**2 for _, spread in Q.STATISTICS.values()])
    correct = Q.SHARE / Q.chi2_cdf(Q.chi2_quantile(Q.SHARE, Q.P), Q.P + 2)
    best = None
    for _ in range(60):
        rows = rng.choice(len(x), Q.P + 1, replace=False)
        while True:
            centre, spread = x[rows].mean(0), np.cov(x[rows].T, bias=True) * correct + floor
            d = x - centre
            d2 = (d @ np.linalg.inv(spread) * d).sum(1)
            near = np.sort(np.argsort(d2, kind="stable")[:n])
            if len(near) == len(rows) and (near == rows).all():
                break
            rows = near
        found = np.linalg.slogdet(spread)[1]
        if best is None or found < best[0]:
            best = found, d2
    return best


def test_estimates_equal_brute_force(spark):
    """Against many random starts, with a quarter of the rows of each group far off in a cluster of their own."""
    rnd, rng = random.Random(11), np.random.default_rng(3)
    docs = []
    for lang, source in (("en", "a"), ("en", "b"), ("de", "a")):
        for _ in range(240):
            docs.append((len(docs), good(rnd), lang, source))
        for _ in range(40 if source == "a" else 60):
            docs.append((len(docs), good(rnd).replace(" ", "** ").title(), lang, source))
        docs += [(len(docs) + k, good(rnd).upper(), lang, source) for k in range(9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in Q.judge_quality(df).collect()}
    stats = spark.createDataFrame([(f"{d[2]}{d[3]}", *map(int, v)) for d, v in zip(docs, vectors([d[1] for d in docs]) * Q.GRID, strict=True)], "group string, " + ", ".join(f"{n} long" for n in Q.NAMES))
    dets = {r["group"]: r["log_det"] for r in Q.least_determinants(stats).collect()}
    for lang, source in (("en", "a"), ("en", "b"), ("de", "a")):
        mine = [d for d in docs if d[2:] == (lang, source)]
        det, d2 = brute_mcd(vectors([d[1] for d in mine]), rng)
        assert dets[lang + source] == pytest.approx(det, abs=0.15)
        want = d2 <= Q.chi2_quantile(Q.QUANTILE, Q.P)
        assert np.mean([kept[d[0]] == w for d, w in zip(mine, want, strict=True)]) > 0.99
        assert not any(kept[d[0]] for d in mine[240:])
