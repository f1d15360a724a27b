from __future__ import annotations

import random

import numpy as np

from kinfold.llm import queries
from kinfold.llm import toxicity as T


def texts(n, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        words = ["".join(rnd.choice("aeinrst") for _ in range(rnd.randint(2, 7))) for _ in range(rnd.randint(3, 60))]
        if bad := rnd.random() < 0.2:
            words.insert(rnd.randrange(len(words)), rnd.choice(["Moron", "vile-scum", "IDIOTS"]))
        out.append((" ".join(words), int(bad)))
    return out


def test_held_out_accuracy():
    train, test = texts(600, 1), texts(300, 2)
    model = T.train([t for t, _ in train], np.array([y for _, y in train]))
    p = T.score(model, [t for t, _ in test], model.weights != 0)
    assert ((p >= 0.5) == [y == 1 for _, y in test]).mean() > 0.97 and ((p > 0) & (p < 1)).all()


def test_features_are_distinct_and_stay_within_texts():
    text, bucket = T.features(["abcabcabc", "", "x"])
    assert len(set(zip(text.tolist(), bucket.tolist(), strict=True))) == len(text)
    alone = T.features(["abcabcabc"])[1]
    assert sorted(bucket[text == 0].tolist()) == sorted(alone.tolist())


def test_odd_input(spark, clash):
    docs = clash(spark.createDataFrame([(1, None), (2, ""), (3, "x" * 300_000), (3, "ok"), (None, "moron")], "doc_id long, text string"))
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.fit(docs, nothing)
    assert {round(r["s"], 6) for r in T.score_toxicity(docs, model, score_col="s").collect()} == {0.25}
    one = T.fit(docs, spark.createDataFrame([(1, 0), (2, 0), (9, 1), (3, None)], "doc_id long, toxic int"))
    scores = [r["s"] for r in T.score_toxicity(docs, one, score_col="s").collect()]
    assert len(scores) == 5 and all(0 < s < 0.5 for s in scores)
    assert T.score_toxicity(docs.limit(0), one, score_col="s").count() == 0


def test_query_holds_rows_out(spark, sf_dir):
    import zlib

    rows = queries.op7_toxicity(spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_corpus_accuracy(spark):
    """On rows that were not learnt from."""
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    scored = queries.op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert scored.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0] > 0.93


def plain_scores(train, test):
    """The same model by dictionaries and a plain gradient descent."""
    grams = lambda t: {s[i : i + n] for s in [f" {' '.join(t.lower().split())} "] for n in T.SIZES for i in range(len(s) - n + 1)}
    sets = [grams(t) for t, _ in train]
    y = np.array([label for _, label in train])
    counts = {}
    for s, label in zip(sets, y, strict=True):
        for g in s:
            counts.setdefault(g, [0, 0])[label] += 1
    ratio = {}
    for g, (no, yes) in counts.items():
        r = np.log((yes + T.SMOOTH) / (y.sum() + 2 * T.SMOOTH)) - np.log((no + T.SMOOTH) / ((1 - y).sum() + 2 * T.SMOOTH))
        if abs(r) >= T.LEAST_Z * np.sqrt(1 / (yes + T.SMOOTH) + 1 / (no + T.SMOOTH)) and yes + no >= T.LEAST_TEXTS:
            ratio[g] = r
    names = sorted(ratio)
    row = lambda s: [ratio[g] * (g in s) for g in names]
    x = np.array([row(s) for s in sets])
    w, bias = np.zeros(len(names)), 0.0
    rate = 1 / (0.25 * (np.linalg.norm(x, 2) ** 2 + len(x)) / len(x) + T.PENALTY)
    for _ in range(20_000):
        g = (1 / (1 + np.exp(-(x @ w + bias))) - y) / len(y)
        w, bias = w - rate * (x.T @ g + T.PENALTY * w), bias - rate * g.sum()
    return 1 / (1 + np.exp(-(np.array([row(grams(t)) for t, _ in test]) @ w + bias)))


def test_equals_a_plain_trainer():
    train, test = texts(250, 5), texts(120, 6)
    model = T.train([t for t, _ in train], np.array([y for _, y in train]))
    got = T.score(model, [t for t, _ in test], model.weights != 0)
    want = plain_scores(train, test)
    assert np.abs(got - want).mean() < 0.02 and ((got >= 0.5) == (want >= 0.5)).mean() > 0.98


def test_sample_is_bounded_in_bytes_and_rows(spark):
    docs = spark.createDataFrame([(1, "x" * 5000)] * 50 + [(2, "y" * 3000), (3, "z" * 100), (4, "w" * 100)], "doc_id long, toxicity string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "doc_id long, toxic int")
    assert T.fit(docs, labels, text_col="toxicity", sample_bytes=200).bias == T.train(["z" * 100, "w" * 100], np.array([1, 0])).bias
    model = T.fit(docs, labels, text_col="toxicity")
    assert model.bias == T.train(["x", "y", "z", "w"], np.array([1, 0, 1, 0])).bias
    named = docs.withColumnRenamed("toxicity", "text").withColumn("toxicity", docs["doc_id"])
    assert T.score_toxicity(named, model).columns == ["doc_id", "text", "toxicity"] and T.score_toxicity(named, model).schema["toxicity"].dataType.simpleString() == "double"


def plain_scores(train, test):
    """Another trainer: n-grams as strings in sets, a dense matrix, and Newton steps to the optimum."""
    grams = lambda t: {f[i : i + n] for f in [f" {' '.join(t.lower().split())} "] for n in T.SIZES for i in range(len(f) - n + 1)}
    sets, y = [grams(t) for t, _ in train], np.array([label for _, label in train])
    seen = {g: [0, 0] for s in sets for g in s}
    for s, label in zip(sets, y, strict=True):
        for g in s:
            seen[g][label] += 1
    totals = np.bincount(y, minlength=2) + 2 * T.SMOOTH
    ratios = {}
    for g, (no, yes) in seen.items():
        r = np.log((yes + T.SMOOTH) / totals[1]) - np.log((no + T.SMOOTH) / totals[0])
        if no + yes >= T.LEAST_TEXTS and abs(r) >= T.LEAST_Z * np.sqrt(1 / (yes + T.SMOOTH) + 1 / (no + T.SMOOTH)):
            ratios[g] = r
    matrix = lambda gs: np.array([[1.0, *[r if g in s else 0.0 for g, r in ratios.items()]] for s in gs])
    x, w = matrix(sets), np.zeros(len(ratios) + 1)
    penalty = np.r_[0.0, np.full(len(ratios), T.PENALTY)]
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (p - y) / len(y) + penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(penalty)
        w = w - np.linalg.solve(curve + 1e-12 * np.eye(len(w)), slope)
    return 1 / (1 + np.exp(-matrix([grams(t) for t, _ in test]) @ w)), len(ratios)


def test_agrees_with_another_trainer():
    train, test = texts(600, 5), texts(300, 6)
    model = T.train([t for t, _ in train], np.array([y for _, y in train]))
    got = T.score(model, [t for t, _ in test], model.weights != 0)
    want, n_features = plain_scores(train, test)
    assert n_features > 20 and abs(n_features - (model.weights != 0).sum()) <= 0.05 * n_features
    assert np.abs(got - want).max() < 0.05 and ((got >= 0.5) == (want >= 0.5)).mean() > 0.99


def test_score_column_of_the_input_is_replaced(spark):
    docs = spark.createDataFrame([(1, "a moron", "old"), (2, None, None)], "doc_id long, text string, toxicity string")
    model = T.Model(0.0, np.zeros(T.BUCKETS))
    assert [(r["doc_id"], r["toxicity"]) for r in T.score_toxicity(docs, model).collect()] == [(1, 0.5), (2, 0.5)]
