"""Toxicity scores by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A text's features are its distinct hashed n-grams of 3 to 6 characters. From labelled texts come each feature's
log-count ratio (how much more frequent it is in toxic texts) and the ratio's standard error; features whose ratio
is within a few errors of 0 say nothing and are dropped. The others, scaled by their ratios, go into a logistic
regression with an L2 penalty. Training takes a sample of labelled texts in one task: those of least hash, at most
sample_size texts of sample_bytes bytes altogether, each whole; longer ones are passed over. The model has at most
BUCKETS weights and is broadcast. Scoring reads every whole text.

Null text counts as empty and gets the score of a text without known features, as do all texts when there is
nothing to learn from. Rows are scored one by one, so ties and repeats do not matter; equal texts under one id are
learnt from once. A column with the name of the score is replaced; other extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_by_value, text_slices

SIZES, BITS = (3, 4, 5, 6), 20
BUCKETS = 1 << BITS
#: Texts of a batch, in characters or bytes.
BATCH_CHARS = 1 << 18
#: Additive smoothing of counts; least number of texts with a feature; least ratio in standard errors; L2 penalty.
SMOOTH, LEAST_TEXTS, LEAST_Z, PENALTY, STEPS = 1.0, 4, 4.0, 0.001, 300


class Model(NamedTuple):
    bias: float
    weights: np.ndarray  # of each bucket, 0 if it is not a feature


def _chars(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased, white space folded and padded; and the texts' offsets."""
    folded = [f" {' '.join(t.lower().split())} " for t in texts]
    return np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), np.uint32), np.r_[0, np.cumsum([len(t) for t in folded])]


def _grams(codes: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: the bucket of the n-gram at each position, and the positions whose n-gram would cross texts."""
    h = np.zeros(len(codes), np.uint64)
    wide = codes.astype(np.uint64)
    for n in range(1, max(SIZES) + 1):
        h = h[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + wide[n - 1 :] + np.uint64(n)
        if n in SIZES and len(h):
            cross = (offsets[1:, None] - np.arange(1, n)).ravel()
            yield ((h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int64), cross[(cross >= 0) & (cross < len(h))]


def features(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, bucket) pairs, of the wanted buckets if a mask of them is given."""
    codes, offsets = _chars(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    found = []
    for buckets, cross in _grams(codes, offsets):
        keep = np.ones(len(buckets), bool) if wanted is None else wanted[buckets]
        keep[cross] = False
        at = np.flatnonzero(keep)
        found.append((text[at] << BITS) | buckets[at])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & (BUCKETS - 1)


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def train(texts: list[str], labels: np.ndarray) -> Model:
    n, positive = len(texts), int(labels.sum())
    prior = float(np.log((positive + 0.5) / (n - positive + 1.5)))
    if not 0 < positive < n:
        return Model(prior, np.zeros(BUCKETS))
    counts = np.zeros((2, BUCKETS))
    for a, b in _slices(texts):
        text, bucket = features(texts[a:b])
        for label in (0, 1):
            counts[label] += np.bincount(bucket[labels[a:b][text] == label], minlength=BUCKETS)
    ratio = np.log((counts[1] + SMOOTH) / (positive + 2 * SMOOTH)) - np.log((counts[0] + SMOOTH) / (n - positive + 2 * SMOOTH))
    error = np.sqrt(1 / (counts[1] + SMOOTH) + 1 / (counts[0] + SMOOTH))
    wanted = (np.abs(ratio) >= LEAST_Z * error) & (counts.sum(0) >= LEAST_TEXTS)
    used = np.flatnonzero(wanted)
    if not len(used):
        return Model(prior, np.zeros(BUCKETS))
    number = np.cumsum(wanted) - 1
    row, col = [], []
    for a, b in _slices(texts):
        text, bucket = features(texts[a:b], wanted)
        row.append(text + a)
        col.append(number[bucket])
    row, col = np.concatenate(row), np.concatenate(col)
    value = ratio[used][col]
    dot = lambda w: np.bincount(row, value * w[col], n)
    back = lambda g: np.bincount(col, value * g[row], len(used))
    v = np.ones(len(used))
    for _ in range(12):  # the largest eigenvalue bounds the curvature
        v = back(dot(v))
        top = np.linalg.norm(v)
        v /= top
    rate = 1 / (0.25 * (top + n) / n + PENALTY)
    w, bias = np.zeros(len(used)), prior
    ahead_w, ahead_b = w, bias
    for step in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(dot(ahead_w) + ahead_b, -40, 40)))
        g = (p - labels) / n
        new_w, new_b = ahead_w - rate * (back(g) + PENALTY * ahead_w), ahead_b - rate * g.sum()
        momentum = step / (step + 3)
        ahead_w, ahead_b = new_w + momentum * (new_w - w), new_b + momentum * (new_b - bias)
        w, bias = new_w, new_b
    weights = np.zeros(BUCKETS)
    weights[used] = w * ratio[used]
    return Model(float(bias), weights)


def score(model: Model, texts: list[str], wanted: np.ndarray) -> np.ndarray:
    out = np.full(len(texts), model.bias)
    for a, b in _slices(texts):
        text, bucket = features(texts[a:b], wanted)
        out[a:b] += np.bincount(text, model.weights[bucket], b - a)
    return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, labels = [], []
    for batch in batches:
        labels += batch.column(0).to_pylist()
        texts += batch.column(1).to_pylist()
    model = train(texts, np.array(labels, np.int64))
    used = np.flatnonzero(model.weights)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, used], pa.int64()), pa.array(np.r_[model.bias, model.weights[used]])], ["bucket", "weight"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_size: int = 8192, sample_bytes: int = 64 << 20) -> Model:
    """labels: rows of id_col and label_col, 0 or 1; the texts of least hash within the two bounds are learnt from."""
    ids = labels.select(labels[id_col].alias("k"), labels[label_col].cast("long").alias("label")).where("k IS NOT NULL AND label IN (0, 1)").distinct()
    ids = ids.orderBy(F.xxhash64("k"), "k", "label").limit(sample_size)
    texts = docs.select(docs[id_col].alias("k"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    sized = texts.select("k", F.xxhash64("text").alias("h"), F.octet_length("text").alias("size")).join(F.broadcast(ids), "k").where(F.col("size") <= sample_bytes)
    sized = sized.distinct().orderBy(F.xxhash64("k"), "k", "h", "label").limit(sample_size)
    upto = F.sum("size").over(Window.orderBy(F.xxhash64("k"), "k", "h", "label"))  # over sample_size rows at most
    sample = sized.withColumn("upto", upto).where(F.col("upto") <= sample_bytes).select(F.col("k").alias("s_k"), F.col("h").alias("s_h"), "label")
    rows = texts.withColumn("h", F.xxhash64("text")).join(F.broadcast(sample), (F.col("k") == F.col("s_k")) & (F.col("h") == F.col("s_h")))
    rows = rows.dropDuplicates(["k", "h", "label"]).select("label", "text").repartition(1).sortWithinPartitions("label", F.xxhash64("text"))
    weights = np.zeros(BUCKETS)
    bias = float(np.log(1 / 3))  # where no row is labelled
    for r in rows.mapInArrow(_train_rows, "bucket long, weight double").collect():  # at most one row a bucket
        if r["bucket"] < 0:
            bias = r["weight"]
        else:
            weights[r["bucket"]] = r["weight"]
    return Model(bias, weights)


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """docs and a column score_col from 0 to 1, in place of one of that name."""
    docs = docs.drop(score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        wanted = model.weights != 0
        for batch in batches:
            texts = batch.column(at)
            scores = [score(model, texts.slice(a, b - a).fill_null("").to_pylist(), wanted) for a, b in text_slices(texts, BATCH_CHARS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0), *scores]))], [*batch.schema.names, score_col])

    return docs.mapInArrow(rate, f"{schema}, `{score_col}` double")


ship_by_value(__name__)
