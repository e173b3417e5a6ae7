"""Quality classifier: logistic regression over hashed word 1- and 2-grams, trained by follow-the-regularised-leader.

A document's score is the logistic of a bias and the dot product of the weights with its sparse gram frequencies. The
model is fitted on at most ``TRAIN_ROWS`` labelled documents, the first in a fixed pseudo-random order of ids, whose
crc32(doc_id as text) mod 5 isn't 0; everything else is scored in full.

Defined results: null counts as empty and scores the bias alone; a label given more than once counts if all agree; a
labelled id with several texts counts with one of them, the same on every run; without labels every score is 0.5; a null
id is never trained on and not held out; repeated rows score alike; an empty table gives no rows; a very long text is read
in pieces; columns other than doc_id and text, whatever their names, are only handed on by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralex.llm import words
from terralex.llm.arrow import mapped
from terralex.llm.keys import unused
from terralex.llm.storage import stage

TRAIN_ROWS = 6000
BITS = 18
EPOCHS = 4
ACCEPT = 0.3
SCALE = 40.0
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.1


def buckets(w: words.Words) -> Iterator[np.ndarray]:
    """Buckets of all 1- and 2-grams of each document of a slice."""
    one = (w.hashes >> np.uint64(64 - BITS)).astype(np.int64)
    pair, valid = words.grams(w, 2)
    two = (pair >> np.uint64(64 - BITS)).astype(np.int64)
    for a, b in zip(w.offsets, w.offsets[1:], strict=False):
        yield np.concatenate([one[a:b], two[a : max(a, b - 1)][valid[a : max(a, b - 1)]]])


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights of 2**BITS buckets and the bias, by FTRL-proximal over rows of (buckets, frequencies, label)."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for _ in range(EPOCHS):
        for at, x, y in rows:
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-max(-35.0, min(35.0, float(w @ x)))))
            g = (p - y) * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def sparse(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and scaled frequencies, with the bias at the end."""
    at, count = np.unique(grams, return_counts=True)
    return np.append(at, 1 << BITS), np.append(count * (SCALE / max(1, len(grams))), 1.0)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Fit in one task on the bounded sample; only the weights come to the driver."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_high"))
    known = known.where((F.col("quality") == F.col("_high")) & (fold(F.col("doc_id")) != 0)).select("doc_id", "quality", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("place"))
    sample = known.orderBy("place", "doc_id").limit(TRAIN_ROWS)
    # at most TRAIN_ROWS rows
    texts = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("pick")).join(F.broadcast(sample), "doc_id")

    def grams(batch: pa.RecordBatch) -> list:
        pairs = [sparse(b) for w in words.split(batch.column("text")) for b in buckets(w)]
        return [[a for a, _ in pairs], [x for _, x in pairs]]

    rows = stage(mapped(texts, ["place", "quality", "pick"], "at array<int>, x array<float>", grams), "classifier-sample")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple] = {}
        for b in batches:
            for place, y, pick, at, x in zip(*(b.column(i).to_pylist() for i in (0, 1, 2)), b.column(3), b.column(4), strict=True):
                if place not in seen or pick < seen[place][0]:
                    seen[place] = (pick, at.values.to_numpy(), x.values.to_numpy().astype(np.float64), y)
        weights = fit([seen[k][1:] for k in sorted(seen)])
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary())], ["weights"])

    made = rows.repartition(1).mapInArrow(fitted, "weights binary").first()
    return np.frombuffer(made[0], np.float32).astype(np.float64) if made else np.zeros((1 << BITS) + 1)


def scored(docs: DataFrame, weights: np.ndarray, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``keep`` columns (all by default) and the score, called ``name``, of every row."""
    packed = weights.astype(np.float32)

    def fn(batch: pa.RecordBatch) -> list:
        out = []
        for w in words.split(batch.column("text")):
            one = packed[w.hashes >> np.uint64(64 - BITS)].astype(np.float64)
            pair, valid = words.grams(w, 2)
            two = np.where(valid, packed[pair >> np.uint64(64 - BITS)], 0.0)
            n, doc = len(w.offsets) - 1, w.doc
            total = np.bincount(doc, one, n) + np.bincount(doc[: len(two)], two, n)
            size = w.counts + np.maximum(0, w.counts - 1)
            out.append(packed[-1] + total * SCALE / np.maximum(1, size))
        logit = np.concatenate(out) if out else np.zeros(0)
        return [1 / (1 + np.exp(-np.clip(logit, -35, 35)))]

    return mapped(docs, keep or docs.columns, f"`{name}` double", fn)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: whether it was held out, its score and the verdict."""
    table = scored(docs.select("doc_id", "text"), train(docs, labels), ["doc_id"])
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return table.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model accepts, with their columns."""
    name = unused(docs, "score")
    return scored(docs, train(docs, labels), name=name).where(F.col(name) >= ACCEPT).drop(name)
