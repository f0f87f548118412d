"""Quality classifier: hashed word and character n-gram vectors, averaged, softmax output, numpy SGD."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Hashes, table, trim

BUCKETS = 1 << 17
DIM = 16
GRAMS = (3, 4, 5)  # characters
SAMPLE = 3000  # labelled texts that the fit takes at most, by hash of doc_id
SAMPLE_BYTES = 16 << 20  # and bytes of them
EPOCHS, RATE, BATCH = 6, 0.6, 16
THRESHOLD = 0.7


def word_bucket(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"), 1) % BUCKETS


def features(text: str | None, known: Hashes) -> np.ndarray:
    """Bucket of every character n-gram and word of the whole text; none for null and white space."""
    w = [] if text is None else text.split()
    if not w:
        return np.zeros(0, dtype=np.int64)
    raw = np.frombuffer(f" {' '.join(w)} ".encode("utf-32-le", "replace"), dtype="<u4")
    out, h = [known.array(w).astype(np.int64)], np.zeros(len(raw), dtype=np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(raw) < n:
            break
        h = h[: len(raw) - n + 1] * np.uint32(0x01000193) + raw[n - 1 :]
        if n in GRAMS:
            out.append((((h + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(15)).astype(np.int64) % BUCKETS)
    return np.concatenate(out)


def fit(texts: list[str], labels: list[int], seed: int = 5) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias): log odds of label 1 are the mean weight of a text's features plus the bias.

    Learned are DIM-dimensional vectors E and softmax weights W; since the text's vector is a mean, E @ W gives the
    same scores from one number a bucket. The loss of each label counts alike in proportion to its share.
    """
    rng = np.random.default_rng(seed)
    vec, out, bias = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)), np.zeros((DIM, 2)), np.zeros(2)
    docs, known = [], Hashes(word_bucket)
    for t in texts:
        ids, n = np.unique(features(t, known), return_counts=True)
        docs.append((ids.astype(np.int32), (n / max(n.sum(), 1)).astype(np.float32)))  # the driver holds the whole sample's
    y = np.array(labels)
    if len(y):
        bias = np.log(np.array([(y == 0).sum(), (y == 1).sum()]) + 1.0)
        bias -= bias.mean()
    steps, total = 0, max(1, EPOCHS * len(docs) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            rate = RATE * max(0.05, 1 - steps / total)
            steps += 1
            hidden = np.array([docs[k][1] @ vec[docs[k][0]] for k in part])
            z = hidden @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            back = p @ out.T
            out -= rate * hidden.T @ p
            bias -= rate * p.mean(axis=0) * 0.1
            for k, g in zip(part, back, strict=True):
                # a mean over many features moves each one little; the step is scaled to the text's own weights
                ids, share = docs[k]
                if len(ids):
                    vec[ids] -= rate * np.outer(share / np.sqrt((share**2).sum()), g)
    return ((vec @ out) @ np.array([-1.0, 1.0])).astype(np.float32), float(bias[1] - bias[0])


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Fits on labelled rows of the folds that aren't held out, SAMPLE texts or SAMPLE_BYTES at most, by hash of doc_id.

    Of clashing labels of a doc_id the larger counts, of its texts the least. Null texts and labels other than
    0 and 1 are left out. Without any labelled text every score is 0.5.
    """
    marked = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    ordered = rows.select("doc_id", F.octet_length("text").alias("b")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # SAMPLE rows at most
    kept, used = [], 0
    for r in ordered:
        if used + r["b"] <= SAMPLE_BYTES:
            kept.append(r["doc_id"])
            used += r["b"]
    got = rows.where(F.col("doc_id").isin(kept)).orderBy(F.xxhash64("doc_id"), "doc_id").collect() if kept else []
    model = fit([r["text"] for r in got], [r["quality"] for r in got])
    trim()
    return model


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """Every column of docs, with score (0 to 1) and predicted; a text without words has the bias's score."""
    weights, bias = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]

    @F.pandas_udf("double")
    def p(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, known = weights.value, Hashes(word_bucket)
        for s in texts:
            z = np.array([w[f].mean(dtype=np.float64) if len(f := features(t, known)) else 0.0 for t in s]) + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    out = docs.withColumn("score", p("text"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; null and empty texts have the bias's score, rows without doc_id aren't held out, repeated rows stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
