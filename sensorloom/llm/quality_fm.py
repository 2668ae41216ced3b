"""Quality classifier: a factorisation machine over hashed words, structure statistics and size.

The score is w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j. By the sum-of-squares identity the pairs
cost as much as the features: half of (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 over the factors f. A document's
features come from its text alone, so every row is scored where it lies, without a shuffle. The model is
fitted with logistic loss on a bounded sample of labelled rows: those with the smallest hashes of doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import cached_words, small_batches

BUCKETS = 2048  # of hashed words
#: Byte classes of the structure statistics (fixed values).
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".,;:", b"!?", b"#$%&*+=<>@^~|\\/_`", b"\"'()[]{}-", bytes(range(128, 256)))
CLASS_OF = np.full(256, len(CLASSES), np.int64)
for _k, _c in enumerate(CLASSES):
    CLASS_OF[list(_c)] = _k
STATS = len(CLASSES) + 1 + 9
WIDTH = BUCKETS + STATS


def features(texts: list[bytes | None]) -> np.ndarray:
    """A row for each text: hashed words by the root of their share, then structure statistics in plain units."""
    cache, out = cached_words(), np.zeros((len(texts), WIDTH), np.float32)
    for k, text in enumerate(texts):
        text = text or b""
        words = text.split()
        n, size = len(words), len(text)
        kinds = np.bincount(CLASS_OF[np.frombuffer(text, np.uint8)], minlength=len(CLASSES) + 1) if size else np.zeros(len(CLASSES) + 1)
        stats = out[k, BUCKETS:]
        stats[: len(kinds)] = np.sqrt(kinds / max(1, size))
        if n:
            h = cache.of(words)
            counts = np.bincount((h % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
            out[k, :BUCKETS] = np.sqrt(counts / n)
            stats[len(kinds) :] = (
                np.log1p(n) / 10,
                np.log1p(size) / 12,
                (size / n) / 20,
                len(set(words)) / n,
                float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0,
                counts.max() / n,
                np.log1p(text.count(b"\n")) / 8,
                sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n,
                sum(w.isupper() for w in words) / n,
            )
    return out


@dataclass
class Machine:
    """A fitted factorisation machine; features are centred and scaled by its own mean and scale."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.mean) / self.scale
        return self.bias + x @ self.linear + 0.5 * ((x @ self.factors) ** 2 - (x * x) @ (self.factors**2)).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30).astype(np.float64)))


def fit(x: np.ndarray, y: np.ndarray, factors: int = 8, rounds: int = 120, rate: float = 0.02, shrink: float = 1e-4, seed: int = 7) -> Machine:
    """Logistic loss with weight decay, full batches, Adam steps. No rows: a machine that gives every text 0.5. x is overwritten."""
    random = np.random.default_rng(seed)
    width = x.shape[1]
    mean, scale = np.zeros(width, np.float32), np.ones(width, np.float32)
    m = Machine(0.0, np.zeros(width, np.float32), np.zeros((width, factors), np.float32), mean, scale)
    if not len(y) or y.min() == y.max():
        m.bias = 0.0 if not len(y) else (3.0 if y[0] else -3.0)
        return m
    mean[:] = x.mean(0)
    # Words are scaled together, so that rare ones stay small; each statistic by its own spread.
    scale[:BUCKETS] = max(1e-6, float(x[:, :BUCKETS].std())) * 4
    scale[BUCKETS:] = np.maximum(x[:, BUCKETS:].std(0), 1e-3)
    z = np.subtract(x, mean, out=x)
    z /= scale
    m.factors[:] = random.normal(0, 0.02, (width, factors))
    theta = np.concatenate([m.factors, m.linear[:, None]], axis=1)
    first, second, bias, b1, b2 = np.zeros_like(theta), np.zeros_like(theta), float(np.log(y.mean() / (1 - y.mean()))), 0.0, 0.0
    square = z * z
    for step in range(1, rounds + 1):
        v, w = theta[:, :-1], theta[:, -1]
        s = z @ v
        raw = bias + z @ w + 0.5 * (s * s - square @ (v * v)).sum(1)
        error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y).astype(np.float32) / len(y)
        grad = np.empty_like(theta)
        grad[:, -1] = z.T @ error
        grad[:, :-1] = z.T @ (error[:, None] * s) - v * (square.T @ error)[:, None]
        grad += shrink * theta
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        e = float(error.sum())
        b1, b2 = 0.9 * b1 + 0.1 * e, 0.999 * b2 + 0.001 * e * e
        bias -= rate * (b1 / (1 - 0.9**step)) / (np.sqrt(b2 / (1 - 0.999**step)) + 1e-8)
    return Machine(bias, theta[:, -1].copy(), theta[:, :-1].copy(), mean, scale)


def held_out(doc_id):
    """Whether crc32 of doc_id as text leaves no remainder by 5; false without doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> Machine:
    """Fits on at most `sample` labelled rows that are not held out: the bound on what reaches the driver.

    Rows without label or text id are left out; a document with several labels counts once for each.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    kinds = "x binary, y int, doc_id long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                x = features(list(part["text"])).astype(np.float16)
                yield pd.DataFrame({"x": [r.tobytes() for r in x], "y": part["y"], "doc_id": part["doc_id"]})

    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    got = texts.join(F.broadcast(known), "doc_id").mapInPandas(run, kinds).orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(sample).toPandas()
    x = np.stack([np.frombuffer(r, np.float16) for r in got["x"]]).astype(np.float32) if len(got) else np.zeros((0, WIDTH), np.float32)
    y = got["y"].to_numpy(np.float32)
    del got
    return fit(x, y)


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold); a null text is an empty one."""
    columns, own = [c for c in docs.columns if c not in ("score", "predicted")], "__text"
    while own in columns:
        own += "_"
    whole = small_batches(docs).select(*[F.col(f"`{c}`") for c in columns], F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias(own))

    @F.pandas_udf(DoubleType())
    def of(texts: pd.Series) -> pd.Series:
        parts = [machine.score(features(list(texts.iloc[lo : lo + 256]))) for lo in range(0, len(texts), 256)]
        return pd.Series(np.concatenate(parts) if parts else np.empty(0))

    return whole.withColumn("score", of(own)).withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop(own)


def classify(docs: DataFrame, labels: DataFrame, sample: int = 6000, threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted, by a machine fitted on labels(doc_id, quality).

    Labels, lang, source and doc_id are no inputs of a score. Without usable labels every score is 0.5.
    Nulls in any column and repeated rows are scored like others; an empty table gives an empty result;
    further columns pass through, but those named score or predicted are replaced.
    """
    return score(docs, train(docs, labels, sample), threshold)
