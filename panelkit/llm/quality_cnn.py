"""Quality classifier (operator 7): a byte-level convolutional network in numpy.

A text's UTF-8 bytes are covered by overlapping chunks of fixed size.  Bytes
are embedded, learned filters run over each chunk with a stride, and each
filter's maximum over the chunk is kept.  A text's mean and maximum over its
chunks enter one logistic unit: one probability for the whole text, whatever
its length.  Training (Adam on the cross-entropy) is done on the driver from
a bounded sample of labelled texts; scoring is one narrow pass over all
documents with the weights broadcast (a few kB).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, doc_columns, hash_sample, text_bytes

CHUNK = 256         # bytes of a chunk
STEP = 192          # from one chunk's start to the next: 64 bytes overlap
STRIDE = 4          # bytes from one filter position to the next
EMBED = 8
FILTERS = 32        # of 2 * STRIDE bytes each
SAMPLE_ROWS = 3_000         # bound of the training sample: texts ...
SAMPLE_TEXT_BYTES = 32_768  # ... and the longest text that is trained on
STEPS = 500
BATCH = 24
THRESHOLD = 0.3
FOLDS = 5


def chunks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Chunk matrix (chunks, CHUNK) and the first chunk of each text; short
    chunks end in zeros, an empty text has one chunk of zeros."""
    counts = [1 + max(0, -(-(len(t) - CHUNK) // STEP)) for t in texts]
    out = np.zeros((sum(counts), CHUNK), np.uint8)
    at = 0
    for t, n in zip(texts, counts):
        raw = np.frombuffer(t, np.uint8)
        for k in range(n):
            part = raw[k * STEP:k * STEP + CHUNK]
            out[at + k, :len(part)] = part
        at += n
    return out, np.cumsum([0, *counts[:-1]])


class ByteCNN:
    """Weights: embedding (256, EMBED); filters of a position's first and
    second half (STRIDE * EMBED, FILTERS); bias; output unit."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        width = STRIDE * EMBED
        draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.w = {"embed": draw(256, EMBED, scale=0.5), "first": draw(width, FILTERS, scale=width ** -0.5),
                  "second": draw(width, FILTERS, scale=width ** -0.5), "bias": np.zeros(FILTERS, np.float32),
                  "out": draw(2 * FILTERS, scale=0.05), "base": np.zeros(1, np.float32)}

    def _maps(self, chunks):
        groups = self.w["embed"][chunks].reshape(len(chunks), CHUNK // STRIDE, STRIDE * EMBED)
        maps = groups[:, :-1] @ self.w["first"]
        maps += groups[:, 1:] @ self.w["second"]
        return groups, maps

    def chunk_features(self, chunks: np.ndarray) -> np.ndarray:
        """Each filter's (rectified) maximum over each chunk."""
        out = np.empty((len(chunks), FILTERS), np.float32)
        for a in range(0, len(chunks), 256):              # stay in the cache
            out[a:a + 256] = self._maps(chunks[a:a + 256])[1].max(1)
        return np.maximum(out + self.w["bias"], 0)

    def pool(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        counts = np.diff(np.r_[first, len(features)])[:, None]
        return np.hstack([np.add.reduceat(features, first, axis=0) / counts,
                          np.maximum.reduceat(features, first, axis=0)])

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each text; long batches go in parts."""
        out, part, size = [], [], 0
        for t in texts:
            part.append(t)
            size += len(t)
            if size > 1_000_000:
                out.append(self._score(part))
                part, size = [], 0
        if part:
            out.append(self._score(part))
        return np.concatenate(out) if out else np.zeros(0)

    def _score(self, texts):
        chunks, first = chunks_of(texts)
        z = self.pool(self.chunk_features(chunks), first).astype(np.float64) @ self.w["out"] + self.w["base"][0]
        return 1 / (1 + np.exp(-z))

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy over a batch."""
        chunks, first = chunks_of(texts)
        groups, maps = self._maps(chunks)
        best = maps.argmax(1)                               # (chunks, FILTERS)
        peak = np.take_along_axis(maps, best[:, None], 1)[:, 0] + self.w["bias"]
        features = np.maximum(peak, 0)
        pooled = self.pool(features, first)
        z = pooled @ self.w["out"] + self.w["base"][0]
        dz = ((1 / (1 + np.exp(-z)) - labels) / len(labels)).astype(np.float32)
        g = {"out": pooled.T @ dz, "base": np.array([dz.sum()], np.float32)}
        counts = np.diff(np.r_[first, len(features)])
        text_of = np.repeat(np.arange(len(texts)), counts)
        d = (dz / counts)[text_of, None] * self.w["out"][:FILTERS]
        top = pooled[text_of, FILTERS:]
        is_top = (features == top) & (top > 0)
        ties = np.add.reduceat(is_top.astype(np.float32), first, axis=0)[text_of]
        d = d + np.where(is_top, dz[text_of, None] * self.w["out"][FILTERS:] / np.maximum(ties, 1), 0)
        d = np.where(peak > 0, d, 0).astype(np.float32)
        g["bias"] = d.sum(0)
        c, f = np.nonzero(d)
        pos, value = best[c, f], d[c, f]
        dfirst, dsecond = np.zeros_like(self.w["first"].T), np.zeros_like(self.w["second"].T)
        np.add.at(dfirst, f, value[:, None] * groups[c, pos])
        np.add.at(dsecond, f, value[:, None] * groups[c, pos + 1])
        g["first"], g["second"] = dfirst.T, dsecond.T
        dembed = np.zeros_like(self.w["embed"])
        for half, name in ((0, "first"), (1, "second")):
            at = ((pos + half) * STRIDE)[:, None] + np.arange(STRIDE)
            np.add.at(dembed, chunks[c[:, None], at], (value[:, None] * self.w[name].T[f]).reshape(len(f), STRIDE, EMBED))
        g["embed"] = dembed
        return g

    def fit(self, texts: list[bytes], labels: list[int], steps: int = STEPS, seed: int = 7) -> "ByteCNN":
        """Adam over shuffled batches, the rate falling to zero.  Of no texts
        or one class only the constant that class has is learned."""
        y = np.asarray(labels, np.float32)
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.w["base"][0] = np.log(share / (1 - share))
        if len(set(labels)) < 2:
            self.w["out"][:] = 0
            return self
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        order, at = rng.permutation(len(texts)), 0
        for step in range(1, steps + 1):
            if at + BATCH > len(order):
                order, at = rng.permutation(len(texts)), 0
            pick = order[at:at + BATCH]
            at += BATCH
            g = self.gradients([texts[i] for i in pick], y[pick])
            rate = 0.01 * (1 - step / (steps + 1))
            for k, x in self.w.items():
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                x -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        return self


def held_out(doc_id) -> F.Column:
    """Whether a doc_id is in the fold that isn't learned from; a null is."""
    fold = F.crc32(doc_id.cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS,
          max_bytes: int = SAMPLE_TEXT_BYTES, steps: int = STEPS) -> ByteCNN:
    """Fit the network on at most ``sample_rows`` labelled documents.

    The sample is drawn by a hash of the doc_id from the labelled rows outside
    the held-out fold (null labels or ids don't count; of contradictory labels
    the larger counts; of repeated documents one text).  Texts of over
    ``max_bytes`` are not trained on.  So at most ``sample_rows * max_bytes``
    bytes come to the driver, at any size of the input.
    """
    ids = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
           .filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
           .groupBy("doc_id").agg(F.max("quality").alias("quality")))
    read = doc_columns(docs).filter(F.octet_length("text") <= max_bytes)
    # more ids than rows are drawn, as some have no (short) text here
    drawn = hash_sample(ids, ["doc_id"], 2 * sample_rows)
    rows = (read.join(F.broadcast(drawn), "doc_id").groupBy("doc_id")
            .agg(F.min("text").alias("text"), F.max("quality").alias("quality"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect())
    return ByteCNN().fit([text_bytes(r["text"]) for r in rows], [r["quality"] for r in rows], steps=steps)


def score_documents(docs: DataFrame, model: ByteCNN, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score double, predicted int`` per row of ``docs``.

    Every whole text is scored, an empty or null one too; null doc_ids (held
    out by definition) and repeated rows are scored like others; other columns
    are ignored.  One narrow pass, no shuffle.
    """
    weights = docs.sparkSession.sparkContext.broadcast(model.w)
    fields = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        net = ByteCNN()
        net.w = weights.value
        for ids, texts in columns_of(batches):
            scores = net.score([text_bytes(t) for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], schema=fields)

    scored = doc_columns(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, model: ByteCNN, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (all their columns) with a score of at least
    ``threshold``; texts are scored as in :func:`score_documents`.  The score
    is computed beside each row, so nothing is joined."""
    weights = docs.sparkSession.sparkContext.broadcast(model.w)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        net = ByteCNN()
        net.w = weights.value
        return pd.Series(net.score([text_bytes(t) for t in texts]))

    return docs.filter(score(F.coalesce(F.col("text").cast("string"), F.lit(""))) >= threshold)
