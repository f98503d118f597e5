"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its hashed character n-grams and of itself; a text's
is the mean over its words. n-grams of few documents count less, by a smooth factor, and those of one document not at
all: its text would only be learned by heart. As the softmax is linear, scoring needs one number per bucket. Labels come
only from rows that aren't held out; documents labelled both ways teach nothing, and of rows that share a doc_id the
first text is learned from. Null or empty texts score the bias alone. Without both classes, or without words, every
score is the share of toxic labels. Repeated rows each give a row.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import by_slices, pick
from meridian.llm.langid import held_out

BUCKETS, DIM, EPOCHS, RATE, DECAY = 1 << 18, 2, 150, 0.03, 1e-4
#: n-grams that this many of the sampled documents hold count half.
HALF = 100
#: Bound of the labelled sample: documents per class, learned from as a whole.
SAMPLE_DOCS = 1200
WORDS_KEPT = 400_000
THRESHOLD = 0.3


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def grams(word: str) -> list[int]:
    s = f"<{word}>".encode()
    return [zlib.crc32(s) % BUCKETS, *(zlib.crc32(s[i : i + n]) % BUCKETS for n in (3, 4, 5) for i in range(len(s) - n + 1))]


def shares(text: str | None, known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text, sorted, and what share of the text each has."""
    words = Counter(words_of(text))
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    for w in words:
        if w not in known:
            if len(known) >= WORDS_KEPT // 8:
                known.clear()
            known[w] = np.array(grams(w), np.int32)
    each = [known[w] if w in known else np.array(grams(w), np.int32) for w in words]
    size = np.array([len(g) for g in each])
    share = np.repeat(np.array(list(words.values())) / words.total() / size, size)
    u, inverse = np.unique(np.concatenate(each), return_inverse=True)
    return u, np.bincount(inverse, share).astype(np.float32)


def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, np.ndarray] = {}
    for b in by_slices(batches):
        got = [shares(t, known) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[k].tobytes() for x in got], pa.binary()) for k in (0, 1))], ["doc_id", "bucket", "share"])


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[np.ndarray, np.ndarray, int]], float]:
    """Buckets, shares and label of a bounded sample of labelled rows, whole texts, the same for the same rows; and the rate of toxic labels."""
    known = pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    rate = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    ids = {}
    for y in (1, 0):
        ids |= {r[0]: y for r in known.where(F.col("toxic") == y).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).collect()}
    if not ids:
        return [], rate
    rows = pick(docs, "doc_id", "text").where(F.col("doc_id").isin(sorted(ids))).groupBy("doc_id").agg(F.min("text").alias("text"))
    got = rows.mapInArrow(vectors, "doc_id long, bucket binary, share binary").collect()
    got.sort(key=lambda r: (r.doc_id, r.bucket, r.share))
    return [(np.frombuffer(r.bucket, np.int32), np.frombuffer(r.share, np.float32), ids[r.doc_id]) for r in got], rate


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], rate: float = 0.5) -> tuple[np.ndarray, float]:
    """One weight per bucket and the bias: embeddings and softmax are learned together by Adam on full
    batches in which both classes weigh the same; then the bias is set for the given rate of toxic labels."""
    y = np.array([t for *_, t in rows], np.float64)
    doc = np.repeat(np.arange(len(y), dtype=np.int32), [len(b) for b, *_ in rows])
    if not len(y) or y.min() == y.max() or not len(doc):
        p = float(np.clip((y.mean() if y.min() == y.max() else rate) if len(y) else 0.0, 1e-6, 1 - 1e-6))
        return np.zeros(BUCKETS), float(np.log(p / (1 - p)))
    # Document-by-bucket shares, as sorted triples.
    bucket, share = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
    held = np.bincount(bucket, minlength=BUCKETS)
    seen = held > 1
    trust = np.where(seen, held / (held + HALF), 0.0)
    ids = np.cumsum(seen) - 1
    share = share * trust[bucket]
    doc, bucket, share = doc[seen[bucket]], ids[bucket[seen[bucket]]], share[seen[bucket]]
    size = int(seen.sum())
    rng = np.random.default_rng(0)
    e, w, bias = rng.normal(0, 0.1, (size, DIM)), rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (e, w, bias)]
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    n = len(y)
    for t in range(1, EPOCHS + 1):
        h = np.stack([np.bincount(doc, share * e[bucket, k], n) for k in range(DIM)], 1) * 100
        z = h @ w + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y.astype(int)] -= 1
        p *= weight[:, None]
        back = p @ w.T * 100
        ge = np.stack([np.bincount(bucket, share * back[doc, k], size) for k in range(DIM)], 1)
        for p_, g, (m, v) in zip((e, w, bias), (ge + DECAY * e, h.T @ p, p.sum(0)), state, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p_ -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-12)
    out = np.zeros(BUCKETS)
    out[seen] = 100 * trust[seen] * (e @ (w[:, 1] - w[:, 0]))
    return out, float(bias[1] - bias[0] + np.log(rate / (1 - rate)))


def predict(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    packed = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = packed.astype(np.float64)
        known: dict[str, float] = {}
        for b in by_slices(batches):
            out = []
            for t in b.column(1).to_pylist():
                words = words_of(t)
                new = {w for w in words if w not in known}
                if len(known) + len(new) > WORDS_KEPT:
                    known.clear()
                    new = set(words)
                for w in new:
                    g = grams(w)
                    known[w] = float(value[g].sum()) / len(g)
                z = bias + (sum(known[w] for w in words) / len(words) if words else 0.0)
                out.append(1 / (1 + np.exp(-np.clip(z, -50, 50))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return predict(docs, *train(*sample(docs, labels))).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
