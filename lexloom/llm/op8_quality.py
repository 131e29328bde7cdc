"""Document quality by random-indexing word vectors and a small numpy network.

Words are runs of letters (A-Z lower-cased), of digits, or of other signs; a word
of capitals has a sign word before it. Words are hashed to BUCKETS. Every bucket
has a sparse random index vector; its context vector is the sum of the index
vectors of the words around its occurrences in all documents, counted in each
partition and added up by Spark. A document is pooled into the weighted mean and
spread of its words' vectors and the logarithm of its words. A two-layer network,
trained on a bounded sample of labelled documents (SAMPLE rows at most, taken by
hash), gives a logit, and a temperature fitted on the part held back from training
makes it a probability.

Defined cases: null and empty texts pool to zeros and are scored like others;
labels without a document, or with a null value, are ignored; repeated label
rows count each; without both classes in the sample the score is the labels'
mean, or 0.5 without any; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import fold, materialize, small_batches

BUCKETS, WIDTH, NONZERO, WINDOW = 1 << 13, 96, 4, 3
#: Bound on the labelled rows that train the network.
SAMPLE = 8192
HIDDEN, EPOCHS, RATE, DECAY, THRESHOLD = 32, 40, 3e-3, 1e-2, 0.3
#: Frequency of a word at which its weight in a document is halved, and the weight of its own index
#: vector beside its context. Chosen, as the sizes above, by log loss on a part of the training rows.
COMMON, OWN = 3e-2, 1.0
HELD_TOKENS = 400_000
SIZE = 2 * WIDTH + 1
WORDS = re.compile(rb"([A-Z]{2,})(?![a-z\x80-\xff])|[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\x00-\x20]+")
CAPITALS = b"\x00A"


class Buckets(dict):
    """Bucket of each word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = found = zlib.crc32(word) % BUCKETS
        return found


def split(text: str | None) -> list[bytes]:
    out: list[bytes] = []
    for m in WORDS.finditer(text.encode("utf-8", "replace") if text else b""):
        if m.group(1):
            out.append(CAPITALS)
        out.append(m.group().lower())
    return out


def index_vectors(seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each bucket's index vector."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, WIDTH, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def context_counts(docs: DataFrame) -> DataFrame:
    """(text) -> bucket, n, c0..: occurrences and summed index vectors of the neighbours."""
    names = [f"c{k}" for k in range(WIDTH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, (place, sign) = Buckets(), index_vectors()
        n, sums = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS * WIDTH)

        def add(flat: np.ndarray, text: np.ndarray) -> None:
            nonlocal n, sums
            n += np.bincount(flat, minlength=BUCKETS)
            for gap in range(1, WINDOW + 1):
                same = text[:-gap] == text[gap:]
                left, right = flat[:-gap][same], flat[gap:][same]
                for word, near in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        sums += np.bincount(word * WIDTH + place[near, k], weights=sign[near, k], minlength=len(sums))

        held, texts, size = [], 0, 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                words = split(t)
                if words:
                    held.append(np.fromiter(map(bucket.__getitem__, words), np.int64, len(words)))
                    size += len(words)
                if size > HELD_TOKENS:
                    add(np.concatenate(held), np.repeat(np.arange(len(held)), [len(x) for x in held]))
                    held, size = [], 0
        if held:
            add(np.concatenate(held), np.repeat(np.arange(len(held)), [len(x) for x in held]))
        at = np.flatnonzero(n)
        wide = sums.reshape(BUCKETS, WIDTH)[at].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), *(pa.array(np.ascontiguousarray(wide[:, k])) for k in range(WIDTH))], ["bucket", "n", *names])

    made = docs.select("text").mapInArrow(run, "bucket int, n long, " + ", ".join(f"{x} long" for x in names))
    return made.groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names])


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (own index plus context) and pooling weights of all buckets."""
    place, sign = index_vectors()
    vectors, n = np.zeros((BUCKETS, WIDTH)), np.zeros(BUCKETS)
    for r in context_counts(docs).collect():
        n[r[0]], vectors[r[0]] = r[1], r[2:]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    for k in range(NONZERO):
        vectors[np.arange(BUCKETS), place[:, k]] += OWN * sign[:, k]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    share = n / max(n.sum(), 1.0)
    return vectors.astype(np.float32), (COMMON / (COMMON + share)).astype(np.float32)


def pooled(text: str | None, bucket: Buckets, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    words = split(text)
    out = np.zeros(SIZE, np.float32)
    if not words:
        return out
    at = np.fromiter(map(bucket.__getitem__, words), np.int64, len(words))
    total, mean, square = 0.0, np.zeros(WIDTH), np.zeros(WIDTH)
    for start in range(0, len(at), 65536):  # bounds memory for long texts
        piece = at[start : start + 65536]
        w, v = weights[piece], vectors[piece]
        total += float(w.sum())
        mean += w @ v
        square += w @ (v * v)
    mean /= total
    out[:WIDTH], out[WIDTH : 2 * WIDTH] = mean, np.sqrt(np.maximum(square / total - mean * mean, 0))
    out[2 * WIDTH] = np.log1p(len(words))
    return out


def pool(docs: DataFrame, vectors: np.ndarray, weights: np.ndarray) -> DataFrame:
    """docs (doc_id, text) -> doc_id, pooled (float32 bytes)."""
    sent = docs.sparkSession.sparkContext.broadcast((vectors, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Buckets()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pooled(t, bucket, *sent.value).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "pooled"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, pooled binary")


class Network(NamedTuple):
    center: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.center) / self.spread @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -50, 50)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 3) -> Network:
    """Adam on log loss; every fifth row is held back and sets the temperature."""
    if len(y) == 0 or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.5, 0.0, 1.0)
        p = min(max(p, 1e-6), 1 - 1e-6)
        return Network(np.zeros(SIZE), np.ones(SIZE), np.zeros((SIZE, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))), 1.0)
    rng = np.random.default_rng(seed)
    center, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - center) / spread
    back = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    fit = np.flatnonzero(~back)
    params = [rng.normal(0, np.sqrt(2 / SIZE), (SIZE, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(fit)
        for at in range(0, len(order), 128):
            rows = order[at : at + 128]
            a = z[rows] @ params[0] + params[1]
            h = np.maximum(a, 0)
            g = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -50, 50))) - y[rows]) / len(rows)
            back_h = np.outer(g, params[2]) * (a > 0)
            grads = [z[rows].T @ back_h + DECAY * params[0], back_h.sum(axis=0), h.T @ g + DECAY * params[2], np.array([g.sum()])]
            t += 1
            for k, d in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                params[k] = params[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net = Network(center, spread, params[0], params[1], params[2], float(params[3][0]), 1.0)
    if back.any():
        logit, label = net.logit(x[back]), y[back]
        grid = np.exp(np.linspace(-1.5, 2.5, 81))
        net = net._replace(temperature=float(min(grid, key=lambda s: (np.logaddexp(0, -np.where(label > 0, logit, -logit) / s)).mean())))
    return net


def sample_of(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most SAMPLE labelled rows, by the hash of their id, so any size of input gives the like."""
    n = labelled.count()
    share = min(1.0, 0.9 * SAMPLE / max(n, 1)) if n > SAMPLE else 1.0
    taken = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(SAMPLE).collect()
    taken.sort(key=lambda r: (r["doc_id"], r["pooled"], r["quality"]))
    x = np.array([np.frombuffer(r["pooled"], np.float32) for r in taken], np.float64).reshape(-1, SIZE)
    return x, np.array([float(r["quality"]) for r in taken])


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, quality) -> doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession, 500)
    rows = materialize(pool(docs, *word_vectors(docs)), "quality-pooled")
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality")
    known = known.where(fold(F.col("doc_id"), folds) != held)
    net = train(*sample_of(rows.join(known, "doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([np.frombuffer(b, np.float32) for b in batch.column(1).to_pylist()], np.float64).reshape(-1, SIZE)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.probability(x), pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
