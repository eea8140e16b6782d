"""Toxicity by subword bags: averaged embeddings of words and their character n-grams under a linear
softmax, trained jointly, so that misspellings share vectors with what they are made from."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fold, mix64

#: Labelled rows, at most about, that the model is fitted on.
TRAIN_ROWS = 8000
#: Bytes, at most about, of the bags of n-grams that the driver receives; longer texts mean fewer rows.
TRAIN_BYTES = 128 << 20
#: Mini-batches, at least, that the model is trained on, so that few rows are seen more often.
STEPS = 1000
#: Power of the classes' ratio that the rarer class weighs more by.
WORTH = 0.5
BUCKET_BITS, DIMS, ORDERS = 15, 8, (3, 4, 5)
_WORDS = bytes(b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
_M = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 1 << 19


def _normal(text: str) -> bytes:
    """Lower case, one blank around each word; what is neither letter nor digit parts words."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_WORDS).split()) + b" "


def _features(data: bytes) -> np.ndarray:
    """Buckets of all n-grams inside single words (with the blank around them) and of whole words."""
    d = np.frombuffer(data, np.uint8)
    blank = d == 32
    inner = np.concatenate(([0], np.cumsum(blank)))
    parts, value = [], np.zeros(len(d), np.uint64)
    for n in range(1, ORDERS[-1] + 1):
        m = len(d) - n + 1
        if m <= 0:
            break
        value = value[:m] | (d[n - 1 :].astype(np.uint64) << np.uint64(8 * (n - 1)))
        if n in ORDERS:
            ok = inner[n - 1 : n - 1 + m] - inner[1 : m + 1] == 0
            parts.append((value[ok] + np.uint64(n)) * _M >> np.uint64(64 - BUCKET_BITS))
    at = np.flatnonzero(blank)
    if len(at) > 1:
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(d) * np.arange(1, len(d) + 1, dtype=np.uint64))))
        # A word's hash: its letters weighted by their place in it.
        plain = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(d))))
        s, e = at[:-1] + 1, at[1:]
        h = (total[e] - total[s]) - (plain[e] - plain[s]) * s.astype(np.uint64)
        parts.append(mix64(h + np.uint64(77)) >> np.uint64(64 - BUCKET_BITS))
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def blocks(text: str):
    data, at = _normal(text), 0
    while at < len(data) - 1:
        end = min(len(data), at + BLOCK)
        end = len(data) if end == len(data) else data.find(b" ", end - 1) + 1
        yield data[at:end]
        at = end - 1


@dataclass
class Model:
    gain: np.ndarray  # of each bucket: its embedding times the difference of the classes' weights
    bias: float

    def score(self, text: str) -> float:
        """Probability of the class 1 of the average of a whole text."""
        total = n = 0.0
        for b in blocks(text):
            f = _features(b)
            total += float(self.gain[f].sum())
            n += len(f)
        z = (total / n if n else 0.0) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", train_rows: int = TRAIN_ROWS) -> Model:
    """Fits on a sample of labelled rows that is bounded by train_rows (drawn by a hash of the key).
    Rows whose key falls in fold 0 of 5 and rows with a NULL text or label are never used. If rows of
    one class are missing the model is constant: the share of class 1, or 0.5 without any row."""
    marked = labels.where(F.col(label).isNotNull() & (F.coalesce(fold(key), F.lit(0)) != 0)).select(F.col(key).alias("id"), (F.col(label) > 0).cast("int").alias("y"), (F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)).alias("u"))
    n = marked.count()
    share = train_rows / n if n else 1.0
    marked = cut(marked.where(F.col("u") < share).groupBy("id").agg(F.max("y").alias("y"), F.max("u").alias("u")))
    # The sample has about train_rows rows of some bytes; texts go to it, never through a shuffle.
    marked = F.broadcast(marked) if marked.count() <= 2 * train_rows else marked
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text")).join(marked, "id")
    # A bag has at most one entry of 4 bytes for each byte and order, and no more than there are buckets.
    weight = rows.agg(F.sum(4 * F.least(F.octet_length("text") * 4, F.lit(1 << BUCKET_BITS)))).first()[0] or 0
    rows = rows.where(F.col("u") < share * min(1.0, TRAIN_BYTES / weight if weight else 1.0)).select("y", "text")
    schema = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("f", T.BinaryType()), T.StructField("c", T.BinaryType())])

    def bags(it):
        for b in it:
            f, c = [], []
            for t in b.column(1):
                t = t.as_py()
                bag = np.zeros(1 << BUCKET_BITS)
                for x in blocks(t):
                    bag += np.bincount(_features(x), minlength=len(bag))
                at = np.flatnonzero(bag)
                f.append(at.astype(np.uint16 if BUCKET_BITS <= 16 else np.uint32).tobytes())
                c.append((bag[at] / max(bag.sum(), 1)).astype(np.float16).tobytes() if len(at) else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.binary()), pa.array(c, pa.binary())], ["y", "f", "c"])

    data = rows.mapInArrow(bags, schema).toPandas()
    y = data["y"].to_numpy(np.float32) if len(data) else np.zeros(0, np.float32)
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), float(np.log((p + 1e-3) / (1 - p + 1e-3))))
    return _train([np.frombuffer(v, np.uint16 if BUCKET_BITS <= 16 else np.uint32) for v in data["f"]], [np.frombuffer(v, np.float16) for v in data["c"]], y)


def _train(buckets: list[np.ndarray], shares: list[np.ndarray], y: np.ndarray, steps: int = STEPS, epochs: int = 4, rate: float = 0.5, seed: int = 5) -> Model:
    """Adagrad on mini-batches over embeddings and class weights together: `epochs` passes, or as many as make
    `steps` batches. The rarer class weighs more, by the square root of its lack."""
    rng = np.random.default_rng(seed)
    v = 1 << BUCKET_BITS
    e = (rng.standard_normal((v, DIMS)) * 0.1).astype(np.float32)
    w, b = np.zeros((DIMS, 2), np.float32), np.zeros(2, np.float32)
    ge, gw, gb = np.full(v, 1e-6, np.float32), np.full((DIMS, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    target = np.stack([1 - y, y], 1)
    worth = np.where(y > 0, (1 - y.mean()) / y.mean(), 1.0) ** WORTH
    worth = (worth / worth.mean()).astype(np.float32)
    batch = 32
    epochs = max(epochs, -(-steps * batch // len(y)))
    # Shares are scaled so that one n-gram of an average text moves the average visibly.
    scale = float(np.mean([len(x) for x in buckets])) ** 0.5
    w += rng.standard_normal((DIMS, 2)).astype(np.float32) * 0.1
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            part = order[lo : lo + batch]
            size = np.array([len(buckets[i]) for i in part])
            keep = size > 0
            part, size = part[keep], size[keep]
            if not len(part):
                continue
            f = np.concatenate([buckets[i] for i in part]).astype(np.int64)
            s = np.concatenate([shares[i] for i in part]).astype(np.float32) * scale
            starts = np.concatenate(([0], np.cumsum(size)[:-1]))
            hidden = np.add.reduceat(e[f] * s[:, None], starts, axis=0)
            z = hidden @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (p - target[part]) * worth[part, None] / len(part)
            back = g @ w.T
            used, place = np.unique(f, return_inverse=True)
            d = np.empty((len(used), DIMS), np.float32)
            rows = np.repeat(back, size, axis=0) * s[:, None]
            for k in range(DIMS):
                d[:, k] = np.bincount(place, rows[:, k], len(used))
            dw, db = hidden.T @ g, g.sum(axis=0)
            ge[used] += (d * d).mean(axis=1)
            gw += dw * dw
            gb += db * db
            e[used] -= rate * d / np.sqrt(ge[used])[:, None]
            w -= rate * 0.2 * dw / np.sqrt(gw)
            b -= rate * 0.2 * db / np.sqrt(gb)
    gain = e @ (w[:, 1] - w[:, 0]) * scale
    return Model(gain.astype(np.float32), float(b[1] - b[0]))


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and score (0 to 1) for each row of docs. NULL and empty texts get the score of an empty
    bag; texts of any length are read whole, in blocks; repeated rows are scored each for itself; other
    columns are not read; an empty table gives an empty result."""
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it):
        own = shared.value
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.score(t.as_py()) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())]))
