"""Language identification by error-correcting output codes."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold

#: Rows of each language, at most about, that the classifiers are fitted on.
ROWS_PER_LANGUAGE = 400
#: Rows of all languages together, at most about, of 32 KB each: with more than 20 languages each has fewer.
SAMPLE_ROWS = 8000
DIM_BITS = 11
ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"
#: Every byte that is no letter ends a word; bytes from 128 on are parts of letters.
_WORDS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def _grams(text: bytes) -> list[np.ndarray]:
    """Bucket of the byte n-gram that starts at each byte, for each order; orders have buckets of their own."""
    d = np.frombuffer(text, np.uint8).astype(np.uint32)
    out, value = [], np.zeros(len(d), np.uint32)
    for i, n in enumerate(ORDERS):
        m = len(d) - n + 1
        if m <= 0:
            break
        value = value[:m] | (d[n - 1 :] << np.uint32(8 * (n - 1)))
        h = (value ^ (value >> np.uint32(15))) * _ODD[i]
        out.append((h ^ (h >> np.uint32(13))) * _ODD[i] >> np.uint32(32 - DIM_BITS))
    return out


def vector(text: str) -> np.ndarray:
    """Square roots of hashed n-gram shares of a whole text, of unit length; zero for no letters.
    Texts are prepared and counted in blocks, so memory is bounded."""
    counts, rest = np.zeros((len(ORDERS), 1 << DIM_BITS)), b" "
    for at in range(0, len(text), 1 << 18):
        data = text[at : at + (1 << 18)].lower().encode("utf-8", "replace").translate(_WORDS)
        # A word that a block cuts goes on without a blank.
        data = rest + (b"" if rest.endswith(b" ") or not data.startswith(b" ") else b" ") + b" ".join(data.split()) + (b" " if data.endswith(b" ") or at + (1 << 18) >= len(text) else b"")
        for i, g in enumerate(_grams(data)):
            counts[i] += np.bincount(g if at == 0 else g[max(0, len(rest) - ORDERS[i] + 1) :], minlength=1 << DIM_BITS)
        rest = data[-(ORDERS[-1] - 1) :]
    total = counts.sum(axis=1, keepdims=True)
    x = np.sqrt(counts / np.maximum(total, 1)).ravel().astype(np.float32)
    return x / max(float(np.sqrt((x * x).sum())), 1e-9)


def codewords(n: int) -> np.ndarray:
    """A codeword of -1 and 1 for each of n languages: all columns that differ up to sign for few
    languages, else 15 * log2(n) columns drawn so that the least distance of two words is large."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 6:
        columns = [(1, *c) for c in product((1, -1), repeat=n - 1) if -1 in c]
        return np.array(columns, float).T
    rng, bits, best, most = np.random.default_rng(n), int(15 * np.log2(n)), None, -1.0
    for _ in range(200):
        m = rng.choice((-1.0, 1.0), (n, bits))
        gap = ((bits - m @ m.T) / 2 + np.eye(n) * bits).min()
        if gap > most:
            best, most = m, gap
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # dimension x bit
    bias: np.ndarray
    trust: np.ndarray  # weight of a bit when decoding

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codeword of least weighted logistic loss, its share among all, share of the runner-up."""
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0.0, -margin[:, None, :] * self.code[None]) @ self.trust
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        order = np.sort(p, axis=1)
        return p.argmax(axis=1), order[:, -1], order[:, -2] if p.shape[1] > 1 else np.zeros(len(p))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows_per_language: int = ROWS_PER_LANGUAGE, steps: int = 120) -> Model | None:
    """Fits a binary logistic classifier for each bit of the code on a sample of labelled rows that
    is bounded by rows_per_language (drawn by a hash of key and text, so it is the same each time).
    Rows whose key falls in fold 0 of 5, and rows without text or language, are never used.
    None if no row is left."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.coalesce(fold(key), F.lit(1)) != 0)).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), (F.pmod(F.xxhash64(key, text), F.lit(1 << 30)) / float(1 << 30)).alias("u")
    )
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    shares = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(rows_per_language, SAMPLE_ROWS / len(counts)) / n)])
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("x", T.BinaryType())])

    def vectors(it):
        for b in it:
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([vector(t.as_py()).tobytes() for t in part.column(1)], pa.binary())], ["lang", "x"])

    sample = rows.where(F.col("u") < shares[F.col("lang")]).select("lang", "text").mapInArrow(vectors, schema).toPandas()
    languages = sorted(counts)
    x = np.stack([np.frombuffer(v, np.float32) for v in sample["x"]]) if len(sample) else np.zeros((0, len(ORDERS) << DIM_BITS), np.float32)
    at = np.array([languages.index(v) for v in sample["lang"]], int)
    code = codewords(len(languages))
    weights, bias, trust = _train(x, code[at] if len(at) else np.zeros((0, code.shape[1])), at, steps)
    return Model(languages, code.astype(np.float32), weights, bias, trust)


def _train(x: np.ndarray, y: np.ndarray, group: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted logistic regressions of all bits at once by Adam; every language has the same weight."""
    y = y.astype(np.float32)
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    if not len(x):
        return w, b, np.ones(y.shape[1], np.float32)
    weight = (1.0 / np.bincount(group)[group]).astype(np.float32)
    weight /= weight.sum()
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        margin = x @ w + b
        g = -y * weight[:, None] / (1 + np.exp(np.clip(y * margin, -30, 30)))
        gw = x.T @ g + 1e-6 * w
        m += 0.1 * (gw - m)
        v += 0.01 * (gw * gw - v)
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= 2.0 * g.sum(axis=0)
    error = ((y * (x @ w + b)) <= 0).T @ weight
    return w, b, (1 - np.minimum(error, 0.5) * 2 + 1e-3).astype(np.float32)


RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("runner_up", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
#: Texts that are vectors at the same time.
AT_ONCE = 64


def detect(docs: DataFrame, model: Model | None, text: str = "text", margin: float = 0.2) -> DataFrame:
    """The columns of docs in a struct `row`, and lang_pred, score, runner_up, ambiguous (the two best
    shares are closer than margin). A text that is NULL or has no letter, and any text if there is no
    model, is `und` with score 0 and not ambiguous. At equal shares the language that comes first by name
    is taken, and marked ambiguous. Each row is judged alone, so repeated rows are judged alike; texts of
    any length are read whole, in blocks. Only the text goes through Python, whatever other columns docs
    has and however they are named; an empty table gives an empty result."""
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    body = F.col("row").getField(text)
    shared = boxed.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def judge(texts: pa.Array) -> pa.Array:
        own, n = shared.value, len(texts)
        name, score, second = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n)
        at = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False)) if own is not None else []
        for lo in range(0, len(at), AT_ONCE):
            part = at[lo : lo + AT_ONCE]
            best, score[part], second[part] = own.decode(np.stack([vector(texts[i].as_py()) for i in part.tolist()]))
            name[part] = np.array(own.languages, object)[best]
        close = (name != UNKNOWN) & (score - second < margin)
        return pa.StructArray.from_arrays([pa.array(name, pa.string()), pa.array(score), pa.array(second), pa.array(close)], RESULT.names)

    return boxed.withColumn("v", judge(F.when(body.rlike(r"\p{L}"), body))).select("row", "v.*")


def filter_language(docs: DataFrame, model: Model | None, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose language is known and not ambiguous. A NULL, empty or letterless
    text goes; repeated rows stay or go together; see `detect`."""
    return detect(docs, model, text).where((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous") & (F.col("score") >= min_score)).select("row.*")


