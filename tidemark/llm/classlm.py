"""Class-based bigrams: exchange clustering assigns words to classes; class transitions and word
emissions, both smoothed, give the probability of a text.

Words are counted over all training texts: each chunk of documents sends its distinct words with their
counts, packed by ranges of the hash, to the range's group, which adds them up and sends every chunk
the totals of its words. So the traffic is distinct words of chunks, not tokens, and no group holds
more than a range. The units that are clustered are the most frequent words, and the endings of all
others; so each word, also one never seen, has a class.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCK_BYTES, _block_words, cut

#: Fixed size of the model: single words, endings, classes (and one for the end of a text).
FREQUENT, ENDINGS, CLASSES = 1535, 128, 64
CHUNK_BYTES, RANGE_BYTES = 8 << 20, 16 << 20
ADD, TRANSITION_PRIOR = 0.5, 50.0


def words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's words, A-Z lower-cased, and numbers of their endings (two last bytes)."""
    data, hashes, endings, at = text.encode("utf-8", "replace"), [], [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK_BYTES)
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        d = np.frombuffer(data, np.uint8, end - at, at)
        h, s, e = _block_words(d)
        low = np.where((d >= 65) & (d <= 90), d + 32, d).astype(np.int64)
        before = np.where(e - s > 1, low[np.maximum(e - 2, 0)], 0)
        hashes.append(h)
        endings.append((low[e - 1] * 31 + before * 57) % 127 % ENDINGS)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(endings)


def _distinct(texts: list[str]):
    """Distinct words of a chunk: hashes, endings, place of every token in them, tokens of each text."""
    each = [words(t) for t in texts]
    size = np.array([len(h) for h, _ in each], np.int64)
    h = np.concatenate([h for h, _ in each]) if each else np.empty(0, np.uint64)
    value, first, place = np.unique(h, return_index=True, return_inverse=True)
    endings = np.concatenate([x for _, x in each])[first] if each else np.empty(0, np.int64)
    return value, endings, place, size


def _ranges(value: np.ndarray, bits: int) -> np.ndarray:
    return np.searchsorted(value >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def _ask(bits: int):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        value, endings, place, size = _distinct(rows["text"].tolist())
        trained = np.repeat(~rows["held"].to_numpy(bool), size)
        counts = np.bincount(place, trained, len(value)).astype(np.uint32)
        cuts, out = _ranges(value, bits), []
        for r in range(1 << bits):
            i, j = cuts[r], cuts[r + 1]
            if i < j:
                out.append((key[0], r, value[i:j].tobytes(), counts[i:j].tobytes(), endings[i:j].astype(np.uint8).tobytes()))
        return pd.DataFrame(out, columns=["chunk", "range", "words", "counts", "endings"])

    return run


ANSWER = "kind int, chunk long, range int, counts binary, word long, n long, ending int, types long"


def _answer(key, rows: pd.DataFrame) -> pd.DataFrame:
    """kind 0: totals for a chunk's words; 1: the range's most frequent words; 2: sums by ending."""
    parts = [np.frombuffer(b, np.uint64) for b in rows["words"]]
    value, first, place = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
    endings = np.concatenate([np.frombuffer(b, np.uint8) for b in rows["endings"]])[first]
    total = np.bincount(place, np.concatenate([np.frombuffer(b, np.uint32) for b in rows["counts"]]), len(value)).astype(np.int64)
    out, at = [], 0
    for chunk, p in zip(rows["chunk"], parts, strict=True):
        out.append((0, chunk, key[0], total[place[at : at + len(p)]].tobytes(), None, None, None, None))
        at += len(p)
    known = np.flatnonzero(total)
    top = known[np.lexsort((value[known], -total[known]))[:FREQUENT]]
    out += [(1, None, None, None, int(w), int(n), int(e), None) for w, n, e in zip(value[top].view(np.int64), total[top], endings[top], strict=True)]
    n, types = np.bincount(endings, total, ENDINGS), np.bincount(endings[known], minlength=ENDINGS)
    out += [(2, None, None, None, None, int(n[e]), e, int(types[e])) for e in range(ENDINGS) if types[e]]
    # Objects, as hashes beside missing values would otherwise be rounded to doubles.
    return pd.DataFrame(out, columns=["kind", "chunk", "range", "counts", "word", "n", "ending", "types"], dtype=object).astype({"kind": "int32", "chunk": "Int64", "range": "Int32", "word": "Int64", "n": "Int64", "ending": "Int32", "types": "Int64"})


def _units(value: np.ndarray, endings: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Unit of each word: 1.. for frequent words (sorted by hash), then the endings; 0 is the end."""
    unit = 1 + FREQUENT + endings
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, value), len(frequent) - 1)
        unit = np.where(frequent[at] == value, 1 + at, unit)
    return unit


#: What a move must add to the log likelihood; far above rounding, so that sweeps end.
LEAST_GAIN = 1e-6


def exchange(pairs: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Class of each unit. pairs: counts of one unit after another. Units start in turn by frequency;
    one after another moves to the class where the likelihood of class bigrams is largest, until a sweep
    moves none; as every move adds to the likelihood, that comes. Unit 0 has class 0 for itself; units that
    never occur go to class 1."""
    b = np.asarray(pairs, float)
    k, weight = classes + 1, b.sum(axis=0) + b.sum(axis=1)
    order = [u for u in np.argsort(-weight, kind="stable") if u and weight[u]]
    cls = np.ones(len(b), int)
    cls[0] = 0
    for i, u in enumerate(order):
        cls[u] = 1 + i % classes
    hot = np.zeros((len(b), k))
    hot[np.arange(len(b)), cls] = 1
    g = hot.T @ b @ hot
    f = lambda x: x * np.log(np.maximum(x, 1.0))  # noqa: E731  counts are whole
    moved = 1
    while moved:
        moved = 0
        for u in order:
            own, loop = cls[u], b[u, u]
            hot[u, own] = 0
            after, before = b[u] @ hot, b[:, u] @ hot
            g[own] -= after
            g[:, own] -= before
            g[own, own] -= loop
            row, col = g + after[None, :], g.T + before[None, :]
            gain = (f(row) - f(g)).sum(axis=1) + (f(col) - f(g.T)).sum(axis=1)
            d = np.diag(g)
            gain += f(d + after + before + loop) - f(d + after) - f(d + before) + f(d)
            left, right = g.sum(axis=1) + before, g.sum(axis=0) + after  # with what stands beside u, in any class
            gain -= f(left + after.sum() + loop) - f(left) + f(right + before.sum() + loop) - f(right)
            gain[0] = -np.inf
            best = int(gain.argmax())
            best = own if gain[best] <= gain[own] + LEAST_GAIN else best
            moved += best != own
            cls[u] = best
            hot[u, best] = 1
            g[best] += after
            g[:, best] += before
            g[best, best] += loop
    return cls


@dataclass
class Model:
    frequent: np.ndarray  # hashes, sorted
    unit_class: np.ndarray
    transition: np.ndarray  # log10 of class after class
    spread: np.ndarray  # log10 of a class's emission denominator
    tokens: int
    types: int
    ends: int

    @property
    def base(self) -> float:
        return math.log10(self.tokens + ADD * (self.types + 1))


def _chunks(docs: DataFrame, key: str, text: str, held: Column, n: int) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), body.alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)))


def _clustered(docs: DataFrame, text: str, held: Column, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each unit, and how often one class follows another, from how often one unit follows another in
    all training texts, the end standing before each text. The unit pairs, a matrix of fixed size, are added up
    and clustered in a task, so that the driver gets only what has the size of units and classes."""
    units = 1 + FREQUENT + ENDINGS
    rows = docs.where(~F.coalesce(held, F.lit(False))).select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def run(it):
        total, seq, size = np.zeros(units * units, np.int64), [np.zeros(1, np.int64)], 0

        def flush():
            s = np.concatenate(seq)
            np.add.at(total, *np.unique(s[:-1] * units + s[1:], return_counts=True))
            seq[:] = [np.zeros(1, np.int64)]

        for b in it:
            for t in b.column(0):
                h, e = words(t.as_py())
                seq += [_units(h, e, frequent), np.zeros(1, np.int64)]
                size += len(h) + 1
                if size > 1 << 18:  # a few MB at a time
                    flush()
                    size = 0
        flush()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // units), pa.array(at % units), pa.array(total[at])], ["before", "unit", "n"])

    def cluster(it):
        pairs = np.zeros((units, units))
        for b in it:
            for before, after in zip(b.column("before").to_pylist(), b.column("after"), strict=True):
                pairs[before, after.values.field("unit").to_numpy()] = after.values.field("n").to_numpy()
        cls = exchange(pairs)
        hot = np.zeros((units, CLASSES + 1))
        hot[np.arange(units), cls] = 1
        yield pa.RecordBatch.from_arrays([pa.array([cls.astype(np.int64).tobytes()]), pa.array([(hot.T @ pairs @ hot).tobytes()])], ["cls", "follows"])

    cells = rows.mapInArrow(run, "before long, unit long, n long").repartition("before").groupBy("before", "unit").agg(F.sum("n").alias("n"))
    lines = cells.groupBy("before").agg(F.collect_list(F.struct("unit", "n")).alias("after"))  # a row a unit
    row = lines.repartition(1).mapInArrow(cluster, "cls binary, follows binary").first()
    k = CLASSES + 1
    if row is None:  # no training text
        return exchange(np.zeros((units, units))), np.zeros((k, k))
    return np.frombuffer(row["cls"], np.int64), np.frombuffer(row["follows"]).reshape(k, k)


def build(docs: DataFrame, held: Column, text: str = "text", key: str = "doc_id") -> tuple[Model, DataFrame, int, int]:
    """The model of all texts that are not held out; the table of answers to chunks; the number of
    chunks and of bits of a range."""
    body = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + 1
    size, ends = docs.agg(F.coalesce(F.sum(body), F.lit(0)), F.count_if(~F.coalesce(held, F.lit(False)))).first()
    chunks, bits = max(1, -(-size // CHUNK_BYTES)), max(4, math.ceil(math.log2(max(1, size / RANGE_BYTES))))
    asked = _chunks(docs, key, text, held, chunks).groupBy("chunk").applyInPandas(_ask(bits), "chunk long, range int, words binary, counts binary, endings binary")
    asked = asked.repartition(1 << bits, "range")  # about one range a task
    answers = cut(asked.groupBy("range").applyInPandas(_answer, ANSWER))
    top = answers.where("kind = 1").orderBy(F.desc("n"), "word").limit(FREQUENT).select("word", "n", "ending").toPandas()
    top["word"] = top["word"].to_numpy(np.int64).view(np.uint64)
    top = top.sort_values("word")
    frequent = top["word"].to_numpy(np.uint64)
    sums = answers.where("kind = 2").groupBy("ending").agg(F.sum("n").alias("n"), F.sum("types").alias("types")).toPandas()
    units = 1 + FREQUENT + ENDINGS
    n, types = np.zeros(units), np.zeros(units)
    n[0], types[0] = ends, ends > 0
    n[1 + FREQUENT + sums["ending"].to_numpy(int)] = sums["n"]
    types[1 + FREQUENT + sums["ending"].to_numpy(int)] = sums["types"]
    for i, (c, e) in enumerate(zip(top["n"], top["ending"], strict=True)):
        n[1 + i], types[1 + i] = c, 1
        n[1 + FREQUENT + e] -= c
        types[1 + FREQUENT + e] -= 1
    cls, g = _clustered(docs, text, held, frequent)
    k = CLASSES + 1
    hot = np.zeros((units, k))
    hot[np.arange(units), cls] = 1
    count, kinds = n @ hot, types @ hot
    plain = (count + ADD) / (count.sum() + ADD * k)
    after = g.sum(axis=1, keepdims=True)
    transition = (g + TRANSITION_PRIOR * plain[None]) / (after + TRANSITION_PRIOR)
    model = Model(frequent, cls, np.log10(transition), np.log10(count + ADD * (kinds + 1)), int(n.sum()), int(types.sum()), int(ends))
    return model, answers, chunks, bits


RESULT = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, held: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens (with the end), n_known, train_tokens, base_score (log10 by single
    words), score (log10 by classes) and perplexity for each row of docs. The model learns from the rows
    that are not held out (a NULL condition counts as not held out).

    NULL and empty texts are one end. Without training texts all words are unknown. Texts of any length are
    counted and scored whole. Repeated rows count and are scored each for itself. Words of equal count are
    units in the order of their hashes. Other columns are not read; an empty table gives an empty result."""
    model, answers, chunks, bits = build(docs, held, text, key)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = _chunks(docs, key, text, held, chunks)
    schema = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string(RESULT).fields])

    def run(key, docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        m = shared.value
        value, endings, place, size = _distinct(docs["text"].tolist())
        found = found.sort_values("range")
        total = np.concatenate([np.frombuffer(b, np.int64) for b in found["counts"]]) if len(found) else np.zeros(0, np.int64)
        if len(total) != len(value):
            raise ValueError("answers do not fit the chunk's words")
        cls = m.unit_class[_units(value, endings, m.frequent)][place]
        edge = np.concatenate(([0], np.cumsum(size)))
        some = size > 0

        def add(x: np.ndarray) -> np.ndarray:
            out = np.zeros(len(size))
            if some.any():
                out[some] = np.add.reduceat(x.astype(float), edge[:-1][some])
            return out

        end = math.log10(m.ends + ADD)
        emit = add(np.log10(total + ADD)[place]) + end
        known = add((total > 0)[place]) + (m.ends > 0)
        before = np.concatenate(([0], cls[:-1])) if len(cls) else cls
        before[edge[:-1][some]] = 0
        steps = add(m.transition[before, cls] - m.spread[cls])
        last = np.where(some, cls[np.maximum(edge[1:] - 1, 0)] if len(cls) else 0, 0)
        steps += m.transition[last, 0] - m.spread[0]
        return pd.DataFrame({"doc_id": docs["doc_id"], "held_out": docs["held"], "n_tokens": size + 1, "n_known": known.astype(np.int64), "train_tokens": m.tokens, "base_score": emit - (size + 1) * m.base, "score": emit + steps})

    own = answers.where("kind = 0").select("chunk", "range", "counts")
    out = rows.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInPandas(run, schema)
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
