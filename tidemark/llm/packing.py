"""Packing of tokenized documents into windows of fixed length with a fixed mixture of sources.

Each source is a queue of tokens. Window after window, deficit round-robin draws from every queue its
share of the window; what a queue gets too little of because tokens are whole stays as its deficit and
is paid in the next window. The deficits of all windows together are differences of rounded running
totals, so that each document finds its windows by arithmetic from the place of its first token in its
queue, wherever it is: no window is filled by one task, and deficits carry across partitions.
"""

from __future__ import annotations

from bisect import bisect_right
from fractions import Fraction
from math import lcm
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCK_BYTES, cut, piece_hashes, slices

MAX_TOKENS, END_ID, VOCABULARY = 2048, 1, "word_bpe_49k.json"
#: Words whose ids a worker remembers; forgotten all at once when there are more.
CACHE_ENTRIES = 400_000
#: Bytes of text that a worker tokenizes at once.
SLICE_BYTES = 4 << 20
_TAIL = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: Kinds of bytes: 0 white space, 1 ASCII letter or digit, 2 other ASCII, 3 part of another character.
_KIND = np.array([3 if b > 127 else 0 if b in b" \t\n\x0b\x0c\r" else 1 if chr(b).isalnum() else 2 for b in range(256)], np.uint8)
_TOKENIZERS: dict[str, Tokens] = {}


class Tokens:
    """Ids of whole texts. The vocabulary lower-cases, drops white space and never joins across it, nor an
    ASCII letter or digit with a sign after it. So texts are cut there into pieces, equal pieces of a slice
    are found by their hashes, and only pieces that are not remembered go through the tokenizer, which does
    all the rest (composing, lower-casing). Hashes have 64 bits and meet only within a slice."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        ids = self.model.get_vocab()
        self.dtype = np.dtype("<u2" if max(ids.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(ids.values()) + 1, bool)
        self.ends[[v for k, v in ids.items() if k.endswith("</w>")]] = True
        self.added = [t.content.lower().encode() for t in self.model.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        """Places of remembered pieces, and their ids one after another from start[place] to start[place + 1]."""
        self.place: dict[bytes, int] = {}
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(0, self.dtype)

    def each(self, words: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, self.dtype) for e in self.model.encode_batch_fast(words, add_special_tokens=False)]

    def learn(self, words: list[bytes]) -> None:
        plain, other, tails = {}, [], {}
        for w in words:
            core = w.rstrip(_TAIL)
            letters = core.decode("utf-8", "replace")
            if letters.isalpha() and (letters.isascii() or normalize("NFC", letters).lower().isalpha()):
                plain[w] = letters
                tails[w[len(core) :]] = None
            else:
                other.append(w)
        cores, known = list(dict.fromkeys(plain.values())), {}
        for at in range(0, len(cores), 1000):
            part = cores[at : at + 1000]
            ids = np.array(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):  # one end of a word for each
                edge = [0, *cuts.tolist()]
                known.update((w, ids[i:j]) for w, i, j in zip(part, edge[:-1], edge[1:], strict=True))
            else:
                known.update(zip(part, self.each(part), strict=True))
        tail = dict(zip(tails, self.each([t.decode() for t in tails]), strict=True))
        found = [np.concatenate((known[c], tail[w[len(w.rstrip(_TAIL)) :]])) if w[-1] in _TAIL else known[c] for w, c in plain.items()]
        found += self.each([w.decode("utf-8", "replace") for w in other])
        first = len(self.place)
        self.place.update(zip([*plain, *other], range(first, first + len(found)), strict=True))
        self.start = np.concatenate((self.start, self.start[-1] + np.cumsum([len(x) for x in found], dtype=np.int64)))
        self.ids = np.concatenate((self.ids, *found))

    def block(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the pieces of a block of bytes, numbers of their ids, and all ids."""
        kind = np.zeros(len(data) + 2, np.uint8)
        kind[1:-1] = _KIND[data]
        sign = (kind[:-1] == 1) & (kind[1:] == 2)
        starts = np.flatnonzero((kind[1:-1] > 0) & ((kind[:-2] == 0) | sign[:-1]))
        ends = np.flatnonzero((kind[1:-1] > 0) & ((kind[2:] == 0) | sign[1:])) + 1
        if not len(starts):
            return starts, np.zeros(0, np.int64), np.zeros(0, self.dtype)
        _, first, which = np.unique(piece_hashes(data, starts, ends), return_index=True, return_inverse=True)
        low = data.tobytes().lower()
        words = [low[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        new = list(dict.fromkeys(w for w in words if w not in self.place))
        if len(self.place) + len(new) > CACHE_ENTRIES:
            self.forget()
            new = list(dict.fromkeys(words))
        if new:
            self.learn(new)
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        n, begin = (self.start[at + 1] - self.start[at])[which], self.start[at][which]
        before = np.cumsum(n) - n
        return starts, n, self.ids[np.repeat(begin - before, n) + np.arange(n.sum())]

    def texts(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text. Texts that spell an added token of the vocabulary go through the tokenizer whole,
        as such a token is cut out before all else."""
        if not texts:
            return []
        whole = {}
        if any(a in b" ".join(texts).lower() for a in self.added):
            whole = {i: t for i, t in enumerate(texts) if any(a in t.lower() for a in self.added)}
            texts = [b"" if i in whole else t for i, t in enumerate(texts)]
        size = np.array([len(t) + 1 for t in texts], np.int64)
        data, edge = np.frombuffer(b" ".join(texts) + b" ", np.uint8), np.cumsum(size) - size
        total, ids, at = np.zeros(len(texts), np.int64), [], 0
        while at < len(data):
            end = min(len(data), at + BLOCK_BYTES)
            while _KIND[data[end - 1]] and end < len(data):
                end += 1
            starts, n, found = self.block(data[at:end])
            total += np.bincount(np.searchsorted(edge, starts + at, "right") - 1, n, len(texts)).astype(np.int64)
            ids.append(found)
            at = end
        out = np.split(np.concatenate(ids), np.cumsum(total)[:-1])
        for i, x in zip(whole, self.each([t.decode("utf-8", "replace") for t in whole.values()]), strict=True):
            out[i] = x
        return out

    def text(self, text: str) -> bytes:
        return self.texts([text.encode("utf-8", "replace")])[0].tobytes()


def _tokens(vocabulary: str) -> Tokens:
    if vocabulary not in _TOKENIZERS:
        import public_tokenizers

        _TOKENIZERS[vocabulary] = Tokens(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
    return _TOKENIZERS[vocabulary]


def tokenize(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """A row for each row of docs: id, source ('s' + its name; 'n' for NULL), ids (with the end id),
    n, part (the partition), before (tokens of the same source before it in the partition)."""
    schema = T.StructType([*[T.StructField(n, T.StringType()) for n in ("source",)], T.StructField("ids", T.BinaryType()), *[T.StructField(n, T.LongType()) for n in ("n", "part", "before")]])
    name = F.when(F.col(f"`{source}`").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")))
    rows = docs.select(F.col(f"`{key}`").alias("id"), name.alias("source"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def run(it):
        tokens, part, before = _tokens(vocabulary), TaskContext.get().partitionId(), {}
        end = np.array([end_id], tokens.dtype)
        for b in it:
            for i, j in slices(b.column(2), SLICE_BYTES):
                rest = b.slice(i, j - i)
                sources, ids, ns, starts = rest.column(1).to_pylist(), [], [], []
                for s, x in zip(sources, tokens.texts([t.as_buffer().to_pybytes() for t in rest.column(2)]), strict=True):
                    ids.append(np.concatenate((x, end)).tobytes())
                    ns.append(len(x) + 1)
                    starts.append(before.get(s, 0))
                    before[s] = starts[-1] + ns[-1]
                yield pa.RecordBatch.from_arrays([rest.column(0), rest.column(1), pa.array(ids, pa.binary()), pa.array(ns, pa.int64()), pa.array([part] * len(ns), pa.int64()), pa.array(starts, pa.int64())], ["id", "source", "ids", "n", "part", "before"])

    return rows.mapInArrow(run, T.StructType([rows.schema["id"], *schema.fields]))


class Mixture:
    """Running totals of deficit round-robin. totals: tokens of each queue; weights: their target
    proportions, by default the totals. While all queues have tokens each window has the target
    proportions; when one runs dry, the others share its part in proportion."""

    def __init__(self, totals: list[int], size: int, weights: list[float] | None = None):
        self.totals, self.size, self.total = totals, size, sum(totals)
        self.windows = -(-self.total // size)
        rate = [Fraction(w) for w in (weights or totals)]
        left, now = [Fraction(t) for t in totals], Fraction(0)
        self.starts: list[Fraction] = []
        self.lines: list[list[tuple[int, int, int]]] = []
        while any(left):
            whole = sum(r for r, x in zip(rate, left, strict=True) if x)
            share = [r / whole if x else Fraction(0) for r, x in zip(rate, left, strict=True)]
            self.starts.append(now)
            base, slope, line = Fraction(0), Fraction(0), [(0, 0, 1)]
            for t, x, s in zip(totals, left, share, strict=True):
                base, slope = base + t - x, slope + s
                at = base - slope * now
                d = lcm(at.denominator, slope.denominator)
                line.append((int(at * d), int(slope * d), d))
            self.lines.append(line)
            step = min(x / s for x, s in zip(left, share, strict=True) if x)
            left, now = [x - s * step for x, s in zip(left, share, strict=True)], now + step

    def drawn(self, queue: int, window: int) -> int:
        """Tokens that the first `queue` queues have given to the first `window` windows."""
        t = min(window * self.size, self.total)
        if t == self.total:
            return sum(self.totals[:queue])
        a, b, d = self.lines[bisect_right(self.starts, t) - 1 if len(self.starts) > 1 else 0][queue]
        return (a + b * t) // d

    def given(self, queue: int, window: int) -> int:
        return self.drawn(queue + 1, window) - self.drawn(queue, window)

    def pieces(self, queue: int, start: int, n: int):
        """(window, offset there, length) of the tokens start..start+n of a queue, in order."""
        lo, hi = 0, self.windows
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.given(queue, mid) <= start else (lo, mid)
        at, w = start, lo
        low, had = self.drawn(queue, w), self.given(queue, w)
        while at < start + n:
            next_low, have = self.drawn(queue, w + 1), self.given(queue, w + 1)
            if have > at:
                length = min(have, start + n) - at
                yield w, next_low - low + at - had, length
                at += length
            w, low, had = w + 1, next_low, have


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", max_tokens: int = MAX_TOKENS, weights: dict[str, float] | None = None, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, source, start, length, ids (little-endian 32-bit), doc_tokens,
    sequence_id, offset. All windows but the last are full.

    weights: target proportions of sources; a source without one has its share of all tokens. Sources
    too small to give a token to each window join one queue (there are at most max_tokens larger ones).
    NULL and empty texts are one end id; a NULL source is a source of its own; repeated rows are packed
    each for itself; other columns are not read; an empty table gives no pieces."""
    spark = docs.sparkSession
    table = cut(tokenize(docs, text, key, source, vocabulary, end_id))
    parts = table.groupBy("source", "part").agg(F.sum("n").alias("n"))
    sources = cut(parts.groupBy("source").agg(F.sum("n").alias("n")))
    total = sources.agg(F.sum("n")).first()[0] or 0
    windows = max(1, -(-total // max_tokens))
    large = {r["source"]: r["n"] for r in sources.where(F.col("n") >= windows).collect()}
    tail = total - sum(large.values())
    queues = sorted(large)
    totals, home = [large[q] for q in queues], 0
    if tail and (tail >= windows or not queues):
        home = len(queues)
        totals.append(tail)
    elif tail:
        home = max(range(len(queues)), key=lambda i: totals[i])
        totals[home] += tail
    share = None
    if weights:
        share = [float(weights.get(q[1:], t / total)) for q, t in zip([*queues, "?"], totals, strict=False)]
        whole = sum(share)
        if min(share) / whole * max_tokens < 1:
            raise ValueError("each source needs a weight of one token in a window at least")
    mix = spark.sparkContext.broadcast(Mixture(totals, max_tokens, share))
    number = F.create_map(*[F.lit(x) for q, i in zip(queues, range(len(queues)), strict=True) for x in (q, i)])[F.col("source")] if queues else F.lit(None)
    placed = parts.withColumn("queue", F.coalesce(number.cast("int"), F.lit(home)))
    before = Window.partitionBy("queue").orderBy("source", "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(placed.select("source", "part", "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    rows = table.join(bases, ["source", "part"]).select("id", "source", "ids", "n", "queue", (F.col("base") + F.col("before")).alias("at"))
    names = ["start", "length", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField("doc_id", rows.schema["id"].dataType), T.StructField("source", T.StringType()), *[T.StructField(n, T.LongType()) for n in names], T.StructField("ids", T.BinaryType())])

    def run(it):
        mixture = mix.value
        for b in it:
            doc, src, ids, ns, queue, at = (b.column(i) for i in range(6))
            row, out, cuts = [], [], []
            for i, (data, n, q, p) in enumerate(zip(ids.to_pylist(), ns.to_pylist(), queue.to_pylist(), at.to_pylist(), strict=True)):
                wide = np.frombuffer(data, f"<u{len(data) // n}").astype("<u4").tobytes()
                start = 0
                for w, offset, length in mixture.pieces(q, p, n):
                    row.append(i)
                    out.append((start, length, n, w, offset))
                    cuts.append(wide[4 * start : 4 * (start + length)])
                    start += length
                if len(row) >= 20_000:
                    yield _batch(doc, src, row, out, cuts, names)
                    row, out, cuts = [], [], []
            if row:
                yield _batch(doc, src, row, out, cuts, names)

    return rows.mapInArrow(run, schema).withColumn("source", F.when(F.col("source") != "n", F.expr("substr(source, 2)")))


def _batch(doc, src, row, out, cuts, names) -> pa.RecordBatch:
    take = pa.array(row, pa.int64())
    return pa.RecordBatch.from_arrays([doc.take(take), src.take(take), *[pa.array(c, pa.int64()) for c in zip(*out, strict=True)], pa.array(cuts, pa.binary())], ["doc_id", "source", *names, "ids"])
