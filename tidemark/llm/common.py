"""What the operators share: tables in the shared folder, word hashing, connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.storage import cut, forget, shared_dir

__all__ = ["components", "cut", "forget", "hot_limit", "key_slices", "meet", "runs", "shared_dir"]
#: White space between words: blank and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
_MULT = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1
#: Bytes hashed at once; bounds the memory of a batch with very long texts.
BLOCK_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str | Column, folds: int = 5) -> Column:
    """crc32 of the id as text modulo folds; NULL ids have no fold."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % F.lit(folds)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_MULT, -1, 1 << 64)
    up, down = np.full(n, _MULT, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_POWERS: list[np.ndarray] = []
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of pieces of a block of bytes, A-Z lower-cased."""
    if not _POWERS or len(_POWERS[0]) <= len(data):
        _POWERS[:] = _powers(max(BLOCK_BYTES + 1, len(data) + 1))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_LOWER[data] * _POWERS[0][: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * _POWERS[1][starts] + (ends - starts).astype(np.uint64))


def _block_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of a block of bytes, A-Z lower-cased."""
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[0::2], edge[1::2]
    return piece_hashes(data, starts, ends), starts, ends


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased, in bounded blocks cut at white space."""
    if len(text) <= BLOCK_BYTES:
        return _block_words(np.frombuffer(text, np.uint8))[0]
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + BLOCK_BYTES)
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        parts.append(_block_words(np.frombuffer(text, np.uint8, end - at, at))[0])
        at = end
    return np.concatenate(parts)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of `size` words; of the whole sequence if it is shorter."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(size, n)
    value = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        value = value * np.uint64(_MULT) + words[i : n - k + 1 + i]
    return np.unique(mix64(value + np.uint64(k)))


def slices(texts, limit: int = BLOCK_BYTES):
    """Slices (from, to) of an Arrow column of strings of about `limit` bytes each; one text at least."""
    import pyarrow.compute as pc

    edge = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(edge, edge[at] + limit, "right")) - 1)
        yield at, to
        at = to


def runs(keys) -> np.ndarray:
    """First places of the runs of equal values of an Arrow column; NULLs are equal."""
    code = keys.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.empty(0, np.int64)


def key_slices(batches, key: str, text: str, limit: int | None = None):
    """Record batches of rows sorted by key, cut anew so that the rows of a key stay together: pairs of batch
    and whether its last key goes on in the next one, which is so only beyond `limit` bytes of rows."""
    import pyarrow as pa

    def joined(held):
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]

    held, size = [], 0  # rows of the last key
    for b in batches:
        for at, to in slices(b[text], min(limit or BLOCK_BYTES, BLOCK_BYTES)):
            now = b.slice(at, to - at)
            if held and now[key][0].as_py() != held[0][key][0].as_py():
                yield joined(held), False
                held, size = [], 0
            last = int(runs(now[key])[-1])
            if last:
                if held:  # the first key of `now` is the held one
                    now, last = joined([*held, now]), last + sum(len(h) for h in held)
                yield now.slice(0, last), False
                held, size, now = [], 0, now.slice(last)
            held.append(now)
            size += now.nbytes
            if limit is not None and size > limit:
                yield joined(held), True
                held, size = [], 0
    if held:
        yield joined(held), False


def hot_limit(rows: int) -> int:
    """Rows of one key above which the key is hot, for tables of up to 64 times `rows` rows: so at most
    65,536 keys are."""
    return max(1024, rows // 1024)


def meet(rows: DataFrame, sizes: DataFrame, key: str, size: str, limit: int) -> DataFrame:
    """rows joined with sizes, which has one row for each key and in `size` the number of its rows. Hot keys,
    which `limit` bounds in number, are broadcast, so that the rows of none of them meet in one task."""
    hot = sizes.where(F.col(size) > limit)
    if hot.isEmpty():
        return rows.join(sizes, key)
    few = F.broadcast(hot)
    return rows.join(few, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(sizes.where(F.col(size) <= limit), key))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): a table (node, component) whose component is the
    smallest node reachable. Alternates large stars and small stars, each an aggregation and a
    join on the node, until no edge changes; every round is written to the shared folder.
    Empty edges give an empty table; loops and repeated edges do no harm; NULL ends are ignored."""
    kind = edges.schema[0].dataType
    pair = edges.select(F.col(edges.columns[0]).alias("a"), F.col(edges.columns[1]).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    loops = pair.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    state = cut(pair.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def both_ways(e: DataFrame) -> DataFrame:
        return e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def stars(e: DataFrame, large: bool, hot: bool) -> DataFrame:
        """Large star: larger neighbours of a node point to its least neighbour (or itself).
        Small star: the node and its smaller neighbours point to the least of them."""
        around = both_ways(e) if large else e
        least = around.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("size")).select("a", F.least("a", "m").alias("m"), "size")
        both = meet(around, cut(least), "a", "size", limit) if hot else around.join(least, "a")
        if large:
            out = both.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = both.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def mark(e: DataFrame):
        """Number and hash of the edges, neighbours of the node that has most."""
        ends = both_ways(e.select("a", "b")).groupBy("a").agg(F.count("*").alias("n"), F.sum(F.when(F.col("a") > F.col("b"), F.xxhash64("a", "b").cast("decimal(38,0)"))).alias("h"))
        return tuple(ends.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("h"), F.max("n")).first())

    seen = mark(state)
    limit = hot_limit(seen[0])
    while seen[0]:
        hot = seen[2] > limit
        new = cut(stars(stars(state, True, hot), False, hot))
        forget(state)
        state, now = new, mark(new)
        if now == seen:
            break
        seen = now
    nodes = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(roots).unionAll(loops).groupBy("node").agg(F.min("component").cast(kind).alias("component"))
