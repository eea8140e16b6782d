"""Near duplicates by MinHash: an inverted join over signature coordinates.

1. Every text becomes the set of its word shingles; equal sets share one representative.
2. A representative's signature has K coordinates. It is posted under (coordinate, value) pairs. As a
   pair of documents must agree in T coordinates to be kept, each posts only its K - T + 1 rarest pairs
   (prefix); those that no other document has are skipped, so most texts post nothing.
3. The most central document of a posting list is its pivot. Lists with one pivot are merged, and the
   collisions of each member with the pivot are counted once over the whole signatures. What reaches T is
   confirmed on full sets; the links found so far are joined to components.
4. Of a pivot's members only those outside of the largest component there may still hold an unseen link,
   as any link not yet known joins two components. Their collisions with all members are counted, block
   against block; what reaches T is confirmed too.
5. Links leave each block as a spanning forest, and connected components finish the job.

Rows are members of merged lists, never pairs; a list of any length is dealt to blocks of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut, forget, hot_limit, meet, mix64, shingle_set, word_hashes

K = 64
#: Chance, at most, that a pair exactly at the similarity asked for agrees in fewer than T coordinates.
MISS = 1e-9
#: Documents and shingles that a block may hold; a merged list is cut into parts of half as many.
BLOCK_DOCS, BLOCK_SHINGLES = 4096, 1 << 20
#: Bits, at most, of the map of ids whose texts are read again (2 MB).
MEMBER_BITS = 1 << 24
_A = mix64(np.arange(1, K + 1, dtype=np.uint64)) | np.uint64(1)


def match_threshold(similarity: float, k: int = K, miss: float = MISS) -> int:
    """The largest T with P(Binomial(k, similarity) < T) <= miss."""
    below = 0.0
    for t in range(k + 1):
        below += math.comb(k, t) * similarity**t * (1 - similarity) ** (k - t)
        if below > miss:
            return max(t, 1)
    return k


def signature(shingles: np.ndarray) -> np.ndarray:
    """K coordinates as int32: upper halves of the least products with K odd factors."""
    out = np.empty(K, np.uint64)
    for i in range(K):
        out[i] = (shingles * _A[i]).min()
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _signatures(size: int):
    """Rows leave some hundred at a time, as arrays without Python numbers, so a worker stays small."""

    def batch(ids, sizes, digests, sigs) -> pa.RecordBatch:
        ends = np.cumsum([0, *[K if len(x) else 0 for x in sigs]]).astype(np.int32)
        lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sigs)), mask=pa.array([not len(x) for x in sigs]))
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists], ["id", "n", "digest", "sig"])

    none = np.empty(0, np.int32)

    def run(it):
        for b in it:
            for at in range(0, b.num_rows, 500):
                part, sizes, digests, sigs = b.slice(at, 500), [], [], []
                for t in part.column(1):
                    s = shingle_set(word_hashes((t.as_py() or "").encode("utf-8", "replace")), size)
                    sizes.append(len(s))
                    digests.append(np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix64(s)) + np.uint64(len(s))]).tobytes() if len(s) else None)
                    sigs.append(signature(s) if len(s) else none)
                yield batch(part.column(0), sizes, digests, sigs)

    return run


def _forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links a - b (positions in ids)."""
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[p] = q
            out.append((int(ids[x]), int(ids[y])))
    return out


def _links(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs with 100 * intersection >= percent * union, by products of the incidence
    matrix of the shingles that two sets have at least, some hundred shingles at a time."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        found = [np.array([[0], [1]])[:, : int(100 * both >= percent * (size.sum() - both))]]
    else:
        values, code = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(n), size)
        often = np.bincount(code) >= 2
        place = np.cumsum(often) - 1
        keep = often[code]
        owner, code, width = owner[keep], place[code[keep]], int(often.sum())
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        cuts = np.searchsorted(code, np.arange(0, width + 1024, 1024))
        found = []
        for row in range(0, n, 256):  # a few rows and some hundred shingles at a time, to bound memory
            part = np.zeros((min(256, n - row), n), np.float32)
            for k in range(len(cuts) - 1):
                i, j = cuts[k], cuts[k + 1]
                m = np.zeros((n, 1024), np.float32)
                m[owner[i:j], code[i:j] - 1024 * k] = 1
                part += m[row : row + 256] @ m.T
            union = size[row : row + 256, None] + size[None, :] - part
            a, b = np.nonzero(100 * part >= percent * union)
            found.append(np.stack([a + row, b])[:, b > a + row])
    a, b = np.concatenate(found, axis=1)
    return a, b


def _groups(rows: pd.DataFrame, by: list[str]):
    """The groups of a block, each with the places of its rows."""
    order = rows.groupby(by, sort=True).indices
    return order.items()


class _Sets:
    """Shingle sets of the texts of a block; each is made once, at its first use."""

    def __init__(self, rows: pd.DataFrame, shingle: int):
        self.text = dict(zip(rows["id"].tolist(), rows["text"].tolist(), strict=True))
        self.shingle, self.made = shingle, {}

    def __call__(self, i: int) -> np.ndarray:
        if i not in self.made:
            self.made[i] = shingle_set(word_hashes(self.text[i].encode("utf-8", "replace")), self.shingle)
        return self.made[i]


def _stars(shingle: int, percent: int):
    """Links between pivots and their candidates."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        sets, out = _Sets(rows.sort_values(["id", "text"]), shingle), []
        for (pivot, _), at in _groups(rows, ["pivot", "salt"]):
            if pivot not in sets.text:
                continue
            centre = sets(pivot)
            for i in set(rows["id"].to_numpy()[at].tolist()) - {pivot}:
                own = sets(i)
                place = np.minimum(np.searchsorted(centre, own), len(centre) - 1)
                both = int((centre[place] == own).sum())
                if 100 * both >= percent * (len(centre) + len(own) - both):
                    out.append((pivot, i))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _confirm(shingle: int, percent: int):
    """Forests of the links inside each group of a block."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        sets, out = _Sets(rows.sort_values(["id", "text"]), shingle), []
        for _, at in _groups(rows, ["pivot", "i", "j", "root"]):
            ids = np.unique(rows["id"].to_numpy()[at])
            if len(ids) > 1:
                out += _forest(ids, *_links([sets(i) for i in ids.tolist()], percent))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _collide(least: int, percent: int):
    """Candidates of each block of a merged list: documents that agree in `least` coordinates or more with
    one of another component, grouped as they hang together (root). Counted 64 rows at a time."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (pivot, i, j), at in _groups(rows, ["pivot", "i", "j"]):
            part = rows.iloc[at]
            ids, comp, n, asks = (part[c].to_numpy() for c in ("id", "comp", "n", "asks"))
            sig = np.stack(part["sig"].to_numpy())
            ask, all_ = np.flatnonzero(asks), np.flatnonzero(~asks)
            links = []
            for lo in range(0, len(ask), 64):
                some = ask[lo : lo + 64]
                ok = (comp[some][:, None] != comp[all_][None]) & (100 * np.minimum(n[some][:, None], n[all_][None]) >= percent * np.maximum(n[some][:, None], n[all_][None]))
                x, y = np.nonzero(ok)
                for k in range(0, len(x), 1 << 16):
                    u, v = some[x[k : k + (1 << 16)]], all_[y[k : k + (1 << 16)]]
                    hit = (sig[u] == sig[v]).sum(axis=1) >= least
                    links.append((u[hit], v[hit]))
            names, code = np.unique(ids, return_inverse=True)
            u, v = (code[np.concatenate(z)] if links else np.empty(0, int) for z in (zip(*links, strict=True) if links else ((), ())))
            tree = _forest(names, u, v)
            root = {}
            for a, b in tree:
                root.setdefault(a, a), root.setdefault(b, b)

            def top(z):
                while root[z] != z:
                    root[z] = root[root[z]]
                    z = root[z]
                return z

            for a, b in tree:
                root[top(a)] = top(b)
            size = dict(zip(ids.tolist(), n.tolist(), strict=True))
            out += [(pivot, i, j, top(z), z, size[z]) for z in root]
        return pd.DataFrame(out, columns=["pivot", "i", "j", "root", "id", "n"], dtype="int64")

    return run


def _parts(docs: str, shingles: str) -> Column:
    return F.greatest(F.ceil(2 * F.col(docs) / BLOCK_DOCS), F.ceil(2 * F.col(shingles) / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _dealt(rows: DataFrame, keys: list[str], docs: int, shingles: int) -> DataFrame:
    """Rows with `block`: a number for groups of keys, so that many small groups share a call of Python."""
    blocks = max(1, -(-8 * docs // BLOCK_DOCS), -(-8 * shingles // BLOCK_SHINGLES))
    return rows.withColumn("block", F.pmod(F.xxhash64(*keys), F.lit(blocks)))


def _load(rows: DataFrame) -> tuple[int, int]:
    return tuple(x or 0 for x in rows.agg(F.count("*"), F.sum("n")).first())


def _members(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of texts whose id may be one of ids: a bitmap of hashed ids, bounded by MEMBER_BITS, is
    broadcast, so that most texts are left out before they are shuffled. It never leaves out one of ids;
    beyond its size it only lets more pass."""
    place = F.pmod(F.xxhash64("id"), F.lit(MEMBER_BITS))
    maps = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    at = F.bitmap_bit_position("p")
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = texts.withColumn("p", place).withColumn("bucket", F.bitmap_bucket_number("p"))
    kept = marked.join(F.broadcast(maps), "bucket").where(F.getbit(byte, (at % 8).cast("int")) == 1)
    return kept.drop("p", "bucket", "bits")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: doc_id (from key, which must be an integer), n_shingles,
    component_id (least id reachable over links of `percent` similarity, itself included), kept.

    NULL, empty and blank texts have an empty set and are linked with nothing. Texts of any length are read
    whole. Rows that repeat an id count as one document and get one component (with several texts the one
    with the greatest digest is searched for it, copies of all are joined to it). A NULL id is linked with
    nothing, has a NULL component and is kept. At ties (of pivots, of largest components) ids decide, which
    changes no result. Other columns of docs are not read. An empty table gives an empty result."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sig", T.ArrayType(T.IntegerType(), False))])
    source = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    least = match_threshold(percent / 100)

    signed = cut(source.mapInArrow(_signatures(shingle), schema))
    limit = hot_limit(signed.count())
    live = signed.where("id IS NOT NULL AND digest IS NOT NULL")
    # A digest has one representative: the least id. Its row, not a copy, goes on.
    chosen = cut(live.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    sigs = live.join(chosen, (F.col("id") == F.col("rep")) & (chosen["digest"] == live["digest"])).groupBy("id").agg(F.max(F.struct(live["digest"], "n", "sig")).alias("s"))
    sigs = cut(sigs.select("id", "s.n", "s.sig"))

    token = F.posexplode("sig").alias("c", "v")
    tokens = sigs.select("id", token).select("id", F.expr("shiftleft(cast(c AS bigint), 32) | (cast(v AS bigint) & 4294967295)").alias("token"))
    often = cut(tokens.groupBy("token").agg(F.count("*").alias("f")).where("f > 1"))
    shared = meet(tokens, often, "token", "f", limit)
    each = Window.partitionBy("id")
    rank = F.row_number().over(each.orderBy("f", "token"))
    posted = shared.select("id", "token", "f", rank.alias("r"), F.count("*").over(each).alias("m"), F.sum("f").over(each).alias("central"))
    posted = cut(posted.where(F.col("r") <= F.lit(K - least + 1) - (F.lit(K) - F.col("m"))).select("id", "token", "central"))

    pivots = cut(posted.groupBy("token").agg(F.max_by("id", F.struct("central", -F.col("id"))).alias("pivot"), F.count("*").alias("size")).where("size > 1"))
    merged = cut(meet(posted.select("id", "token"), pivots, "token", "size", limit).where("id <> pivot").groupBy("pivot", "id").agg(F.count("*").alias("lists")))
    forget(often, posted, pivots)

    heads = merged.groupBy("pivot").agg(F.count("*").alias("size"))
    heads = cut(heads.join(sigs.select(F.col("id").alias("pivot"), F.col("sig").alias("pivot_sig"), F.col("n").alias("pivot_n")), "pivot"))
    agree = F.aggregate(F.zip_with("sig", "pivot_sig", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    alike = 100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n")
    counted = meet(merged.select("pivot", "id").join(sigs, "id"), heads, "pivot", "size", limit).where(alike).where(agree >= least)
    near = cut(counted.select("pivot", "id", "n"))
    docs_, shingles = _load(near)
    parts = near.groupBy("pivot").agg(F.count("*").alias("docs"), F.sum("n").alias("w")).select("pivot", _parts("docs", "w").alias("parts"), "docs")
    rays = meet(near.select("pivot", "id"), parts, "pivot", "docs", limit).select("pivot", "id", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("salt"))
    centres = parts.select("pivot", F.col("pivot").alias("id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    rays = cut(_dealt(rays.unionByName(centres), ["pivot", "salt"], docs_, shingles))
    whole = source.where("id IS NOT NULL AND text IS NOT NULL")
    texts = _members(whole, rays.select("id").distinct())
    star = cut(rays.join(texts, "id").groupBy("block").applyInPandas(_stars(shingle, percent), "a long, b long"))
    found = cut(components(star))
    forget(heads, near, rays)

    # What may still be linked across components.
    members = merged.select("pivot", "id").unionAll(merged.select("pivot", F.col("pivot").alias("id")).distinct())
    members = members.join(sigs.select("id", "n"), "id").join(found.withColumnRenamed("node", "id"), "id", "left").select("pivot", "id", "n", F.coalesce("component", "id").alias("comp"))
    members = cut(members)
    kinds = members.groupBy("pivot", "comp").agg(F.count("*").alias("docs"), F.sum("n").alias("w"))
    most = F.max_by(F.struct("comp", "docs", "w"), F.struct("docs", "comp")).alias("most")
    open_ = kinds.groupBy("pivot").agg(most, F.sum("docs").alias("docs"), F.sum("w").alias("w"), F.count("*").alias("kinds")).where("kinds > 1")
    open_ = open_.select("pivot", F.col("most.comp").alias("base"), "docs", _parts("docs", "w").alias("all_parts"), (F.col("docs") - F.col("most.docs")).alias("ask_docs"), (F.col("w") - F.col("most.w")).alias("ask_w"))
    open_ = cut(open_.select("pivot", "base", "docs", "all_parts", _parts("ask_docs", "ask_w").alias("ask_parts")))
    rows = meet(members, open_, "pivot", "docs", limit)
    place = lambda n: F.pmod(F.xxhash64("id", F.lit("part")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sides = rows.select("pivot", "id", "n", "comp", F.lit(False).alias("asks"), place("all_parts").alias("i"), every("ask_parts").alias("j"))
    sides = cut(sides.unionByName(rows.where("comp <> base").select("pivot", "id", "n", "comp", F.lit(True).alias("asks"), every("all_parts").alias("i"), place("ask_parts").alias("j"))))
    blocks = _dealt(sides, ["pivot", "i", "j"], *_load(sides)).join(sigs.select("id", "sig"), "id")
    apart = cut(blocks.groupBy("block").applyInPandas(_collide(least, percent), "pivot long, i int, j int, root long, id long, n long"))
    texts = _members(whole, apart.select("id").distinct())
    links = cut(_dealt(apart, ["pivot", "i", "j", "root"], *_load(apart)).join(texts, "id").groupBy("block").applyInPandas(_confirm(shingle, percent), "a long, b long"))
    if not links.isEmpty():
        found = cut(components(star.unionAll(links)))
    forget(merged, members, open_, sides, apart, links, star)

    named = cut(chosen.join(found, chosen["rep"] == found["node"], "left").select("digest", "copies", F.coalesce("component", "rep").alias("component")))
    known = meet(live.select("id", "n", "digest"), named, "digest", "copies", limit).select("id", "n", "component")
    other = signed.where("id IS NULL OR digest IS NULL").select("id", "n", F.col("id").alias("component"))
    forget(chosen, sigs, found)
    out = known.unionAll(other)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def filter_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, that are no near duplicate of a document with a smaller id. Rows with
    a NULL id, and NULL, empty and blank texts, stay; rows that repeat an id stay or go together."""
    gone = near_duplicates(docs, text, key, shingle, percent).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(f"`{key}`").cast("long") == F.col("__gone"), "left_anti")
