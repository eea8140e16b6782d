"""Benchmark decontamination by spaced seeds: hashes of token windows that ignore fixed positions find
hits that survive substitutions; overlaps around the hits are then verified token by token."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions of a window that a mask looks at (1): whichever two of OVERLAP tokens differ, one of these
#: masks fits into the OVERLAP tokens so that it looks at neither.
WINDOW_MASKS = ("11110111", "1100101111", "11101100101")
#: Tokens of an overlap and the share of them that must agree.
OVERLAP, AGREE_PERCENT = 13, 80
#: Items of fewer tokens are not looked for (1: all are); those below OVERLAP only as a whole.
MIN_TOKENS = 1
#: Items of fewer tokens condemn no document in `filter_contaminated`: phrases of that length are common.
FILTER_TOKENS = 6
#: Seeds, at most, that are broadcast, at about 40 bytes, and bytes of items' tokens; more are joined by a shuffle.
BROADCAST_SEEDS, BROADCAST_BYTES = 500_000, 20 << 20


def tokens(text: Column) -> Column:
    """Hashes of the runs of letters and digits, lower-cased."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def short_masks(n: int) -> list[str]:
    """Masks for an item of n tokens below OVERLAP: it is cut into two blocks more than tokens may differ,
    and each mask looks at two of the blocks; so differing tokens always leave one mask untouched."""
    blocks = n * (100 - AGREE_PERCENT) // 100 + 2
    return ["".join("1" if i * blocks // n in pair else "0" for i in range(n)) for pair in combinations(range(blocks), 2)]


def _seeds(h: Column, at: Column, n: Column, kind: int, masks: list[str] | tuple[str, ...], span: int = 0) -> list[Column]:
    """Seeds of the tokens from `at` on, NULL where the mask (or span) exceeds the tokens."""
    out = []
    for i, m in enumerate(masks):
        value = F.xxhash64(F.lit(100 * kind + i), *[F.get(h, at + p) for p, c in enumerate(m) if c == "1"])
        out.append(F.when(at + max(span, len(m)) <= n, value))
    return out


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", min_tokens: int = MIN_TOKENS) -> DataFrame:
    """A row for each document and benchmark item that overlap: doc_id, item_id, item_tokens, matched
    (tokens of the item found in their places, at its best alignment), position (token of the document
    where the item starts, negative if its head is cut off), row_hash (of doc_id and text).

    An overlap: OVERLAP tokens in a row of an alignment (all, if the item is shorter) of which
    AGREE_PERCENT agree; the seeds miss none. Tokens are runs of letters and digits, lower-cased, of whole
    texts of any length. NULL and empty texts on either side overlap with nothing; items below min_tokens
    tokens are left out; repeated rows and items count once, different texts of one id each for itself, of
    which the best is returned; at ties the first position is; other columns are not read; an empty table
    on either side gives an empty result."""
    items = benchmark.select(F.col(f"`{item_key}`").alias("item_id"), tokens(F.col(f"`{item_text}`")).alias("ih"))
    items = items.select("item_id", "ih", F.size("ih").alias("n"), F.xxhash64("item_id", "ih").alias("item")).where(F.col("n") >= min_tokens).distinct()
    short = sorted(r["n"] for r in items.where(F.col("n") < OVERLAP).select("n").distinct().collect())
    starts = items.select("item", "ih", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("ipos"))
    # A short item is looked for as a whole only.
    kinds = [F.when(F.col("n") >= OVERLAP, k) for k in _seeds(F.col("ih"), F.col("ipos"), F.col("n"), 0, WINDOW_MASKS)]
    kinds += [F.when((F.col("n") == s) & (F.col("ipos") == 0), k) for s in short for k in _seeds(F.col("ih"), F.col("ipos"), F.col("n"), s, short_masks(s), s)]
    seeds = starts.select("item", "ipos", F.explode(F.array(*kinds)).alias("seed")).where("seed IS NOT NULL")
    held = items.agg(F.coalesce(F.sum(8 * F.col("n") + 40), F.lit(0))).first()[0]
    small = held <= BROADCAST_BYTES and seeds.count() <= BROADCAST_SEEDS

    rows = docs.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{key}`").alias("doc_id"), F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("row_hash"), tokens(F.col(f"`{text}`")).alias("h"))
    at = rows.select("doc_id", "row_hash", "h", F.posexplode("h").alias("pos", "token"))
    kinds = _seeds(F.col("h"), F.col("pos"), F.size("h"), 0, WINDOW_MASKS) + [k for s in short for k in _seeds(F.col("h"), F.col("pos"), F.size("h"), s, short_masks(s), s)]
    each = at.select("doc_id", "row_hash", "h", "pos", F.explode(F.array(*kinds)).alias("seed")).where("seed IS NOT NULL")
    if small:
        hits = each.join(F.broadcast(seeds), "seed").select("doc_id", "row_hash", "h", "item", (F.col("pos") - F.col("ipos")).alias("position")).join(F.broadcast(items), "item")
        hits = hits.select("doc_id", "row_hash", "item", "item_id", "position", "ih", "n", _aligned().alias("part")).dropDuplicates(["row_hash", "item", "position"])
    else:
        hits = each.drop("h").join(seeds, "seed").select("row_hash", "item", (F.col("pos") - F.col("ipos")).alias("position")).distinct()
        hits = hits.join(rows.dropDuplicates(["row_hash"]), "row_hash").join(items, "item")
        hits = hits.select("doc_id", "row_hash", "item", "item_id", "position", "ih", "n", _aligned().alias("part"))
    head = F.greatest(-F.col("position"), F.lit(0))
    same = F.transform("part", lambda x, i: (x == F.get("ih", head + i)).cast("int"))
    hits = hits.select("doc_id", "row_hash", "item_id", "position", "n", same.alias("same")).where(F.size("same") >= F.least("n", F.lit(OVERLAP)))
    span = F.least("n", F.lit(OVERLAP))
    windows = F.transform(F.sequence(F.lit(1), F.size("same") - span + 1), lambda i: F.aggregate(F.slice("same", i, span), F.lit(0), lambda s, x: s + x))
    total = F.aggregate("same", F.lit(0), lambda s, x: s + x)
    found = hits.select("doc_id", "row_hash", "item_id", "position", F.col("n").alias("item_tokens"), total.alias("matched"), F.array_max(windows).alias("best"), span.alias("span"))
    found = found.where(F.col("best") * 100 >= F.col("span") * AGREE_PERCENT)
    best = F.max_by(F.struct("item_tokens", "matched", "position"), F.struct("matched", -F.col("position"))).alias("b")
    return found.groupBy("row_hash", "doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.item_tokens", "b.matched", "b.position", "row_hash")


def _aligned() -> Column:
    """The document's tokens under the item, as far as the document goes."""
    first = F.greatest(F.col("position"), F.lit(0))
    return F.slice("h", first + 1, F.greatest(F.least(F.col("position") + F.col("n"), F.size("h")) - first, F.lit(0)))


def filter_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns, that overlap with no item of FILTER_TOKENS tokens or more. Rows without
    text stay; repeated rows go or stay together."""
    found = overlaps(docs, benchmark, text, key, min_tokens=FILTER_TOKENS).select(F.col("row_hash").alias("__hit")).distinct()
    return docs.join(found, F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")) == F.col("__hit"), "left_anti")
