"""Prefix trie of conversations, with totals of every subtree by parallel tree contraction: rounds of joins
rake leaves and compress unary chains, then the contracted nodes are expanded again."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, forget, hot_limit, meet

_WORD = r"[^\x20\x09-\x0D]+"


def turn_rows(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 1, by turn, NULL first, at a tie by content), said (digest of role and text), words:
    all that the trie needs of a turn. NULL roles and texts are empty; rows without a conversation go."""
    c = lambda name: F.col(f"`{name}`")
    role_, text_ = F.coalesce(c(role), F.lit("")), F.coalesce(c(text), F.lit(""))
    said = F.unhex(F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_), 256))
    few = rows.where(c(key).isNotNull()).select(c(key).cast("long").alias("conv_id"), c(turn).alias("turn"), said.alias("said"), F.regexp_count(text_, F.lit(_WORD)).cast("long").alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "said")
    return few.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "said", "words")


def grafted(turns: DataFrame, base: Column, head: Column, longest: int) -> tuple[DataFrame, DataFrame]:
    """Every conversation rebuilt as the first `head` turns of conversation `base` (fewer, if it has fewer) and its
    own turns after its first `head`; both are columns of conv_id, and no head is above `longest`. Returns the
    turns and all conversations; one that has no turn left is in the second only."""
    convs = turns.where("pos = 1").select("conv_id", base.alias("base"), head.cast("long").alias("head"))
    starts = turns.where(F.col("pos") <= longest).select(F.col("conv_id").alias("base"), "pos", "said", "words")
    taken = cut(convs.where("head > 0").join(starts, "base").where("pos <= head").select("conv_id", "pos", "said", "words"))
    size = taken.groupBy("conv_id").agg(F.count("*").alias("got"))
    own = turns.withColumn("head", head.cast("long")).where("pos > head").join(size, "conv_id", "left")
    return taken.unionByName(own.select("conv_id", (F.col("pos") - F.col("head") + F.coalesce("got", F.lit(0))).alias("pos"), "said", "words")), convs.select("conv_id")


def nodes_of(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie of turns (conv_id, pos, said, words) of the conversations convs: its nodes (at, node, parent, n_convs,
    words, n_children; at is depth and a fingerprint of 128 bits of the turns up to the node, node its smallest
    member and depth; the root has no parent), and where each conversation ends (at, conv_id)."""
    hashed = lambda seed: F.xxhash64(F.lit(seed), "pos", "said")
    zero = F.lit(0).cast("long")
    rows = turns.select("conv_id", F.col("pos").alias("depth"), "words", hashed("a").alias("x"), hashed("b").alias("y"))
    # The root is a place of every conversation, before its first turn.
    rows = rows.unionByName(convs.select("conv_id", zero.alias("depth"), zero.alias("words"), zero.alias("x"), zero.alias("y")))
    order = Window.partitionBy("conv_id").orderBy("depth")
    path = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", F.expr("bit_xor(x)").over(path).alias("a"), F.expr("bit_xor(y)").over(path).alias("b"), F.lead("depth").over(order).isNull().alias("ends"))
    up = F.struct((F.col("depth") - 1).alias("depth"), F.col("a").bitwiseXOR(F.col("x")).alias("a"), F.col("b").bitwiseXOR(F.col("y")).alias("b"))
    rows = cut(rows.select("conv_id", "words", F.struct("depth", "a", "b").alias("at"), up.alias("up"), "ends"))

    found = rows.groupBy("at").agg(F.min("conv_id").alias("conv"), F.count("*").alias("n_convs"), F.first("words").alias("words"), F.first("up").alias("up"))
    found = cut(found.select("at", F.struct("conv", F.col("at.depth").alias("depth")).alias("node"), "n_convs", "words", "up"))
    kids = found.where("at.depth > 0").groupBy(F.col("up").alias("at")).agg(F.count("*").alias("n_children"))
    own = cut(found.join(kids, "at", "left").withColumn("n_children", F.coalesce("n_children", zero)))
    parents = own.where("n_children > 0").select(F.col("at").alias("up"), F.col("node").alias("parent"), F.col("n_children").alias("siblings"))
    below = meet(own.where("at.depth > 0"), parents, "up", "siblings", hot_limit(own.count()))
    root = own.where("at.depth = 0").withColumn("parent", F.lit(None).cast(own.schema["node"].dataType))
    columns = ["at", "node", "parent", "n_convs", "words", "n_children"]
    nodes = cut(below.select(*columns).unionByName(root.select(*columns)))
    ends = cut(rows.where("ends").select("at", "conv_id"))
    forget(rows, found, own)
    return nodes, ends


def _coin(node: Column, turn: int, bits: int) -> Column:
    """Heads or tails of a node in a round: first the bits of its depth, which halve a whole chain each, then hashes."""
    if turn < bits:
        return F.shiftright(node["depth"], turn).bitwiseAND(F.lit(1)) == 1
    return F.xxhash64(node, F.lit(turn)).bitwiseAND(F.lit(1)) == 1


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """(node, values) summed over the subtree of every node of tree (node, parent, values). node is a struct with
    a field depth; the root has no parent; any number of trees may stand in the table, and an empty one gives
    an empty result.

    Each round first compresses: of nodes with one open child, those whose coin shows heads and whose parent's
    shows tails give their sums to the parent, on which their child now hangs; then it rakes: leaves give their
    sums, which are their totals, to their parent. No node is compressed together with its parent, so all of
    this is sums by parent and joins by node. The rounds end when no node is open, after a number that grows
    with the logarithm of the nodes. Then, from the last round to the first, each compressed node gets its own
    sum and the total of the child that it had, which went in that round or later. Sums by parent are added up
    before the shuffle; of the children of one parent, only those of compressed nodes, which have one, match."""
    kids = tree.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("open"))
    state = cut(tree.select("node", "parent", *values).join(kids, "node", "left").withColumn("open", F.coalesce("open", F.lit(0).cast("long"))))
    held = {v: f"__{v}" for v in values}
    written, rounds = [state], []
    bits = int(tree.agg(F.max("node.depth")).first()[0] or 0).bit_length()
    while not state.isEmpty():
        heads = (F.col("open") == 1) & F.col("parent").isNotNull() & _coin(F.col("node"), len(rounds), bits) & ~_coin(F.col("parent"), len(rounds), bits)
        heads = F.coalesce(heads, F.lit(False))
        gone = state.where(heads).select(F.col("node").alias("parent"), F.col("parent").alias("above"), *[F.col(v).alias(h) for v, h in held.items()])
        hung = state.where(~heads).join(gone, "parent", "left")
        hung = cut(hung.select("node", F.coalesce("above", "parent").alias("parent"), *values, "open", F.when(F.col("above").isNotNull(), F.col("parent")).alias("was"), *held.values()))
        given = hung.where("was IS NOT NULL").select(F.col("parent").alias("node"), *[F.col(h).alias(v) for v, h in held.items()], F.lit(0).alias("less"))
        given = given.unionByName(hung.where("open = 0 AND parent IS NOT NULL").select(F.col("parent").alias("node"), *values, F.lit(1).alias("less")))
        sums = given.groupBy("node").agg(*[F.sum(v).alias(h) for v, h in held.items()], F.sum("less").alias("__less"))
        rest = hung.where("open > 0").select("node", "parent", *values, "open").join(sums, "node", "left")
        state = cut(rest.select("node", "parent", *[(F.col(v) + F.coalesce(h, F.lit(0))).alias(v) for v, h in held.items()], (F.col("open") - F.coalesce("__less", F.lit(0))).alias("open")))
        rounds.append(hung)
        written += [hung, state]

    known = state.select("node", *values)
    for hung in reversed(rounds):
        known = known.unionByName(hung.where("open = 0").select("node", *values))
        lost = hung.where("was IS NOT NULL").select(F.col("was").alias("lost"), "node", *held.values())
        if not lost.isEmpty():
            back = cut(lost.join(known, "node").select(F.col("lost").alias("node"), *[(F.col(v) + F.col(h)).alias(v) for v, h in held.items()]))
            written.append(back)
            known = known.unionByName(back)
    out = cut(known)
    forget(*written)
    return out


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each distinct start of the conversations convs, whose turns are (conv_id, pos, said, words), pos
    from 1 without gaps: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256; the root (depth 0) has all conversations, also those without turns.

    Turns are compared by digests; long texts count only in them. Equal conversations are members of the same
    nodes; pos leaves no ties. Without conversations there is no root, and the result is empty."""
    nodes, ends = nodes_of(turns, convs)
    tree = nodes.select("node", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = subtree_totals(tree, ["n_leaves", "saved_tokens"])
    out = nodes.join(totals, "node").join(end_digests(ends), "at", "left")
    return out.select(F.col("node.conv").alias("conv_id"), F.col("node.depth").alias("depth"), F.col("parent.conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def end_digests(ends: DataFrame) -> DataFrame:
    """(at, ends_sha256): SHA-256 of the ids of the conversations that end at each node, rising, with commas. A
    hash goes over its bytes in order, so a node's ids pass through one task; they are sorted by Spark, on disk
    if they are many, and none is held."""
    ordered = ends.select("at", "conv_id").repartition("at").sortWithinPartitions("at", "conv_id").select("at", F.col("conv_id").cast("string").alias("id"))
    schema = T.StructType([ordered.schema["at"], T.StructField("ends_sha256", T.StringType())])

    def run(it):
        last, digest = None, None
        for b in it:
            ats, ids, done = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for at, id_ in zip(ats, ids, strict=True):
                if at == last:
                    digest.update(f",{id_}".encode())
                    continue
                if last is not None:
                    done.append((last, digest.hexdigest()))
                last, digest = at, hashlib.sha256(id_.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], b.schema[0].type), pa.array([d[1] for d in done], pa.string())], schema.names)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], b.schema[0].type), pa.array([digest.hexdigest()])], schema.names)

    return ordered.mapInArrow(run, schema)
