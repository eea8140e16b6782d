"""Balanced label propagation: linked rows move to their neighbours' shards under capacity quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Cells, at least, that the running totals of a shard are cut into, and rows of a cell, about.
CELLS, CELL_ROWS = 64, 1 << 16
#: A group of equal texts is large above this share of a shard; so at most 16 a shard are.
LARGE_SHARE = 16
#: Rounds without gain after which the propagation has converged.
PATIENCE = 3


def running(df: DataFrame, group: list[str], cell: str, order: list[str], value: str, name: str) -> DataFrame:
    """df with `name`: the total of value over the rows before it in its group, by cell, then by order.
    Cells are summed first and only their sums are added up in one window; rows are added up within
    their cell. Cells must be few for each group."""
    sums = df.groupBy(*group, cell).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*group, cell, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inner = Window.partitionBy(*group, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("__in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return out.join(base, [*group, cell]).withColumn(name, F.col("__base") + F.col("__in")).drop("__base", "__in")


def level_cell(cells: int) -> Column:
    """Cells of the groups of linked rows: larger groups first, the rows of a group one after another. A group of
    more than CELL_ROWS rows has cells of its own, by rid, so that it is no single window."""
    level = F.lpad((F.lit(99) - F.floor(F.log2("crowd"))).cast("string"), 2, "0")
    own = F.concat(F.lit("-"), F.col("hub").cast("string"), F.lit("-"), F.pmod(F.xxhash64("rid"), F.ceil(F.col("crowd") / CELL_ROWS)).cast("string"))
    return F.concat(level, F.lit("-"), F.pmod(F.xxhash64("hub"), F.lit(cells)).cast("string"), F.when(F.col("crowd") > CELL_ROWS, own).otherwise(""))


def _pick(values: list[int], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("long") for v in values]), index)


def targets(votes: dict[int, dict[int, int]], room: list[int]) -> list[tuple[int, int, int, int]]:
    """(hub, target, low, high) for hubs by falling crowd: members low to high - 1 go to target. A hub goes
    to the shard, of those with room for all that is left of it, where most of its members are; without
    one it fills the shard with most room first. room is used up."""
    out = []
    for hub, where in sorted(votes.items(), key=lambda v: (-sum(v[1].values()), v[0])):
        at, crowd = 0, sum(where.values())
        while at < crowd:
            fits = [s for s, r in enumerate(room) if r >= crowd - at]
            to = max(fits, key=lambda s: (where.get(s, 0), -room[s], -s)) if fits else max(range(len(room)), key=lambda s: (room[s], where.get(s, 0), -s))
            n = min(room[to], crowd - at)
            out.append((hub, to, at, at + n))
            room[to] -= n
            at += n
    return out


def deal(state: DataFrame, links: DataFrame, room: list[int], cells: int) -> DataFrame:
    """(rid, shard) of the members of large hubs, one hub a row: each hub names as many targets as it needs,
    and its members are dealt to them by their running number. The driver holds hubs x shards counts."""
    votes: dict[int, dict[int, int]] = {}
    for r in state.join(links, "rid").groupBy("hub", "shard").agg(F.count("*").alias("n")).collect():
        votes.setdefault(r["hub"], {})[r["shard"]] = r["n"]
    if not votes:
        return state.where("false")
    rows = ", ".join(f"(bigint('{h}'), {t}, {low}L, {high}L)" for h, t, low, high in targets(votes, room))
    named = state.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(hub, target, low, high)")
    members = links.withColumn("cell", F.pmod(F.xxhash64("rid"), F.lit(cells))).withColumn("one", F.lit(1))
    ranked = running(members, ["hub"], "cell", ["rid"], "one", "rank")
    return ranked.join(F.broadcast(named), "hub").where("rank >= low AND rank < high").select("rid", F.col("target").cast("int").alias("shard"))


def propagate(state: DataFrame, links: DataFrame, caps: list[int], cells: int = CELLS) -> DataFrame:
    """state: (rid, shard) of the rows that have links; links: (rid, hub), rows of one hub being
    neighbours of each other; caps: rows that each shard may take. In each round a hub looks to that shard,
    among those with room, where most of its members are, and its members ask to go there. A row with
    several hubs follows the largest crowd. A shard takes asking rows, those of the largest crowds first,
    up to its cap without the rows that ask to leave it. Ends when nothing asks, or when PATIENCE rounds
    have not lessened the rows apart from most of their hub; the state with the fewest is returned. Every
    round is written to the shared folder."""
    best, least, idle = state, None, 0
    while True:
        load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        if not load:
            return state
        full = [s for s in range(len(caps)) if load.get(s, 0) >= caps[s] - max(1, caps[s] // 50)]
        at_full = F.col("shard").isin(full) if 0 < len(full) < len(caps) else F.lit(False)
        votes = cut(state.join(links, "rid").groupBy("hub", "shard").agg(F.count("*").alias("n")))
        apart = votes.groupBy("hub").agg((F.sum("n") - F.max("n")).alias("n")).agg(F.sum("n")).first()[0] or 0
        if least is None or apart < least:
            best, least, idle = state, apart, 0
        else:
            idle += 1
        if idle == PATIENCE:
            return best
        looks = votes.groupBy("hub").agg(F.max_by("shard", F.struct((~at_full).cast("int"), "n", F.xxhash64("hub", "shard"))).alias("target"), F.sum("n").alias("crowd"))
        wish = state.join(links, "rid").join(looks, "hub").groupBy("rid", "shard").agg(F.max(F.struct("crowd", "target", "hub")).alias("w"))
        wish = wish.select("rid", "shard", "w.target", "w.crowd", "w.hub").where("shard <> target")
        wish = cut(wish.withColumn("cell", level_cell(cells)).withColumn("one", F.lit(1)))
        leave = {r["shard"]: r["n"] for r in wish.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        if not leave:
            return best
        room = [max(0, c - load.get(s, 0) + leave.get(s, 0)) for s, c in enumerate(caps)]
        ranked = running(wish, ["target"], "cell", ["crowd", "hub", "rid"], "one", "rank")
        moves = ranked.where(F.col("rank") < _pick(room, F.col("target").cast("int"))).select("rid", "target")
        state = cut(state.join(moves, "rid", "left").select("rid", F.coalesce("target", "shard").alias("shard")))


def shard(docs: DataFrame, shards: int = 40, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard
    (NULL), hub (of equal texts; NULL for a text that no other row has).

    Law: counts of rows differ by one at most. Rows of equal texts (also empty ones) are linked. They
    start where a hash puts them. Groups over a LARGE_SHARE-th of a shard are placed first, by `deal`; the others
    move by `propagate` under the room that is left, and what exceeds a shard's count afterwards fills
    the gaps, in the order of groups, together with the rows without links. A group larger than a shard
    fills as few as the room allows. A NULL text has no links, size 16 and crc 0. Repeated rows are placed each for itself,
    in the order of the scan (rid). Texts of any length are only measured and hashed. Other columns are not read; an empty table gives an empty result."""
    t = F.col(f"`{text}`")
    rows = cut(
        docs.select(
            F.monotonically_increasing_id().alias("rid"), F.col(f"`{key}`").alias("doc_id"), (F.coalesce(F.octet_length(t), F.lit(0)) + 16).cast("long").alias("size"),
            F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), F.when(t.isNotNull(), F.xxhash64(t)).alias("digest"),
        )
    )
    total = rows.count()
    capacity = total // shards
    large, cells = max(1, capacity // LARGE_SHARE), max(CELLS, -(-capacity // CELL_ROWS))
    caps = [capacity + (s < total % shards) for s in range(shards)]
    crowds = cut(rows.where("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("crowd")).where("crowd > 1"))
    # Few groups are large (LARGE_SHARE a shard at most): broadcast, so that none meets in one task.
    hot = F.broadcast(crowds.where(F.col("crowd") > large))
    keyed = rows.select("rid", "digest")
    linked = keyed.join(hot, "digest").unionByName(keyed.join(hot, "digest", "left_anti").join(crowds.where(F.col("crowd") <= large), "digest"))
    linked = cut(linked.select("rid", F.col("digest").alias("hub"), "crowd"))
    start = cut(linked.select("rid", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int").alias("shard"), (F.col("crowd") > large).alias("large")))
    room = list(caps)
    dealt = cut(deal(start.where("large").drop("large"), linked.where(F.col("crowd") > large).select("rid", "hub"), room, cells))
    state = propagate(start.where("NOT large").drop("large"), linked.where(F.col("crowd") <= large).select("rid", "hub"), room, cells)
    state = dealt.unionByName(state).join(linked, "rid")

    # Large groups come first and have room for all, so their cells may be cut by rows.
    large_cell = F.concat(F.lit("00-"), F.pmod(F.xxhash64("rid"), F.lit(cells)).cast("string"))
    state = state.withColumn("cell", F.when(F.col("crowd") > large, large_cell).otherwise(level_cell(cells))).withColumn("one", F.lit(1))
    settled = cut(running(state, ["shard"], "cell", ["hub", "rid"], "one", "rank").select("rid", "shard", "hub", (F.col("rank") < _pick(caps, F.col("shard"))).alias("stays")))
    kept = {r["shard"]: r["n"] for r in settled.where("stays").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    bounds, at = [], 0
    for s in range(shards):
        at += caps[s] - kept.get(s, 0)
        bounds.append(at)
    placed = rows.join(settled, "rid", "left").withColumn("one", F.lit(1)).withColumn("all", F.lit(0))
    fill = placed.where("NOT coalesce(stays, false)")
    # Overflow of groups first, group by group, then the rows without links.
    fill = fill.withColumn("cell", F.when(F.col("hub").isNotNull(), F.pmod(F.xxhash64("hub"), F.lit(cells))).otherwise(cells + F.pmod(F.xxhash64("rid"), F.lit(shards * cells))))
    fill = running(fill, ["all"], "cell", ["hub", "rid"], "one", "rank")
    gap = F.array(*[F.lit(b).cast("long") for b in bounds])
    fill = fill.withColumn("shard", F.size(F.filter(gap, lambda b: b <= F.col("rank"))).cast("int"))
    columns = ["rid", "doc_id", "size", "text_crc32", "hub", "shard", "one"]
    done = cut(placed.where("stays").select(*columns).unionByName(fill.select(*columns)))
    slots = running(done.withColumn("cell", F.pmod(F.xxhash64("rid"), F.lit(cells))), ["shard"], "cell", ["rid"], "one", "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hub")
