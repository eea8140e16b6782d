"""Panel and time-series operators. Every operator takes partition keys, so that symbols, strategies,
scenarios and resamples run in one job; a window never lacks a key but over a calendar."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import TRADING_DAYS, annualize, safe_div, std0
from ..storage import cut


def ordered(part: Sequence[str], *order: str):
    return Window.partitionBy(*part).orderBy(*order)


def upto(part: Sequence[str], *order: str):
    return ordered(part, *order).rowsBetween(Window.unboundedPreceding, 0)


def trailing(part: Sequence[str], n: int, *order: str):
    return ordered(part, *order).rowsBetween(1 - n, 0)


def with_returns(df: DataFrame, part: Sequence[str], price: str = "adjclose", order: str = "d") -> DataFrame:
    """idx (from 0) and ret: simple return on the row before, 0 on the first row."""
    w = ordered(part, order)
    before = F.lag(price).over(w)
    return df.withColumns({"idx": F.row_number().over(w) - 1, "ret": F.coalesce(safe_div(F.col(price) - before, before), F.lit(0.0))})


def rolling_vol(n: int, part: Sequence[str], ret: str = "ret", order: str = "d") -> Column:
    """Annualized sample deviation of n rows; 0 until n rows follow the first."""
    return F.when(F.row_number().over(ordered(part, order)) > n, annualize(F.coalesce(F.stddev_samp(ret).over(trailing(part, n, order)), F.lit(0.0)))).otherwise(0.0)


def trailing_std(n: int, least: int, part: Sequence[str], ret: str = "ret", order: str = "d") -> Column:
    """Sample deviation of up to n rows, NULL for fewer than `least`."""
    w = trailing(part, n, order)
    return F.when(F.count(ret).over(w) >= least, F.coalesce(F.stddev_samp(ret).over(w), F.lit(0.0)))


def momentum(k: int, part: Sequence[str], price: str = "adjclose", order: str = "d") -> Column:
    """Return over k rows; NULL on the first k."""
    before = F.lag(price, k).over(ordered(part, order))
    return safe_div(F.col(price), before) - 1


def skew_score(n: int, least: int, part: Sequence[str], ret: str = "ret", order: str = "d") -> Column:
    """Up deviation / (up + down deviation) of n returns, NULL for fewer than `least`. A side's deviation
    is its sample deviation, with one value its size, without any 0; 0.5 if both are 0."""
    w = trailing(part, n, order)

    def side(sign: int) -> Column:
        v = F.when(F.col(ret) * sign > 0, F.abs(ret))
        return F.when(F.count(v).over(w) > 1, F.stddev_samp(v).over(w)).otherwise(F.coalesce(F.avg(v).over(w), F.lit(0.0)))

    up, down = side(1), side(-1)
    return F.when(F.count(ret).over(w) >= least, F.when(up + down > 0, F.try_divide(up, up + down)).otherwise(0.5))


def compounded(part: Sequence[str], ret: str = "ret", order: str = "d") -> Column:
    return F.product(1 + F.col(ret)).over(upto(part, order))


def drawdown(value: str, part: Sequence[str], order: str = "d") -> Column:
    return safe_div(F.col(value), F.max(value).over(upto(part, order))) - 1


def crossings(df: DataFrame, part: Sequence[str], value: str, thresholds: Sequence[float], order: str = "d") -> DataFrame:
    """A row for each threshold that the value crosses: down (before > t >= now) or up (before < t <= now)."""
    each = df.withColumn("before", F.lag(value).over(ordered(part, order))).withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    t, now, was = F.col("threshold"), F.col(value), F.col("before")
    way = F.when((was > t) & (t >= now), "down").when((was < t) & (t <= now), "up")
    return each.select(*part, order, "threshold", way.alias("direction"), F.round("before", 6).alias("before"), F.round(value, 6).alias("now")).where("direction IS NOT NULL")


def longest_run(df: DataFrame, part: Sequence[str], condition: Column, order: str = "d", ranges: int | None = None) -> DataFrame:
    """Days on which the condition holds and the longest run of them, for each key; ranges: see `scan`."""
    if ranges:
        hits = scan(df.withColumn("hit", F.coalesce(condition, F.lit(False)).cast("int")), part, order, {"was": ("lag", "hit", 1)}, ranges)
        runs = scan(hits.withColumn("starts", F.greatest(F.col("hit") - F.coalesce("was", F.lit(0)), F.lit(0))), part, order, {"run": ("sum", "starts")}, ranges)
        lengths = runs.groupBy(*part, "run").agg(F.sum("hit").alias("n"))
        return lengths.groupBy(*part).agg(F.sum("n").alias("days"), F.max("n").alias("longest"))
    flagged = df.withColumn("hit", F.coalesce(condition, F.lit(False)))
    islands = flagged.withColumn("island", F.row_number().over(ordered(part, order)) - F.row_number().over(ordered([*part, "hit"], order)))
    runs = islands.groupBy(*part, "hit", "island").agg(F.count("*").alias("n"))
    return runs.groupBy(*part).agg(F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("days"), F.coalesce(F.max(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("longest"))


def rank_split(df: DataFrame, order: Column | Sequence[Column], parts: int, part: Sequence[str]) -> DataFrame:
    """tier 0.. by place in the order: cuts at k * n // parts."""
    w = Window.partitionBy(*part)
    place, n = F.row_number().over(w.orderBy(*([order] if isinstance(order, Column) else order))) - 1, F.count("*").over(w)
    tier = F.lit(0)
    for k in range(1, parts):
        tier = tier + (place >= F.floor(n * k / parts)).cast("int")
    return df.withColumn("tier", tier)


def placed(df: DataFrame, by: str, tie: str, ranges: int = 64) -> DataFrame:
    """Rows with a value of by, with their place (from 0) in the order of by and tie among all rows, and the number
    of rows (`of`). Each range of values is ordered for itself and starts where the counts of those before it
    end, so that no task orders all rows; a value of very many rows is in one range. The places are exact, whatever
    the bounds of the ranges."""
    rows = df.where(F.col(by).isNotNull())
    bounds = rows.agg(F.percentile_approx(by, [i / ranges for i in range(1, ranges)], 1000).alias("range_bounds"))
    ranged = rows.crossJoin(F.broadcast(bounds)).withColumn("range_no", F.size(F.filter("range_bounds", lambda b: b < F.col(by)))).drop("range_bounds")  # one row
    w = Window.orderBy("range_no")  # one row a range
    counts = ranged.groupBy("range_no").agg(F.count("*").alias("range_n"))
    starts = counts.select("range_no", (F.sum("range_n").over(w) - F.col("range_n")).alias("start"), F.sum("range_n").over(Window.partitionBy()).alias("of"))
    place = F.col("start") + F.row_number().over(ordered(["range_no"], by, tie)) - 1
    return ranged.join(F.broadcast(starts), "range_no").withColumn("place", place).drop("range_no", "start")


_KINDS = {
    "sum": (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0))),
    "product": (F.product, lambda a, b: a * F.coalesce(b, F.lit(1.0))),
    "max": (F.max, F.greatest),
    "last": (lambda c: F.last(c, ignorenulls=True), F.coalesce),
}


def scan(df: DataFrame, part: Sequence[str], order: str | Sequence[str], running: Mapping[str, tuple], ranges: int = 64, reverse: bool = False) -> DataFrame:
    """df with running values, the same as of windows by key over all rows up to each, for keys of any length. running:
    name to (kind, column), kind being sum, product, max or last (of values that are not NULL), or to (lag, column,
    k), the value k rows before. Rows go by the columns of order, from the end if reverse; keys may be NULL.

    Rows are dealt to ranges of the first column of order. Values run inside a range; of each range only its total
    and its last rows go on to the next, through a window of one row a range, so that a key of very many rows
    is spread over as many tasks as there are ranges. Equal values of that column are in one range."""
    order = [order] if isinstance(order, str) else list(order)
    by, key = order[0], ["range_key"]
    way = F.desc if reverse else F.asc_nulls_first
    first = [F.desc_nulls_last(c) if reverse else F.asc_nulls_first(c) for c in order]
    last = [F.asc_nulls_first(c) if reverse else F.desc_nulls_last(c) for c in order]
    bounds = df.agg(F.percentile_approx(by, [i / ranges for i in range(1, ranges)], 1000).alias("range_bounds"))
    number = F.size(F.filter(F.coalesce("range_bounds", F.array()), lambda b: b < F.col(by)))
    # A struct, as its parts may be NULL and meet nevertheless.
    ranged = df.crossJoin(F.broadcast(bounds)).withColumn("range_key", F.struct(number.alias("no"), *[F.col(p).alias(f"k{i}") for i, p in enumerate(part)])).drop("range_bounds")  # bounds is one row
    w, n = Window.partitionBy(*key).orderBy(*first), F.row_number()
    upto_ = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = {k: v for k, v in running.items() if v[0] != "lag"}
    lags = {k: v for k, v in running.items() if v[0] == "lag"}
    rows = ranged.withColumns({f"in_{k}": _KINDS[kind][0](c).over(upto_) for k, (kind, c) in sums.items()} | {f"in_{k}": F.lag(c, j).over(w) for k, (_, c, j) in lags.items()} | {"range_row": n.over(w)})

    most = max([1, *[v[2] for v in lags.values()]])
    tail = ranged.withColumn("range_end", n.over(Window.partitionBy(*key).orderBy(*last))).where(F.col("range_end") <= most)
    picks = {k: F.transform(F.sort_array(F.collect_list(F.struct((-F.col("range_end")).alias("e"), F.col(c).alias("v")))), lambda x: x["v"]) for k, (_, c, _) in lags.items()}
    ends = tail.groupBy(*key).agg(F.count("*").alias("range_size"), *[p.alias(k) for k, p in picks.items()])
    across = Window.partitionBy(*[F.col(f"range_key.k{i}") for i in range(len(part))]).orderBy(way(F.col("range_key.no")))
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    some = across.rowsBetween(-most, -1)
    carried = ends.select(*key, *[F.flatten(F.collect_list(k).over(some)).alias(f"c_{k}") for k in lags])
    if sums:
        place = F.struct(*order)
        seen = lambda c: F.when(F.col(c).isNotNull(), place)
        total = lambda kind, c: (F.min_by if reverse else F.max_by)(c, seen(c)) if kind == "last" else _KINDS[kind][0](c)
        totals = ranged.groupBy(*key).agg(*[total(kind, c).alias(k) for k, (kind, c) in sums.items()])
        over = totals.select(*key, *[_KINDS[kind][0](k).over(before).alias(f"c_{k}") for k, (kind, _) in sums.items()])
        carried = carried.join(over, key) if lags else over
    out = rows.join(carried, key)
    value = {k: _KINDS[kind][1](F.col(f"in_{k}"), F.col(f"c_{k}")) for k, (kind, _) in sums.items()}
    value |= {k: F.when(F.col("range_row") > j, F.col(f"in_{k}")).otherwise(F.try_element_at(f"c_{k}", (F.col("range_row") - j - 1).cast("int"))) for k, (_, _, j) in lags.items()}
    return out.select(*df.columns, *[v.alias(k) for k, v in value.items()])


def _same(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """A join in which NULL keys meet."""
    other = right.withColumnsRenamed({k: f"r_{k}" for k in key})
    on = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in key]
    return (left.join(other, on) if key else left.crossJoin(F.broadcast(other))).drop(*[f"r_{k}" for k in key])  # without a key one row


#: Keys of at most this number meet their rows by broadcast; of more keys, only those of more than HOT_ROWS rows do.
FEW_KEYS, HOT_ROWS = 10_000, 1_000_000


def _met(rows: DataFrame, known: DataFrame, part: Sequence[str]) -> DataFrame:
    """rows with what is known of their key (a row a key, written before, n being its rows); no task gathers the rows
    of a long key, as long keys, which are few, are broadcast."""
    if not part or known.limit(FEW_KEYS + 1).count() <= FEW_KEYS:
        return _same(rows, F.broadcast(known), part)  # counted
    hot = F.broadcast(known.where(F.col("n") > HOT_ROWS))  # at most one for each HOT_ROWS rows
    short = rows.join(hot.select(*part), [rows[k].eqNullSafe(hot[k]) for k in part], "left_anti")
    return _same(rows, hot, part).unionByName(_same(short, known.where(F.col("n") <= HOT_ROWS), part))


def percentile(df: DataFrame, part: Sequence[str], value: str, p: float, name: str, accuracy: int = 10_000) -> DataFrame:
    """Exact percentile p (0 to 1, between two places in proportion) of the values of each key that are not NULL; NULL if
    a key has none. A sketch of each key gives bounds around the place; the values below are counted and only those
    between them are ordered, each once with its count, some 6 / accuracy of the key's, so no task holds a long key's
    values. Where a sketch has missed the place, which the counts show, the key's values are ordered after all."""
    names, part = part, [f"key_{i}" for i in range(len(part))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(names, part, strict=True)], F.col(value).cast("double").alias("v"))
    some, step = rows.where("v IS NOT NULL"), 3 / accuracy
    sketch = cut(rows.groupBy(*part).agg(F.count("v").alias("n"), F.percentile_approx("v", [max(p - step, 0.0), min(p + step, 1.0)], accuracy).alias("b")))
    least = sketch.select(*part, "n", (F.lit(p) * (F.col("n") - 1)).alias("h"), F.get("b", F.lit(0)).alias("low"), F.get("b", F.lit(1)).alias("high"))
    counts = _met(some, least, part).groupBy(*part).agg(F.count_if(F.col("v") < F.col("low")).alias("under"), F.count_if(F.col("v").between(F.col("low"), F.col("high"))).alias("inside"))
    known = _same(least, counts, part)
    sure = (F.col("under") <= F.floor("h")) & (F.ceil("h") < F.col("under") + F.col("inside"))
    known = cut(known.withColumns({"under": F.when(sure, F.col("under")).otherwise(0), "low": F.when(sure, F.col("low")), "high": F.when(sure, F.col("high"))}))
    near = _met(some, known, part).where(F.col("low").isNull() | F.col("v").between(F.col("low"), F.col("high")))
    values = near.groupBy(*part, "v").agg(F.count("*").alias("c"), F.first("h").alias("h"), F.first("under").alias("under"))
    ends = values.withColumn("end", F.sum("c").over(Window.partitionBy(*part).orderBy("v")) + F.col("under"))
    holds = lambda k: (F.col("end") - F.col("c") <= k) & (k < F.col("end"))
    two = ends.where(holds(F.floor("h")) | holds(F.ceil("h"))).groupBy(*part).agg(F.min("v").alias("a"), F.max("v").alias("b"), F.first("h").alias("h"))
    found = two.select(*part, (F.col("a") + (F.col("b") - F.col("a")) * (F.col("h") - F.floor("h"))).alias(name))
    none = sketch.where("n = 0").select(*part, F.lit(None).cast("double").alias(name))
    return found.unionByName(none).toDF(*names, name)


def asof(left: DataFrame, right: DataFrame, left_time: str, right_time: str, values: Sequence[str], part: Sequence[str] = (), tolerance_days: int | None = None, forward: bool = False, ranges: int | None = None) -> DataFrame:
    """left with the values and the time (`asof_time`) of the last right row at or before it (forward: the
    first at or after it) with the same keys; NULL if there is none or it is farther than the tolerance.
    One shuffle by key: both sides are stacked and the last seen value is carried. Without keys all rows
    share one window, which only calendars may; with ranges, long keys and none are spread over tasks (see `scan`)."""
    seen = F.struct(F.col(right_time).alias("asof_time"), *values)
    keep = [c for c in left.columns]
    stacked = left.select(F.struct(*keep).alias("row"), *[F.col(p).alias(f"k_{p}") for p in part], F.col(left_time).alias("t"), F.lit(1).alias("side"), F.lit(None).cast(right.select(seen).schema[0].dataType).alias("seen")).unionByName(
        right.select(F.lit(None).cast(left.select(F.struct(*keep)).schema[0].dataType).alias("row"), *[F.col(p).alias(f"k_{p}") for p in part], F.col(right_time).alias("t"), F.lit(0).alias("side"), seen.alias("seen"))
    )
    if ranges:
        # From the end, the right rows of a time have to come before its left rows too.
        stacked = stacked.withColumn("turn", -F.col("side") if forward else F.col("side"))
        out = scan(stacked, [f"k_{p}" for p in part], ["t", "turn"], {"last_seen": ("last", "seen")}, ranges, reverse=forward).drop("seen").withColumnRenamed("last_seen", "seen").where("side = 1")
    else:
        order = [F.desc("t"), "side"] if forward else ["t", "side"]
        w = Window.partitionBy(*[f"k_{p}" for p in part]).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = stacked.withColumn("seen", F.last("seen", ignorenulls=True).over(w)).where("side = 1")
    if tolerance_days is not None:
        near = F.abs(F.datediff("t", F.col("seen.asof_time"))) <= tolerance_days
        out = out.withColumn("seen", F.when(near, F.col("seen")))
    return out.select("row.*", "seen.*")


def on_calendar(left: DataFrame, cal: DataFrame, left_time: str, cal_time: str, values: Sequence[str], forward: bool = False) -> DataFrame:
    """`asof` without keys for a left side of any length: only its distinct days, as few as a calendar's, share one
    window, and left meets them by day. NULL days have NULLs. left is read twice: write it first if it is costly."""
    days = left.select(F.col(left_time).alias("on_day")).where("on_day IS NOT NULL").distinct()
    found = asof(days, cal, "on_day", cal_time, values, forward=forward)
    return left.join(found, F.col(left_time) == F.col("on_day"), "left").drop("on_day")


def trailing_sum(left: DataFrame, right: DataFrame, left_time: str, right_time: str, value: str, name: str, days: int, part: Sequence[str]) -> DataFrame:
    """left with the sum (`name`) of value over the right rows of the same keys in the last `days` days up to and
    with left_time; NULL if there is none. One shuffle by key and a window of a range of days, no join."""
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    keys = [f"k_{p}" for p in part]
    mine = left.select(F.struct(*left.columns).alias("row"), *[F.col(p).alias(k) for p, k in zip(part, keys, strict=True)], day(left_time).alias("t"))
    theirs = right.select(*[F.col(p).alias(k) for p, k in zip(part, keys, strict=True)], day(right_time).alias("t"), F.col(value).alias("add"))
    w = Window.partitionBy(*keys).orderBy("t").rangeBetween(1 - days, 0)
    stacked = mine.unionByName(theirs.where("t IS NOT NULL"), allowMissingColumns=True)
    return stacked.withColumn(name, F.sum("add").over(w)).where("row IS NOT NULL").select("row.*", name)


def calendar(days: DataFrame, d: str = "d") -> DataFrame:
    """Distinct days with their number from 0. A calendar has some thousand rows, hence the one window."""
    return days.select(F.col(d).alias("d")).distinct().withColumn("idx", F.row_number().over(Window.orderBy("d")) - 1)


def performance(daily: DataFrame, part: Sequence[str], rate: str = "annual_rate", idle: float = 0.1) -> DataFrame:
    """The 14 metrics of daily rows (part, d, position, daily_return, equity and a yearly rate), for each
    key, from one exchange by key."""
    w, up = ordered(part, "d"), upto(part, "d")
    month = F.date_format("d", "yyyy-MM")
    free = F.pow(1 + F.col(rate), F.lit(1.0 / TRADING_DAYS)) - 1
    low = F.coalesce(F.col("position") <= idle, F.lit(False))
    rows = daily.withColumn("__before", F.lag("d").over(w)).select(
        *part, "d", "position", "daily_return", "equity", free.alias("free"), low.alias("low"),
        F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy(*part)).alias("n"),
        (F.col("equity") / F.max("equity").over(up) - 1).alias("dd"),
        (F.coalesce(F.lead(month).over(w), F.lit("")) != month).alias("month_end"),
        F.row_number().over(Window.partitionBy(*part).orderBy(F.when(F.col("__before").isNotNull(), F.col("daily_return")).asc_nulls_last(), "d")).alias("worst"),
    )
    rows = rows.withColumn("month_peak", F.max(F.when(F.col("month_end"), F.col("equity"))).over(up))
    rows = rows.withColumn("island", F.col("i") - F.sum(F.col("low").cast("int")).over(up))
    runs = rows.withColumn("run", F.when(F.col("low"), F.count(F.when(F.col("low"), 1)).over(Window.partitionBy(*part, "island"))).otherwise(0))
    first, excess = F.col("i") > 1, F.col("daily_return") - F.col("free")
    a = runs.groupBy(*part).agg(
        F.max_by("equity", "d").alias("last"), F.count("*").alias("n"),
        std0(F.when(first, F.col("daily_return"))).alias("sd"), F.avg(F.when(first, F.col("daily_return"))).alias("mean"), F.avg(F.when(first, excess)).alias("mean_excess"),
        F.sqrt(F.avg(F.when(first, F.pow(F.least(excess, F.lit(0.0)), 2)))).alias("down"),
        F.coalesce(F.avg(F.when(first & (F.col("worst") <= F.greatest(F.lit(1), F.ceil(0.05 * (F.col("n") - 1)))), F.col("daily_return"))), F.lit(0.0)).alias("cvar"),
        F.min("dd").alias("dd"), F.min(F.when(F.col("month_end"), F.col("equity") / F.col("month_peak") - 1)).alias("dd_month"),
        F.avg("position").alias("position"), F.count_if("low").alias("low_days"), F.max("run").alias("low_run"),
    )
    year = F.lit(math.sqrt(TRADING_DAYS))
    cagr = F.pow("last", TRADING_DAYS / F.greatest(F.col("n") - 1, F.lit(1))) - 1
    vol, down = F.col("sd") * year, F.coalesce(F.col("down"), F.lit(0.0)) * year
    return a.select(
        *part, (F.col("last") - 1).alias("total_return"), cagr.alias("cagr"), vol.alias("volatility"),
        F.coalesce(safe_div(F.col("mean") * TRADING_DAYS, vol), F.lit(0.0)).alias("sharpe"), down.alias("downside_deviation"),
        F.coalesce(safe_div(F.col("mean_excess") * TRADING_DAYS, down), F.lit(0.0)).alias("sortino"), F.col("cvar").alias("cvar_95"),
        F.col("dd").alias("max_drawdown"), F.col("dd").alias("max_drawdown_daily"), F.col("dd_month").alias("max_drawdown_monthly"), F.coalesce(safe_div(cagr, F.abs("dd")), F.lit(0.0)).alias("calmar"),
        F.col("position").alias("avg_position"), F.col("low_days").alias("days_idle"), F.col("low_run").alias("longest_idle_run"),
    )


def falls(df: DataFrame, part: Sequence[str], value: str, order: str = "d", ranges: int = 64) -> DataFrame:
    """df with peak, the greatest value so far, and drawdown from it, for keys of any length (see `scan`)."""
    return scan(df, part, order, {"peak": ("max", value)}, ranges).withColumn("drawdown", safe_div(F.col(value), F.col("peak")) - 1)


def simulate(df: DataFrame, part: Sequence[str], cost_bps: float = 5.0, ret: str = "ret", position: str = "position", ranges: int | None = None) -> DataFrame:
    """df with daily_return and equity. A day earns the position of the day before less the cost of that
    position's change; the first day earns nothing and the first position is free; ranges: see `scan`."""
    if ranges:
        at = scan(df, part, "d", {"__held": ("lag", position, 1), "__was": ("lag", position, 2)}, ranges)
        cost = F.abs(F.col("__held") - F.coalesce("__was", "__held")) * cost_bps / 1e4
        paid = at.withColumn("daily_return", F.coalesce(F.col("__held") * F.col(ret) - cost, F.lit(0.0))).drop("__held", "__was").withColumn("__step", 1 + F.col("daily_return"))
        return scan(paid, part, "d", {"equity": ("product", "__step")}, ranges).drop("__step")
    w = ordered(part, "d")
    held, was = F.lag(position).over(w), F.lag(position, 2).over(w)
    cost = F.abs(held - F.coalesce(was, held)) * cost_bps / 1e4
    out = df.withColumn("daily_return", F.coalesce(held * F.col(ret) - cost, F.lit(0.0)))
    return out.withColumn("equity", F.product(1 + F.col("daily_return")).over(upto(part, "d")))


def vol_target(n: int, target: float, cap: float, part: Sequence[str]) -> Column:
    """target / volatility within [0, cap]; the cap while there is no volatility."""
    v = rolling_vol(n, part)
    return F.when(v <= 0, F.lit(float(cap))).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), F.try_divide(F.lit(float(target)), v))))
