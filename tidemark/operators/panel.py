"""Event-probability panels, exposure signals, strategies and their evaluation."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fx
from . import series as ts

METRICS = ("cagr", "total_return", "volatility", "max_drawdown_daily", "max_drawdown_monthly", "downside_deviation", "cvar_95", "sharpe", "sortino", "calmar", "avg_position", "days_idle", "longest_idle_run")
#: Look-up tables of at most this many rows are broadcast; longer ones are left to the optimizer.
SMALL = 10_000


def small(df: DataFrame) -> DataFrame:
    """df, broadcast if it is proven to be short."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def hazard_signal(days: DataFrame, probs: DataFrame, weight: Column, rate: Column, scenarios: DataFrame | None = None, norm: float = 30.0) -> DataFrame:
    """hazard and stability for each day (and scenario: name, rate_scale, probability_scale): the sum over
    the day's events of weight * exp(-rate * days to resolution, 1 at least, / norm) * probability in
    [0, 1]; stability = 1 / (1 + hazard). A day without events has hazard 0, stability 1.
    Events are summed by day before the join, so the calendar meets one row for each day."""
    left = F.datediff("resolution_date", "d")
    rows, keys = probs.select("d", F.col("probability").alias("p"), weight.alias("w"), rate.alias("r"), left.alias("left")), ["d"]
    scale_r, scale_p = F.lit(1.0), F.lit(1.0)
    if scenarios is not None:
        rows, days, keys = rows.crossJoin(F.broadcast(scenarios)), days.crossJoin(F.broadcast(scenarios.select("scenario"))), ["d", "scenario"]  # scenarios: a parameter list
        scale_r, scale_p = F.col("rate_scale"), F.col("probability_scale")
    sums = rows.groupBy(*keys).agg(F.sum(F.col("w") * fx.decay(F.col("r") * scale_r, F.col("left"), norm) * fx.clamp(F.col("p") * scale_p, 0, 1)).alias("hazard"))
    out = days.join(sums, keys, "left").withColumn("hazard", F.coalesce("hazard", F.lit(0.0)))
    return out.withColumn("stability", 1 / (1 + F.col("hazard")))


def pool(panel: DataFrame) -> DataFrame:
    """One row for each (d, event_id): probability averaged with weights 1 / brier (0.25 if unknown,
    1e-6 at least), the other columns from the first source."""
    w = 1 / F.greatest(F.coalesce("source_brier", F.lit(0.25)), F.lit(1e-6))
    rest = [c for c in panel.columns if c not in ("d", "event_id", "probability", "source_brier")]
    agg = panel.groupBy("d", "event_id").agg((F.sum(F.col("probability") * w) / F.sum(w)).alias("probability"), F.min_by(F.struct(*rest), F.col("source")).alias("first"))
    return agg.select("d", "event_id", "probability", "first.*")


def metadata(panel: DataFrame) -> DataFrame:
    """The first row, by day and source, of each event."""
    rest = [c for c in panel.columns if c != "event_id"]
    return panel.groupBy("event_id").agg(F.min_by(F.struct(*rest), F.struct("d", "source")).alias("first")).select("event_id", "first.*")


def reconstruct_paths(seeds: DataFrame) -> DataFrame:
    """A daily probability from start to end: smooth from baseline to peak up to the peak's day, then to
    the tail; spans are one day at least; 6 decimals."""
    days = seeds.withColumn("d", F.explode(F.sequence("start_date", "end_date")))
    up = fx.smoothstep(F.datediff("d", "start_date") / F.greatest(F.datediff("peak_date", "start_date"), F.lit(1)))
    down = fx.smoothstep(F.datediff("d", "peak_date") / F.greatest(F.datediff("end_date", "peak_date"), F.lit(1)))
    rise = F.col("baseline") + (F.col("peak") - F.col("baseline")) * up
    fall = F.col("peak") + (F.col("tail") - F.col("peak")) * down
    return days.select("event_id", "category", "d", F.round(F.when(F.col("d") <= F.col("peak_date"), rise).otherwise(fall), 6).alias("probability"))


def market_paths(markets: DataFrame, bets: DataFrame) -> DataFrame:
    """Daily probability of each market (market_id, start_d, end_d) from its bets (market_id, ts, bet_id,
    prob_before, prob_after): the last bet of a day or of an earlier one, before any the first bet's
    prob_before, else its prob_after, else 0.5. A bet without prob_after changes nothing; a market
    without bets or days has no path."""
    first = bets.groupBy("market_id").agg(F.min_by(F.coalesce("prob_before", "prob_after", F.lit(0.5)), F.struct("ts", "bet_id")).alias("seed"))
    daily = bets.where("prob_after IS NOT NULL").groupBy("market_id", F.to_date("ts").alias("d")).agg(F.max_by("prob_after", F.struct("ts", "bet_id")).alias("p"))
    days = markets.where("start_d <= end_d").join(first, "market_id").select("market_id", "seed", F.explode(F.sequence("start_d", "end_d")).alias("d"))
    return ts.asof(days, daily, "d", "d", ["p"], ["market_id"]).select("market_id", "d", F.coalesce("p", "seed").alias("probability"))


def brier_summary(panel: DataFrame) -> DataFrame:
    """Mean squared error of each event's last probability, outcome YES counting 1: a constant 0.25,
    overall, and by source in lower case."""
    last = panel.groupBy("event_id").agg(F.max_by(F.struct("probability", "outcome", "source"), F.struct("d", "source")).alias("x")).select("x.*")
    err = last.select(F.lower("source").alias("source"), F.pow(F.col("probability") - (F.col("outcome") == "YES").cast("double"), 2).alias("e"))
    levels = err.groupingSets([["source"], []], "source").agg(F.avg("e").alias("mean_brier"), F.count("*").alias("n"), F.grouping_id().alias("g"))
    named = levels.select(F.when(F.col("g") == 1, "overall").otherwise(F.col("source")).alias("forecast_source"), "mean_brier", "n")
    return named.unionByName(err.agg(F.count("*").alias("n")).select(F.lit("constant").alias("forecast_source"), F.lit(0.25).alias("mean_brier"), "n"))


def metrics_table(summary: DataFrame, strategies: Sequence[str], part: Sequence[str] = ()) -> DataFrame:
    """A row for each metric (and key of part), a column for each strategy of the list."""
    rows = summary.select(*part, "strategy", *[F.col(m).cast("double").alias(m) for m in METRICS]).unpivot([*part, "strategy"], list(METRICS), "metric", "value")
    return rows.groupBy(*part, "metric").pivot("strategy", list(strategies)).agg(F.max("value"))


def compare_to_baseline(summary: DataFrame, baseline: DataFrame) -> DataFrame:
    """strategy, metric, value, baseline, delta. The monthly drawdown is held against the baseline's
    max_drawdown, the daily one against nothing; other metrics only if the baseline has them."""
    rows = summary.select("strategy", *[F.col(m).cast("double").alias(m) for m in METRICS]).unpivot("strategy", list(METRICS), "metric", "value")
    rows = rows.withColumn("name", F.when(F.col("metric") == "max_drawdown_monthly", "max_drawdown").otherwise(F.col("metric")))
    out = rows.join(small(baseline.select("strategy", F.col("metric").alias("name"), F.col("value").alias("baseline"))), ["strategy", "name"], "left")
    out = out.where(F.col("baseline").isNotNull() | F.col("metric").isin("max_drawdown_daily", "max_drawdown_monthly"))
    base = F.when(F.col("metric") != "max_drawdown_daily", F.col("baseline"))
    return out.select("strategy", "metric", "value", base.alias("baseline"), (F.col("value") - base).alias("delta"))


def draw(*parts: Column | str | int) -> Column:
    """A number below 2^32 drawn by the md5 of the parts."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


#: Resamples of one series that a task makes at once.
CHUNK = 250


def _starts(resamples: range, n: int, block: int, seed: int) -> np.ndarray:
    """Where the blocks of each resample of a series of n days start; the draws of `draw`."""
    size, width = min(block, n - 1), max(1, n - block)
    return np.array([[1 + int(hashlib.md5(f"{r}|{k}|{seed}".encode()).hexdigest()[:8], 16) % width for k in range(-(-n // size))] for r in resamples])


def _blocks(r: np.ndarray, over: np.ndarray) -> dict[str, np.ndarray]:
    """Summaries of blocks (rows): product, peak and least of the running product, least fall from its peak, sums of
    the returns, their squares, the excess over the rate and the squares of its falls. Two that follow
    one another have a summary made of theirs."""
    run = np.cumprod(1 + r, axis=1)
    return {"product": run[:, -1], "peak": run.max(1), "low": run.min(1), "fall": (run / np.maximum.accumulate(run, axis=1)).min(1), "sum": r.sum(1), "squares": (r * r).sum(1), "excess": over.sum(1), "down": (np.minimum(over, 0) ** 2).sum(1)}


def resampled(r: np.ndarray, over: np.ndarray, starts: np.ndarray, block: int) -> dict[str, np.ndarray]:
    """Metrics of the resamples (rows of starts) of a series of returns and excess returns: blocks are summed up once
    for each start, a resample merges its blocks' summaries in order. The worst days are found among the days
    of some resamples at a time."""
    n, size = len(r), min(block, len(r) - 1)
    last = n - (starts.shape[1] - 1) * size  # days of the last block
    view = np.lib.stride_tricks.sliding_window_view
    rows, over_rows = view(r, size), view(over, size)
    first_r, first_over = rows.copy(), over_rows.copy()
    first_r[:, 0] = first_over[:, 0] = 0.0  # the first day earns nothing and is left out of all means
    each, first, end = _blocks(rows, over_rows), _blocks(first_r, first_over), _blocks(view(r, last), view(over, last))
    total = {k: v[starts[:, 0]] for k, v in first.items()}
    for k in range(1, starts.shape[1]):
        part = {name: v[starts[:, k]] for name, v in (end if k == starts.shape[1] - 1 else each).items()}
        total["fall"] = np.minimum(np.minimum(total["fall"], part["fall"]), total["product"] * part["low"] / total["peak"])
        total["peak"] = np.maximum(total["peak"], total["product"] * part["peak"])
        total["product"] = total["product"] * part["product"]
        for name in ("sum", "squares", "excess", "down"):
            total[name] = total[name] + part[name]
    m, year = n - 1, ts.TRADING_DAYS
    worst, tail = max(1, math.ceil(0.05 * m)), np.empty(len(starts))
    for at in range(0, len(starts), 32):
        days = (starts[at : at + 32, :, None] + np.arange(size)).reshape(-1, starts.shape[1] * size)[:, 1:n]
        tail[at : at + 32] = np.partition(r[days], worst - 1, axis=1)[:, :worst].mean(1)
    mean = total["sum"] / m
    spread = np.sqrt(np.maximum(total["squares"] - m * mean * mean, 0) / (m - 1)) if m > 1 else np.zeros(len(starts))
    down = np.sqrt(total["down"] / m)
    ratio = lambda a, b: np.divide(a * year, b * math.sqrt(year), out=np.zeros(len(starts)), where=b > 0)
    return {"cagr": total["product"] ** (year / max(m, 1)) - 1, "max_drawdown": total["fall"] - 1, "sharpe": ratio(mean, spread), "sortino": ratio(total["excess"] / m, down), "cvar_95": tail}


def block_bootstrap(daily: DataFrame, part: Sequence[str], resamples: int, block: int = 21, seed: int = 1, rate: str = "annual_rate") -> DataFrame:
    """Block resamples of daily returns (part, d, daily_return, yearly rate): metrics of each resample. All series of
    one length share the draws. Blocks start on 1..max(1, n - block) and are cut at the end of the series; as many
    as fill n; the first day earns 0. Series of one day have no resamples; NULL returns count as 0, NULL rates too.

    A series goes as one row of arrays to the tasks that make CHUNK of its resamples each, so that rows are series
    x chunks, never resample x day; a series, of one day's rows each, must fit a task."""
    free = F.coalesce(F.pow(1 + F.col(rate), F.lit(1.0 / ts.TRADING_DAYS)) - 1, F.lit(0.0))
    one = daily.groupBy(*part).agg(F.sort_array(F.collect_list(F.struct("d", F.coalesce("daily_return", F.lit(0.0)).alias("r"), free.alias("free")))).alias("rows")).where(F.size("rows") > 1)
    one = one.select(*part, F.col("rows.r").alias("r"), F.col("rows.free").alias("free"), F.size("rows").alias("n"))
    work = one.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(-(-resamples // CHUNK) - 1)))).repartition("n", "chunk")
    metrics = ("cagr", "max_drawdown", "sharpe", "sortino", "cvar_95")
    schema = T.StructType([*[work.schema[p] for p in part], T.StructField("resample", T.LongType()), *[T.StructField(m, T.DoubleType()) for m in metrics]])

    def run(it):
        held, starts = None, None
        for b in it:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                r, free_ = (row[c][0].values.to_numpy() for c in ("r", "free"))
                n, chunk = len(r), row["chunk"][0].as_py()
                ids = range(chunk * CHUNK, min(resamples, (chunk + 1) * CHUNK))
                if held != (n, chunk):
                    held, starts = (n, chunk), _starts(ids, n, block, seed)
                found = resampled(r, r - free_, starts, block)
                yield pa.RecordBatch.from_arrays([*[pa.repeat(row[p][0], len(ids)) for p in part], pa.array(ids, pa.int64()), *[pa.array(found[m]) for m in metrics]], schema.names)

    return work.mapInArrow(run, schema)


def intervals(draws: DataFrame, part: Sequence[str], metrics: Sequence[str] = ("cagr", "max_drawdown", "sharpe", "sortino", "cvar_95")) -> DataFrame:
    long = draws.unpivot([*part, "resample"], list(metrics), "metric", "value")
    return long.groupBy(*part, "metric").agg(F.percentile("value", 0.025).alias("ci_low"), F.percentile("value", 0.975).alias("ci_high"))


#: Kinds of events whose windows are looked at.
BUCKETS = ("drawdown", "false_positive")


def event_windows(seeds: DataFrame, daily: DataFrame, probs: DataFrame, reach: int = 5, buckets: Sequence[str] | None = BUCKETS) -> DataFrame:
    """With buckets, only seeds whose analysis_bucket is one of them count. For each seed (event_id, event_date) on a trading day of daily (d, ret, position, stability): the
    event's highest probability and the lowest stability within `reach` trading days where it has a row
    (0 and 1 without any), the compound return of holding and of the strategy (position of the day
    before) over the next `reach` days, their difference, and position_cut = low - 1."""
    w = Window.orderBy("d")  # a calendar
    cal = daily.select("d", "ret", "stability", (F.row_number().over(w) - 1).alias("idx"), F.lag("position").over(w).alias("held"))
    ahead = w.rowsBetween(1, reach)
    cal = cal.withColumns({"hold": F.coalesce(F.product(1 + F.col("ret")).over(ahead), F.lit(1.0)) - 1, "strategy": F.coalesce(F.product(1 + F.coalesce("held", F.lit(0.0)) * F.col("ret")).over(ahead), F.lit(1.0)) - 1})
    if buckets is not None:
        seeds = seeds.where(F.col("analysis_bucket").isin(*buckets))
    at = seeds.join(small(cal.select(F.col("d").alias("event_date"), F.col("idx").alias("i"), "hold", "strategy")), "event_date")
    near = at.select("event_id", F.col("i"), F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("o")).withColumn("idx", F.col("i") + F.col("o")).join(small(cal.select("idx", "d", "stability")), "idx")
    seen = near.join(probs.select("event_id", "d", "probability"), ["event_id", "d"]).groupBy("event_id").agg(F.max("probability").alias("peak"), F.min("stability").alias("low"))
    out = at.join(seen, "event_id", "left")
    low = F.coalesce("low", F.lit(1.0))
    return out.select("event_id", "event_date", F.coalesce("peak", F.lit(0.0)).alias("peak_probability"), low.alias("lowest_stability"), "hold", "strategy", (F.col("hold") - F.col("strategy")).alias("avoided"), (low - 1).alias("position_cut"))


def monthly_drawdown(curves: DataFrame, part: Sequence[str]) -> DataFrame:
    """Least fall of the last equity of each month from the highest before it or its own, for each key."""
    ends = curves.groupBy(*part, F.trunc("d", "month").alias("month")).agg(F.max_by("equity", "d").alias("equity"))
    return ends.withColumn("fall", ts.drawdown("equity", part, "month")).groupBy(*part).agg(F.min("fall").alias("value"))


def growth_lost(metrics: DataFrame, hold: str) -> DataFrame:
    """cost_of_caution: a strategy's cagr less that of the strategy `hold` of the same name before the last slash."""
    growth = metrics.where("metric = 'cagr'").withColumn("base", F.regexp_replace("strategy", "[^/]+$", hold))
    held = growth.where("strategy = base").select("base", F.col("value").alias("held"))
    return growth.where("strategy <> base").join(held, "base").select("strategy", F.lit("cost_of_caution").alias("metric"), (F.col("value") - F.col("held")).alias("value"))


def stored_run(summary: DataFrame, curves: DataFrame, hold: str = "hold") -> DataFrame:
    """An earlier run (strategy, metric, value) as comparisons need it, from its stored summary and curves (strategy,
    d, equity): the stored max_drawdown is the daily one and the monthly one is made from the curve, for strategies
    that have both; cost_of_caution is made where it is missing."""
    had = summary.join(curves.select("strategy").distinct(), "strategy", "left_semi")
    daily = had.where("metric = 'max_drawdown'").select("strategy", F.lit("max_drawdown_daily").alias("metric"), "value")
    monthly = monthly_drawdown(curves, ["strategy"]).join(had.select("strategy").distinct(), "strategy", "left_semi").select("strategy", F.lit("max_drawdown_monthly").alias("metric"), "value")
    kept = summary.join(daily.select("strategy", "metric").unionByName(monthly.select("strategy", "metric")), ["strategy", "metric"], "left_anti")
    lost = growth_lost(summary, hold).join(summary.where("metric = 'cost_of_caution'").select("strategy"), "strategy", "left_anti")
    return kept.select("strategy", "metric", "value").unionByName(daily).unionByName(monthly).unionByName(lost)


def run_comparison(previous: DataFrame, current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Three tables (strategy, metric, value) side by side with differences; rows without any value go."""
    p, c, b = (x.select("strategy", "metric", F.col("value").alias(n)) for x, n in ((previous, "previous"), (current, "current"), (baseline, "baseline")))
    out = p.join(c, ["strategy", "metric"], "full_outer").join(b, ["strategy", "metric"], "full_outer")
    out = out.where("previous IS NOT NULL OR current IS NOT NULL OR baseline IS NOT NULL")
    return out.select("*", (F.col("current") - F.col("previous")).alias("delta_previous"), (F.col("current") - F.col("baseline")).alias("delta_baseline"))
