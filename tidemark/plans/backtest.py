"""The hazard backtest as queries over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fx
from .. import sources as src
from ..operators import panel as pn
from ..operators import series as ts
from ..storage import new_path
from .basic import LAMBDAS, WEIGHTS, R, case_of, lookup, query, ret_query

KEY = ["symbol"]
VOL = dict(n=21, target=0.12, cap=1.0)


def _strategies(v, target: float = VOL["target"], cost_bps: float = 5.0):
    """Daily rows of buy and hold and of volatility targeting for every symbol, with the day's rate."""
    r = ts.with_returns(v("px"), KEY)
    r = r.withColumn("vol_target", ts.vol_target(VOL["n"], target, VOL["cap"], KEY)).withColumn("hold", F.lit(1.0))
    rows = r.select("symbol", "d", "ret", F.explode(F.create_map(F.lit("hold"), F.col("hold"), F.lit("vol_target"), F.col("vol_target"))).alias("strategy", "position"))
    rate = ts.asof(v("mkt").select("d"), v("rates"), "d", "d", ["annual_rate"]).select("d", F.coalesce("annual_rate", F.lit(0.0431)).alias("annual_rate"))
    return ts.simulate(rows.join(rate, "d"), ["symbol", "strategy"], cost_bps)


_STRAT = """,
pos AS (SELECT symbol, d, ret, idx, 1.0::DOUBLE AS hold, CASE WHEN vol <= 0 THEN 1.0 ELSE greatest(0, least(1.0, 0.12 / vol)) END AS vt FROM (SELECT *, CASE WHEN idx >= 21 THEN coalesce(stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY d ROWS 20 PRECEDING), 0) * sqrt(252) ELSE 0 END AS vol FROM ret)),
st AS (SELECT symbol, 'hold' AS strategy, d, ret, hold AS position FROM pos UNION ALL SELECT symbol, 'vol_target', d, ret, vt FROM pos),
dr AS (SELECT *, coalesce(lag(position) OVER w * ret - abs(lag(position) OVER w - coalesce(lag(position, 2) OVER w, lag(position) OVER w)) * 0.0005, 0) AS daily_return, row_number() OVER w AS i FROM st WINDOW w AS (PARTITION BY symbol, strategy ORDER BY d)),
eq AS (SELECT *, product(1 + daily_return) OVER (PARTITION BY symbol, strategy ORDER BY d) AS equity FROM dr),
daily AS (SELECT e.*, coalesce(r.annual_rate, 0.0431) AS annual_rate FROM eq e ASOF LEFT JOIN rates r ON e.d >= r.d)"""
_SUMMARY = """,
x AS (SELECT *, daily_return - (power(1 + annual_rate, 1.0 / 252) - 1) AS ex, equity / max(equity) OVER w - 1 AS dd, count(*) OVER (PARTITION BY symbol, strategy) AS n,
        row_number() OVER (PARTITION BY symbol, strategy ORDER BY (i = 1), daily_return, d) AS worst,
        row_number() OVER w - row_number() OVER (PARTITION BY symbol, strategy, position <= 0.1 ORDER BY d) AS g FROM daily WINDOW w AS (PARTITION BY symbol, strategy ORDER BY d)),
mo AS (SELECT symbol, strategy, min(e / p - 1) AS ddm FROM (SELECT symbol, strategy, e, max(e) OVER (PARTITION BY symbol, strategy ORDER BY m) AS p FROM (SELECT symbol, strategy, date_trunc('month', d) AS m, arg_max(equity, d) AS e FROM daily GROUP BY ALL)) GROUP BY ALL),
rn AS (SELECT symbol, strategy, max(c) AS run, sum(c) AS days FROM (SELECT symbol, strategy, g, count(*) AS c FROM x WHERE position <= 0.1 GROUP BY ALL) GROUP BY ALL),
a AS (SELECT symbol, strategy, arg_max(equity, d) AS last, max(n) AS n, coalesce(stddev_samp(daily_return) FILTER (WHERE i > 1), 0) AS sd, avg(daily_return) FILTER (WHERE i > 1) AS mean, avg(ex) FILTER (WHERE i > 1) AS mex,
        sqrt(avg(power(least(ex, 0), 2)) FILTER (WHERE i > 1)) AS down, coalesce(avg(daily_return) FILTER (WHERE i > 1 AND worst <= greatest(1, ceil(0.05 * (n - 1)))), 0) AS cvar, min(dd) AS dd, avg(position) AS pos FROM x GROUP BY ALL),
s AS (SELECT a.symbol, a.strategy, last - 1 AS total_return, power(last, 252.0 / greatest(n - 1, 1)) - 1 AS cagr, sd * sqrt(252) AS volatility, coalesce(mean * 252 / nullif(sd * sqrt(252), 0), 0) AS sharpe, down * sqrt(252) AS downside_deviation,
        coalesce(mex * 252 / nullif(down * sqrt(252), 0), 0) AS sortino, cvar AS cvar_95, dd AS max_drawdown, dd AS max_drawdown_daily, ddm AS max_drawdown_monthly, coalesce((power(last, 252.0 / greatest(n - 1, 1)) - 1) / nullif(abs(dd), 0), 0) AS calmar,
        pos AS avg_position, coalesce(rn.days, 0)::BIGINT AS days_idle, coalesce(rn.run, 0)::BIGINT AS longest_idle_run FROM a JOIN mo ON mo.symbol = a.symbol AND mo.strategy = a.strategy LEFT JOIN rn ON rn.symbol = a.symbol AND rn.strategy = a.strategy)"""
_DOUBLES = ("total_return", "cagr", "volatility", "sharpe", "downside_deviation", "sortino", "cvar_95", "max_drawdown", "max_drawdown_daily", "max_drawdown_monthly", "calmar", "avg_position")


def strat_query(sql: str, dates: str = "", summary: bool = True):
    return ret_query(_STRAT.lstrip("\n") + (_SUMMARY if summary else "") + "\n" + sql, ("px", "rates"), dates)


@strat_query(f"SELECT symbol, strategy, d, {R('daily_return', 'daily_return')}, {R('equity', 'equity')} FROM daily", dates="d", summary=False)
def simulate_strategy(v, spark, sf):
    return _strategies(v).select("symbol", "strategy", "d", "daily_return", "equity")


@strat_query(f"SELECT symbol, d, {R('vt', 'position')} FROM pos", dates="d", summary=False)
def vol_target_positions(v, spark, sf):
    return ts.with_returns(v("px"), KEY).select("symbol", "d", ts.vol_target(**VOL, part=KEY).alias("position"))


@strat_query(f"SELECT symbol, strategy, {', '.join(R(c, c) for c in _DOUBLES)}, days_idle, longest_idle_run FROM s")
def performance_summary(v, spark, sf):
    return ts.performance(_strategies(v), ["symbol", "strategy"])


def _summary(v):
    """One row for each strategy: the symbol's name joins the strategy's."""
    return ts.performance(_strategies(v), ["symbol", "strategy"]).withColumn("strategy", F.concat_ws("/", "symbol", "strategy")).drop("symbol")


_LONG = "lg AS (UNPIVOT (SELECT symbol || '/' || strategy AS strategy, " + ", ".join(f"{m}::DOUBLE AS {m}" for m in pn.METRICS) + f" FROM s) ON {', '.join(pn.METRICS)} INTO NAME metric VALUE value)"


@strat_query(f",{_LONG}\nSELECT symbol, metric, {R('max(value) FILTER (WHERE kind = \'hold\')', 'hold')}, {R('max(value) FILTER (WHERE kind = \'vol_target\')', 'vol_target')} FROM (SELECT split_part(strategy, '/', 1) AS symbol, split_part(strategy, '/', 2) AS kind, metric, value FROM lg) GROUP BY symbol, metric")
def metrics_table(v, spark, sf):
    return pn.metrics_table(ts.performance(_strategies(v), ["symbol", "strategy"]), ["hold", "vol_target"], ["symbol"])


_BASE = [("AUTOMOBILE/hold", "cagr", 0.1), ("AUTOMOBILE/hold", "max_drawdown", -0.25), ("AUTOMOBILE/hold", "sharpe", 0.45), ("BUILDING/vol_target", "cagr", 0.09), ("BUILDING/vol_target", "max_drawdown", -0.18)]
_BASE_SQL = "base AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in _BASE) + ") AS b(strategy, name, baseline))"


@strat_query(f""",{_LONG}, {_BASE_SQL}
SELECT lg.strategy, metric, {R('value', 'value')}, {R("CASE WHEN metric <> 'max_drawdown_daily' THEN baseline END", 'baseline')}, {R("CASE WHEN metric <> 'max_drawdown_daily' THEN value - baseline END", 'delta')} FROM lg
LEFT JOIN base b ON b.strategy = lg.strategy AND b.name = CASE WHEN metric = 'max_drawdown_monthly' THEN 'max_drawdown' ELSE metric END WHERE baseline IS NOT NULL OR metric IN ('max_drawdown_daily', 'max_drawdown_monthly')""")
def compare_to_baseline(v, spark, sf):
    return pn.compare_to_baseline(_summary(v), spark.createDataFrame(_BASE, "strategy string, metric string, value double"))


@strat_query(f"SELECT h.symbol, {R('t.cagr - h.cagr', 'cost')} FROM s h JOIN s t ON h.symbol = t.symbol AND h.strategy = 'hold' AND t.strategy = 'vol_target'")
def cost_of_caution(v, spark, sf):
    s = ts.performance(_strategies(v), ["symbol", "strategy"])
    return s.groupBy("symbol").agg((F.max(F.when(F.col("strategy") == "vol_target", F.col("cagr"))) - F.max(F.when(F.col("strategy") == "hold", F.col("cagr")))).alias("cost"))


@strat_query(f"SELECT symbol, strategy, d, {R('position', 'position')}, {R('daily_return', 'daily_return')}, {R('equity', 'equity')}, CASE WHEN strategy = 'vol_target' THEN {R('1 / (1 + position)', 'x').rpartition(' AS ')[0]} END AS stability FROM daily", dates="d", summary=False)
def strategy_series(v, spark, sf):
    rows = _strategies(v).select("symbol", "strategy", "d", "position", "daily_return", "equity")
    plain = rows.where("strategy = 'hold'")
    return plain.unionByName(rows.where("strategy = 'vol_target'").withColumn("stability", 1 / (1 + F.col("position"))), allowMissingColumns=True)


_HAZ = f"sum({case_of(WEIGHTS, 0.0)} * exp(-{case_of(LAMBDAS, 0.1)} * rs * greatest(date_diff('day', d, resolution_date), 1) / 30.0) * greatest(0, least(1, probability * ps)))"
_SCEN = [("lower", 0.5, 0.85), ("base", 1.0, 1.0), ("higher", 1.5, 1.15)]
_SCEN_SQL = "sc AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b}::DOUBLE, {c}::DOUBLE)" for a, b, c in _SCEN) + ") AS s(scenario, rs, ps))"


def _scenarios(spark):
    return spark.createDataFrame(_SCEN, "scenario string, rate_scale double, probability_scale double")


def _signal(v, scenarios=None):
    return pn.hazard_signal(v("mkt").select("d"), v("probs"), lookup(WEIGHTS, 0.0), lookup(LAMBDAS, 0.1), scenarios)


_SIG = f"hz AS (SELECT m.d, coalesce(h.h, 0) AS hazard, 1 / (1 + coalesce(h.h, 0)) AS stability FROM mkt m LEFT JOIN (SELECT d, {_HAZ} AS h FROM (SELECT *, 1.0 AS rs, 1.0 AS ps FROM probs) GROUP BY d) h ON h.d = m.d)"


@query(f",{_SIG}\nSELECT d, {R('hazard', 'hazard')}, {R('stability', 'stability')} FROM hz", ("mkt", "probs"), "d")
def hazard_signal(v, spark, sf):
    return _signal(v)


@query(f""",{_SIG}
SELECT d, threshold, direction, {R('was', 'before')}, {R('stability', 'now')} FROM (SELECT d, stability, was, t AS threshold, CASE WHEN was > t AND t >= stability THEN 'down' WHEN was < t AND t <= stability THEN 'up' END AS direction
FROM (SELECT *, unnest([0.2::DOUBLE, 0.5::DOUBLE, 0.8::DOUBLE]) AS t FROM (SELECT *, lag(stability) OVER (ORDER BY d) AS was FROM hz))) WHERE direction IS NOT NULL""", ("mkt", "probs"), "d")
def threshold_events(v, spark, sf):
    one = _signal(v).withColumn("series", F.lit("all"))
    return ts.crossings(one, ["series"], "stability", (0.2, 0.5, 0.8)).drop("series")


@query(f"SELECT m.d, {R('coalesce(r.annual_rate, 0.0431)', 'annual_rate')}, {R('power(1 + coalesce(r.annual_rate, 0.0431), 1.0 / 252) - 1', 'daily_rate')} FROM mkt m ASOF LEFT JOIN rates r ON m.d >= r.d", ("mkt", "rates"), "d")
def daily_risk_free(v, spark, sf):
    out = ts.asof(v("mkt").select("d"), v("rates"), "d", "d", ["annual_rate"]).select("d", F.coalesce("annual_rate", F.lit(0.0431)).alias("annual_rate"))
    return out.withColumn("daily_rate", fx.daily_rate("annual_rate"))


@query(
    f""",{_SCEN_SQL},
hz AS (SELECT m.d, s.scenario, 1 / (1 + coalesce(h.h, 0)) AS position FROM mkt m CROSS JOIN sc s LEFT JOIN (SELECT d, scenario, {_HAZ} AS h FROM probs, sc GROUP BY ALL) h ON h.d = m.d AND h.scenario = s.scenario),
rt AS (SELECT h.scenario, h.d, h.position, coalesce(adjclose / lag(adjclose) OVER w - 1, 0) AS ret FROM hz h JOIN mkt m ON m.d = h.d WINDOW w AS (PARTITION BY h.scenario ORDER BY h.d)),
dr AS (SELECT *, coalesce(lag(position) OVER w * ret - abs(lag(position) OVER w - coalesce(lag(position, 2) OVER w, lag(position) OVER w)) * 0.0005, 0) AS x FROM rt WINDOW w AS (PARTITION BY scenario ORDER BY d)),
eq AS (SELECT *, product(1 + x) OVER w AS e FROM dr WINDOW w AS (PARTITION BY scenario ORDER BY d)),
dd AS (SELECT *, e / max(e) OVER (PARTITION BY scenario ORDER BY d) - 1 AS dd FROM eq)
SELECT scenario, {R('arg_max(e, d) - 1', 'total_return')}, {R('min(dd)', 'max_drawdown')}, {R('avg(position)', 'avg_position')} FROM dd GROUP BY scenario""",
    ("mkt", "probs"),
)
def scenario_sweep(v, spark, sf):
    signal = _signal(v, _scenarios(spark)).select("d", "scenario", F.col("stability").alias("position"))
    returns = ts.with_returns(v("mkt").withColumn("series", F.lit("mkt")), ["series"]).select("d", "ret", F.lit(0.0431).alias("annual_rate"))
    daily = ts.simulate(signal.join(returns, "d"), ["scenario"])
    return ts.performance(daily, ["scenario"]).select("scenario", "total_return", "max_drawdown", "avg_position")


RESAMPLES, ALL_RESAMPLES, BLOCK, SEED = 50, 10_000, 21, 7


@strat_query(
    f""",nn AS (SELECT symbol, strategy, count(*) AS n FROM daily GROUP BY ALL),
pk AS (SELECT n, b AS resample, k AS block, 1 + ('0x' || substr(md5(concat_ws('|', b, k, {SEED})), 1, 8))::BIGINT % greatest(1, n - {BLOCK}) AS s FROM (SELECT DISTINCT n FROM nn), range({RESAMPLES}) r(b), LATERAL (SELECT unnest(range(CAST(ceil(n / {BLOCK}.0) AS BIGINT))) AS k)),
pos2 AS (SELECT n, resample, block * {BLOCK} + j AS pos, s + j + 1 AS i FROM pk, range({BLOCK}) q(j) WHERE block * {BLOCK} + j < n),
sm AS (SELECT d.symbol, d.strategy, p.resample, p.pos, CASE WHEN p.pos = 0 THEN 0 ELSE d.daily_return END AS r, d.annual_rate FROM pos2 p JOIN nn USING (n) JOIN daily d ON d.symbol = nn.symbol AND d.strategy = nn.strategy AND d.i = p.i),
e2 AS (SELECT *, product(1 + r) OVER (PARTITION BY symbol, strategy, resample ORDER BY pos) AS e, r - (power(1 + annual_rate, 1.0 / 252) - 1) AS ex, count(*) OVER (PARTITION BY symbol, strategy, resample) AS n, row_number() OVER (PARTITION BY symbol, strategy, resample ORDER BY (pos = 0), r, pos) AS worst FROM sm),
d2 AS (SELECT *, e / max(e) OVER (PARTITION BY symbol, strategy, resample ORDER BY pos) - 1 AS dd FROM e2),
m2 AS (SELECT symbol, strategy, resample, power(arg_max(e, pos), 252.0 / greatest(max(n) - 1, 1)) - 1 AS cagr, min(dd) AS max_drawdown, coalesce(avg(r) FILTER (WHERE pos > 0) * 252 / nullif(stddev_samp(r) FILTER (WHERE pos > 0) * sqrt(252), 0), 0) AS sharpe,
   coalesce(avg(ex) FILTER (WHERE pos > 0) * 252 / nullif(sqrt(avg(power(least(ex, 0), 2)) FILTER (WHERE pos > 0)) * sqrt(252), 0), 0) AS sortino, avg(r) FILTER (WHERE pos > 0 AND worst <= greatest(1, ceil(0.05 * (n - 1)))) AS cvar_95 FROM d2 GROUP BY ALL)
SELECT symbol, strategy, metric, {R('quantile_cont(value, 0.025)', 'ci_low')}, {R('quantile_cont(value, 0.975)', 'ci_high')} FROM (UNPIVOT m2 ON cagr, max_drawdown, sharpe, sortino, cvar_95 INTO NAME metric VALUE value) GROUP BY ALL""",
    summary=False,
)
def block_bootstrap_ci(v, spark, sf):
    part = ["symbol", "strategy"]
    return pn.intervals(pn.block_bootstrap(_strategies(v), part, RESAMPLES, BLOCK, SEED), part)


@query()
def block_bootstrap_full(v, spark, sf):
    """The same with ALL_RESAMPLES, whose days are too many for the SQL."""
    part = ["symbol", "strategy"]
    return pn.intervals(pn.block_bootstrap(_strategies(v), part, ALL_RESAMPLES, BLOCK, SEED), part)


@query(
    f"SELECT event_id, d, {R('CASE WHEN d <= peak_date THEN b + (p - b) * u * u * (3 - 2 * u) ELSE p + (t - p) * w * w * (3 - 2 * w) END', 'probability')} FROM (SELECT *, greatest(0, least(1, date_diff('day', start_date, d) / greatest(date_diff('day', start_date, peak_date), 1)::DOUBLE)) AS u, greatest(0, least(1, date_diff('day', peak_date, d) / greatest(date_diff('day', peak_date, end_date), 1)::DOUBLE)) AS w FROM (SELECT *, CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT event_id, min(d) AS start_date, CAST(min(d) + INTERVAL 30 DAY AS DATE) AS peak_date, CAST(min(d) + INTERVAL 90 DAY AS DATE) AS end_date, min(probability) / 2 AS b, max(probability) AS p, min(probability) AS t FROM probs GROUP BY event_id)))",
    ("probs",), "d",
)
def reconstruct_paths(v, spark, sf):
    s = v("probs").groupBy("event_id").agg(F.min("d").alias("start_date"), F.first("category").alias("category"), (F.min("probability") / 2).alias("baseline"), F.max("probability").alias("peak"), F.min("probability").alias("tail"))
    return pn.reconstruct_paths(s.withColumns({"peak_date": F.date_add("start_date", 30), "end_date": F.date_add("start_date", 90)})).select("event_id", "d", "probability")


_PATHS = """sp AS (SELECT market_id, CAST(unnest(generate_series(a - INTERVAL 2 DAY, b, INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT market_id, min(d) AS a, max(d) AS b FROM bets GROUP BY 1)),
lb AS (SELECT market_id, d, max_by(prob_after, (ts, bet_id)) AS p FROM bets GROUP BY 1, 2), sd AS (SELECT market_id, min_by(prob_after, (ts, bet_id)) AS seed FROM bets GROUP BY 1),
mp AS (SELECT s.market_id, s.d, coalesce(b.p, sd.seed) AS probability FROM sp s JOIN sd ON sd.market_id = s.market_id ASOF LEFT JOIN lb b ON s.market_id = b.market_id AND s.d >= b.d)"""


def _market_paths(v):
    bets = v("bets").withColumn("prob_before", F.lit(None).cast("double"))
    markets = bets.groupBy("market_id").agg(F.date_sub(F.min("d"), 2).alias("start_d"), F.max("d").alias("end_d"))
    return pn.market_paths(markets, bets)


@query(f",{_PATHS}\nSELECT market_id, d, {R('probability', 'probability')} FROM mp", ("bets",), "d")
def market_paths(v, spark, sf):
    return _market_paths(v)


@query(f",{_PATHS}\nSELECT 'market-' || market_id::VARCHAR AS event_id, d, {R('probability', 'probability')}, 'market' AS source FROM mp UNION ALL SELECT 'panel-' || event_id::VARCHAR, d, {R('probability', 'p').rpartition(' AS ')[0]}, lower(source) FROM probs ORDER BY 2, 1, 4", ("bets", "probs"), "d")
def event_panel(v, spark, sf):
    a = _market_paths(v).select(F.concat(F.lit("market-"), F.col("market_id").cast("string")).alias("event_id"), "d", "probability", F.lit("market").alias("source"))
    b = v("probs").select(F.concat(F.lit("panel-"), F.col("event_id").cast("string")).alias("event_id"), "d", "probability", F.lower("source").alias("source"))
    return a.unionByName(b).orderBy("d", "event_id", "source")


@query(f"SELECT d, event_id, {R('sum(probability / source_brier) / sum(1 / source_brier)', 'probability')}, min(source) AS source, arg_min(category, source) AS category, arg_min(outcome, source) AS outcome FROM probs GROUP BY d, event_id", ("probs",), "d")
def pool_probabilities(v, spark, sf):
    return pn.pool(v("probs")).select("d", "event_id", "probability", "source", "category", "outcome")


@query("SELECT event_id, category, d, source, resolution_date FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, source) AS k FROM probs) WHERE k = 1", ("probs",), "d resolution_date")
def event_metadata(v, spark, sf):
    return pn.metadata(v("probs")).select("event_id", "category", "d", "source", "resolution_date")


@query(f""",l AS (SELECT event_id, lower(source) AS source, power(probability - CASE WHEN outcome = 'YES' THEN 1 ELSE 0 END, 2) AS e FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d DESC, source DESC) AS k FROM probs) WHERE k = 1)
SELECT source AS forecast_source, {R('avg(e)', 'mean_brier')}, count(*) AS n FROM l GROUP BY source UNION ALL SELECT 'overall', {R('avg(e)', 'x').rpartition(' AS ')[0]}, count(*) FROM l UNION ALL SELECT 'constant', 0.25, count(*) FROM l""", ("probs",))
def brier_summary(v, spark, sf):
    return pn.brier_summary(v("probs"))


@query(
    f""",{_SIG},
dl AS (SELECT m.d, coalesce(m.adjclose / lag(m.adjclose) OVER w - 1, 0) AS ret, z.stability, row_number() OVER w - 1 AS idx, lag(z.stability) OVER w AS held FROM mkt m JOIN hz z ON z.d = m.d WINDOW w AS (ORDER BY m.d)),
fw AS (SELECT *, coalesce(product(1 + ret) OVER f, 1) - 1 AS hold, coalesce(product(1 + coalesce(held, 0) * ret) OVER f, 1) - 1 AS strategy FROM dl WINDOW f AS (ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
ev AS (SELECT event_id, max(resolution_date) - INTERVAL 200 DAY AS event_date FROM probs GROUP BY 1),
pp AS (SELECT event_id, d, sum(probability / source_brier) / sum(1 / source_brier) AS p FROM probs GROUP BY 1, 2),
sn AS (SELECT e.event_id, max(p.p) AS peak, min(n.stability) AS low FROM ev e JOIN fw c ON c.d = e.event_date JOIN fw n ON n.idx BETWEEN c.idx - 5 AND c.idx + 5 JOIN pp p ON p.event_id = e.event_id AND p.d = n.d GROUP BY 1)
SELECT e.event_id, CAST(e.event_date AS DATE) AS event_date, {R('coalesce(peak, 0)', 'peak_probability')}, {R('coalesce(low, 1)', 'lowest_stability')}, {R('hold', 'hold')}, {R('strategy', 'strategy')}, {R('hold - strategy', 'avoided')}, {R('coalesce(low, 1) - 1', 'position_cut')} FROM ev e JOIN fw c ON c.d = e.event_date LEFT JOIN sn ON sn.event_id = e.event_id""",
    ("mkt", "probs"), "event_date",
)
def event_windows(v, spark, sf):
    signal = _signal(v)
    daily = ts.with_returns(v("mkt").withColumn("series", F.lit("mkt")), ["series"]).join(signal, "d").select("d", "ret", "stability", F.col("stability").alias("position"))
    seeds = v("probs").groupBy("event_id").agg(F.date_sub(F.max("resolution_date"), 200).alias("event_date"))
    return pn.event_windows(seeds, daily, pn.pool(v("probs")), buckets=None)


#: What an earlier run was made with, and the metrics that its summary has.
EARLIER = dict(target=0.08, cost_bps=10.0)
_STORED = [m for m in pn.METRICS if m not in ("calmar", "max_drawdown_daily", "max_drawdown_monthly")]


def earlier_run(v, spark):
    """Paths of the summary and the curves of an earlier run, as it stored them."""
    rows = v.once("earlier", lambda: _strategies(v, **EARLIER).withColumn("strategy", F.concat_ws("/", "symbol", "strategy")))
    summary = ts.performance(rows, ["strategy"]).select("strategy", *[F.col(m).cast("double").alias(m) for m in (*_STORED, "max_drawdown")])
    paths = new_path(spark), new_path(spark)
    src.write_summary(summary.unpivot("strategy", [*_STORED, "max_drawdown"], "metric", "value"), paths[0])
    src.write_csv(rows.select("symbol", "strategy", "d", "position", "daily_return", "equity"), paths[1])
    return paths


_COST = "SELECT t.symbol || '/vol_target' AS strategy, 'cost_of_caution' AS metric, t.cagr - h.cagr AS value FROM s t JOIN s h ON h.symbol = t.symbol WHERE t.strategy = 'vol_target' AND h.strategy = 'hold'"
_EARLIER_STRAT = _STRAT.replace("0.12 / vol", "0.08 / vol").replace("* 0.0005", "* 0.001").lstrip("\n,")
_EARLIER_SQL = f"prv AS (WITH {_EARLIER_STRAT}{_SUMMARY}, {_LONG} SELECT strategy, metric, value FROM lg WHERE metric <> 'calmar' UNION ALL SELECT strategy, 'max_drawdown', value FROM lg WHERE metric = 'max_drawdown_daily' UNION ALL {_COST})"


@strat_query(f""",{_LONG}, {_BASE_SQL}, {_EARLIER_SQL},
cur AS (SELECT strategy, metric, value FROM lg UNION ALL {_COST})
SELECT coalesce(p.strategy, c.strategy, b.strategy) AS strategy, coalesce(p.metric, c.metric, b.name) AS metric, {R('p.value', 'previous')}, {R('c.value', 'current')}, {R('b.baseline', 'baseline')}, {R('c.value - p.value', 'delta_previous')}, {R('c.value - b.baseline', 'delta_baseline')}
FROM prv p FULL OUTER JOIN cur c ON p.strategy = c.strategy AND p.metric = c.metric FULL OUTER JOIN base b ON coalesce(p.strategy, c.strategy) = b.strategy AND coalesce(p.metric, c.metric) = b.name""")
def run_comparison(v, spark, sf):
    summary, curves = earlier_run(v, spark)
    previous = pn.stored_run(src.read_summary(spark, summary), src.read_curves(spark, curves))
    now = v.once("summary", lambda: _summary(v)).select("strategy", *[F.col(m).cast("double").alias(m) for m in pn.METRICS]).unpivot("strategy", list(pn.METRICS), "metric", "value")
    current = now.unionByName(pn.growth_lost(now, "hold"))
    return pn.run_comparison(previous, current, spark.createDataFrame(_BASE, "strategy string, metric string, value double"))


@strat_query(f""",{_EARLIER_SQL},
cu AS (WITH {_EARLIER_STRAT} SELECT symbol || '/' || strategy AS strategy, count(*) AS days FROM daily GROUP BY 1)
SELECT prv.strategy, metric, {R('value', 'value')}, days FROM prv JOIN cu ON cu.strategy = prv.strategy""", summary=False)
def scan_prior_run(v, spark, sf):
    summary, curves = (f(spark, p) for f, p in zip((src.read_summary, src.read_curves), earlier_run(v, spark), strict=True))
    return pn.stored_run(summary, curves).join(curves.groupBy("strategy").agg(F.count("*").alias("days")), "strategy")
