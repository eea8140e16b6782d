"""The announcement study as queries over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fx
from ..operators import series as ts
from ..operators import stats as st
from ..operators import study as sd
from ..operators.panel import small
from ..storage import cut
from .basic import KEY, R, error_terms, query, ret_query, simple_ols

START = "1995-01-01"
HORIZONS = (1, 2, 3, 5, 10, 20, 40, 60, 90, 120)
GROUPS = {"buyback": ["the", "der"], "dividend": ["que"], "split": ["was"], "internal_reallocation": ["with"]}
POSITIVE, NEGATIVE = ["the", "le", "der"], ["and", "und", "que"]


def _day(s: str):
    return F.lit(s).cast("date")


def _market(v):
    made = lambda: ts.with_returns(v("mkt").withColumn("series", F.lit("m")), ["series"]).select("d", "idx", "ret", "adjclose", ts.momentum(20, ["series"]).alias("state"))
    return v.once("market", made)


def _returns(v):
    return v.once("returns", lambda: ts.with_returns(v("px"), KEY))


def _ledger_rows(v):
    return v.once("ledger", lambda: v("ledger"))


def _events(v):
    """Ledger with t0, the as-of day before it, and the firm's variant."""
    return v.once("events", lambda: _make_events(v))


def _make_events(v):
    ts_col = F.expr("cast(announced as timestamp) + make_interval(0, 0, 0, 0, cast(hour as int), 0, 0)")
    market = _market(v)
    at = sd.map_to_trading_day(_ledger_rows(v).withColumn("ts", ts_col), market)
    prior = market.select((F.col("idx") + 1).alias("t0_idx"), F.col("d").alias("asof"), "state")
    return at.join(small(prior), "t0_idx", "left").join(small(v("firms").select("ticker", "variant")), "ticker", "left")


def _by_day(v):
    """Sector and VIX as of every day of the market or of a stock; as long as a calendar."""
    days = _returns(v).select("d").union(_market(v).select("d")).distinct()
    of = lambda df, name: ts.asof(df, v(name).select("d", F.col("adjclose").alias(name)), "d", "d", [name]).drop("asof_time")
    return v.once("by_day", lambda: of(of(days, "sector"), "vix"))


def _facts(v):
    return v.once("facts", lambda: sd.resolve_tags(v("raw_facts")))


_FACTS = f"""
facts AS (SELECT symbol, concept AS tag, tag AS source_tag, unit, start_d, end_d, filed, val FROM (SELECT r.*, p.concept, dense_rank() OVER (PARTITION BY symbol, concept ORDER BY place, unit_no) AS k FROM raw_facts r JOIN (VALUES {", ".join(f"('{c}', '{x}', '{t}', {i})" for c, (x, tags) in sd.CONCEPTS.items() for i, t in enumerate(tags))}) p(concept, taxonomy, tag, place) ON r.taxonomy = p.taxonomy AND r.tag = p.tag) WHERE k = 1)"""


@query(f",{_FACTS}\nSELECT DISTINCT symbol, tag, source_tag, unit FROM facts", ("raw_facts",))
def arr_tag_preference(v, spark, sf):
    return _facts(v).select("symbol", "tag", "source_tag", "unit").distinct()


_EV = """
mk AS (SELECT d, adjclose, coalesce(adjclose / lag(adjclose) OVER w - 1, 0) AS ret, row_number() OVER w - 1 AS idx, adjclose / lag(adjclose, 20) OVER w - 1 AS state FROM mkt WINDOW w AS (ORDER BY d)),
tg AS (SELECT l.*, CAST(CAST(x AS DATE) + CAST(hour(x) >= 16 AS INTEGER) AS DATE) AS target FROM (SELECT *, timezone('America/New_York', timezone('UTC', announced + to_hours(hour))) AS x FROM ledger) l),
ev AS (SELECT t.event_id, t.ticker, t.announced, t.amount, m.d AS t0, m.idx AS t0_idx, p.d AS prior_d, p.state, f.variant FROM tg t ASOF LEFT JOIN mk m ON t.target <= m.d LEFT JOIN mk p ON p.idx = m.idx - 1 LEFT JOIN firms f ON f.ticker = t.ticker)"""
_VIEWS = ("px", "mkt", "ledger", "firms")


@query(f",{_EV}\nSELECT event_id, t0, prior_d FROM ev", ("mkt", "ledger", "firms"), "t0 prior_d")
def map_to_trading_day(v, spark, sf):
    return _events(v).select("event_id", "t0", F.col("asof").alias("prior_d"))


@query(f",{_FACTS},{_EV}\nSELECT event_id, {R('arg_max(val, (end_d, filed))', 'shares')} FROM ev JOIN facts f ON f.symbol = ev.ticker AND f.tag = 'shares' AND f.filed <= ev.prior_d AND f.end_d <= ev.prior_d GROUP BY 1", ("mkt", "ledger", "firms", "raw_facts"))
def pit_instant(v, spark, sf):
    return sd.pit_instant(_events(v), _facts(v), "shares", "shares")


_PQ = "pq AS (SELECT *, row_number() OVER (PARTITION BY event_id, tag ORDER BY end_d DESC) AS k FROM (SELECT event_id, tag, end_d, arg_max(val, filed) AS val FROM ev JOIN facts f ON f.symbol = ev.ticker AND f.filed <= ev.prior_d AND f.end_d <= ev.prior_d AND date_diff('day', start_d, end_d) + 1 BETWEEN 70 AND 110 GROUP BY ALL))"


@query(f",{_FACTS},{_EV},{_PQ}\nSELECT event_id, tag, end_d, {R('val', 'val')}, CAST(k AS INTEGER) AS k FROM pq", ("mkt", "ledger", "firms", "raw_facts"), "end_d")
def pit_quarters(v, spark, sf):
    return sd.pit_quarters(_events(v), _facts(v))


@query(f",{_FACTS},{_EV},{_PQ}\nSELECT event_id, tag, {R('CASE WHEN count(*) FILTER (WHERE k <= 4) = 4 THEN sum(val) FILTER (WHERE k <= 4) END', 'ttm')}, {R('max(val) FILTER (WHERE k = 1)', 'latest')}, {R('avg(val) FILTER (WHERE k BETWEEN 2 AND 5)', 'earlier')} FROM pq GROUP BY 1, 2", ("mkt", "ledger", "firms", "raw_facts"))
def ttm_sum(v, spark, sf):
    return sd.quarter_sums(sd.quarters_known(_events(v), _facts(v)))


def _features(v):
    """All point-in-time features of the events, one row for each."""
    px, facts = _returns(v), _facts(v)
    w20 = F.lag("d", 20).over(ts.ordered(KEY, "d"))
    daily = px.select(F.col("symbol").alias("ticker"), F.col("d").alias("asof"), (fx.annualize(ts.trailing_std(30, 10, KEY)) * (5.0 / 252) ** 0.5).alias("vol_amplitude"), ts.skew_score(20, 8, KEY).alias("skew"), (ts.momentum(20, KEY)).alias("stock_20"), w20.alias("from_d"))
    f = _events(v).join(daily, ["ticker", "asof"], "left")
    days = _by_day(v)
    f = f.join(small(days.withColumnRenamed("d", "asof")), "asof", "left").join(small(days.select(F.col("d").alias("from_d"), F.col("sector").alias("sector_from"))), "from_d", "left")
    f = f.withColumn("strength", fx.tanh_score(F.col("stock_20") - (fx.safe_div("sector", "sector_from") - 1), 0.15))
    f = ts.asof(f, px.select(F.col("symbol").alias("ticker"), "d", F.col("adjclose").alias("close")), "asof", "d", ["close"], ["ticker"]).drop("asof_time")
    f = sd.with_instant(f, facts, "shares", "shares").drop("asof_time").withColumn("cap", F.col("shares") * F.col("close"))
    f = ts.trailing_sum(f, v.once("dividends", lambda: v("dividends")).withColumnRenamed("symbol", "ticker"), "asof", "d", "amount", "dividend", 365, ["ticker"])
    f = f.withColumn("income", F.when(F.col("close") > 0, F.coalesce("dividend", F.lit(0.0)) / F.col("close")).otherwise(0.0))
    before = ts.Window.partitionBy("ticker").orderBy(F.datediff("announced", _day("1970-01-01"))).rangeBetween(ts.Window.unboundedPreceding, -1)
    f = f.withColumns({"prior": F.coalesce(F.sum("amount").over(before), F.lit(0.0)), "eve": F.date_sub("announced", 1)})
    f = sd.with_quarter_total(f, facts.where((F.col("tag") == "repurchases") & (F.col("end_d") >= _day(START))), "spent", "eve").drop("asof_time", "eve")
    f = f.withColumn("balance", F.greatest(F.col("prior") - F.coalesce("spent", F.lit(0.0)), F.lit(0.0)))
    f = f.join(sd.internal_gains(sd.quarters_known(_events(v), facts.where(F.col("tag").isin("revenue", "operating_income", "capex")))), "event_id", "left")
    f = f.withColumn("capital_amplitude", sd.capital_amplitude(F.col("balance"), F.col("cap"), F.col("income"), F.col("variant") == "internal_reallocation", F.col("margin_gain"), F.col("capex_gain"), F.col("revenue_ttm")))
    words = {"pos": fx.keyword_count("text", POSITIVE), "neg": fx.keyword_count("text", NEGATIVE)}
    score = (F.col("pos") + 1.0) / (F.col("pos") + F.col("neg") + 2.0)
    f = sd.with_text(f, v.once("said", lambda: sd.filing_texts(v("statements"), sd.select_documents(v("statement_docs"), read=words), score)))
    f = f.withColumn("angle", sd.alignment_angle([F.col("text_score"), F.col("strength"), F.col("skew")]))
    f = f.withColumn("index_value", sd.interference_index(F.col("capital_amplitude"), F.col("vol_amplitude"), F.col("angle")))
    return f.withColumn("intensity", F.when(F.col("cap") != 0, F.col("amount") / F.col("cap")))


def _count(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"(length({text}) - length(replace({text}, '{w}', ''))) // {len(w)}" for w in words) + ")"


_RT = "rt AS (SELECT *, coalesce(adjclose / lag(adjclose) OVER w - 1, 0) AS ret, lag(adjclose, 20) OVER w AS c20, lag(d, 20) OVER w AS d20 FROM px WINDOW w AS (PARTITION BY symbol ORDER BY d))"
_SIDE = "CASE WHEN count(ret) FILTER (WHERE ret {0} 0) OVER x > 1 THEN stddev_samp(ret) FILTER (WHERE ret {0} 0) OVER x ELSE coalesce(avg(abs(ret)) FILTER (WHERE ret {0} 0) OVER x, 0) END"
_FT = f"""{_FACTS},{_EV},
{_RT},
dy AS (SELECT symbol, d, adjclose, c20, d20, CASE WHEN count(*) OVER y >= 10 THEN coalesce(stddev_samp(ret) OVER y, 0) * sqrt(252) * sqrt(5.0 / 252) END AS vol_amplitude, count(*) OVER x AS n20, {_SIDE.format('>')} AS up, {_SIDE.format('<')} AS down
  FROM rt WINDOW x AS (PARTITION BY symbol ORDER BY d ROWS 19 PRECEDING), y AS (PARTITION BY symbol ORDER BY d ROWS 29 PRECEDING)),
ds AS (SELECT symbol, dy.d, vol_amplitude, CASE WHEN n20 >= 8 THEN CASE WHEN up + down > 0 THEN up / (up + down) ELSE 0.5 END END AS skew, 0.5 + 0.5 * tanh((dy.adjclose / c20 - 1 - (a.adjclose / b.adjclose - 1)) / 0.15) AS strength
  FROM dy ASOF LEFT JOIN sector a ON dy.d >= a.d ASOF LEFT JOIN sector b ON dy.d20 >= b.d),
{_PQ},
sh AS (SELECT event_id, arg_max(val, (end_d, filed)) AS shares FROM ev JOIN facts f ON f.symbol = ev.ticker AND f.tag = 'shares' AND f.filed <= ev.prior_d AND f.end_d <= ev.prior_d GROUP BY 1),
dv AS (SELECT event_id, sum(x.amount) AS dividend FROM ev JOIN dividends x ON x.symbol = ev.ticker AND x.d > ev.prior_d - INTERVAL 365 DAY AND x.d <= ev.prior_d GROUP BY 1),
pr AS (SELECT l.event_id, coalesce(sum(e.amount), 0) AS prior FROM ledger l LEFT JOIN ledger e ON e.ticker = l.ticker AND e.announced < l.announced GROUP BY 1),
sp AS (SELECT event_id, sum(val) AS spent FROM (SELECT event_id, end_d, arg_max(val, filed) AS val FROM ev JOIN facts f ON f.symbol = ev.ticker AND f.tag = 'repurchases' AND f.filed <= ev.announced - 1 AND f.end_d <= ev.announced - 1 AND date_diff('day', start_d, end_d) + 1 BETWEEN 70 AND 110 GROUP BY ALL) WHERE end_d >= DATE '{START}' GROUP BY 1),
wd AS (SELECT event_id, k, max(val) FILTER (WHERE tag = 'revenue') AS rv, max(val) FILTER (WHERE tag = 'operating_income') AS oi, max(val) FILTER (WHERE tag = 'capex') AS cx FROM pq WHERE k <= 5 AND tag IN ('revenue', 'operating_income', 'capex') GROUP BY 1, 2),
ig AS (SELECT event_id, greatest(nw - coalesce(bf, nw), 0) AS mg, greatest(coalesce(cx1, 0) - coalesce(cxb, cx1, 0), 0) AS cg, rt4 FROM (SELECT event_id, max(CASE WHEN k = 1 THEN coalesce(oi / nullif(rv, 0), 0) END) AS nw, avg(CASE WHEN k > 1 THEN oi / nullif(rv, 0) END) AS bf, max(CASE WHEN k = 1 THEN cx END) AS cx1, avg(CASE WHEN k > 1 THEN cx END) AS cxb, CASE WHEN count(rv) FILTER (WHERE k <= 4) = 4 THEN sum(rv) FILTER (WHERE k <= 4) END AS rt4 FROM wd GROUP BY 1)),
ft0 AS (SELECT g.filing, ticker, filed AS d, CASE WHEN form <> '8-K' THEN 'periodic_filing' WHEN name = 'ex99-1.htm' THEN 'press_release' ELSE 'primary_filing' END AS text_source, lower(trim(regexp_replace(regexp_replace(text, '(?s)<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS t FROM statement_docs s JOIN statements g ON g.filing = s.filing WHERE form = '8-K' OR name = 'main.htm'),
tx AS (SELECT ticker, d, text_source, ({_count('t', POSITIVE)} + 1.0) / ({_count('t', POSITIVE)} + {_count('t', NEGATIVE)} + 2.0) AS text_score FROM (SELECT *, row_number() OVER (PARTITION BY ticker, d ORDER BY filing, text_source <> 'press_release') AS r FROM ft0 WHERE t <> '') WHERE r = 1),
f1 AS (SELECT ev.*, ds.vol_amplitude, ds.skew, ds.strength, sh.shares, dv.dividend, pr.prior, sp.spent, ig.mg, ig.cg, ig.rt4 FROM ev LEFT JOIN ds ON ds.symbol = ev.ticker AND ds.d = ev.prior_d LEFT JOIN sh ON sh.event_id = ev.event_id LEFT JOIN dv ON dv.event_id = ev.event_id LEFT JOIN pr ON pr.event_id = ev.event_id LEFT JOIN sp ON sp.event_id = ev.event_id LEFT JOIN ig ON ig.event_id = ev.event_id),
f2 AS (SELECT f1.*, p.adjclose AS close, x.adjclose AS vix, CASE WHEN date_diff('day', t.d, f1.prior_d) <= 120 THEN t.text_score END AS text_score, CASE WHEN date_diff('day', t.d, f1.prior_d) <= 120 THEN t.text_source ELSE 'missing' END AS text_source, CASE WHEN date_diff('day', t.d, f1.prior_d) <= 120 THEN t.d END AS text_day FROM f1 ASOF LEFT JOIN px p ON p.symbol = f1.ticker AND f1.prior_d >= p.d ASOF LEFT JOIN vix x ON f1.prior_d >= x.d ASOF LEFT JOIN tx t ON t.ticker = f1.ticker AND f1.prior_d >= t.d),
f3 AS (SELECT *, shares * close AS cap, CASE WHEN close > 0 THEN coalesce(dividend, 0) / close ELSE 0 END AS income, greatest(prior - coalesce(spent, 0), 0) AS balance FROM f2),
f4 AS (SELECT *, CASE WHEN variant = 'internal_reallocation' THEN CASE WHEN cap > 0 AND rt4 IS NOT NULL AND mg IS NOT NULL THEN greatest((mg * rt4 + coalesce(cg, 0)) / cap, 0) END WHEN cap <> 0 THEN balance / cap + income END AS capital_amplitude,
  CASE WHEN text_score + strength + skew IS NOT NULL THEN greatest(0, least(180, 180 * (1 - (text_score + strength + skew) / 3))) END AS angle, CASE WHEN cap <> 0 THEN amount / cap END AS intensity FROM f3),
ft AS (SELECT *, coalesce(2 * capital_amplitude * vol_amplitude / nullif(capital_amplitude * capital_amplitude + vol_amplitude * vol_amplitude, 0), CASE WHEN capital_amplitude + vol_amplitude IS NOT NULL THEN 0 END) * cos(radians(angle)) AS index_value FROM f4)"""
_FVIEWS = ("px", "mkt", "ledger", "firms", "raw_facts", "dividends", "sector", "vix", "statement_docs", "statements")


def feature_query(name: str, columns: str, source: str | None = None):
    """One or more columns of the feature rows as a query."""
    names = columns.split()
    sql = f",{_FT}\nSELECT event_id, " + ", ".join(R(c, c) for c in names) + " FROM ft"

    def f(v, spark, sf):
        return _features(v).select("event_id", *[F.col(c).cast("double").alias(c) for c in names])

    f.__name__ = name
    query(sql, _FVIEWS)(f)


for _name, _columns in {
    "market_cap": "cap", "trailing_yield": "income", "authorization_balance": "prior balance", "capital_amplitude": "capital_amplitude", "vol_amplitude": "vol_amplitude",
    "relative_strength": "strength", "skew_score": "skew", "market_state": "state vix", "interference_index": "angle index_value",
}.items():
    feature_query(_name, _columns)


@query(f",{_FT}\nSELECT event_id, {R('text_score', 'text_score')}, text_source, text_day FROM ft", _FVIEWS, "text_day")
def text_score(v, spark, sf):
    return _features(v).select("event_id", "text_score", "text_source", "text_day")


def _path(v, last=120):
    return sd.offsets(_events(v), _returns(v), _market(v), last)


_PATH = f"""
{_RT},
ofs AS (SELECT event_id, ticker, t0_idx, unnest(range(121))::INTEGER AS off FROM ev WHERE t0_idx IS NOT NULL),
pa AS (SELECT o.event_id, o.ticker, o.off, m.d, r.ret - m.ret AS ar, r.adjclose FROM ofs o LEFT JOIN mk m ON m.idx = o.t0_idx + o.off LEFT JOIN rt r ON r.symbol = o.ticker AND r.d = m.d),
car AS (SELECT event_id, ticker, off, d, ar, CASE WHEN ar IS NOT NULL THEN sum(ar) OVER (PARTITION BY event_id ORDER BY off) END AS car, adjclose FROM pa)"""


@query(f",{_EV},{_PATH}\nSELECT event_id, off AS horizon, {R('car', 'car')} FROM car WHERE off IN {HORIZONS}", _VIEWS)
def event_returns(v, spark, sf):
    return _path(v).where(F.col("off").isin(*HORIZONS)).select("event_id", F.col("off").alias("horizon"), "car")


def _base(v):
    return v.once("base", lambda: _make_base(v))


def _make_base(v):
    px = _returns(v).select(F.col("symbol").alias("ticker"), "d", F.col("adjclose").alias("base"))
    on_day = px.withColumnRenamed("d", "t0").withColumnRenamed("base", "day_base")
    back = ts.asof(_events(v), px, "asof", "d", ["base"], ["ticker"])
    return back.join(on_day, ["ticker", "t0"], "left").select("event_id", F.coalesce("day_base", "base").alias("base"))


_DD = """
bs AS (SELECT ev.event_id, coalesce(a.adjclose, b.adjclose) AS base FROM ev LEFT JOIN px a ON a.symbol = ev.ticker AND a.d = ev.t0 ASOF LEFT JOIN px b ON b.symbol = ev.ticker AND ev.prior_d >= b.d),
dd AS (SELECT p.event_id, min(adjclose / base - 1) AS drawdown FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY off) AS k FROM car WHERE ar IS NOT NULL) p JOIN bs ON bs.event_id = p.event_id WHERE k <= 51 GROUP BY 1)"""


@query(f",{_EV},{_PATH},{_DD}\nSELECT event_id, {R('drawdown', 'drawdown')} FROM dd", _VIEWS)
def post_event_drawdown(v, spark, sf):
    return sd.post_event_drawdown(_path(v), _base(v))


def _panel(v):
    car = _path(v, 5).where("off = 5").select("event_id", F.col("car").alias("car_5"))
    f = _features(v).where("t0 IS NOT NULL AND asof IS NOT NULL").join(car, "event_id", "left")
    gap = lambda c, n: F.when(F.col(c).isNull(), F.lit(n))
    reasons = F.array(gap("text_score", "missing_text"), gap("index_value", "missing_index"), gap("state", "missing_market_state"), gap("vix", "missing_vix"), gap("car_5", "missing_car_5"))
    have = sum((F.col(c).isNotNull().cast("int") for c in ("text_score", "strength", "skew")), F.lit(0))
    return f.withColumns({"eligible": F.col("index_value").isNotNull() & F.col("state").isNotNull() & F.col("vix").isNotNull() & F.col("car_5").isNotNull(), "reasons": F.array_join(F.array_sort(F.array_distinct(F.array_compact(reasons))), ";"), "coverage": F.concat(have.cast("string"), F.lit("/3"))})


_PN = """
pn AS (SELECT f.*, c.car AS car_5, index_value IS NOT NULL AND state IS NOT NULL AND vix IS NOT NULL AND c.car IS NOT NULL AS eligible, CAST((text_score IS NOT NULL)::INT + (strength IS NOT NULL)::INT + (skew IS NOT NULL)::INT AS VARCHAR) || '/3' AS coverage,
  concat_ws(';', CASE WHEN c.car IS NULL THEN 'missing_car_5' END, CASE WHEN index_value IS NULL THEN 'missing_index' END, CASE WHEN state IS NULL THEN 'missing_market_state' END, CASE WHEN text_score IS NULL THEN 'missing_text' END, CASE WHEN vix IS NULL THEN 'missing_vix' END) AS reasons
  FROM ft f LEFT JOIN (SELECT event_id, car FROM car WHERE off = 5) c ON c.event_id = f.event_id WHERE t0 IS NOT NULL AND prior_d IS NOT NULL)"""
_PANEL = f",{_FT},{_PATH.replace(_RT + ',', '')},{_PN}"


_PANEL_NUMBERS = "amount cap balance income capital_amplitude vol_amplitude intensity state vix text_score strength skew angle index_value car_5 drawdown".split()
_PANEL_NAMES = "event_id ticker t0 announced variant text_source text_day source_variant eligible reasons coverage data_tier".split()


@query(
    f"{_PANEL},{_DD.replace(chr(10) + 'bs AS', 'bs AS')}\nSELECT {', '.join('pn.' + n if n == 'event_id' else n for n in _PANEL_NAMES if n not in ('source_variant', 'data_tier'))}, {', '.join(R(n, n) for n in _PANEL_NUMBERS)}, 'public_proxy' AS data_tier, "
    + "coalesce(nullif(concat_ws('+', " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN '{n}' END" for c, n in sd.SOURCES.items()) + "), ''), 'missing') AS source_variant FROM pn LEFT JOIN dd ON dd.event_id = pn.event_id",
    _FVIEWS, "t0 announced text_day",
)
def feature_panel(v, spark, sf):
    fall = sd.post_event_drawdown(_path(v), _base(v))
    return _panel(v).join(fall, "event_id", "left").withColumns({"source_variant": sd.source_variant(), "data_tier": F.lit(sd.DATA_TIER)}).select(*_PANEL_NAMES, *_PANEL_NUMBERS)


# Ledger


_SEL = f"""
sl AS (SELECT filing, doc_id, name, text, ex, k FROM (SELECT *, row_number() OVER (PARTITION BY filing ORDER BY (lower(name) = 'main.htm')::INT, lower(name), doc_id) AS k
  FROM (SELECT *, regexp_matches(lower(name), '{sd.EXHIBIT}') AS ex FROM filing_docs) WHERE (ends_with(name, '.htm') OR ends_with(name, '.html') OR ends_with(name, '.txt')) AND (ex OR lower(name) = 'main.htm')) WHERE k <= 3 OR lower(name) = 'main.htm')"""


@query(f",{_SEL}\nSELECT filing, doc_id, name, k::INT AS place, CASE WHEN ex THEN 'press_release' ELSE 'primary_filing' END AS source_type FROM sl", ("filing_docs",))
def select_documents(v, spark, sf):
    return sd.select_documents(v("filing_docs")).select("filing", "doc_id", "name", "place", "source_type")


def _classified(v):
    documents = sd.select_documents(v("filing_docs"))
    found = sd.classify_filings(documents, GROUPS, F.col("filing") % 5 == 2)
    return sd.describe_candidates(found, v("filings"), documents)


_NEAR = ", ".join(f"'{w}'" for w in GROUPS["buyback"])
_SCALE = "CASE z[2] " + " ".join(f"WHEN '{a}' THEN {x}" for a, x in fx.SCALES) + " ELSE 1.0 END"
_AMOUNT = r"'(\d+(?:\.\d+)?)\s*(trillion|tn|billion|bn|b|million|m|thousand|k)?'"
_CL = rf"""{_SEL},
bx AS (SELECT filing, string_agg(t, ' ' ORDER BY k) FILTER (WHERE t <> '') AS x, bool_or(ex) AS release, list('' || filing || '/' || name ORDER BY k) AS urls FROM (SELECT filing, name, ex, k, trim(regexp_replace(regexp_replace(text, '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM sl) GROUP BY filing),
bd AS (SELECT filing, x, lower(x) AS t, release, urls FROM bx WHERE x <> ''),
ak AS (SELECT filing, t, w, string_split(t, w) AS parts FROM bd, (SELECT unnest([{_NEAR}]) AS w)),
ap AS (SELECT filing, t, w, unnest(list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda y: length(y))) + (i - 1) * length(w)))::BIGINT AS p FROM ak WHERE len(parts) > 1 AND regexp_matches(t, '[0-9]')),
aa AS (SELECT filing, substr(t, greatest(p - 120, 0) + 1, p + length(w) + 120 - greatest(p - 120, 0)) AS around FROM ap),
af AS (SELECT filing, unnest(list_zip(regexp_extract_all(around, {_AMOUNT}, 1), regexp_extract_all(around, {_AMOUNT}, 2))) AS z FROM aa),
am AS (SELECT filing, max(CAST(z[1] AS DOUBLE) * {_SCALE}) AS amount FROM af GROUP BY filing HAVING max(CAST(z[1] AS DOUBLE) * {_SCALE}) >= 1e6),
ct AS (SELECT bd.filing, x, release, urls, amount, {", ".join(f"{_count('t', w)} AS {g}" for g, w in GROUPS.items())}, CAST(nullif(regexp_extract(t, '(\d+(?:\.\d+)?)\s*(?:per\s+share|/share)', 1), '') AS DOUBLE) AS per_share FROM bd LEFT JOIN am ON am.filing = bd.filing),
cl AS (SELECT *, CASE WHEN filing % 5 = 2 AND internal_reallocation > 0 THEN 'internal_reallocation' WHEN (buyback > 0 OR amount IS NOT NULL) AND (dividend > 0 OR per_share IS NOT NULL) THEN 'dual_announcement' WHEN buyback > 0 OR amount IS NOT NULL THEN 'buyback_authorization' WHEN dividend > 0 OR per_share IS NOT NULL THEN 'dividend_announcement' WHEN split > 0 THEN 'signal_reset' END AS family,
  CAST(4 * (amount IS NOT NULL)::INT + 2 * (per_share IS NOT NULL)::INT + 2 * buyback + 2 * dividend + split + 2 * internal_reallocation + release::INT AS INTEGER) AS score FROM ct)"""


@query(
    f",{_CL}\nSELECT cl.filing, family, score, {R('amount', 'amount')}, {R('per_share', 'per_share')}, buyback::INT AS buyback, dividend::INT AS dividend, split::INT AS split, internal_reallocation::INT AS internal_reallocation, form, strftime(coalesce(accepted, filed + INTERVAL 20 HOUR + INTERVAL 5 MINUTE), '%Y-%m-%d %H:%M:%S') AS announced_ts, array_to_string(urls, ' ') AS urls, "
    "trim(regexp_replace(substr(x, 1, 180), '\\s+', ' ', 'g')) AS title, 'public_proxy' AS data_tier FROM cl JOIN filings ON filings.filing = cl.filing WHERE family IS NOT NULL",
    ("filing_docs", "filings"),
)
def classify_filings(v, spark, sf):
    return _classified(v).select("filing", "family", "score", "amount", "per_share", *GROUPS, "form", F.date_format("announced_ts", "yyyy-MM-dd HH:mm:ss").alias("announced_ts"), F.array_join("urls", " ").alias("urls"), "title", "data_tier")


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD")
FORMS, FIRST, LAST = ("8-K",), START, "2001-06-30"


def _candidates(v):
    """Candidates of the forms and days asked for with a score of 4 at least."""
    c = _classified(v).where("score >= 4").where(F.col("form").isin(*FORMS) & F.col("filed").between(_day(FIRST), _day(LAST)))
    ticker = F.get(F.array(*[F.lit(s) for s in _SEGMENTS]), (F.col("filing") % 5).cast("int"))
    return c.select(ticker.alias("ticker"), F.col("filed").alias("announced"), F.concat(F.lit("F"), F.col("filing").cast("string")).alias("event_id"), "family", "amount", "score")


def _overlay(v):
    return v("ledger").groupBy("ticker", "announced").agg(F.lit("buyback_authorization").alias("family"), F.max("amount").alias("amount"))


def _ledger(v):
    return sd.apply_overlay(_candidates(v), _overlay(v), v("firms"), v("exclusions"))


_LD = f"""
ca AS (SELECT [{", ".join(repr(s) for s in _SEGMENTS)}][cl.filing % 5 + 1] AS ticker, filed AS announced, 'F' || cl.filing::VARCHAR AS event_id, family, amount, score FROM cl JOIN filings g ON g.filing = cl.filing WHERE family IS NOT NULL AND score >= 4 AND form = '8-K' AND filed BETWEEN DATE '{FIRST}' AND DATE '{LAST}'),
bc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, announced ORDER BY score DESC, event_id) AS k FROM ca) WHERE k = 1),
ov AS (SELECT ticker, announced, 'buyback_authorization' AS family, max(amount) AS amount FROM ledger GROUP BY 1, 2),
mg AS (SELECT coalesce(b.ticker, o.ticker) AS ticker, coalesce(b.announced, o.announced) AS announced, coalesce(b.event_id, o.ticker || '-' || strftime(o.announced, '%Y%m%d') || '-' || o.family) AS event_id, coalesce(o.family, b.family) AS family, coalesce(o.amount, b.amount) AS amount, CASE WHEN b.event_id IS NULL THEN 100 ELSE b.score END AS score, CASE WHEN b.event_id IS NULL THEN 'manual_seed' WHEN o.ticker IS NOT NULL THEN 'manual_enriched' ELSE 'auto_discovered' END AS status FROM bc b FULL OUTER JOIN ov o ON b.ticker = o.ticker AND b.announced = o.announced),
ld AS (SELECT * FROM (SELECT m.*, f.target_count, row_number() OVER (PARTITION BY m.ticker ORDER BY (status LIKE 'manual%') DESC, score DESC, m.announced, event_id) AS k FROM mg m JOIN firms f ON f.ticker = m.ticker WHERE NOT EXISTS (SELECT 1 FROM exclusions x WHERE x.ticker = m.ticker AND x.announced = m.announced)) WHERE k <= target_count)"""
_LV = ("filing_docs", "filings", "ledger", "firms", "exclusions")


@query(f",{_CL},{_LD}\nSELECT ticker, announced, event_id, family, {R('amount', 'amount')}, CAST(score AS INTEGER) AS score, status, CASE WHEN status = 'manual_seed' THEN 'Buyback Authorization' END AS title, 'public_proxy' AS data_tier FROM ld", _LV, "announced")
def apply_overlay(v, spark, sf):
    return _ledger(v)


@query(f",{_CL},{_LD}\nSELECT m.ticker, m.announced, min(reason) AS reason FROM mg m JOIN exclusions x ON x.ticker = m.ticker AND x.announced = m.announced GROUP BY 1, 2", _LV, "announced")
def excluded_events(v, spark, sf):
    return sd.excluded(_candidates(v), _overlay(v), v("exclusions"))


@query(f",{_CL},{_LD}\nSELECT f.ticker, f.target_count, count(l.event_id) AS achieved, greatest(f.target_count - count(l.event_id), 0) AS gap, greatest(count(l.event_id) - f.target_count, 0) AS overflow FROM firms f LEFT JOIN ld l ON l.ticker = f.ticker GROUP BY 1, 2", _LV)
def gap_report(v, spark, sf):
    return sd.gap_report(_ledger(v), v("firms"))


@query(f",{_CL},{_LD}\nSELECT ticker, family, status, count(*) AS n, min(announced) AS first_day FROM ld GROUP BY 1, 2, 3", _LV, "first_day")
def build_ledger(v, spark, sf):
    return _ledger(v).groupBy("ticker", "family", "status").agg(F.count("*").alias("n"), F.min("announced").alias("first_day"))


# Statistics


_X = ["index_value", "state", "vix"]
OUT_OF_SAMPLE = "1999-01-01"


def _design(v):
    """Eligible events; the index implies the amplitudes and the angle. Queries that pass over them again
    and again write them first."""
    return _panel(v).where("eligible").select("event_id", "ticker", "announced", "car_5", "intensity", "capital_amplitude", "vol_amplitude", "index_value", "state", "vix", F.cos(F.radians("angle")).alias("cosine"))


_DESIGN = "de AS (SELECT event_id, ticker, announced, car_5, intensity, capital_amplitude, vol_amplitude, index_value, state, vix, cos(radians(angle)) AS cosine FROM pn WHERE eligible)"


def _solved(rows: str) -> str:
    """Tables of the least squares of y on a, b, c with effects, for each label, of rows (label, effect, y, a, b,
    c): ce has the rows about the means of their effect, ls the slopes ka, kb, kc, the inverse and the errors."""
    return f"""ra AS ({rows}),
ce AS (SELECT label, effect, y AS raw, y - avg(y) OVER g AS y, a - avg(a) OVER g AS a, b - avg(b) OVER g AS b, c - avg(c) OVER g AS c FROM ra WINDOW g AS (PARTITION BY label, effect)),
sm AS (SELECT label, count(*) AS n, count(DISTINCT effect) AS g, var_pop(raw) * count(*) AS total, sum(y * y) AS yy, sum(a * y) AS ya, sum(b * y) AS yb, sum(c * y) AS yc, sum(a * a) AS aa, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * b) AS bb, sum(b * c) AS bc, sum(c * c) AS cc FROM ce GROUP BY label),
dt AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM sm),
iv AS (SELECT *, (bb * cc - bc * bc) / det AS iaa, (ac * bc - ab * cc) / det AS iab, (ab * bc - ac * bb) / det AS iac, (aa * cc - ac * ac) / det AS ibb, (ab * ac - aa * bc) / det AS ibc, (aa * bb - ab * ab) / det AS icc FROM dt),
sl AS (SELECT *, iaa * ya + iab * yb + iac * yc AS ka, iab * ya + ibb * yb + ibc * yc AS kb, iac * ya + ibc * yb + icc * yc AS kc FROM iv),
ls AS (SELECT *, yy - ka * ya - kb * yb - kc * yc AS sse, 1 - (yy - ka * ya - kb * yb - kc * yc) / total AS r2 FROM sl)"""


_PRIMARY = _solved("SELECT 'all' AS label, ticker AS effect, car_5 AS y, index_value AS a, state AS b, vix AS c FROM de")
_SCORES = """sc AS (SELECT effect, sum(e * a) AS sa, sum(e * b) AS sb, sum(e * c) AS sc FROM (SELECT ce.*, ce.y - ka * a - kb * b - kc * c AS e FROM ce, ls) GROUP BY effect),
pl AS (SELECT effect, iaa * sa + iab * sb + iac * sc AS pa, iab * sa + ibb * sb + ibc * sc AS pb, iac * sa + ibc * sb + icc * sc AS pc FROM sc, ls)"""
_TERMS = (("index_value", "a"), ("state", "b"), ("vix", "c"))


@query(f"{_PANEL},{_DESIGN},{_PRIMARY}\n" + " UNION ALL ".join(f"SELECT '{t}' AS term, {R('k' + x, 'coefficient')}, {R(f'sqrt(sse / (n - 3 - g) * i{x}{x})', 'std_error')}, {R('r2', 'r2')}, n FROM ls" for t, x in _TERMS), _FVIEWS)
def fixed_effect_ols(v, spark, sf):
    terms = F.arrays_zip(F.array(*map(F.lit, _X)).alias("term"), F.col("slopes").alias("coefficient"), F.col("errors").alias("std_error"))
    return st.fits(_design(v), _X, "car_5", fixed="ticker").select(F.inline(terms).alias("term", "coefficient", "std_error"), "r2", "n")


_MEANS = "gm AS (SELECT ticker, count(*) AS n, avg(car_5) AS my, avg(index_value) AS ma, avg(state) AS mb, avg(vix) AS mc FROM de GROUP BY ticker)"


def _primary_fit(v):
    rows = v.once("design", lambda: _design(v))
    return st.ols(rows, "car_5", _X, fixed="ticker")


@query(f"{_PANEL},{_DESIGN},{_PRIMARY},{_MEANS}\nSELECT event_id, {R('my + ka * (index_value - ma) + kb * (state - mb) + kc * (vix - mc)', 'fitted')}, {R('car_5 - my - ka * (index_value - ma) - kb * (state - mb) - kc * (vix - mc)', 'residual')} FROM de JOIN gm ON gm.ticker = de.ticker, ls", _FVIEWS)
def fixed_effect_residuals(v, spark, sf):
    return _primary_fit(v)[1].select("event_id", "fitted", "residual")


@query(f"{_PANEL},{_DESIGN},{_PRIMARY},{_MEANS},\nfe AS (SELECT ticker, gm.n, my - ka * ma - kb * mb - kc * mc AS effect FROM gm, ls)\nSELECT ticker, n, {R('effect', 'effect')}, CASE WHEN ticker <> (SELECT min(ticker) FROM fe) THEN {R('effect - (SELECT arg_min(effect, ticker) FROM fe)', 'x').rpartition(' AS ')[0]} END AS coefficient FROM fe", _FVIEWS)
def firm_effects(v, spark, sf):
    fit, _ = _primary_fit(v)
    return st.effects(v.once("design", lambda: _design(v)), fit, "car_5", _X, "ticker")


@query(f"{_PANEL},{_DESIGN},{_PRIMARY},{_SCORES}\n" + " UNION ALL ".join(f"SELECT '{t}' AS term, {R('k' + x, 'coefficient')}, {R(f'sqrt((SELECT sum(p{x} * p{x}) FROM pl) * g / (g - 1) * (n - 1) / (n - 3 - g))', 'std_error')}, {R('r2', 'r2')}, n FROM ls" for t, x in _TERMS), _FVIEWS)
def clustered_se(v, spark, sf):
    fit, _ = st.ols(cut(_design(v)), "car_5", _X, cluster="ticker", fixed="ticker")
    return st.coefficients(spark, fit).where("term <> 'intercept'")


@query(f"{_PANEL},{_DESIGN},{_PRIMARY},{_SCORES},\ndr AS (SELECT ka + sum(pa * CASE WHEN CAST('0x' || substr(md5(concat_ws('|', i, effect, 7)), 1, 8) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS b, any_value(ka) AS ka FROM pl, ls, range(1000) t(i) GROUP BY i, ka)\n"
       f"SELECT {R('quantile_cont(b, 0.025)', 'ci_low')}, {R('quantile_cont(b, 0.975)', 'ci_high')}, {R('least(1, 2 * least(avg((b >= 0)::INT), avg((b <= 0)::INT)))', 'p_value')}, {R('max(ka)', 'coefficient')} FROM dr", _FVIEWS)
def wild_cluster_bootstrap(v, spark, sf):
    fit, _ = st.ols(cut(_design(v)), "car_5", _X, cluster="ticker", fixed="ticker")
    return st.wild_bootstrap(spark, fit, 1, 1000, 7)


#: Regressors by model; all but the first have one intercept, and market state and VIX as controls or three components.
_FORMS = {
    "primary": _X, "amount_only": ["intensity", "state", "vix"], "components": ["capital_amplitude", "vol_amplitude", "cosine"],
    "multiplicative": ["capital_amplitude * vol_amplitude * cosine", "state", "vix"], "arithmetic": ["0.5D * (capital_amplitude + vol_amplitude) * cosine", "state", "vix"], "cosine_only": ["cosine", "state", "vix"],
}
_MODELS = _solved(" UNION ALL ".join(f"SELECT '{m}' AS label, {'ticker' if m == 'primary' else repr('all')} AS effect, car_5 AS y, {a} AS a, {b} AS b, {c} AS c FROM de WHERE {a} IS NOT NULL" for m, (a, b, c) in _FORMS.items()).replace("0.5D", "0.5::DOUBLE"))


@query(f"{_PANEL},{_DESIGN},{_MODELS}\nSELECT label AS model, {R('r2', 'r2')}, n FROM ls", _FVIEWS)
def model_benchmarks(v, spark, sf):
    effect = lambda m: F.col("ticker") if m == "primary" else F.lit("all")
    forms = F.array(*[F.struct(F.lit(m).alias("model"), effect(m).alias("effect"), *[F.expr(e).cast("double").alias(n) for n, e in zip("abc", x, strict=True)]) for m, x in _FORMS.items()])
    return st.fits(_design(v).select("car_5", F.inline(forms)), ["a", "b", "c"], "car_5", ["model"], "effect").select("model", "r2", "n")


#: Ranges of announcement days, both ends included; they may overlap and leave days out.
TIME_SPLITS = (("early", "1995-01-01", "1997-12-31"), ("late", "1998-01-01", "2001-12-31"), ("middle", "1996-07-01", "2000-06-30"))
_SPLITS = _solved(f"""SELECT 'time_' || s.name AS label, ticker AS effect, car_5 AS y, index_value AS a, state AS b, vix AS c FROM de JOIN (VALUES {", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in TIME_SPLITS)}) s(name, low, high) ON announced BETWEEN s.low AND s.high
  UNION ALL SELECT 'size_' || (k >= n // 2)::INT, ticker, car_5, index_value, state, vix FROM (SELECT *, row_number() OVER (ORDER BY intensity, event_id) - 1 AS k, count(*) OVER () AS n FROM de WHERE intensity IS NOT NULL)
  UNION ALL SELECT 'vix_' || ((k >= n // 3)::INT + (k >= 2 * n // 3)::INT), ticker, car_5, index_value, state, vix FROM (SELECT *, row_number() OVER (ORDER BY vix, event_id) - 1 AS k, count(*) OVER () AS n FROM de)""")


@query(f"{_PANEL},{_DESIGN},{_SPLITS}\nSELECT label, {R('r2', 'r2')}, n FROM ls", _FVIEWS)
def robustness_splits(v, spark, sf):
    rows = cut(_design(v))
    pick = lambda df, label: df.select(label.alias("label"), "ticker", "car_5", *_X)
    tier = lambda name, parts: F.concat(F.lit(name), sum((F.expr(f"int(place >= {i} * of div {parts})") for i in range(1, parts)), F.lit(0)).cast("string"))
    inside = F.array_compact(F.array(*[F.when(F.col("announced").between(_day(a), _day(b)), F.lit(f"time_{n}")) for n, a, b in TIME_SPLITS]))
    time = pick(rows.withColumn("label", F.explode(inside)), F.col("label"))
    halves = ts.placed(rows, "intensity", "event_id")
    thirds = ts.placed(rows, "vix", "event_id")
    both = pick(halves, tier("size_", 2)).unionByName(pick(thirds, tier("vix_", 3)))
    return st.fits(time.unionByName(both), _X, "car_5", ["label"], "ticker").select("label", "r2", "n")


_OOS = f"""{_solved(f"SELECT 'all' AS label, ticker AS effect, car_5 AS y, index_value AS a, state AS b, vix AS c FROM de WHERE announced < DATE '{OUT_OF_SAMPLE}'")},
ef AS (SELECT effect, avg(ra.y - ka * ra.a - kb * ra.b - kc * ra.c) AS base FROM ra, ls GROUP BY effect),
te AS (SELECT car_5 AS y, coalesce(ef.base, (SELECT arg_min(base, effect) FROM ef)) + ka * index_value + kb * state + kc * vix AS p FROM (SELECT * FROM de WHERE announced >= DATE '{OUT_OF_SAMPLE}') d CROSS JOIN ls LEFT JOIN ef ON ef.effect = d.ticker)"""


@query(f"{_PANEL},{_DESIGN},{_OOS}\nSELECT {R('coalesce(1 - sum(power(y - p, 2)) / nullif(var_pop(y) * count(*), 0), 0)', 'r2')}, {R('sqrt(avg(power(y - p, 2)))', 'rmse')}, {R('avg(abs(y - p))', 'mae')}, {R('avg(CASE WHEN sign(y) = sign(p) THEN 1.0 ELSE 0.0 END)', 'direction')} FROM te", _FVIEWS)
def out_of_sample(v, spark, sf):
    """The primary model fitted before the cut-off and scored after it; a firm without rows before it has the
    effect of the first firm."""
    rows, before = cut(_design(v)), F.col("announced") < _day(OUT_OF_SAMPLE)
    fit = st.fits(rows.where(before), _X, "car_5", fixed="ticker").select("slopes")
    part = sum((F.col("slopes")[i] * F.col(c) for i, c in enumerate(_X)), F.lit(0.0))
    # fit and first are one row each
    effects = rows.where(before).crossJoin(F.broadcast(fit)).groupBy("ticker").agg(F.avg(F.col("car_5") - part).alias("effect"))
    first = effects.agg(F.min_by("effect", "ticker").alias("first"))
    test = rows.where(~before).join(effects, "ticker", "left").crossJoin(F.broadcast(fit)).crossJoin(F.broadcast(first))
    guessed = test.select(F.col("car_5").alias("y"), (F.coalesce("effect", "first") + part).alias("p"))
    return guessed.agg(st.r2_of(F.col("y"), F.col("p")).alias("r2"), *error_terms("y", "p"))


@query()
def forest_benchmark(v, spark, sf):
    out = st.forest(_design(v), [*_X, "capital_amplitude", "vol_amplitude"], "car_5", F.col("announced") < _day(OUT_OF_SAMPLE))
    return out.select("event_id", "car_5", "predicted")


GRID = [0.5 * i for i in range(1, 601)]


def _fits(v):
    return st.reversion_fit(event_returns(v, None, None), GRID, 60, 0.5)


_FIT = f"""
er AS (SELECT event_id, off AS h, car AS y FROM car WHERE off IN {HORIZONS} AND car IS NOT NULL),
gz AS (SELECT event_id, tau, regr_sxx(y, exp(-h / tau)) AS sxx, regr_sxy(y, exp(-h / tau)) AS sxy, regr_syy(y, exp(-h / tau)) AS syy, avg(exp(-h / tau)) AS mz, avg(y) AS my FROM er, (SELECT unnest(range(1, 601)) * 0.5::DOUBLE AS tau) WHERE event_id IN (SELECT event_id FROM er GROUP BY 1 HAVING max(h) >= 60) GROUP BY 1, 2),
gs AS (SELECT *, coalesce(sxy / nullif(sxx, 0), 0) AS b FROM gz),
gb AS (SELECT event_id, tau, my - b * mz AS car_inf, my - b * mz + b AS car_0, greatest(syy - b * sxy, 0) AS sse, syy FROM gs),
bf AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(sse, 12), tau) AS k FROM gb WHERE car_0 BETWEEN -0.5 AND 0.5 AND car_inf BETWEEN -0.3 AND 0.3),
fit AS (SELECT event_id, tau, car_0, car_inf, CASE WHEN syy > 0 THEN 1 - sse / syy ELSE 0 END AS r2, CASE WHEN syy > 0 THEN 1 - sse / syy ELSE 0 END >= 0.5 AS qualified FROM bf WHERE k = 1)"""


@query(f",{_EV},{_PATH},{_FIT}\nSELECT event_id, {R('tau', 'tau')}, {R('car_0', 'car_0')}, {R('car_inf', 'car_inf')}, {R('r2', 'r2')}, qualified FROM fit", _VIEWS)
def reversion_fit(v, spark, sf):
    return _fits(v)


@query(f",{_FT},{_PATH.replace(_RT + ',', '')},{_FIT}\nSELECT {R('exp(regr_intercept(ln(tau), angle))', 'tau_max')}, {R('-regr_slope(ln(tau), angle)', 'alpha')}, {R('coalesce(regr_r2(ln(tau), angle), 0)', 'r2')}, count(*) AS n FROM fit JOIN ft ON ft.event_id = fit.event_id WHERE qualified AND angle IS NOT NULL", _FVIEWS)
def decay_law(v, spark, sf):
    rows = _fits(v).where("qualified").join(_features(v).select("event_id", "angle"), "event_id").where("angle IS NOT NULL").select(F.log("tau").alias("y"), F.col("angle").alias("x"))
    return simple_ols(rows, [], "y", "x").select(F.exp("intercept").alias("tau_max"), (-F.col("slope")).alias("alpha"), "r2", "n")


def _written_features(v):
    return v.once("features", lambda: _features(v))


def _dims(v):
    f = _written_features(v).where("capital_amplitude IS NOT NULL AND vol_amplitude IS NOT NULL")
    f = f.select("ticker", "capital_amplitude", "vol_amplitude", fx.or_default("intensity", 0.0).alias("intensity"), (1 - fx.or_default("skew", 0.5)).alias("down"), (F.coalesce("vix", F.lit(0.0)) - 100 * F.coalesce("state", F.lit(0.0))).alias("stress"))
    return st.effective_dimension(f, ["capital_amplitude", "vol_amplitude", "intensity", "down", "stress"])


@query()
def effective_dimension(v, spark, sf):
    return _dims(v).select("ticker", "n", "dimension", "tier", F.aggregate("eigenvalues", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query()
def reversion_regimes(v, spark, sf):
    return st.reversion_regimes(_fits(v), _dims(v), _written_features(v).select("event_id", "ticker", "angle"))


@query()
def tail_screen(v, spark, sf):
    dd = sd.post_event_drawdown(_path(v), _base(v)).join(_events(v).select("event_id", "ticker"), "event_id")
    return st.tail_screen(dd, _dims(v), -0.01)


@ret_query(
    f"""mk AS (SELECT d, coalesce(adjclose / lag(adjclose) OVER (ORDER BY d) - 1, 0) AS m FROM mkt), xs AS (SELECT r.symbol, r.d, r.ret - mk.m AS x FROM ret r JOIN mk ON mk.d = r.d)
SELECT left_symbol, right_symbol, {R('xi', 'xi')}, n FROM (SELECT a.symbol AS left_symbol, b.symbol AS right_symbol, corr(a.x, b.x) AS xi, count(*) AS n FROM xs a JOIN xs b ON a.d = b.d AND a.symbol < b.symbol GROUP BY 1, 2) WHERE n >= 60 AND xi > 0.3""",
    ("px", "mkt"),
)
def comovement_edges(v, spark, sf):
    return st.comovement_edges(_returns(v), _market(v), 0.3)


@query(f"{_PANEL}\nSELECT count(*) AS events, count(*) FILTER (WHERE eligible) AS eligible, count(DISTINCT ticker) AS tickers, count(*) FILTER (WHERE reasons <> '') AS incomplete FROM pn", _FVIEWS)
def run_summary(v, spark, sf):
    return _panel(v).agg(F.count("*").alias("events"), F.count_if("eligible").alias("eligible"), F.count_distinct("ticker").alias("tickers"), F.count_if(F.col("reasons") != "").alias("incomplete"))
