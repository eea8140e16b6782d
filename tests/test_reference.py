"""Worked examples, invariants and edge rules of the panel operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import functions as fx
from tidemark import sources
from tidemark.operators import panel as pn
from tidemark.operators import series as ts
from tidemark.operators import stats as st
from tidemark.operators import study as sd

D = dt.date


def days(start: str, n: int):
    a = D.fromisoformat(start)
    return [a + dt.timedelta(i) for i in range(n)]


def test_hazard_worked_example(spark):
    probs = spark.createDataFrame([(D(2022, 2, 15), 0.60, D(2022, 3, 17))], "d date, probability double, resolution_date date")
    out = pn.hazard_signal(probs.select("d").unionAll(spark.createDataFrame([(D(2022, 2, 16),)], "d date")), probs, F.lit(10.0), F.lit(0.1)).orderBy("d").collect()
    assert out[0]["hazard"] == pytest.approx(6 * math.exp(-0.1)) and round(out[0]["hazard"], 2) == 5.43
    assert out[0]["stability"] == pytest.approx(1 / 6.43, abs=1e-3) and out[1]["stability"] == 1.0


def test_vol_target_within_cap(spark):
    rows = spark.createDataFrame([("s", d, r) for d, r in zip(days("2024-01-01", 6), [0.0, 0.001, -0.001, 0.001, -0.001, 0.001], strict=True)], "symbol string, d date, ret double")
    p = [x[0] for x in rows.select(ts.vol_target(3, 0.12, 1.0, ["symbol"]), "d").orderBy("d").collect()]
    assert p[:3] == [1.0] * 3 and all(0 <= x <= 1 for x in p)


def test_turnover_costs(spark):
    rows = spark.createDataFrame([("s", d, r, p) for d, r, p in zip(days("2024-01-01", 3), [0.0, 0.01, 0.0], [1.0, 0.0, 0.0], strict=True)], "symbol string, d date, ret double, position double")
    out = ts.simulate(rows, ["symbol"]).orderBy("d").collect()
    assert [x["daily_return"] for x in out] == pytest.approx([0.0, 0.01, -0.0005]) and out[0]["equity"] == 1.0


def test_trading_day_map(spark):
    cal = ts.calendar(spark.createDataFrame([(d,) for d in days("2024-05-01", 3)], "d date"))
    ev = spark.createDataFrame([(1, dt.datetime(2024, 5, 2, 20, 30)), (2, dt.datetime(2024, 5, 2, 11, 0)), (3, dt.datetime(2024, 5, 3, 20, 30)), (4, dt.datetime(2024, 4, 28, 1, 0))], "id int, ts timestamp")
    got = {x["id"]: x["t0"] for x in sd.map_to_trading_day(ev, cal).collect()}
    assert got == {1: D(2024, 5, 3), 2: D(2024, 5, 2), 3: None, 4: D(2024, 5, 1)}


def test_default_time_is_after_the_close_in_summer_only(spark):
    d, closed = fx.market_day("ts")
    rows = spark.createDataFrame([(dt.datetime(2024, 7, 1, 20, 5),), (dt.datetime(2024, 1, 2, 20, 5),)], "ts timestamp")
    assert [x[0] for x in rows.select(closed).collect()] == [True, False]


def test_angle_and_index(spark):
    one = spark.range(1)
    angle = sd.alignment_angle([F.lit(0.9), F.lit(0.7), F.lit(0.8)])
    same, against = (sd.interference_index(F.lit(0.2), F.lit(0.2), F.lit(a)) for a in (0.0, 180.0))
    none = sd.interference_index(F.lit(None).cast("double"), F.lit(0.2), F.lit(0.0))
    zero = sd.interference_index(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    assert tuple(one.select(angle, same, against, none, zero).first()) == pytest.approx((36.0, 1.0, -1.0, None, 0.0))


def test_internal_amplitude(spark):
    ends = [D(2023, 3, 31), D(2023, 6, 30), D(2023, 9, 30), D(2023, 12, 31), D(2024, 3, 31)]
    rows = []
    for tag, values in {"revenue": [100, 100, 100, 100, 110], "operating_income": [10, 10, 10, 10, 16.5], "capex": [8, 8, 8, 8, 12]}.items():
        rows += [("A", tag, e - dt.timedelta(90), e, e + dt.timedelta(30), float(x)) for e, x in zip(ends, values, strict=True)]
    facts = spark.createDataFrame(rows, "symbol string, tag string, start_d date, end_d date, filed date, val double")
    ev = spark.createDataFrame([("e", "A", D(2024, 5, 1)), ("early", "A", D(2024, 4, 15))], "event_id string, ticker string, asof date")
    g = sd.internal_gains(sd.pit_quarters(ev, facts))
    amp = sd.capital_amplitude(F.lit(0.0), F.lit(1000.0), F.lit(0.0), F.lit(True), F.col("margin_gain"), F.col("capex_gain"), F.col("revenue_ttm"))
    got = {x[0]: x[1] for x in g.select("event_id", amp).collect()}
    assert got["e"] == pytest.approx(0.0245) and got["early"] == 0.0  # the last quarter was not yet filed


def test_reversion_fit_recovers_tau(spark):
    h = (1, 2, 3, 5, 10, 20, 40, 60, 90, 120)
    rows = [(f"e{t}", x, 0.01 + 0.07 * math.exp(-x / t)) for t in (10, 20, 40) for x in h] + [("short", 5, 0.1), ("short", 10, 0.2)]
    cars = spark.createDataFrame(rows, "event_id string, horizon int, car double")
    fit = st.reversion_fit(cars, [0.5 * i for i in range(1, 201)])
    got = {x["event_id"]: (x["tau"], x["qualified"]) for x in fit.collect()}
    assert got == {"e10": (10.0, True), "e20": (20.0, True), "e40": (40.0, True)}
    plan = fit._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_spectral_dimension():
    d, w = st.spectral_dimension(np.eye(5))
    assert d == pytest.approx(5) and sum(w) == pytest.approx(1)
    assert st.spectral_dimension(np.ones((5, 5)))[0] == pytest.approx(1)


def test_ols_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x, g = rng.normal(size=(60, 2)), np.arange(60) % 4
    y = 0.3 + x @ [1.5, -2.0] + g * 0.2 + rng.normal(size=60) * 0.1
    rows = spark.createDataFrame([(float(a), float(b), f"g{k}", float(v)) for (a, b), k, v in zip(x, g, y, strict=True)], "a double, b double, g string, y double")
    fit, out = st.ols(rows, "y", ["a", "b"], cluster="g", fixed="g")
    design = np.column_stack([np.ones(60), x, *[(g == k).astype(float) for k in (1, 2, 3)]])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    effects = beta[0] + np.array([0, *beta[3:]])[g]
    assert fit["beta"] == pytest.approx([effects.mean(), *beta[1:3]], abs=1e-6) and fit["n"] == 60
    total = ((y - y.mean()) ** 2).sum()
    assert fit["r2"] == pytest.approx(1 - ((y - design @ beta) ** 2).sum() / total, abs=1e-6)
    inv, res = np.linalg.inv(design.T @ design), y - design @ beta
    s = np.array([design[g == k].T @ res[g == k] for k in range(4)])
    want = np.sqrt(np.maximum(np.diag(inv @ s.T @ s @ inv) * 4 / 3 * 59 / 54, 0))
    assert fit["se"][1:3] == pytest.approx(want[1:3], abs=1e-6)
    assert out.agg(F.sum("residual")).first()[0] == pytest.approx(0, abs=1e-6)
    boot = st.wild_bootstrap(spark, fit, 1, 200).first()
    assert boot["ci_low"] <= boot["coefficient"] <= boot["ci_high"] and boot["p_value"] < 0.05
    one = st.fits(rows, ["a", "b"], "y", fixed="g").first()
    sigma = np.sqrt(res @ res / 54)
    assert one["slopes"] == pytest.approx(beta[1:3], abs=1e-6) and one["errors"] == pytest.approx(sigma * np.sqrt(np.diag(inv))[1:3], abs=1e-6)
    assert one["r2"] == pytest.approx(fit["r2"]) and one["n"] == 60
    assert st.fits(rows.where("a IS NULL"), ["a", "b"], "y", fixed="g").count() == 0
    plain = st.fits(rows, ["a", "b"], "y", ["g"]).where("g = 'g1'").first()
    each = np.linalg.lstsq(design[g == 1][:, :3], y[g == 1], rcond=None)[0]
    assert plain["slopes"] == pytest.approx(each[1:], abs=1e-6)


def test_places_are_those_of_the_whole_order(spark):
    values = [None, *[float(i * 7919 % 101) for i in range(400)], *[5.0] * 150]
    rows = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    got = ts.placed(rows, "v", "id", 8).select("id", "place", "of").collect()
    want = sorted((v, i) for i, v in enumerate(values) if v is not None)
    assert {r["id"]: r["place"] for r in got} == {i: k for k, (_, i) in enumerate(want)} and {r["of"] for r in got} == {550}
    assert ts.placed(rows.where("v > 1000"), "v", "id").count() == 0


def test_performance_matches_plain_version(spark):
    rng = np.random.default_rng(3)
    n = 130
    r, p = np.concatenate(([0.0], rng.normal(0.0005, 0.01, n - 1))), rng.choice([0.05, 0.5, 1.0], n)
    e, d = np.cumprod(1 + r), days("2024-01-01", n)
    rows = spark.createDataFrame([("s", a, float(b), float(c), float(x), 0.03) for a, b, c, x in zip(d, p, r, e, strict=True)], "k string, d date, position double, daily_return double, equity double, annual_rate double")
    got = ts.performance(rows, ["k"]).first()
    free = 1.03 ** (1 / 252) - 1
    x = r[1:] - free
    down = math.sqrt((np.minimum(x, 0) ** 2).mean()) * math.sqrt(252)
    tail = np.sort(r[1:])[: math.ceil(0.05 * (n - 1))].mean()
    dd = (e / np.maximum.accumulate(e) - 1).min()
    run = best = 0
    for v in p:
        run = run + 1 if v <= 0.1 else 0
        best = max(best, run)
    assert got["cagr"] == pytest.approx(e[-1] ** (252 / (n - 1)) - 1) and got["sortino"] == pytest.approx(x.mean() * 252 / down)
    assert got["cvar_95"] == pytest.approx(tail) and got["max_drawdown_daily"] == pytest.approx(dd)
    assert got["days_idle"] == (p <= 0.1).sum() and got["longest_idle_run"] == best
    months = {}
    for a, v in zip(d, e, strict=True):
        months[a.strftime("%Y-%m")] = v
    m = np.array(list(months.values()))
    assert got["max_drawdown_monthly"] == pytest.approx(min((m / np.maximum.accumulate(m) - 1).min(), 0))


def test_safe_helpers(spark):
    row = spark.createDataFrame([(1.0, 0.0, None)], "a double, b double, c double").select(
        fx.safe_div("a", "b"), fx.safe_div("a", "c"), fx.clamp("c", 0, 1), fx.or_default("b", 0.5), fx.tanh_score("a", 0), fx.smoothstep(F.lit(0.5))
    ).first()
    assert tuple(row) == (0.0, None, None, 0.5, 0.5, 0.5)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert flat.agg(fx.safe_corr("x", "y"), fx.std0("x"), fx.mean0("y")).first()[0] == 0.0


def test_text_helpers(spark):
    t = "Board authorized a $10 billion share repurchase. A dividend of $0.25 per share. The 3 months plan; share repurchase."
    row = spark.createDataFrame([(t, "<p>a&amp;b</p><script>var x = 1</script> c")], "t string, h string").select(
        fx.keyword_count("t", ["share repurchase"]), fx.context_money("t", ["share repurchase"]), fx.per_share("t"), fx.strip_html("h"), fx.strip_html("h", keep_bodies=True), fx.context_money("t", ["nothing"])
    ).first()
    assert tuple(row) == (2, 1e10, 0.25, "a&b c", "a&b var x = 1 c", None)
    near = spark.createDataFrame([("buyback in 3 months", )], "t string").select(fx.context_money("t", ["buyback"]), fx.context_money("t", ["buyback"], strict_suffix=True)).first()
    assert tuple(near) == (3e6, None)


def test_asof_rules(spark):
    left = spark.createDataFrame([(1, D(2024, 1, 5)), (1, D(2024, 1, 1)), (2, D(2024, 1, 5))], "k int, d date")
    right = spark.createDataFrame([(1, D(2024, 1, 2), 7.0), (1, D(2024, 1, 5), 8.0), (1, D(2024, 1, 9), 9.0)], "k int, d date, v double")
    get = lambda **a: {(x["k"], x["d"].day): x["v"] for x in ts.asof(left, right, "d", "d", ["v"], ["k"], **a).collect()}
    assert get() == {(1, 5): 8.0, (1, 1): None, (2, 5): None}
    assert get(forward=True) == {(1, 5): 8.0, (1, 1): 7.0, (2, 5): None}
    assert get(forward=True, tolerance_days=0)[1, 1] is None


def test_overlay(spark):
    cand = spark.createDataFrame([("A", D(2024, 1, 1), "a1", "split", None, 5), ("A", D(2024, 1, 1), "a2", "split", None, 9), ("A", D(2024, 2, 1), "a3", "dividend", 1.0, 6), ("A", D(2024, 3, 1), "a4", "dividend", 1.0, 7)], "ticker string, announced date, event_id string, family string, amount double, score int")
    over = spark.createDataFrame([("A", D(2024, 2, 1), "buyback", 5.0), ("B", D(2024, 1, 9), "buyback", 2.0)], "ticker string, announced date, family string, amount double")
    firms = spark.createDataFrame([("A", 2), ("B", 3), ("C", 1)], "ticker string, target_count int")
    gone = spark.createDataFrame([("A", D(2024, 3, 1))], "ticker string, announced date")
    rows = sd.apply_overlay(cand, over, firms, gone)
    got = {x["event_id"]: (x["family"], x["score"], x["status"]) for x in rows.collect()}
    assert got == {"a2": ("split", 9, "auto_discovered"), "a3": ("buyback", 6, "manual_enriched"), "B-20240109-buyback": ("buyback", 100, "manual_seed")}
    assert {x["ticker"]: (x["achieved"], x["gap"], x["overflow"]) for x in sd.gap_report(rows, firms).collect()} == {"A": (2, 0, 0), "B": (1, 2, 0), "C": (0, 1, 0)}


def test_market_paths_seed(spark):
    markets = spark.createDataFrame([("m", D(2024, 1, 1), D(2024, 1, 4)), ("none", D(2024, 1, 1), D(2024, 1, 2)), ("late", D(2024, 2, 1), D(2024, 1, 1))], "market_id string, start_d date, end_d date")
    bets = spark.createDataFrame([("m", dt.datetime(2024, 1, 2, 9), 1, 0.3, 0.4), ("m", dt.datetime(2024, 1, 2, 10), 2, 0.4, 0.6), ("m", dt.datetime(2024, 1, 3), 3, 0.6, None), ("late", dt.datetime(2024, 1, 1), 4, 0.1, 0.2)], "market_id string, ts timestamp, bet_id int, prob_before double, prob_after double")
    got = [(x["d"].day, x["probability"]) for x in pn.market_paths(markets, bets).orderBy("d").collect()]
    assert got == [(1, 0.3), (2, 0.6), (3, 0.6), (4, 0.6)]


def test_price_payload_rules(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"symbol": "X", "chart": {"result": [{"timestamp": [0, 86400, 172800], "indicators": {"quote": [{"close": [1.0, null, 3.0]}], "adjclose": [{"adjclose": [0.9]}]}, "events": {"splits": {"0": {"date": 86400, "numerator": 2, "denominator": 1, "splitRatio": "2:1"}}}}]}}')
    path = str(tmp_path / "a.json")
    rows = sources.read_price_payloads(spark, path, multiline=True).orderBy("d").collect()
    assert [(str(x["d"]), x["adjclose"]) for x in rows] == [("1970-01-01", 0.9), ("1970-01-03", 3.0)]
    assert sources.read_price_payloads(spark, path, multiline=True, fall_back=False).count() == 1
    assert sources.read_actions(spark, path, "splits", multiline=True).first()["split_ratio"] == "2:1"


def test_bootstrap_shares_draws(spark):
    rows = [(k, d, r, 0.0) for k in ("a", "b") for d, r in zip(days("2024-01-01", 60), np.sin(np.arange(60)) / 50, strict=True)]
    daily = spark.createDataFrame([(k, d, float(r), x) for k, d, r, x in rows], "strategy string, d date, daily_return double, annual_rate double")
    out = pn.block_bootstrap(daily, ["strategy"], 20, 7).toPandas()
    a, b = (out[out["strategy"] == k].sort_values("resample")["cagr"].to_numpy() for k in ("a", "b"))
    assert len(a) == 20 and np.allclose(a, b)
    ci = pn.intervals(pn.block_bootstrap(daily, ["strategy"], 20, 7), ["strategy"]).toPandas()
    assert (ci["ci_low"] <= ci["ci_high"]).all()


@pytest.mark.parametrize("n", [2, 3, 21, 22, 23, 60, 400])
def test_merged_blocks_equal_the_days_one_by_one(n):
    """Summaries of blocks, merged, against a plain walk over each resample's days."""
    r, free = np.random.default_rng(n).normal(0, 0.02, n), np.full(n, 0.0001)
    starts, block = pn._starts(range(9), n, 21, 5), 21
    got, size = pn.resampled(r, r - free, starts, block), min(block, n - 1)
    for i, row in enumerate(starts):
        days = np.concatenate([np.arange(s, s + size) for s in row])[:n]
        assert len(days) == n and days.max() < n and days.min() > 0
        path = np.r_[0.0, r[days[1:]]]
        equity = np.cumprod(1 + path)
        over = (path - free)[1:]
        later = path[1:]
        sd, down = later.std(ddof=1) if n > 2 else 0.0, np.sqrt((np.minimum(over, 0) ** 2).mean())
        want = {"cagr": equity[-1] ** (252 / (n - 1)) - 1, "max_drawdown": (equity / np.maximum.accumulate(equity)).min() - 1, "sharpe": later.mean() * 252 / (sd * 252**0.5) if sd else 0.0, "sortino": over.mean() * 252 / (down * 252**0.5) if down else 0.0, "cvar_95": np.sort(later)[: max(1, math.ceil(0.05 * (n - 1)))].mean()}
        assert all(got[m][i] == pytest.approx(w, rel=1e-9, abs=1e-12) for m, w in want.items())


def test_bootstrap_has_no_row_for_each_day(spark):
    from tidemark.plans import registry

    out = registry.QUERIES["block_bootstrap_full"](spark, "/root/testdata/sf0.001")
    rows = out.toPandas()
    assert len(rows) == 50 and (rows["ci_low"] <= rows["ci_high"]).all()
    few = registry.QUERIES["block_bootstrap_ci"](spark, "/root/testdata/sf0.001").toPandas().set_index(["symbol", "strategy", "metric"]).sort_index()
    wide = rows.set_index(["symbol", "strategy", "metric"]).sort_index()
    middle = (wide["ci_low"] + wide["ci_high"]) / 2
    assert ((few["ci_low"] <= middle) & (middle <= few["ci_high"])).mean() > 0.9


def test_filings_keep_amounts_near_buyback_words(spark):
    """5 million near a buyback word: 4 points more, and the amount reaches the candidates."""
    from tidemark.plans import study

    rows = [(1, 1, "main.htm", "we buy back the shares for 5 million"), (2, 2, "main.htm", "we buy back the shares for 5")]
    docs = spark.createDataFrame(rows, "filing long, doc_id long, name string, text string")
    filings = spark.sql("SELECT bigint(id) AS filing, '8-K' AS form, DATE '1999-05-03' AS filed, CASE WHEN id = 1 THEN TIMESTAMP '1999-05-03 12:00:00' END AS accepted, '' AS description FROM VALUES (1), (2) AS t(id)")
    v = {"filing_docs": docs, "filings": filings}.__getitem__
    found = study._classified(v).collect()
    got = {r["filing"]: (r["family"], r["score"], r["amount"]) for r in found}
    assert got == {1: ("buyback_authorization", 6, 5e6), 2: ("buyback_authorization", 2, None)}
    assert {r["filing"]: (str(r["announced_ts"]), r["urls"], r["data_tier"]) for r in found} == {1: ("1999-05-03 12:00:00", ["1/main.htm"], "public_proxy"), 2: ("1999-05-03 20:05:00", ["2/main.htm"], "public_proxy")}
    assert [(r["event_id"], r["amount"]) for r in study._candidates(v).collect()] == [("F1", 5e6)]


def test_metrics_table_has_every_symbol(spark):
    from tidemark.plans import registry

    rows = registry.QUERIES["metrics_table"](spark, "/root/testdata/sf0.001").toPandas()
    assert list(rows.columns) == ["symbol", "metric", "hold", "vol_target"] and rows.notna().all().all()
    assert set(rows["symbol"]) == {"AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"} and len(rows) == 5 * len(pn.METRICS)


def test_documents_are_exhibits_and_the_primary(spark):
    names = ["Main.htm", "ex99-4.htm", "ex99-1.htm", "notes.txt", "EX-99_2.html", "99.1.txt", "ex99-3.pdf", "index99.htm"]
    docs = spark.createDataFrame([(1, i, n, "x") for i, n in enumerate(names)], "filing long, doc_id long, name string, text string")
    kept = sorted((r["place"], r["name"]) for r in sd.select_documents(docs).collect())
    assert kept == [(1, "99.1.txt"), (2, "EX-99_2.html"), (3, "ex99-1.htm"), (5, "Main.htm")]


def test_references_titles_and_reasons(spark):
    from tidemark import functions as fx

    row = spark.sql("SELECT '<p>a &amp;lt; b &#233;&hellip;&NotEqual; &amp</p>' AS t, 'dual_announcement' AS c").select(fx.strip_html("t").alias("t"), fx.title_case("c").alias("c")).first()
    assert (row["t"], row["c"]) == ("a &lt; b é…≠ &", "Dual Announcement")
    days = spark.sql("SELECT 'A' AS ticker, DATE '2000-01-03' AS announced UNION ALL SELECT 'B', DATE '2000-01-03'")
    gone = spark.sql("SELECT 'A' AS ticker, DATE '2000-01-03' AS announced, 'halted' AS reason")
    assert [(r["ticker"], r["reason"]) for r in sd.excluded(days, days, gone).collect()] == [("A", "halted")]


def test_references_cut_short_stay(spark, tmp_path):
    """str_strip_html as its SQL: a title that ends inside a reference keeps what is left of it."""
    import duckdb

    from tidemark.plans import registry

    pages = [(1, "<h1>a &amp;&amp</h1>b &am<p>&copy;&amp;lt; c&ampd; &mdash;"), (2, "&amp"), (3, None), (4, "x &notit; &quot;y&quot; &#39;z&#39;")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = dict(con.execute(registry.ORACLES["str_strip_html"]).fetchall())
    assert {r["page_id"]: r["text"] for r in registry.QUERIES["str_strip_html"](spark, str(tmp_path)).collect()} == want


def test_event_windows_of_all_events(spark):
    """No category of events is left out: each event whose day is a trading day has its window."""
    from tidemark.plans import bindings, registry

    v = bindings.Views(spark, "/root/testdata/sf0.01")
    days = v("probs").groupBy("event_id").agg(F.date_sub(F.max("resolution_date"), 200).alias("d"), F.min("category").alias("category"))
    want = days.join(v("mkt"), "d").select("event_id", "category").collect()
    assert {r["event_id"] for r in registry.QUERIES["event_windows"](spark, "/root/testdata/sf0.01").collect()} == {r["event_id"] for r in want}
    assert {"other", "trade"} <= {r["category"] for r in want}


def test_text_helpers_equal_plain_ones_and_take_linear_time(spark):
    """Amounts near words, counts and squeezed text against plain Python, and one long text full of both."""
    import random
    import re
    import time

    from tidemark import functions as fx

    rng = random.Random(5)
    parts = ["the ", "aaa", "a", "aa ", "5 million", "1.5b", "12 345.67.8 ", "\n", "  ", " \t", "\u00a0", "é", "9.", "x" * 7, "2 Mx ", "THE", "\x0b"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(300)]

    def amount(t, words, radius, least):
        best, scale = [], dict(fx.SCALES)
        for w in words:
            for hit in re.finditer(re.escape(w), t.lower()):
                around = t.lower()[max(hit.start() - radius, 0) : hit.end() + radius]
                best += [float(m[1]) * scale.get(m[2], 1.0) for m in re.finditer(rf"{fx._NUMBER}\s*({fx._SUFFIX})?", around, re.ASCII)]
        return max((v for v in best if v >= least), default=None)

    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select(
        "id", fx.context_money("t", ["the", "aa"], 6, 2.0).alias("m"), fx.keyword_count("t", ["The", "aa", "é"]).alias("n"), fx.squeeze("t").alias("s")
    ).collect()
    for r in rows:
        t = texts[r["id"]]
        assert r["m"] == amount(t, ["the", "aa"], 6, 2.0)
        assert r["n"] == sum(t.lower().count(w) for w in ("the", "aa", "é"))
        assert r["s"] == re.sub(r"\s+", " ", t, flags=re.ASCII).strip(" ")
    began = time.time()
    long = spark.range(1).select(F.repeat(F.lit("the plan of 7 "), 60_000).alias("t")).select(fx.context_money("t", ["the"], least=1.0), fx.keyword_count("t", ["the"])).first()
    assert tuple(long) == (7.0, 60_000) and time.time() - began < 30


def test_statement_texts_are_scored_before_the_shuffle(spark):
    docs = spark.sql("SELECT 1L AS filing, id AS doc_id, 'main.htm' AS name, repeat('the und ', 9) AS text FROM range(3)")
    found = sd.select_documents(docs, read={"n": fx.keyword_count("text", ["the"])})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window") :]
    assert window.index("replace(") > 0 and "text#" not in window.split("Project")[0]
    assert [(r["said"], r["n"]) for r in found.collect()] == [(True, 9)] * 3


def test_point_in_time_matches_every_fact(spark):
    """Latest value, total of quarters and trailing sums by running windows equal a scan of all facts of the firm:
    later filings of a quarter, unknown filing days, ties of days, a firm without facts, a NULL as-of day."""
    import datetime as dt
    import random

    rnd, first = random.Random(5), dt.date(2000, 1, 1)
    day = lambda n: first + dt.timedelta(n)
    facts = []
    for symbol in "AB":
        for q in range(12):
            for version in range(rnd.randint(1, 3)):
                filed = None if version == 0 and q % 5 == 0 else day(90 * q + 100 + 40 * version)
                facts.append((symbol, "revenue", day(90 * q), day(90 * q + 89), filed, float(rnd.randint(1, 99))))
    facts.append(("A", "revenue", day(0), None, day(5), 7.0))
    events = [(f"{t}{i}", t, day(rnd.randint(0, 1400))) for t in "ABC" for i in range(25)] + [("A100", "A", day(100 + 40)), ("AN", "A", None)]
    f = spark.createDataFrame(facts, "symbol string, tag string, start_d date, end_d date, filed date, val double")
    e = spark.createDataFrame(events, "event_id string, ticker string, asof date")
    instant = {r["event_id"]: r["x"] for r in sd.with_instant(e, f, "revenue", "x").collect()}
    total = {r["event_id"]: r["x"] for r in sd.with_quarter_total(e, f, "x").collect()}
    spent = {r["event_id"]: r["x"] for r in ts.trailing_sum(e, f.withColumnRenamed("symbol", "ticker"), "asof", "filed", "val", "x", 365, ["ticker"]).collect()}
    assert set(instant) == set(total) == set(spent) == {n for n, _, _ in events}
    for name, ticker, asof in events:
        known = [x for x in facts if asof and x[0] == ticker and x[3] and x[3] <= asof and (x[4] is None or x[4] <= asof)]
        best = max(known, key=lambda x: (x[3], x[4] or dt.date.min), default=None)
        assert instant[name] == (best[5] if best else None)
        last = {}
        for x in sorted(known, key=lambda x: x[4] or dt.date.min):
            last[x[3]] = x[5]
        assert total[name] == (sum(last.values()) if last else None)
        near = [x[5] for x in facts if asof and x[0] == ticker and x[4] and dt.timedelta(0) <= asof - x[4] < dt.timedelta(365)]
        assert spent[name] == (sum(near) if near else None)


def test_events_meet_the_calendar_by_day(spark):
    left = spark.sql("SELECT id, IF(id = 6, NULL, date_add(DATE '2000-01-01', int(id % 5))) AS d FROM range(7)")
    cal = spark.sql("SELECT date_add(DATE '2000-01-01', int(id)) AS day, id AS v FROM range(1, 4, 2)")
    got = {r["id"]: r["v"] for r in ts.on_calendar(left, cal, "d", "day", ["v"], forward=True).collect()}
    assert got == {0: 1, 1: 1, 2: 3, 3: 3, 4: None, 5: 1, 6: None}


def test_feature_panel_plan(spark):
    """No window over all rows: calendars are resolved in tables of their own; the bound tables are read as written."""
    from tidemark.plans import registry

    plan = registry.QUERIES["feature_panel"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") < 20 and "SinglePartition" not in plan and "NestedLoop" not in plan


def test_pairs_by_blocks_equal_pairs_by_day(spark):
    """More blocks and ranges than one, days that some keys lack, NULL values; against a pairwise join."""
    rows = spark.sql("SELECT concat('S', k) AS symbol, date_add(DATE '2000-01-01', int(t)) AS d, IF((k * t) % 11 = 3, NULL, double((k * 7 + t * t * (k + 3)) % 23)) AS x FROM (SELECT id AS k FROM range(14)), (SELECT id AS t FROM range(70)) WHERE (k + t) % 5 > 0")
    got = sorted(map(tuple, st.pair_sums(rows, block=4, days=20).drop("xi").collect()))
    rows.createOrReplaceTempView("pair_rows")
    want = spark.sql("SELECT a.symbol, b.symbol, count(*), sum(a.x), sum(b.x), sum(a.x * a.x), sum(b.x * b.x), sum(a.x * b.x) FROM pair_rows a JOIN pair_rows b ON a.d = b.d AND a.symbol < b.symbol WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1, 2")
    assert got == sorted(map(tuple, want.collect())) and len(got) == 91
    assert st.pair_sums(rows.limit(0)).count() == 0
    every = st.pair_sums(rows, block=4)
    strong = {tuple(r) for r in every.where("n >= 20 AND xi > 0.05").collect()}
    assert 0 < len(strong) < 91
    for days_ in (1 << 14, 20):  # filtered inside the blocks, and after adding up ranges
        some = {(r["left"], r["right"], r["n"]) for r in st.pair_sums(rows, block=4, days=days_, above=0.05, least=20).collect()}
        assert some == {(r[0], r[1], r[2]) for r in strong}
    assert every._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_tags_are_chosen_by_firm_whatever_their_days(spark):
    """The first listed tag with any unit, and its first unit as delivered, hide all others, also where they are newer."""
    t = lambda s, tag, unit, no, filed, val, tax="x": (s, tax, tag, unit, no, D(2019, 1, 1), D(2019, 3, 31), filed, val)
    rows = [
        t("A", "first", "USD", 0, D(2023, 1, 1), 1.0), t("A", "second", "USD", 0, D(2020, 1, 1), 2.0),  # only the later tag counts
        t("B", "second", "EUR", 0, D(2020, 1, 1), 3.0), t("B", "second", "USD", 1, D(2020, 1, 1), 4.0), t("B", "second", "EUR", 0, None, 5.0),
        t("C", "third", "USD", 0, D(2020, 1, 1), 6.0), t("D", "first", "USD", 0, D(2020, 1, 1), 7.0, "other"),
    ]
    facts = spark.createDataFrame(rows, "symbol string, taxonomy string, tag string, unit string, unit_no int, start_d date, end_d date, filed date, val double")
    out = sd.resolve_tags(facts, {"spent": ("x", ("first", "second")), "again": ("x", ("second",))})
    got = {(r["symbol"], r["tag"], r["source_tag"], r["unit"], r["val"]) for r in out.collect()}
    assert got == {("A", "spent", "first", "USD", 1.0), ("A", "again", "second", "USD", 2.0), *((("B", c, "second", "EUR", v)) for c in ("spent", "again") for v in (3.0, 5.0))}
    assert sd.resolve_tags(facts.where("false")).count() == 0


def test_units_keep_their_order_of_arrival(spark, tmp_path):
    row = '[{"start": "2020-01-01", "end": "2020-03-31", "filed": "2020-05-01", "val": 1}]'
    (tmp_path / "f.json").write_text('{"cik": "1", "facts": {"dei": {"T": {"units": {"zeta": %s, "alpha": %s}}}}}' % (row, row))
    assert {(r["unit"], r["unit_no"]) for r in sources.read_facts(spark, str(tmp_path)).collect()} == {("zeta", 0), ("alpha", 1)}


def test_running_quarters_equal_the_join_with_all_facts(spark):
    """Late filings, amendments, filings without a day and firms with few quarters."""
    import random

    r, facts, events = random.Random(4), [], []
    for firm in "ABC":
        for tag in ("u", "v"):
            for q in range(14 if firm != "C" else 2):
                start = D(2018, 1, 1) + dt.timedelta(91 * q)
                for _ in range(r.randint(1, 3)):
                    filed = None if r.random() < 0.1 else start + dt.timedelta(r.choice([60, 100, 130, 200, 500]))
                    facts.append((firm, tag, start, start + dt.timedelta(r.choice([90, 90, 90, 300])), filed, r.random()))
        events += [(f"{firm}{i}", firm, D(2018, 1, 1) + dt.timedelta(r.randrange(1500))) for i in range(40)]
    facts = [f for i, f in enumerate(facts) if all((f[0], f[1], f[3], f[4]) != (g[0], g[1], g[3], g[4]) for g in facts[:i])]
    f = spark.createDataFrame(facts, "symbol string, tag string, start_d date, end_d date, filed date, val double")
    e = spark.createDataFrame(events, "event_id string, ticker string, asof date")
    key = lambda x: (x["event_id"], x["tag"], x["k"], x["end_d"], round(x["val"], 9))
    known = sd.quarters_known(e, f)
    assert {key(x) for x in known.collect()} == {key(x) for x in sd.pit_quarters(e, f).where("k <= 5").collect()}
    assert "SortMergeJoin" not in known._jdf.queryExecution().toString() and sd.latest_quarters(f.where("false")).count() == 0


def test_text_by_source_preference(spark):
    """Releases before primary documents, periodic filings by their primary document, empty ones skipped."""
    filings = [(1, "A", "8-K", D(2020, 1, 1)), (2, "A", "8-K", D(2020, 2, 1)), (3, "A", "10-Q", D(2020, 3, 1)), (4, "A", "8-K", D(2020, 4, 1)), (5, "A", "8-K", D(2020, 4, 1)), (6, "B", "10-Q", D(2020, 1, 1))]
    docs = [
        (1, 1, "ex99-1.htm", "press_release", ""), (1, 2, "ex99-2.htm", "press_release", "one"), (1, 3, "main.htm", "primary_filing", "x"),
        (2, 1, "ex99-1.htm", "press_release", ""), (2, 2, "main.htm", "primary_filing", "four"),
        (3, 1, "ex99-1.htm", "press_release", "x"), (3, 2, "main.htm", "primary_filing", "sixsix"),
        (4, 1, "main.htm", "primary_filing", ""), (5, 1, "main.htm", "primary_filing", "fiveseven"), (6, 1, "main.htm", "primary_filing", ""),
    ]
    texts = sd.filing_texts(spark.createDataFrame(filings, "filing long, ticker string, form string, filed date"), spark.createDataFrame(docs, "filing long, place int, name string, source_type string, text string"), F.length("text"))
    got = {r["d"]: (r["text_score"], r["text_source"]) for r in texts.collect()}
    assert got == {D(2020, 1, 1): (3, "press_release"), D(2020, 2, 1): (4, "primary_filing"), D(2020, 3, 1): (6, "periodic_filing"), D(2020, 4, 1): (9, "primary_filing")}
    events = spark.createDataFrame([(1, "A", D(2020, 3, 15)), (2, "A", D(2020, 7, 30)), (3, "A", D(2020, 7, 31)), (4, "B", D(2020, 2, 1)), (5, "A", None)], "event_id long, ticker string, asof date")
    out = {r["event_id"]: (r["text_score"], r["text_source"], r["text_day"]) for r in sd.with_text(events, texts).collect()}
    assert out == {1: (6, "periodic_filing", D(2020, 3, 1)), 2: (9, "primary_filing", D(2020, 4, 1)), 3: (None, "missing", None), 4: (None, "missing", None), 5: (None, "missing", None)}


def test_named_pages_alone_are_read(spark, tmp_path):
    """Pages with names of all kinds, one that is not named, one that is missing; the first of a number stays."""
    import json

    page = lambda *n: {"accessionNumber": [x for x, _ in n], "filingDate": ["2020-01-02"] * len(n), "form": [f for _, f in n], "acceptanceDateTime": [None] * len(n), "primaryDocument": ["d"] * len(n), "primaryDocDescription": [""] * len(n), "reportDate": [None] * len(n)}
    folder = tmp_path / "pages x"
    folder.mkdir()
    main = [{"cik": "1", "filings": {"recent": page(("a", "main"), ("b", "main")), "files": [{"name": "p+1 %.json"}, {"name": "gone.json"}, {"name": "p2.json"}]}}, {"cik": "2", "filings": {"recent": page(("a", "other"))}}]
    (tmp_path / "main.json").write_text("\n".join(map(json.dumps, main)))
    for name, body in {"p+1 %.json": page(("b", "one"), ("c", "one")), "p2.json": page(("c", "two"), ("d", "two")), "unnamed.json": page(("e", "x"))}.items():
        (folder / name).write_text(json.dumps(body))
    read = lambda path: {(r["cik"], r["accession_number"]): r["form"] for r in sources.read_filing_history(spark, str(path), str(folder)).collect()}
    assert read(tmp_path / "main.json") == {("1", "a"): "main", ("1", "b"): "main", ("1", "c"): "one", ("1", "d"): "two", ("2", "a"): "other"}
    (tmp_path / "lone.json").write_text(json.dumps(main[1]))
    assert read(tmp_path / "lone.json") == {("2", "a"): "other"}


def test_stored_runs_are_read_back(spark, tmp_path):
    """Numbers of the summary only; drawdowns by month from the curves, where there are curves."""
    (tmp_path / "summary.json").write_text('{"a/hold": {"cagr": 0.1, "max_drawdown": -0.5, "note": "x", "none": null}, "a/timed": {"cagr": 0.25, "max_drawdown": -0.25}, "b/timed": {"cagr": 1, "max_drawdown": -1}}')
    summary = sources.read_summary(spark, str(tmp_path / "summary.json"))
    curve = spark.createDataFrame([("a/hold", D(2020, m, d), e) for m, d, e in ((1, 5, 9.0), (1, 31, 4.0), (2, 3, 1.0), (2, 28, 3.0), (3, 1, 5.0))] + [("c/hold", D(2020, 1, 1), 1.0)], "strategy string, d date, equity double")
    got = {(r["strategy"], r["metric"]): r["value"] for r in pn.stored_run(summary, curve).collect()}
    assert got == {
        ("a/hold", "cagr"): 0.1, ("a/hold", "max_drawdown"): -0.5, ("a/hold", "max_drawdown_daily"): -0.5, ("a/hold", "max_drawdown_monthly"): -0.25,
        ("a/timed", "cagr"): 0.25, ("a/timed", "max_drawdown"): -0.25, ("a/timed", "cost_of_caution"): pytest.approx(0.15), ("b/timed", "cagr"): 1.0, ("b/timed", "max_drawdown"): -1.0,
    }
    sources.write_summary(summary, str(tmp_path / "again"))
    assert sorted(map(tuple, sources.read_summary(spark, str(tmp_path / "again")).collect())) == sorted(map(tuple, summary.collect()))


def test_bytes_that_are_no_text_are_left_out(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"caf\xc3\xa9 \xff\xfe ok\n")
    assert sources.read_documents(spark, str(tmp_path)).first()["text"] == "caf\u00e9  ok\n"


def _series(spark, n):
    """Two keys, one of them with most rows, and NULL keys; ties of days, NULL values."""
    return spark.sql(f"SELECT IF(id % 11 = 3, 'b', IF(id % 13 = 5, NULL, 'a')) AS k, date_add(DATE '2000-01-01', int(id / 3)) AS d, id, IF(id % 7 = 2, NULL, double(hash(id) % 100) / 1e4) AS x, double(abs(hash(id)) % 5) / 4 AS position FROM range({n})")


@pytest.mark.parametrize("reverse", [False, True])
def test_scan_equals_windows_over_whole_keys(spark, reverse):
    from pyspark.sql import Window

    rows = _series(spark, 900)
    way = [F.desc_nulls_last, F.desc_nulls_last] if reverse else [F.asc_nulls_first, F.asc_nulls_first]
    w = Window.partitionBy("k").orderBy(way[0]("d"), way[1]("id"))
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("y", F.coalesce("x", F.lit(0.0)))
    got = ts.scan(filled, ["k"], ["d", "id"], {"s": ("sum", "id"), "m": ("max", "y"), "l": ("last", "x"), "p": ("lag", "id", 1), "q": ("lag", "x", 40)}, 16, reverse)
    want = filled.withColumns({"s": F.sum("id").over(up), "m": F.max("y").over(up), "l": F.last("x", ignorenulls=True).over(up), "p": F.lag("id", 1).over(w), "q": F.lag("x", 40).over(w)})
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.where("false").count() == 0 and ts.scan(rows.where("false"), ["k"], "d", {"s": ("sum", "id")}).count() == 0


def test_long_series_equal_plain_windows(spark):
    rows = _series(spark, 600).where("k IS NOT NULL").withColumnRenamed("x", "ret").dropDuplicates(["k", "d"])
    key = lambda df, *c: sorted((r["k"], r["d"], *(None if r[x] is None else round(r[x], 12) for x in c)) for r in df.collect())
    assert key(ts.simulate(rows, ["k"], ranges=8), "daily_return", "equity") == key(ts.simulate(rows, ["k"]), "daily_return", "equity")
    hit = F.col("position") > 0.3
    assert sorted(map(tuple, ts.longest_run(rows, ["k"], hit, ranges=8).collect())) == sorted(map(tuple, ts.longest_run(rows, ["k"], hit).collect()))
    plain = rows.withColumn("drawdown", ts.drawdown("position", ["k"]))
    assert key(ts.falls(rows, ["k"], "position", ranges=8), "drawdown") == key(plain, "drawdown")
    some = rows.where("id % 5 = 0").select("k", F.col("d").alias("t"), F.col("id").alias("v"))
    for forward in (False, True):
        a, b = (ts.asof(rows.select("k", "d"), some, "d", "t", ["v"], ["k"], forward=forward, tolerance_days=20, ranges=r) for r in (8, None))
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_scan_spreads_one_key(spark):
    """One key's rows end in many partitions, none with more than a few ranges."""
    rows = spark.range(0, 200_000, 1, 8).select(F.lit("one").alias("k"), F.col("id").alias("d"), (F.col("id") % 10).alias("x"))
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    was = {k: spark.conf.get(k) for k in conf}
    try:
        for k, value in conf.items():
            spark.conf.set(k, value)
        out = ts.scan(rows, ["k"], "d", {"s": ("sum", "x")}, 64)
        # One exchange by range for the rows, one for the totals of their ranges, which are summed before it; the last moves totals.
        assert out._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(range_key") == 3
        parts = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max("s").alias("s")).collect()
    finally:
        for k, value in was.items():
            spark.conf.set(k, value)
    assert sum(r["n"] for r in parts) == 200_000 and max(r["n"] for r in parts) < 50_000 and max(r["s"] for r in parts) == 900_000


@pytest.mark.parametrize("p", [0.0, 0.025, 0.5, 0.9, 1.0])
def test_percentile_is_exact(spark, p):
    rows = spark.sql("SELECT IF(id < 30000, 'long', IF(id < 30003, 'few', IF(id = 30003, NULL, IF(id < 30010, 'same', 'none')))) AS k, IF(id >= 30010, NULL, IF(id BETWEEN 30004 AND 30009, 1.5D, double(hash(id) % 1000000) / 7)) AS v FROM range(30012)")
    want = {r["k"]: r["x"] for r in rows.groupBy("k").agg(F.percentile("v", p).alias("x")).collect()}
    for accuracy in (10_000, 50):
        got = {r["k"]: r["x"] for r in ts.percentile(rows, ["k"], "v", p, "x", accuracy).collect()}
        assert set(got) == set(want) and all(got[k] == pytest.approx(v) if v is not None else got[k] is None for k, v in want.items())


def test_percentile_gathers_no_long_key(spark, monkeypatch):
    """No task gets all rows of a key, whatever the optimizer thinks of sizes; many keys are split into long and short ones."""
    rows = spark.sql("SELECT CASE WHEN id % 10 = 0 THEN NULL WHEN id % 10 < 8 THEN -1L ELSE id % 100 END AS n, id % 7 / 2D AS v FROM range(5000)")
    want = {r["n"]: r["x"] for r in rows.groupBy("n").agg(F.percentile("v", 0.3).alias("x")).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ts.percentile(rows, ["n"], "v", 0.3, "x")
        assert "BroadcastHashJoin" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "SortMergeJoin" not in plan
        assert {r["n"]: r["x"] for r in found.collect()} == want
        monkeypatch.setattr(ts, "FEW_KEYS", 3)
        monkeypatch.setattr(ts, "HOT_ROWS", 400)
        assert {r["n"]: r["x"] for r in ts.percentile(rows, ["n"], "v", 0.3, "x").collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
