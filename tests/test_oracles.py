"""Every query with SQL gives the same rows in Spark and DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tidemark.plans import registry, study

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x != x:
            return "NULL"
        return f"{x:.5g}" if isinstance(x, float) else str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(cell(x) for x in row) for row in df.itertuples(index=False))


#: The features share one chain of joins, which a few of its results cover.
STUDY = {f.__name__ for f in vars(study).values() if callable(f) and getattr(f, "__module__", "") == study.__name__}
FEATURES = STUDY | {"market_cap", "trailing_yield", "authorization_balance", "capital_amplitude", "vol_amplitude", "text_score", "relative_strength", "skew_score", "market_state", "interference_index"}
COVER = {"feature_panel", "fixed_effect_residuals", "firm_effects", "arr_tag_preference", "authorization_balance", "text_score", "decay_law", "event_returns", "post_event_drawdown", "reversion_fit", "apply_overlay", "classify_filings", "robustness_splits", "model_benchmarks", "out_of_sample", "fixed_effect_ols", "clustered_se", "wild_cluster_bootstrap", "comovement_edges", "ttm_sum", "market_cap"}


@pytest.mark.parametrize("name", sorted(set(registry.ORACLES) - FEATURES | COVER))
def test_same_rows(spark, duck, name):
    assert normal(registry.QUERIES[name](spark, SF).toPandas()) == normal(duck.execute(registry.ORACLES[name]).df())


def test_tail_screen_rates(spark):
    """The share of each tier is that of its rows, whose order is by drawdown."""
    rows = registry.QUERIES["tail_screen"](spark, SF).toPandas()
    assert len(rows) and rows["drawdown"].dropna().is_monotonic_increasing
    assert ((rows["drawdown"] <= -0.01) == rows["flagged"]).all()
    assert (rows.groupby("tier")["flagged"].mean() - rows.groupby("tier")["hit_rate"].first()).abs().max() < 1e-6


def test_forest_scores_the_rows_after_the_cut_off(spark):
    rows = registry.QUERIES["forest_benchmark"](spark, SF).toPandas()
    assert len(rows) and rows.notna().all().all() and rows["event_id"].is_unique
    assert rows["predicted"].between(-0.5, 0.5).all() and rows["predicted"].nunique() > 1


def test_prior_run_by_strategy(spark):
    rows = registry.QUERIES["scan_prior_run"](spark, SF).toPandas()
    assert len(rows) and rows.notna().any().all() and not rows.duplicated().any()


def test_dimensions_regimes_and_tails_by_numpy(spark):
    """Spectral dimension of the features of each firm, and what is made of it, from the rows of other queries."""
    import numpy as np

    rows = {n: registry.QUERIES[n](spark, SF).toPandas() for n in ("feature_panel", "effective_dimension", "reversion_fit", "reversion_regimes", "post_event_drawdown", "tail_screen")}
    f = rows["feature_panel"]
    f = f[f["capital_amplitude"].notna() & f["vol_amplitude"].notna()]
    drivers = np.array([f["capital_amplitude"], f["vol_amplitude"], f["intensity"].fillna(0.0), 1 - f["skew"].where(f["skew"].notna() & (f["skew"] != 0), 0.5), f["vix"].fillna(0.0) - 100 * f["state"].fillna(0.0)])
    dims, tiers = {}, {}
    for ticker in set(f["ticker"]):
        x = drivers[:, (f["ticker"] == ticker).to_numpy()]
        if x.shape[1] > 1:
            with np.errstate(invalid="ignore"):
                r = np.nan_to_num(np.corrcoef(x))
            np.fill_diagonal(r, 1.0)
            w = np.maximum(np.linalg.eigvalsh(r), 0) / 5
            dims[ticker] = float(2 ** -sum(v * np.log2(v) for v in w if v > 1e-15))
    got = rows["effective_dimension"].set_index("ticker")
    assert set(got["dimension"].dropna().index) == set(dims) and len(dims) >= 4
    for ticker, d in dims.items():
        assert got.loc[ticker, "dimension"] == pytest.approx(d, abs=0.02) and got.loc[ticker, "total"] == pytest.approx(1.0)
        d = got.loc[ticker, "dimension"]
        tiers[ticker] = next((name for name, top in (("low", 2.75), ("moderate", 3.3), ("elevated", 4.0)) if d < top), "high")
        assert got.loc[ticker, "tier"] == tiers[ticker]

    panel, fits = rows["feature_panel"].set_index("event_id"), rows["reversion_fit"]
    want = {}
    for fit in fits[fits["qualified"]].itertuples():
        row = panel.loc[fit.event_id] if fit.event_id in panel.index else None
        if row is None or row["angle"] != row["angle"] or row["ticker"] not in dims:
            continue
        place = 0 if got.loc[row["ticker"], "dimension"] < 3 else 1 if got.loc[row["ticker"], "dimension"] < 4 else 2
        band, names = next((b, n) for b, n, top in (("aligned", ("A+", "A", "A-"), 45), ("mixed", ("B+", "B", "B-"), 90), ("opposed", ("C+", "C", "D"), 181)) if row["angle"] < top)
        want[fit.event_id] = (band, names[place], pytest.approx(2.303 * fit.tau, abs=1e-4))
    assert len(want) > 5 and {r.event_id: (r.band, r.grade, r.t90) for r in rows["reversion_regimes"].itertuples()} == want

    falls, screen = rows["post_event_drawdown"].set_index("event_id")["drawdown"], rows["tail_screen"].set_index("event_id")
    assert set(screen.index) == {e for e in falls.index if e.rpartition("-")[0] in set(got.index)}
    assert ((screen["drawdown"] == falls.reindex(screen.index)) | screen["drawdown"].isna()).all()
    assert (screen["flagged"] == (screen["drawdown"] <= -0.01)).all() and set(screen["tier"]) <= {*tiers.values(), "insufficient_data"}
