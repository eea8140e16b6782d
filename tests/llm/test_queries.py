"""The queries opN_<name> themselves: against their SQL where there is some, else against plain accounts."""

import itertools
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest

from tidemark.llm import decontam, html, packing, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}


def rows(df):
    df = df[sorted(df.columns)]
    cell = lambda x: "NULL" if pd.isna(x) else str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_sharding_digest(spark, docs):
    out = queries.op1_sharding(spark, SF).toPandas()
    assert sorted(out["doc_id"]) == sorted(docs) and set(out["law"]) == {"rows"}
    for r in out.itertuples():
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    sizes = out.groupby("shard").size()
    assert set(sizes.index) <= set(range(40)) and sizes.max() - (sizes.min() if len(sizes) == 40 else 0) <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))


def test_packing_digest(spark, docs):
    tokens, out = packing._tokens(packing.VOCABULARY), queries.op3_packing(spark, SF).toPandas()
    for doc, g in out.sort_values("start").groupby("doc_id"):
        ids = np.array([*tokens.model.encode(docs[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        assert list(g["start"]) == [0, *np.cumsum(g["length"])[:-1]] and set(g["doc_tokens"]) == {len(ids)}
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(g["start"], g["length"], strict=True)] == list(g["ids_crc32"])
    assert sorted(set(out["doc_id"])) == sorted(docs) and out.groupby("sequence_id")["length"].sum().max() <= 2048


def test_capital_sigma_and_added_tokens():
    tokens = packing._tokens(packing.VOCABULARY)
    for t in ("ΟΔΟΣ λόγος", "ΣΑΣ Σ ΑΣ.", "İSTANBUL ıI_", "a.'s dog'sx", "<|EndOfText|> x<|endoftext|>y."):
        assert tokens.text(t) == np.array(tokens.model.encode(t, add_special_tokens=False).ids, tokens.dtype).tobytes()


@pytest.mark.parametrize("name", ["op4_toxicity", "op9_language"])
def test_scores(spark, docs, name):
    out = queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(out["doc_id"]) == sorted(docs) and out["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(out["doc_id"], out["held_out"], strict=True))
    if name == "op9_language":
        lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
        held = out[out["held_out"] & (out["lang_pred"] != "und")]
        known = [(lang[i], p) for i, p in zip(held["doc_id"], held["lang_pred"], strict=True) if lang[i]]
        assert sum(a == b for a, b in known) >= 0.95 * len(known)


def test_extraction_digest(spark):
    out = queries.op5_html(spark, SF).toPandas()
    pages = {r["page_id"]: r for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    assert len(out) == len(pages)
    for r in out.itertuples():
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id]["url"], html.main_text(pages[r.page_id]["html"]), len(r.text))


def test_language_model_counts(spark, docs):
    out = queries.op7_class_lm(spark, SF).toPandas().set_index("doc_id")
    assert sorted(out.index) == sorted(docs) and (out["score"] < 0).all()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    size = {i: len((t or "").translate(low).split()) + 1 for i, t in docs.items() if (t or "").isascii()}
    assert all(out.loc[i, "n_tokens"] == n for i, n in size.items())


PROSE = "the quick story of the river and the town is that it was for all of us to see and to keep in the mind as we go on"


def test_marks_do_not_hide_articles():
    for page in (f"<div class='content with-sidebar page-header'><p>{PROSE}</p></div>", f"<div class='side-by-side'><article><p>{PROSE}</p></article></div>", f'<p title="it"s">{PROSE}</p>'):
        assert html.main_text(page) == PROSE
    assert PROSE in html.main_text(f"<main><p>Short.</p></main><div><p>{PROSE}</p></div>")


def test_broken_pages_end():
    for page in ("<a " * 300_000, "< " * 300_000, '<a b="' * 100_000 + ">", "<script>" * 100_000, '<div class="sidebar">t' * 50_000 + "</p>" * 50_000):
        html.main_text(page)


def test_extraction_of_odd_tables(spark):
    some = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (2, f"<p>{PROSE}</p>", "y"), (2, f"<p>{PROSE}</p>", "y")], "page_id long, html string, text string")
    assert sorted((r["page_id"], r["text"]) for r in html.extract(some).collect()) == [(1, ""), (1, ""), (2, PROSE), (2, PROSE)]
    assert html.extract(some.where("false")).count() == 0


def test_overlaps_recall_by_substitutions(spark):
    """Every pattern of substitutions that the rule allows, in items of 5 to 16 tokens, is found."""
    made, items = [], []
    for n in (5, 7, 10, 12, 13, 14, 16):
        words = [f"w{n}x{i}" for i in range(n)]
        items.append((n, " ".join(words)))
        allowed = n * 20 // 100 if n < 13 else 2
        for k in range(allowed + 1):
            for gone in itertools.combinations(range(n), k):
                made.append((len(made), n, "lead in " + " ".join("other" if i in gone else w for i, w in enumerate(words)) + " and out"))
    table = spark.createDataFrame(made, "doc_id long, n long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.overlaps(table, bench).collect()}
    assert found == {(i, n) for i, n, _ in made}
