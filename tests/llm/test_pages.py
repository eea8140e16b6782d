"""Extraction from generated pages with known articles, and links between addresses, with odd markup."""

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import html, queries, urls

PROSE = "the quick story of the river and the town is that it was for all of us to see and to keep in the mind as we go on"
#: Sentences of five languages; no stop word of the last two is listed.
SENTENCES = {
    "en": ["The town woke up slowly and the river was still in the early light.", "It is said that all of the boats had left for the sea before the bells rang.", "We walked to the market with a basket and came back with bread, fish and flowers."],
    "de": ["Die Stadt wurde langsam wach und der Fluss war noch still im ersten Licht.", "Es heißt, dass alle Boote schon vor dem Läuten der Glocken auf dem Meer waren.", "Wir gingen mit einem Korb auf den Markt und kamen mit Brot und Fisch zurück."],
    "fr": ["La ville se réveillait et le fleuve était encore calme dans la lumière du matin.", "On dit que tous les bateaux sont partis pour la mer avant que les cloches sonnent.", "Nous sommes allés au marché avec un panier et nous avons rapporté du pain et des fleurs."],
    "pl": ["Miasto budziło się powoli, a rzeka była jeszcze spokojna w pierwszym świetle poranka.", "Podobno wszystkie łodzie wypłynęły na morze, zanim zabrzmiały dzwony starego kościoła.", "Poszliśmy na targ z koszykiem i wróciliśmy z chlebem, rybami oraz kwiatami."],
    "ru": ["Город просыпался медленно, и река была ещё тиха в первом утреннем свете.", "Говорят, что все лодки ушли в море раньше, чем зазвонили колокола старой церкви.", "Мы пошли на рынок с корзиной и вернулись с хлебом, рыбой и цветами."],
}


def page(seed: int, lang: str) -> tuple[str, str]:
    """A page and its article: layouts differ, and forms, menus, notices, adverts and comments stand around."""
    r = random.Random(seed)
    paragraphs = [" ".join(r.choice(SENTENCES[lang]) for _ in range(r.randint(2, 5))) for _ in range(r.randint(2, 6))]
    body = "".join(f"<p>{p}</p>\n" for p in paragraphs)
    wrap = r.choice(["<article>{}</article>", "<main>{}</main>", "<div class='post-content'>{}</div>", "<div id=body-no-sidebar>{}</div>", "<form method=post><div>{}</div></form>"])
    menu = "<nav><ul>" + "".join(f"<li><a href='/{i}'>Menu {i}</a></li>" for i in range(6)) + "</ul></nav>"
    extra = ["<div class='cookie-notice'><p>We use cookies to make the site work and to see how it is used by all of you, as the law asks of us.</p></div>", "<section class='comments'><h3>Comments</h3><p>I was there and it is all true, the town is as lovely as they say it is in the story.</p></section>", "<div class=sidebar><a href='/a'>Read this</a> <a href='/b'>And that</a></div>", "<div class='ad-slot'>Buy the best of the best lamps in the land, now with free delivery to all of the towns.</div>", "<footer><p>All rights of this site are with us and it is not to be copied in any way, as is the law of the land.</p></footer>", "<script>var x = '<p>the and of to</p>';</script>"]
    r.shuffle(extra)
    cut = r.randint(0, len(extra))
    return f"<!doctype html><html><head><title>T</title><style>p {{}}</style></head><body>{menu}{''.join(extra[:cut])}{wrap.format(body)}{''.join(extra[cut:])}</body></html>", " ".join(paragraphs)


@pytest.mark.parametrize("lang", sorted(SENTENCES))
def test_known_articles(lang):
    """Words of the article found, and found words that are the article's, over 40 pages a language."""
    from collections import Counter

    both = want = got = 0
    for seed in range(40):
        source, article = page(seed, lang)
        a, b = Counter(article.split()), Counter(html.main_text(source).split())
        both, want, got = both + (a & b).total(), want + a.total(), got + b.total()
    assert both > 0.98 * want and both > 0.98 * got


def test_prose_is_not_lost_to_what_is_around_it():
    for source in (f"<html><body><form><p>{PROSE}</p></form></body></html>", f"<div class='comments-off'><p>{PROSE}</p></div>", f"<div id='ad-free-page'><p>{PROSE}</p></div>", f"<div class='related'><p>{PROSE}</p></div>"):
        assert html.main_text(source) == PROSE
    assert PROSE in html.main_text(f"<article><h1>Title</h1><div class='notice'><p>{PROSE}</p></div></article>")
    russian, japanese = " ".join(SENTENCES["ru"] * 3), "昨日、私は友達と山に登りました。天気がとても良かったです。" * 20
    assert html.main_text(f"<p>{russian}</p>") == russian and html.main_text(f"<p>{japanese}</p>") == japanese


def test_notices_beside_an_article_go():
    for around in ("div class=comments", "form", "div class='cookie-banner'", "aside", "div class=advert"):
        assert html.main_text(f"<p>{PROSE}</p><{around}><p>it is the other story of the town and the river</p></{around.split()[0]}>") == PROSE


@pytest.mark.parametrize("source", ['<a b=">"' * (1 << 17), "<div class='" + "a_" * (1 << 19) + "'>x</div>", "<p class=\"" * (1 << 17), "<div class=ads>" * 30_000 + "<h1>x</h1>" * 30_000, "<div class=sidebar>" * 40_000 + f"<p>{PROSE}</p>" * 2000])
def test_time_grows_with_the_page(source):
    began = time.time()
    html.main_text(source)
    assert time.time() - began < 10


LINKS = [
    ("http://a.com/1", "<link data-href='http://x.net/' rel=canonical href='http://b.net/1'>"),
    ("http://a.com/2", "<script>s = '<link rel=canonical href=http://b.net/2>'</script>"),
    ("http://a.com/3", "<style><link rel=canonical href=http://b.net/2></style><!-- <link rel=canonical href=http://b.net/2> -->"),
    ("http://a.com/4", "<LINK REL='nofollow Canonical' HREF=\"http&#58;//b.net&#x2f;4?a=1&amp;b\">"),
    ("http://a.com/5", "<link rel=canonical-x href=http://b.net/5><link title='rel=canonical' href=http://b.net/5>"),
    ("http://a.com/6", "<meta http-equiv=Refresh content=\"0; URL='http://b.net/6'\">"),
    ("http://a.com/7", "<base href='http://b.net/d/'><link href=x rel='canonical'>"),
    ("http://a.com/8", "<link rel=canonical><link rel=canonical href=' http://b.net/8 '><link rel=canonical href=http://c.org/>"),
    ("http://a.com/9", None),
    ("http://a.com/10", "<link " * 1000 + "rel=canonical href=http://b.net/10>"),
    ("http://a.com/11", "<link rel=canonical href=//b.net/&#233;>"),
]
EDGES = {"1": "b.net/1", "4": "b.net/4?a=1&b", "6": "b.net/6", "7": "b.net/d/x", "8": "b.net/8", "10": "b.net/10", "11": "b.net/é"}


def test_links_of_pages(spark):
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(LINKS)], "page_id long, url string, html string")
    assert {r["a"].rpartition("/")[2]: r["b"] for r in urls.page_links(pages).collect()} == EDGES
    rows = urls.filter_urls(pages).toPandas()
    judged = {r.page_id + 1: r.verdict for r in rows.itertuples()}
    assert judged == {i: "block" if str(i) in EDGES else "allow" for i in range(1, 12)}
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = con.execute(queries.ORACLES["op6_urls"]).df()
    cells = lambda df: sorted(tuple("" if x is None or x != x else x for x in r) for r in df[["page_id", "host", "path", "rule", "verdict"]].itertuples(index=False))
    assert cells(rows) == cells(want)


def test_urls_of_odd_tables(spark):
    odd = spark.createDataFrame([(1, None, "x", "y"), (1, None, None, "y"), (2, "no scheme", "<link rel=canonical href=http://b.net/>", "y"), (3, "HTTP://Sub.Example.NET/en/a?b#c", None, "y"), (3, "HTTP://Sub.Example.NET/en/a?b#c", None, "y"), (None, "http://a.com/" + "x" * 100_000, "<p>" * 100_000, "y"), (5, "http:///x", "", "y")], "page_id long, url string, html string, node string")
    odd = odd.select("*", *[F.lit("z").alias(c) for c in ("host", "path", "rule", "verdict", "alias", "u", "v")])
    rows = urls.filter_urls(odd).collect()
    assert len(rows) == 7
    assert sorted((r["host"], r["path"], r["verdict"]) for r in rows if r["page_id"] == 3) == [("sub.example.net", "/en/a", "allow")] * 2
    assert all((r["host"], r["path"], r["verdict"]) == ("", "", "allow") for r in rows if r["page_id"] in (1, 2))
    assert urls.filter_urls(odd.where("false")).count() == 0


def test_long_pages_of_open_tags_end(spark):
    pages = spark.createDataFrame([(i, f"http://a.com/{i}", part * 100_000 + "canonical refresh") for i, part in enumerate(("<link ", "<link a=\"", "<script ", "<!-- ", "<meta a='>", "<script>", "<link a=b "))], "page_id long, url string, html string")
    began = time.time()
    assert urls.page_links(pages).count() == 0
    assert time.time() - began < 60
