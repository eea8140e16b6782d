"""Operators on small fixtures against plain versions, and the edge cases that they define."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import classlm, decontam, html, langid, minhash, packing, quality, sharding, toxicity, urls
from tidemark.llm.common import components, fold, shingle_set, word_hashes

WORDS = "river stone cloud lamp forest wind table garden window silver paper bridge morning orange village winter letter summer honest quiet".split()
TYPES = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def table(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], TYPES)


@pytest.fixture(scope="module")
def edge(spark):
    """NULLs in any column, empty and blank texts, ties, repeated rows, and columns with clashing names."""
    long = prose(1, 20_000)
    rows = [(1, "", "en", "a", 0), (2, None, None, None, None), (3, " \n\t ", "en", "a", 4), (None, prose(2, 60), "en", None, 1), (4, long, "en", "b", 1), (5, long, "en", "b", 1), (6, prose(3, 70), "de", "a", 1), (6, prose(3, 70), "de", "a", 1), (7, "é ü ñ 語", "fr", "c", 1)]
    return spark.createDataFrame(rows, TYPES).select("*", *[F.lit("x").alias(c) for c in ("row", "w", "h", "n_words", "token", "id", "shard", "lang_pred", "chunk", "node")])


@pytest.fixture(scope="module")
def empty(edge):
    return edge.where("false")


def test_word_hashes_do_not_depend_on_blocks():
    text = prose(5, 400_000).encode()
    assert len(text) > 1 << 20
    assert len(word_hashes(text)) == 400_000
    assert (word_hashes(text)[:50] == word_hashes(text[:500])[:50]).all()
    assert (word_hashes(b"Ab \x0b\x0c cD") == word_hashes(b"aB cd")).all()
    assert len(shingle_set(word_hashes(b"one two"), 4)) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near(texts, size, percent):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def test_near_duplicates_match_brute_force(spark):
    r, texts = random.Random(4), []
    for g in range(25):
        base = prose(g, r.choice([3, 12, 60, 150])).split()
        for _ in range(r.choice([1, 2, 4])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                w[r.randrange(len(w))] = r.choice(WORDS) + "x"
            texts.append(" ".join(w))
    want, sizes = near(texts, 4, 80)
    got = {x["doc_id"]: x for x in minhash.near_duplicates(table(spark, texts), shingle=4).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes


def test_near_duplicates_in_one_large_group(spark, monkeypatch):
    """Small blocks: the group is dealt to many of them, and outsiders of the canopy meet the whole list."""
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 8)
    r, base, texts = random.Random(9), prose(77, 120).split(), []
    for i in range(60):
        w = list(base)
        for _ in range(r.randrange(0, 14)):
            w[r.randrange(len(w))] = f"new{i}"
        texts.append(" ".join(w))
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(table(spark, texts), shingle=4).collect()}
    assert [got[i] for i in range(60)] == near(texts, 4, 80)[0]


def test_near_duplicates_of_five_thousand_copies(spark):
    """One component, though no two texts are equal; texts that share a third of theirs stay alone."""
    base = prose(5, 60)
    texts = [f"{base} end{i}" for i in range(5000)] + [f"{base} " + prose(10_000 + i, 130) for i in range(40)]
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(table(spark, texts), shingle=4).collect()}
    assert [got[i] for i in range(5000)] == [0] * 5000
    assert [got[i] for i in range(5000, 5040)] == list(range(5000, 5040))


def test_match_threshold():
    t = minhash.match_threshold(0.8)
    tail = sum(math.comb(64, k) * 0.8**k * 0.2 ** (64 - k) for k in range(t))
    assert tail <= minhash.MISS < tail + math.comb(64, t) * 0.8**t * 0.2 ** (64 - t)


def test_near_duplicates_edges(edge, empty):
    rows = minhash.near_duplicates(edge).collect()
    assert len(rows) == 9 and minhash.near_duplicates(empty).count() == 0
    by = {x["doc_id"]: x for x in rows}
    assert by[5]["component_id"] == 4 and not by[5]["kept"] and by[1]["kept"] and by[2]["n_shingles"] == 0
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert minhash.filter_near_duplicates(edge).columns == edge.columns


def test_quality_matches_plain_version(spark):
    texts = [prose(1, 80), "a b c a b c a b c " * 20, "x\nx\n \ny\nx", "one|two " * 30, "", None]
    for row in quality.quality(table(spark, texts)).collect():
        t = texts[row["doc_id"]] or ""
        w = t.split()
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hot = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if x.strip()]
        assert (row["n_words"], row["word_chars"], row["n_repeat_words"], row["n_dup_lines"]) == (len(w), sum(map(len, w)), len(hot), len(lines) - len(set(lines)))
        assert row["base_failed"] == (len(w) < 50 or 2 * len(hot) > len(w))


def test_quality_edges(edge, empty):
    assert quality.quality(edge).count() == 9 and quality.quality(empty).count() == 0
    assert quality.filter_quality(edge).columns == edge.columns


def test_quality_is_native(spark):
    plan = quality.quality(table(spark, ["a"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def languages(spark, n=60):
    a, b, c = "der die und ist nicht mit schule straße".split(), "the and with that school street".split(), "el los con para escuela calle niño".split()
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(ws) for _ in range(r.choice([3, 30]))), ("de", "en", "es")[k], "s", 1) for i, (k, ws) in enumerate((i % 3, (a, b, c)[i % 3]) for i in range(n * 3))]
    return spark.createDataFrame(rows, TYPES)


def test_language_held_out(spark, edge, empty):
    docs = languages(spark)
    model = langid.fit(docs)
    rows = langid.detect(docs, model).where(fold("row.doc_id") == 0).collect()
    assert np.mean([x["row"]["lang"] == x["lang_pred"] for x in rows]) > 0.95
    out = langid.detect(edge, model).collect()
    assert len(out) == 9 and {x["lang_pred"] for x in out if x["row"]["doc_id"] in (1, 2, 3)} == {"und"}
    assert langid.detect(empty, model).count() == 0 and langid.fit(empty) is None
    assert {x["lang_pred"] for x in langid.detect(edge, None).collect()} == {"und"}
    assert langid.filter_language(edge, model).columns == edge.columns


@pytest.mark.parametrize("n", [1, 2, 4, 6, 9, 40])
def test_codewords_differ(n):
    c = langid.codewords(n)
    assert len({tuple(x) for x in c}) == n and set(np.unique(c)) <= {-1.0, 1.0}


def test_packing_round_trip(spark, edge, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    texts = [prose(i, 5 + 97 * i % 300) for i in range(40)] + ["İstanbul don't it's 語 é a<|endoftext|>b --- x.", "", None]
    pieces = packing.pack(table(spark, texts), max_tokens=64).toPandas().sort_values(["doc_id", "start"])
    for i, g in pieces.groupby("doc_id"):
        want = model.encode(texts[i] or "", add_special_tokens=False).ids + [1]
        assert list(np.concatenate([np.frombuffer(x, "<u4") for x in g["ids"]])) == want
        assert set(g["doc_tokens"]) == {len(want)} and list(g["start"]) == [0, *np.cumsum(g["length"])[:-1]]
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *np.cumsum(g["length"])[:-1]]
    full = pieces.groupby("sequence_id")["length"].sum()
    assert (full[:-1] == 64).all() and full.max() <= 64
    assert packing.pack(empty).count() == 0
    assert packing.pack(edge).agg(F.count_distinct("doc_id")).first()[0] == 7


def test_mixture_holds_proportions():
    m = packing.Mixture([5000, 3000, 400], 64, [1, 1, 0.5])
    per = [[m.given(q, w + 1) - m.given(q, w) for q in range(3)] for w in range(m.windows)]
    assert all(x >= 0 for p in per for x in p) and all(sum(p) == 64 for p in per[:-1])
    assert [sum(p[q] for p in per) for q in range(3)] == [5000, 3000, 400]
    assert all(abs(p[0] - p[1]) <= 2 for p in per[:15])  # equal weights while both last
    for q in range(3):
        got = [x for x in m.pieces(q, 10, 300)]
        assert sum(n for _, _, n in got) == 300


def test_toxicity_learns_subwords(spark, edge, empty):
    r = random.Random(3)
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = prose(i, 40).split()
        if bad:
            for k in range(4):
                w[r.randrange(40)] = r.choice(["dreadfool", "dreadful", "dreadfull", "rotten", "rottenn"])
        rows.append((i, " ".join(w), "en", "s", 1))
        marks.append((i, 1, int(bad)))
    docs, labels = spark.createDataFrame(rows, TYPES), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs, model).where(fold("doc_id") == 0).collect()}
    assert np.mean([(s >= 0.5) == (i % 4 == 0) for i, s in got.items()]) > 0.9
    assert model.score(prose(1, 20) + " dreadfuul rotteen dreadfooll dreadfuly") > model.score(prose(1, 20))
    assert toxicity.score(edge, model).count() == 9 and toxicity.score(empty, model).count() == 0
    flat = toxicity.fit(empty, labels.where("false"))
    assert flat.score("anything") == pytest.approx(0.5)


PAGE = """<html><head><title>t</title><style>p{}</style><script>if (a < b) document.write("<p>no</p>")</script></head><body>
<header class="masthead"><a href="/">Home</a></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies and the law of it.</div>
<article><h1>A title</h1><p>The first   paragraph of the text &amp; more, with a <b>bo</b>ld word and the rest of it that is long enough to count.<br>Short.</p>
<div class="ad">Buy the thing</div><p>The second paragraph of the article is here as well, with some of the usual words.<p>&copy; unclosed
<section class="comments"><p>The reader said that it was of no use to him at all, and so on and on.</p></section></article>
<aside>Related</aside><footer>&copy; 2020</footer>"""


def test_html_main_text():
    assert html.main_text(PAGE) == (
        "A title The first paragraph of the text & more, with a bold word and the rest of it that is long enough to count. Short. "
        "The second paragraph of the article is here as well, with some of the usual words. © unclosed"
    )
    plain = "<div><p>" + "The cat of the house and the dog of the yard. " * 8 + "</p><p>Short end.</p></div><div><a href='/'>one</a> <a href='/'>two</a></div>"
    assert html.main_text(plain).endswith("Short end.") and "two" not in html.main_text(plain)
    for broken in (None, "", "<", "<p", "<!-- open", "<script>x", "a<b", "<p class='x>y"):
        html.main_text(broken)


GOOD = "The cat of the house and the dog of the yard. " * 8


@pytest.mark.parametrize("name", ["page has-sidebar", "content-with-sidebar", "no-sidebar", "main side", "post comments-open"])
def test_html_class_words_of_a_wrapper_keep_its_text(name):
    page = f"<div class='{name}'><h1>A title</h1><p>{GOOD}</p><div class='sidebar'><a href='/'>one</a> two</div><div class='comments'><p>{GOOD.replace('cat', 'fox')}</p></div></div>"
    assert html.main_text(page) == f"A title {GOOD.strip()}"


def test_html_articles_are_evidence_only():
    head = f"<article><div class='article-header'><h1>A title</h1><p>{GOOD}</p></div><p>{GOOD}</p></article>"
    assert html.main_text(head) == f"A title {GOOD.strip()} {GOOD.strip()}"
    cards = "<article><a href='/'>Another page of the site</a></article>" * 2
    assert html.main_text(f"<div><p>{GOOD}</p></div>{cards}").startswith(GOOD.strip())
    comment = f"<article><p>{GOOD}</p></article><article class='comment'><p>{GOOD.replace('cat', 'fox') * 3}</p></article>"
    assert html.main_text(comment) == GOOD.strip()


def test_html_table(spark):
    rows = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, None, "")], "page_id long, url string, html string")
    got = {x["page_id"]: x["text"] for x in html.extract(rows).collect()}
    assert got[2] == "" and got[3] == "" and got[1].startswith("A title")


def test_urls(spark):
    c = "<link rel='canonical' href='{}'>".format
    rows = [
        (1, "https://x.example.net/en/1", ""), (2, "http://a.net/p?q", ""), (3, "HTTP://M.Example.COM/de/2#f", ""), (4, "https://z.org/fr/1", c("http://worse.net/9")), (5, None, None), (6, "no scheme", ""),
        (7, "https://mirror.io/a", c("https://bad.net/9")), (8, "https://other.io/b", c("https://mirror.io/a")), (9, "https://both.io/c", c("https://x.example.net/en/1")), (10, "https://free.io/d", c("/e")), (11, "https://both.io/f", c("https://both.io/c")), (12, "https://both.io/g", c("https://net.net/1") ),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    redirects = spark.createDataFrame([("https://both.io/g", "https://both.io/f")], "src string, dst string")
    got = {x["page_id"]: x for x in urls.filter_urls(pages, redirects).collect()}
    verdict = {k: x["verdict"] for k, x in got.items()}
    assert verdict == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "block", 9: "allow", 10: "allow", 11: "allow", 12: "allow"}
    assert got[3]["host"] == "m.example.com" and got[3]["path"] == "/de/2" and got[3]["rule"] == "example.com/de/" and got[6]["host"] == ""
    assert urls.filter_urls(pages.where("false")).count() == 0


def test_class_model_matches_plain_counts(spark, edge, empty):
    texts = [prose(i, 30 + i) for i in range(40)] + ["", None, "Never seen WORDS here"]
    docs = table(spark, texts)
    got = classlm.score(docs, fold("doc_id") == 1).collect()
    held = {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 1}
    counts: dict = {}
    for i, t in enumerate(texts):
        for w in [*(t or "").lower().split(), None] if i not in held else []:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for x in got:
        w = [*(texts[x["doc_id"]] or "").lower().split(), None]
        assert x["held_out"] == (x["doc_id"] in held) and x["train_tokens"] == n
        assert (x["n_tokens"], x["n_known"]) == (len(w), sum(c in counts for c in w))
        assert x["base_score"] == pytest.approx(sum(math.log10((counts.get(c, 0) + 0.5) / (n + 0.5 * (v + 1))) for c in w))
    assert classlm.score(edge, fold("doc_id") == 1).count() == 9
    assert classlm.score(empty, fold("doc_id") == 1).count() == 0


def test_exchange_ends_where_no_move_helps():
    """At the end no single move adds to the likelihood of class bigrams, counted anew."""

    def likelihood(b, cls, k):
        hot = np.eye(k)[cls]
        g = hot.T @ b @ hot
        part = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
        return part(g) - part(g.sum(0)) - part(g.sum(1))

    for seed in range(8):
        b = np.random.default_rng(seed).poisson(3, (14, 14)) * np.random.default_rng(seed + 50).integers(0, 2, (14, 14))
        cls = classlm.exchange(b, classes=3)
        best = likelihood(b, cls, 4)
        assert cls[0] == 0
        for u in range(1, 14):
            for c in (1, 2, 3):
                other = cls.copy()
                other[u] = c
                assert likelihood(b, other, 4) <= best + 1e-5


def test_class_model_sums_to_one(spark):
    docs = table(spark, [prose(i, 50) for i in range(30)])
    model, _, _, _ = classlm.build(docs, F.lit(False))
    k = len(model.transition)
    assert np.allclose((10.0**model.transition).sum(axis=1), 1)
    # Emissions of a class: its words, and one unknown word, make one.
    h, e = classlm.words(" ".join(WORDS))
    cls = model.unit_class[classlm._units(h, e, model.frequent)]
    texts = " ".join(prose(i, 50) for i in range(30)).split()
    for c in range(1, k):
        mine = [texts.count(w) for w, x in zip(WORDS, cls, strict=True) if x == c]
        if mine:
            assert sum(n + 0.5 for n in mine) + 0.5 == pytest.approx(10.0 ** model.spread[c])


def test_exchange_finds_classes():
    b = np.zeros((9, 9))
    for i in range(1, 5):
        for j in range(5, 9):
            b[i, j] = b[j, i] = 20 + 3 * i + j
    cls = classlm.exchange(b, classes=2)
    assert len(set(cls[1:5])) == 1 and len(set(cls[5:9])) == 1 and cls[1] != cls[5]


def test_class_pairs_are_clustered_in_a_task(spark, monkeypatch):
    """The driver, here limited to two rows, does not gather the pairs of units; classes and their pairs are those
    of plain counts."""
    docs = spark.createDataFrame([(0, "a b a c"), (1, "b a"), (2, None), (3, "zzz a")], "doc_id long, text string")
    frequent = np.sort(classlm.words("a b c")[0])
    for name in ("toPandas", "collect", "toArrow"):
        monkeypatch.setattr(type(docs), name, lambda self, f=getattr(type(docs), name): f(self.limit(2)))
    cls, follows = classlm._clustered(docs, "text", F.col("doc_id") == 3, frequent)
    units = 1 + classlm.FREQUENT + classlm.ENDINGS
    pairs = np.zeros((units, units))
    for text in ("a b a c", "b a", ""):
        seq = [0, *(classlm._units(*classlm.words(text), frequent) if text else []), 0]
        for a, b in zip(seq, seq[1:]):
            pairs[a, b] += 1
    want = classlm.exchange(pairs)
    hot = np.eye(classlm.CLASSES + 1)[want]
    assert (cls == want).all() and (follows == hot.T @ pairs @ hot).all()


def test_decontamination(spark, edge, empty):
    item = [prose(900 + i, 30) for i in range(3)] + ["too short", prose(950, 8), None, ""]
    bench = spark.createDataFrame(list(enumerate(item)), "item_id long, text string")
    w = item[1].split()
    changed = list(w)
    changed[4] = changed[17] = "swapped"
    docs = table(spark, [prose(1, 300), prose(2, 50) + " " + item[0].upper() + ". " + prose(3, 50), " ".join(changed) + " tail", " ".join(w[8:24]) + " " + prose(8, 30), "start " + item[4], "too short", None, ""])
    for limit in (500_000, 0):  # broadcast, and shuffle
        decontam.BROADCAST_SEEDS, keep = limit, decontam.BROADCAST_SEEDS
        got = {(x["doc_id"], x["item_id"]): x for x in decontam.overlaps(docs, bench).collect()}
        decontam.BROADCAST_SEEDS = keep
        # Items of any length count, so the one of two words does, unless min_tokens leaves it out.
        assert set(got) == {(1, 0), (2, 1), (3, 1), (4, 4), (5, 3)}
        assert all(x["item_id"] != 3 for x in decontam.overlaps(docs, bench, min_tokens=6).collect())
        assert got[1, 0]["matched"] == 30 and got[2, 1]["matched"] == 28 and got[3, 1]["position"] == -8
    assert sorted(x["doc_id"] for x in decontam.filter_contaminated(docs, bench).collect()) == [0, 5, 6, 7]
    assert decontam.overlaps(edge, bench).count() == 0 and decontam.overlaps(empty, bench).count() == 0
    assert decontam.filter_contaminated(edge, bench).count() == 9 and decontam.filter_contaminated(edge, bench.where("false")).columns == edge.columns


def agreeing(w, item):
    """The best alignment by the rule of 13 tokens and 80 %, over all alignments: matched, position."""
    span, best = min(13, len(item)), None
    for p in range(span - len(item), len(w) - span + 1):
        same = [w[p + j] == item[j] for j in range(max(0, -p), min(len(item), len(w) - p))]
        if any(100 * sum(same[i : i + span]) >= 80 * span for i in range(len(same) - span + 1)):
            best = max(best or (0, 0), (sum(same), -p))
    return best and (best[0], -best[1])


def test_decontamination_masks_miss_no_pattern():
    for n in range(decontam.MIN_TOKENS, 14):
        masks = decontam.WINDOW_MASKS if n == 13 else decontam.short_masks(n)
        for differ in itertools.combinations(range(n), n * 20 // 100):
            free = [all(i < a or m[i - a : i - a + 1] != "1" for i in differ) for m in masks for a in range(n - len(m) + 1)]
            assert any(free), (n, differ)


def test_decontamination_matches_unseeded_brute_force(spark):
    r = random.Random(12)
    items = [[f"i{k}x{j}" for j in range(n)] for k, n in enumerate((6, 7, 8, 9, 10, 11, 12, 13, 14, 16, 16, 30))]
    docs = []
    for item in items:
        for _ in range(40):
            cut = r.randrange(max(1, len(item) - 12)) if r.random() < 0.5 else 0
            w = item[cut : cut + 13] if cut else list(item)
            for i in r.sample(range(len(w)), r.randrange(5)):
                w[i] = "other"
            docs.append(prose(len(docs), r.randrange(4)).split() + w + prose(len(docs) + 1, r.randrange(4)).split())
    want = {(d, i): agreeing(w, item) for d, w in enumerate(docs) for i, item in enumerate(items) if agreeing(w, item)}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): (x["matched"], x["position"]) for x in decontam.overlaps(table(spark, [" ".join(w) for w in docs]), bench).collect()}
    assert got == want


@pytest.mark.parametrize("shards", [3, 40])
def test_sharding(spark, shards):
    texts = [prose(i % 50 if i < 150 else i, 10) for i in range(260)] + ["hot"] * 90 + ["", "", None, None]
    rows = sharding.shard(table(spark, texts), shards).toPandas()
    n = rows.groupby("shard").size().reindex(range(shards), fill_value=0)
    assert len(rows) == len(texts) and n.max() - n.min() <= 1
    for _, g in rows.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    for x in rows.itertuples():
        t = (texts[x.doc_id] or "").encode()
        assert x.size == len(t) + 16 and x.text_crc32 == zlib.crc32(t)
    small = rows[rows["hub"].notna()].groupby("hub").agg(n=("shard", "size"), k=("shard", "nunique"))
    if shards == 3:
        assert (small[small["n"] < 10]["k"] > 1).mean() < 0.1


def test_sharding_keeps_a_third_of_all_rows_in_few_shards(spark):
    """A group of 13.3 shards, one of 1.5 shards, and many pairs."""
    texts = ["hot"] * 400 + ["warm"] * 45 + [prose(i % 200, 10) for i in range(400)] + [prose(1000 + i, 10) for i in range(355)]
    rows = sharding.shard(table(spark, texts), 40).toPandas()
    assert (rows.groupby("shard").size() == 30).all()
    assert rows[rows["doc_id"] < 400]["shard"].nunique() == 14
    assert rows[(rows["doc_id"] >= 400) & (rows["doc_id"] < 445)]["shard"].nunique() == 2
    pairs = rows[(rows["doc_id"] >= 445) & (rows["doc_id"] < 845)].groupby("hub")["shard"].nunique()
    assert len(pairs) == 200 and (pairs > 1).mean() < 0.05


def test_sharding_targets():
    assert sharding.targets({7: {0: 1, 1: 5, 2: 4}}, [6, 6, 6]) == [(7, 1, 0, 6), (7, 2, 6, 10)]
    assert sharding.targets({7: {0: 1, 1: 3}, 8: {1: 3}}, [4, 4]) == [(7, 1, 0, 4), (8, 0, 0, 3)]


def test_sharding_edges(edge, empty):
    assert sharding.shard(edge, 4).count() == 9 and sharding.shard(empty, 4).count() == 0
