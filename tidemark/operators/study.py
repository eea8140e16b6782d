"""Announcement studies: documents to events, point-in-time features, abnormal returns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import functions as fx
from . import series as ts
from .panel import small

#: Fixed value: names of exhibits 99: "ex", perhaps a separator, "99", or "99" and "1"; no letter beside.
EXHIBIT = r"(?:^|[^a-z])(?:ex[-_ ]?99|99(?:\.|_|-)?1)(?:[^a-z]|$)"
#: Where all rows of these studies come from.
DATA_TIER = "public_proxy"


def select_documents(docs: DataFrame, most: int = 3, primary: str = "main.htm", read: Mapping[str, Column] | None = None) -> DataFrame:
    """Exhibits and the primary document of each filing (filing, doc_id, name, text) with .htm, .html or .txt
    names: the first `most` by name, exhibits before the primary, which always stays; text without markup. With
    read, columns made of that text, and `said`, whether there is any, stand for it, and no text is shuffled."""
    name = F.lower("name")
    exhibit, main = name.rlike(EXHIBIT), name == primary.lower()
    able = docs.where(F.col("name").rlike(r"\.(htm|html|txt)$") & (exhibit | main)).withColumn("text", fx.strip_html("text"))
    if read is not None:
        able = able.select("filing", "doc_id", "name", (F.col("text") != "").alias("said"), *[c.alias(k) for k, c in read.items()])
    w = Window.partitionBy("filing").orderBy(main.cast("int"), name, "doc_id")
    kept = able.withColumn("place", F.row_number().over(w)).where((F.col("place") <= most) | (F.lower("name") == primary.lower()))
    return kept.select("filing", "doc_id", "name", "place", F.when(exhibit, "press_release").otherwise("primary_filing").alias("source_type"), *(["text"] if read is None else ["said", *read]))


def classify_filings(bundles: DataFrame, groups: Mapping[str, Sequence[str]], internal: Column | None = None, least_amount: float = 1e6) -> DataFrame:
    """One row for each filing (filing, place, source_type, text) that has a family: keyword counts of the
    groups buyback, dividend, split and internal_reallocation over all its texts, amount near a buyback
    word, amount per share, family, score, matched keywords. internal: condition on filing under which
    internal words decide. Only a filing's few texts are gathered in one row."""
    parts = F.array_sort(F.collect_list(F.struct("place", "text", "source_type")))
    one = bundles.groupBy("filing").agg(parts.alias("parts"))
    one = one.select("filing", F.array_join(F.transform(F.filter("parts", lambda p: p["text"] != ""), lambda p: p["text"]), " ").alias("text"), F.exists("parts", lambda p: p["source_type"] == "press_release").alias("release")).where("text <> ''")
    counts = {g: fx.keyword_count("text", list(words)) for g, words in groups.items()}
    one = one.withColumn("amount", fx.context_money("text", list(groups["buyback"]), least=least_amount))
    found = F.struct("amount", *[c.alias(g) for g, c in counts.items()], fx.per_share("text").alias("per_share"), F.substring(fx.squeeze(F.substring("text", 1, 180)), 1, 180).alias("title"))
    # Unnested, as conditions on the result would otherwise search the texts again.
    rows = one.select("filing", "release", F.inline(F.array(found)))
    buy, div = (F.col("buyback") > 0) | F.col("amount").isNotNull(), (F.col("dividend") > 0) | F.col("per_share").isNotNull()
    family = F.when((internal if internal is not None else F.lit(False)) & (F.col("internal_reallocation") > 0), "internal_reallocation").when(buy & div, "dual_announcement").when(buy, "buyback_authorization").when(div, "dividend_announcement").when(F.col("split") > 0, "signal_reset")
    score = 4 * F.col("amount").isNotNull().cast("int") + 2 * F.col("per_share").isNotNull().cast("int") + 2 * F.col("buyback") + 2 * F.col("dividend") + F.col("split") + 2 * F.col("internal_reallocation") + F.col("release").cast("int")
    matched = F.map_filter(F.create_map(*[x for g in groups for x in (F.lit(g), F.col(g))]), lambda k, n: n > 0)
    return rows.select("filing", family.alias("family"), score.alias("score"), "amount", "per_share", *groups, matched.alias("matched"), "title").where("family IS NOT NULL")


def describe_candidates(classified: DataFrame, filings: DataFrame, documents: DataFrame) -> DataFrame:
    """Classified filings with form, filing day, time of announcement (20:05 where acceptance is unknown),
    addresses of their documents, title (the description where there is no text, else the form), data_tier."""
    urls = documents.groupBy("filing").agg(F.array_sort(F.collect_list(F.struct("place", F.concat_ws("/", F.col("filing").cast("string"), "name").alias("url")))).alias("u"))
    rows = classified.join(filings, "filing").join(urls, "filing")
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif("description", F.lit("")), "form")
    return rows.select(*[c for c in classified.columns if c != "title"], "form", "filed", fx.announced_at("accepted", "filed").alias("announced_ts"), F.transform("u", lambda x: x["url"]).alias("urls"), title.alias("title"), F.lit(DATA_TIER).alias("data_tier"))


def excluded(candidates: DataFrame, overlay: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Days of candidates and overlay that exclusions take out, with their reasons."""
    days = candidates.select("ticker", "announced").unionByName(overlay.select("ticker", "announced")).distinct()
    return days.join(exclusions.groupBy("ticker", "announced").agg(F.min("reason").alias("reason")), ["ticker", "announced"])


def apply_overlay(candidates: DataFrame, overlay: DataFrame, firms: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Ledger of (ticker, announced): the best candidate (score, then event_id) of a day, fields replaced
    by the overlay where it has them; overlay rows without a candidate come in with score 100 and their
    family as title; excluded days go; each firm keeps target_count rows, manual ones first, then by score and day."""
    best = candidates.groupBy("ticker", "announced").agg(F.min_by(F.struct("event_id", "family", "amount", "score"), F.struct(-F.col("score"), F.col("event_id"))).alias("c")).select("ticker", "announced", "c.*")
    o = overlay.select("ticker", "announced", F.col("family").alias("o_family"), F.col("amount").alias("o_amount"), F.lit(True).alias("manual"))
    both = best.join(o, ["ticker", "announced"], "full_outer")
    fresh = F.col("event_id").isNull()
    rows = both.select(
        "ticker", "announced", F.coalesce("event_id", F.concat_ws("-", "ticker", F.date_format("announced", "yyyyMMdd"), "o_family")).alias("event_id"), F.coalesce("o_family", "family").alias("family"), F.coalesce("o_amount", "amount").alias("amount"),
        F.when(fresh, 100).otherwise(F.col("score")).alias("score"), F.when(fresh, "manual_seed").when(F.col("manual"), "manual_enriched").otherwise("auto_discovered").alias("status"),
    )
    rows = rows.withColumn("title", F.when(F.col("status") == "manual_seed", fx.title_case("family"))).withColumn("data_tier", F.lit(DATA_TIER))
    rows = rows.join(exclusions.select("ticker", "announced"), ["ticker", "announced"], "left_anti").join(small(firms.select("ticker", "target_count")), "ticker")
    w = Window.partitionBy("ticker").orderBy(F.col("status").startswith("manual").cast("int").desc(), F.desc("score"), "announced", "event_id")
    return rows.withColumn("k", F.row_number().over(w)).where("k <= target_count").drop("k", "target_count")


def gap_report(ledger: DataFrame, firms: DataFrame) -> DataFrame:
    """Target, achieved and missing rows of each firm."""
    n = ledger.groupBy("ticker").agg(F.count("*").alias("achieved"))
    achieved = F.coalesce("achieved", F.lit(0))
    return firms.join(n, "ticker", "left").select("ticker", "target_count", achieved.alias("achieved"), F.greatest(F.col("target_count") - achieved, F.lit(0)).alias("gap"), F.greatest(achieved - F.col("target_count"), F.lit(0)).alias("overflow"))


def map_to_trading_day(events: DataFrame, cal: DataFrame, ts_col: str = "ts") -> DataFrame:
    """events with t0 and t0_idx: the first trading day at or after the local day, from the next day on if
    the market has closed; NULL past the calendar."""
    d, closed = fx.market_day(ts_col)
    out = ts.on_calendar(events.withColumn("target", F.date_add(d, closed.cast("int"))), cal.select("d", "idx"), "target", "d", ["idx"], forward=True)
    return out.withColumnsRenamed({"asof_time": "t0", "idx": "t0_idx"}).drop("target")


#: Concepts, and the taxonomy and tags that report them, the preferred tag first.
CONCEPTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "shares": ("dei", ("EntityCommonStockSharesOutstanding",)),
    "repurchases": ("us-gaap", ("PaymentsForRepurchaseOfCommonStock", "StockRepurchasedAndRetiredDuringPeriodValue", "TreasuryStockValueAcquiredCostMethod")),
    "revenue": ("us-gaap", ("RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet")),
    "operating_income": ("us-gaap", ("OperatingIncomeLoss",)),
    "capex": ("us-gaap", ("PaymentsToAcquirePropertyPlantAndEquipment",)),
}


def resolve_tags(facts: DataFrame, concepts: Mapping[str, tuple[str, Sequence[str]]] = CONCEPTS) -> DataFrame:
    """Facts (symbol, taxonomy, tag, unit, unit_no, ...) of the concepts, `tag` being the concept and `source_tag`
    the reported one: for each firm and concept all facts of the first listed tag that the firm reports at all, in
    that tag's first unit (by unit_no). The choice looks at no day, so a tag that a firm reports only later
    hides the others all the time. A tag may serve several concepts; a firm without any of a concept's tags has
    no facts of it. The choice is a minimum for each firm and concept, added up before its shuffle."""
    places = [(c, taxonomy, tag, i) for c, (taxonomy, tags) in concepts.items() for i, tag in enumerate(tags)]
    known_tags = facts.sparkSession.createDataFrame(places, "concept string, taxonomy string, tag string, place int")
    ranked = facts.join(F.broadcast(known_tags), ["taxonomy", "tag"])  # a parameter list
    best = ranked.groupBy("symbol", "concept").agg(F.min(F.struct("place", "unit_no")).alias("best"))
    chosen = ranked.join(best, ["symbol", "concept"]).where((F.col("place") == F.col("best.place")) & (F.col("unit_no") == F.col("best.unit_no")))
    return chosen.select("symbol", F.col("concept").alias("tag"), F.col("tag").alias("source_tag"), "unit", "start_d", "end_d", "filed", "val")


def known(facts: DataFrame, asof: Column) -> Column:
    """Facts filed by the as-of day (or without a filing day) about periods that ended by it."""
    return F.coalesce(F.col("filed") <= asof, F.lit(True)) & (F.col("end_d") <= asof)


def _known_from(facts: DataFrame) -> DataFrame:
    """Facts by ticker with the first day (known_from) on which `known` holds."""
    return facts.where("end_d IS NOT NULL").withColumn("known_from", F.greatest("filed", "end_d")).withColumnRenamed("symbol", "ticker")


def with_instant(events: DataFrame, facts: DataFrame, tag: str, name: str, asof: str = "asof") -> DataFrame:
    """events with the value of the latest (end, filed) fact known at each event's as-of day, NULL if none is. The
    best fact so far runs along each firm's facts, so that an event meets one row and not all facts of its firm."""
    w = Window.partitionBy("ticker").orderBy("known_from").rangeBetween(Window.unboundedPreceding, 0)
    best = _known_from(facts.where(F.col("tag") == tag)).select("ticker", "known_from", F.max(F.struct("end_d", "filed", "val")).over(w).getField("val").alias(name))
    return ts.asof(events, best, asof, "known_from", [name], ["ticker"])


def pit_instant(events: DataFrame, facts: DataFrame, tag: str, name: str, asof: str = "asof") -> DataFrame:
    """event_id and the value of `with_instant`, for events with a known fact."""
    return with_instant(events.select("event_id", "ticker", asof), facts, tag, name, asof).where("asof_time IS NOT NULL").select("event_id", name)


def quarter_lengths(low: int = 70, high: int = 110) -> Column:
    """Facts about periods of low to high days, both ends counted."""
    return (F.datediff("end_d", "start_d") + 1).between(low, high)


def with_quarter_total(events: DataFrame, facts: DataFrame, name: str, asof: str = "asof") -> DataFrame:
    """events with the sum over all quarters known at the as-of day, each with its latest filing's value; NULL if
    none is known. A new filing adds its difference to the one before it, so that one running sum serves all days."""
    was = F.lag("val").over(Window.partitionBy("ticker", "end_d").orderBy(F.asc_nulls_first("filed"), "val"))
    steps = _known_from(facts.where(quarter_lengths())).withColumn("step", F.coalesce("val", F.lit(0.0)) - F.coalesce(was, F.lit(0.0)))
    w = Window.partitionBy("ticker").orderBy("known_from").rangeBetween(Window.unboundedPreceding, 0)
    return ts.asof(events, steps.select("ticker", "known_from", F.sum("step").over(w).alias(name)), asof, "known_from", [name], ["ticker"])


def pit_quarters(events: DataFrame, facts: DataFrame, asof: str = "asof", low: int = 70, high: int = 110) -> DataFrame:
    """Quarters (event_id, tag, end_d, val, k from the latest) known at each event's as-of day: periods of
    low to high days, both ends counted, the latest filing of each. The result has a firm's quarters for each of
    its events; sums and latest values alone come from with_quarter_total and with_instant."""
    f = facts.where(quarter_lengths(low, high)).select(F.col("symbol").alias("ticker"), "tag", "end_d", "filed", "val")
    rows = events.select("event_id", "ticker", asof).join(f, "ticker").where(known(f, F.col(asof)))
    last = rows.groupBy("event_id", "tag", "end_d").agg(F.max_by("val", F.coalesce("filed", F.lit("0001-01-01").cast("date"))).alias("val"))
    return last.withColumn("k", F.row_number().over(Window.partitionBy("event_id", "tag").orderBy(F.desc("end_d"))))


def latest_quarters(facts: DataFrame, n: int = 5, low: int = 70, high: int = 110) -> DataFrame:
    """What is known of each firm's latest quarters from a day on: ticker, known_from, quarters, a map from tag to
    the latest n quarters (end_d, val; latest first), each with its latest filing's value (at a tie the first
    in order of val). One row for each firm and day on which a quarter is filed or amended; it holds all tags.

    A quarter that n later ones have pushed out never comes back, so a firm's state is bounded by n and its tags;
    it runs along the firm's facts, which Spark has sorted, and no event or fact meets another."""
    f = _known_from(facts.where(quarter_lengths(low, high) & F.col("val").isNotNull())).select("ticker", "tag", "known_from", "end_d", "filed", "val")
    ordered = f.repartition("ticker").sortWithinPartitions("ticker", "known_from", F.asc_nulls_first("filed"), "val")
    types = {name: f.schema[name].dataType for name in ("ticker", "known_from")}
    schema = T.StructType([*[T.StructField(k, t) for k, t in types.items()], T.StructField("quarters", T.MapType(T.StringType(), T.ArrayType(T.StructType([T.StructField("end_d", T.DateType()), T.StructField("val", T.DoubleType())]))))])

    def run(it):
        firm = day = None
        state: dict[str, dict] = {}  # tag -> end of quarter -> (filed, val)

        def snapshot():
            return firm, day, {tag: [{"end_d": e, "val": ends[e][1]} for e in sorted(ends, reverse=True)] for tag, ends in state.items()}

        for batch in it:
            out = []
            for ticker, tag, at, end, filed, val in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if day is not None and (ticker, at) != (firm, day):
                    out.append(snapshot())
                if ticker != firm:
                    state = {}
                firm, day = ticker, at
                ends = state.setdefault(tag, {})
                was = ends.get(end)
                if was is None or (was[0] is None and filed is not None) or (was[0] is not None and filed is not None and filed > was[0]):
                    ends[end] = (filed, val)
                if len(ends) > n:
                    del ends[min(ends)]
            yield _batch(out, schema)
        if day is not None:
            yield _batch([snapshot()], schema)

    return ordered.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    names = schema.names
    return pa.RecordBatch.from_pylist([{k: (list(v.items()) if isinstance(v, dict) else v) for k, v in zip(names, r, strict=True)} for r in rows], to_arrow_schema(schema))


def quarters_known(events: DataFrame, facts: DataFrame, n: int = 5, asof: str = "asof") -> DataFrame:
    """Quarters (event_id, tag, end_d, val, k from 1, the latest) known at each event's as-of day, n at most for each
    tag: as pit_quarters gives for k <= n, by one as-of join with latest_quarters."""
    held = ts.asof(events.select("event_id", "ticker", asof), latest_quarters(facts, n), asof, "known_from", ["quarters"], ["ticker"])
    tags = held.where("quarters IS NOT NULL").select("event_id", F.explode("quarters").alias("tag", "q"))
    return tags.select("event_id", "tag", F.posexplode("q").alias("k", "x")).select("event_id", "tag", "x.end_d", "x.val", (F.col("k") + 1).alias("k"))


def quarter_sums(quarters: DataFrame) -> DataFrame:
    """For each (event_id, tag): sum of the last four quarters (NULL if fewer), the latest, the mean of up
    to four earlier ones."""
    at = lambda c: F.when(c, F.col("val"))
    k = F.col("k")
    return quarters.groupBy("event_id", "tag").agg(F.when(F.count_if(k <= 4) == 4, F.sum(at(k <= 4))).alias("ttm"), F.max(at(k == 1)).alias("latest"), F.avg(at(k.between(2, 5))).alias("earlier"))


def capital_amplitude(balance: Column, cap: Column, income_yield: Column, internal: Column, margin_gain: Column, capex_gain: Column, ttm: Column) -> Column:
    """Standard: balance / cap + yield; internal: (margin gain * revenue of four quarters + capex gain) /
    cap, not below 0. NULL without a cap or, inside, without revenue or margin."""
    standard = F.when(cap.isNotNull() & (cap != 0), fx.safe_div(balance, cap) + income_yield)
    inside = F.when((cap > 0) & ttm.isNotNull() & margin_gain.isNotNull(), F.greatest((margin_gain * ttm + F.coalesce(capex_gain, F.lit(0.0))) / cap, F.lit(0.0)))
    return F.when(internal, inside).otherwise(standard)


def internal_gains(quarters: DataFrame) -> DataFrame:
    """Per event: gain of the operating margin over the mean of up to four earlier margins, paired by
    place, and of capital spending over its earlier mean, neither below 0; revenue of four quarters."""
    wide = quarters.where("k <= 5 AND tag IN ('revenue', 'operating_income', 'capex')").groupBy("event_id", "k").pivot("tag", ["revenue", "operating_income", "capex"]).agg(F.max("val"))
    margin = F.when(F.col("revenue") != 0, F.col("operating_income") / F.col("revenue"))
    k = F.col("k")
    g = wide.groupBy("event_id").agg(
        F.max(F.when(k == 1, fx.safe_div("operating_income", "revenue"))).alias("now"), F.avg(F.when(k > 1, margin)).alias("before"),
        F.max(F.when(k == 1, F.col("capex"))).alias("capex"), F.avg(F.when(k > 1, F.col("capex"))).alias("capex_before"),
        F.when(F.count_if((k <= 4) & F.col("revenue").isNotNull()) == 4, F.sum(F.when(k <= 4, F.col("revenue")))).alias("revenue_ttm"),
    )
    return g.select("event_id", F.when(F.col("now").isNotNull(), F.greatest(F.col("now") - F.coalesce("before", "now"), F.lit(0.0))).alias("margin_gain"), F.greatest(F.coalesce("capex", F.lit(0.0)) - F.coalesce("capex_before", "capex", F.lit(0.0)), F.lit(0.0)).alias("capex_gain"), "revenue_ttm")


def filing_texts(filings: DataFrame, documents: DataFrame, score: Column, releases: Sequence[str] = ("8-K",), primary: str = "main.htm") -> DataFrame:
    """What each firm's filings of a day say: ticker, d, text_score, text_source. filings: (filing, ticker, form,
    filed); documents: (filing, place, name, source_type, text) without markup, or said for text; score: of a document.

    A filing of the forms `releases` speaks by its first press release with a text, else by its first document with
    one; any other by its primary document. Filings without such a text do not speak, so that an older one does;
    of a day's filings the first does. Only scores are shuffled, not texts."""
    on = documents.where("text <> ''" if "text" in documents.columns else "said").select("filing", "place", "source_type", (F.lower("name") == primary.lower()).alias("main"), score.alias("text_score"))
    rows = on.join(filings.select("filing", "ticker", "form", F.col("filed").alias("d")), "filing")
    release = F.col("form").isin(*releases)
    source = F.when(~release, "periodic_filing").otherwise(F.col("source_type"))
    rows = rows.where(release | F.col("main")).select("ticker", "d", "filing", "place", "text_score", source.alias("text_source"))
    first = rows.groupBy("ticker", "d").agg(F.min_by(F.struct("text_score", "text_source"), F.struct("filing", (F.col("text_source") != "press_release").cast("int"), "place")).alias("x"))
    return first.select("ticker", "d", "x.*")


def with_text(events: DataFrame, texts: DataFrame, days: int = 120, asof: str = "asof") -> DataFrame:
    """events with text_score, text_source (missing without any) and text_day: of the newest text of the firm at or
    before the as-of day, if it is at most `days` old."""
    found = ts.asof(events, texts, asof, "d", ["text_score", "text_source"], ["ticker"], tolerance_days=days)
    return found.withColumn("text_source", F.coalesce("text_source", F.lit("missing"))).withColumnRenamed("asof_time", "text_day")


#: Names of the parts of the angle's sources.
SOURCES = {"text_score": "management_lexical_proxy", "strength": "market_price_proxy", "skew": "options_realized_skew_proxy"}


def source_variant(parts: Mapping[str, str] = SOURCES) -> Column:
    """Names of the scores (columns) that are there, with "+"; missing if none is."""
    return F.coalesce(F.nullif(F.concat_ws("+", *[F.when(F.col(c).isNotNull(), F.lit(n)) for c, n in parts.items()]), F.lit("")), F.lit("missing"))


def alignment_angle(scores: Sequence[Column], h: float = 1.0) -> Column:
    """180 * (1 - mean of the scores) * h within 0..180; NULL if one is NULL."""
    total = scores[0]
    for s in scores[1:]:
        total = total + s
    return fx.clamp(180 * (1 - total / len(scores)) * h, 0, 180)


def interference_index(p: Column, w: Column, angle: Column) -> Column:
    """2pw / (p * p + w * w) * cos(angle); 0 if both are 0; NULL if one is NULL."""
    return fx.safe_div(2 * p * w, p * p + w * w) * F.cos(F.radians(angle))


def offsets(events: DataFrame, returns: DataFrame, market: DataFrame, last: int) -> DataFrame:
    """For each event (event_id, ticker, t0_idx) and offset 0..last on the market's calendar (d, idx, ret):
    day, abnormal return (NULL if a leg is missing), its running sum (NULL there, going on afterwards;
    NULL past the calendar), stock close."""
    each = events.where("t0_idx IS NOT NULL").select("event_id", "ticker", "t0_idx", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("off")).withColumn("idx", F.col("t0_idx") + F.col("off"))
    m = small(market.select("idx", "d", F.col("ret").alias("market_ret")))
    s = returns.select(F.col("symbol").alias("ticker"), "d", F.col("ret").alias("stock_ret"), "adjclose")
    rows = each.join(m, "idx", "left").join(s, ["ticker", "d"], "left")
    ar = F.col("stock_ret") - F.col("market_ret")
    total = F.sum(ar).over(ts.upto(["event_id"], "off"))
    return rows.select("event_id", "ticker", "off", "d", ar.alias("abnormal"), F.when(ar.isNotNull(), total).alias("car"), "adjclose")


def post_event_drawdown(path: DataFrame, base: DataFrame, points: int = 51) -> DataFrame:
    """Least close / base - 1 over the first `points` observed days of each event's path."""
    seen = path.where("abnormal IS NOT NULL AND adjclose IS NOT NULL").withColumn("k", F.row_number().over(ts.ordered(["event_id"], "off"))).where(F.col("k") <= points)
    return seen.join(base, "event_id").groupBy("event_id").agg(F.min(F.col("adjclose") / F.col("base") - 1).alias("drawdown"))
