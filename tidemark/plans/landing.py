"""Sources and sinks: landing files are written from whole tables to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources as src
from ..storage import new_path
from .basic import R, query, table


def _seconds(d):
    return F.unix_seconds(F.col(d).cast("timestamp"))


def _charts(v, spark):
    """Price payloads, one for each symbol and year, so that no row holds a whole history."""
    px, dv = v("px").withColumn("y", F.year("d")), v("dividends").withColumn("y", F.year("d"))
    rows = px.groupBy("symbol", "y").agg(F.array_sort(F.collect_list(F.struct(_seconds("d").alias("t"), F.col("adjclose").alias("c")))).alias("x"))
    paid = dv.groupBy("symbol", "y").agg(F.map_from_entries(F.collect_list(F.struct(_seconds("d").cast("string").alias("k"), F.struct("amount", _seconds("d").alias("date")).alias("v")))).alias("dividends"))
    rows = rows.join(paid, ["symbol", "y"], "left")
    c = F.col("x.c")
    result = F.struct(F.col("x.t").alias("timestamp"), F.struct(F.array(F.struct(c.alias("close"))).alias("quote"), F.array(F.struct(c.alias("adjclose"))).alias("adjclose")).alias("indicators"), F.struct("dividends").alias("events"))
    path = new_path(spark)
    rows.select("symbol", F.struct(F.array(result).alias("result")).alias("chart")).write.json(path)
    return path


@query(f"SELECT symbol, d, {R('adjclose', 'close')}, {R('adjclose', 'adjclose')} FROM px", ("px",), "d")
def scan_price_arrays(v, spark, sf):
    return src.read_price_payloads(spark, _charts(v, spark))


@query(f"SELECT symbol, d, {R('amount', 'amount')} FROM dividends", ("dividends",), "d")
def scan_action_map(v, spark, sf):
    return src.read_actions(spark, _charts(v, spark))


@query("SELECT 'm' || market_id::VARCHAR AS market_id, min(d) AS start_d, max(d) AS end_d FROM bets GROUP BY market_id", ("bets",), "start_d end_d")
def scan_markets(v, spark, sf):
    path, ms = new_path(spark), lambda c: F.unix_millis(c.cast("timestamp"))
    m = v("bets").groupBy("market_id").agg(ms(F.min("ts")).alias("createdTime"), ms(F.max("ts")).alias("closeTime"))
    m.select(F.concat(F.lit("m"), F.col("market_id").cast("string")).alias("id"), "createdTime", "closeTime", F.lit(0).alias("resolutionTime")).write.json(path)
    return src.read_markets(spark, path).select("market_id", "start_d", "end_d")


@query(f"SELECT market_id::VARCHAR AS market_id, epoch_us(ts) // 1000 AS ms, {R('prob_after', 'prob_after')} FROM bets", ("bets",))
def scan_bets(v, spark, sf):
    path = new_path(spark)
    v("bets").select(F.col("market_id").cast("string").alias("contractId"), F.unix_millis(F.col("ts").cast("timestamp")).alias("createdTime"), F.col("prob_after").alias("probAfter")).write.json(path)
    return src.read_bets(spark, path).select("market_id", F.unix_millis("ts").alias("ms"), "prob_after")


@query(f"SELECT d, {R('annual_rate', 'annual_rate')} FROM rates WHERE month(d) <> 2", ("rates",), "d")
def scan_rates_csv(v, spark, sf):
    path = new_path(spark)
    v("rates").select(F.col("d").cast("string").alias("DATE"), F.when(F.month("d") == 2, ".").otherwise((F.col("annual_rate") * 100).cast("string")).alias("TB3MS")).write.csv(path, header=True)
    return src.read_rates(spark, path)


def _filing_columns(rows, *keys):
    """Columnar lists of the ledger's filings for each of the keys, in the order of days."""
    few = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("announced").cast("string").alias("a"), "event_id", "form"))).alias("x"))
    return few.select(*keys, F.col("x.event_id").alias("accessionNumber"), F.col("x.a").alias("filingDate"), F.col("x.form").alias("form"), F.array_repeat(F.lit("t"), F.size("x")).alias("primaryDocument"))


_LISTS = ("accessionNumber", "filingDate", "form", "primaryDocument")


@query("SELECT ticker AS cik, event_id AS accession_number, '8-K' AS form, announced AS filing_date FROM ledger", ("ledger",), "filing_date")
def scan_filing_index(v, spark, sf):
    path = new_path(spark)
    rows = _filing_columns(v("ledger").select("*", F.year("announced").alias("y"), F.lit("8-K").alias("form")), "ticker", "y")
    rows.select(F.col("ticker").alias("cik"), F.struct(F.struct(*_LISTS).alias("recent")).alias("filings")).write.json(path)
    return src.read_filing_index(spark, path).select("cik", "accession_number", "form", "filing_date")


@query("SELECT ticker AS cik, event_id AS accession_number, CASE WHEN year(announced) >= 2000 AND ticker <> 'BUILDING' OR month(announced) = 12 THEN '8-K' ELSE 'page' END AS form, announced AS filing_date FROM ledger WHERE NOT (year(announced) = 1997 AND ticker = 'FURNITURE' AND month(announced) <> 12)", ("ledger",), "filing_date")
def scan_filing_pages(v, spark, sf):
    """Main payloads with the latest filings and, a second time, those of December; a page for each earlier year, one of
    which no payload names; one page that all name is missing."""
    main, folder = new_path(spark), new_path(spark)
    ledger = v("ledger").withColumn("y", F.year("announced"))
    late = (F.col("y") >= 2000) & (F.col("ticker") != "BUILDING")
    early = ledger.where(~late).select("*", F.concat_ws("-", "ticker", "y").alias("page"), F.lit("page").alias("form"))
    _filing_columns(early, "page").repartition("page").write.partitionBy("page").json(folder)
    names = early.select("ticker", F.concat(F.lit("page="), "page").alias("name")).distinct().where("name <> 'page=FURNITURE-1997'")
    names = names.unionByName(ledger.select("ticker", F.lit("page=NONE-1900").alias("name")).distinct()).groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("name"))).alias("files"))
    rows = _filing_columns(ledger.where(late | (F.month("announced") == 12)).withColumn("form", F.lit("8-K")), "ticker").join(names, "ticker", "full")
    rows.select(F.col("ticker").alias("cik"), F.struct(F.struct(*_LISTS).alias("recent"), "files").alias("filings")).write.json(main)
    return src.read_filing_history(spark, main, folder).select("cik", "accession_number", "form", "filing_date")


@query(f"SELECT symbol AS cik, tag, start_d, end_d, filed, {R('val', 'val')} FROM facts", ("facts",), "start_d end_d filed")
def scan_fact_map(v, spark, sf):
    text = lambda c, n: F.col(c).cast("string").alias(n)
    rows = v("facts").groupBy("symbol", "tag").agg(F.collect_list(F.struct(text("start_d", "start"), text("end_d", "end"), "filed", "val")).alias("r"))
    rows = rows.select("symbol", "tag", F.struct(F.create_map(F.lit("USD"), "r").alias("units")).alias("u"))
    path = new_path(spark)
    rows.groupBy(F.col("symbol").alias("cik")).agg(F.create_map(F.lit("gaap"), F.map_from_entries(F.collect_list(F.struct("tag", "u")))).alias("facts")).write.json(path)
    return src.read_facts(spark, path).select("cik", "tag", "start_d", "end_d", "filed", "val")


@query("SELECT 'part-' || (page_id % 97)::VARCHAR AS name, length(string_agg(html, chr(10) ORDER BY page_id)) + 1 AS n_chars, md5(string_agg(html, chr(10) ORDER BY page_id) || chr(10)) AS digest FROM pages GROUP BY page_id % 97")
def scan_documents(v, spark, sf):
    """All pages, delivered as 97 files of some pages each."""
    path = new_path(spark)
    parts = table(spark, sf, "pages").groupBy(F.concat(F.lit("part-"), (F.col("page_id") % 97).cast("string")).alias("name")).agg(F.array_sort(F.collect_list(F.struct("page_id", "html"))).alias("x"))
    parts.select("name", F.array_join("x.html", "\n").alias("value")).repartition("name").write.partitionBy("name").text(path)
    read = src.read_documents(spark, f"{path}/*/*.txt")
    return read.select(F.regexp_extract("path", "name=([^/]+)/", 1).alias("name"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query(f"SELECT event_id, ticker, {R('amount', 'amount')} FROM ledger", ("ledger",))
def scan_seed_json(v, spark, sf):
    path = new_path(spark)
    v("ledger").groupBy("ticker", F.year("announced").alias("y")).agg(F.collect_list(F.struct("event_id", "ticker", "amount")).alias("events")).select("events").write.json(path)
    return src.read_seeds(spark, path, "events", "event_id: STRING, ticker: STRING, amount: DOUBLE", multiline=False)


@query("SELECT event_id, announced::VARCHAR AS announced, '[' || chr(34) || ticker || chr(34) || ',' || chr(34) || hour::VARCHAR || chr(34) || ']' AS tags FROM ledger", ("ledger",))
def sink_csv_roundtrip(v, spark, sf):
    path = new_path(spark)
    src.write_csv(v("ledger").select("event_id", F.col("announced").cast("string").alias("announced"), F.array("ticker", F.col("hour").cast("string")).alias("tags")), path)
    return spark.read.schema("event_id STRING, announced STRING, tags STRING").csv(path, header=True, escape="\\")


@query(f"SELECT event_id, announced, {R('amount', 'amount')} FROM ledger", ("ledger",), "announced")
def sink_json_roundtrip(v, spark, sf):
    path = new_path(spark)
    src.write_json(v("ledger").select("event_id", "announced", "amount"), path)
    return spark.read.schema("event_id STRING, announced DATE, amount DOUBLE").json(path)


@query(f"SELECT symbol, d, {R('adjclose', 'adjclose')}, 'run-1' AS run_id FROM px", ("px",), "d")
def sink_results(v, spark, sf):
    path = new_path(spark)
    src.write_results(v("px"), path, "run-1")
    src.write_results(v("px"), path, "run-2")
    return spark.read.parquet(path).where("run_id = 'run-1'").select("symbol", "d", "adjclose", "run_id")
