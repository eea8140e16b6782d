"""Landing files to tables and back. Readers take a path of files as they were delivered (multiline) or of
one document a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _day(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


_EVENTS = "events STRUCT<dividends: MAP<STRING, STRUCT<amount: DOUBLE, date: BIGINT>>, splits: MAP<STRING, STRUCT<date: BIGINT, numerator: DOUBLE, denominator: DOUBLE, splitRatio: STRING>>>"
_CHART = f"symbol STRING, chart STRUCT<result: ARRAY<STRUCT<timestamp: ARRAY<BIGINT>, indicators: STRUCT<quote: ARRAY<STRUCT<close: ARRAY<DOUBLE>>>, adjclose: ARRAY<STRUCT<adjclose: ARRAY<DOUBLE>>>>, {_EVENTS.replace('events STRUCT', 'events: STRUCT')}>>>"


def read_price_payloads(spark: SparkSession, path: str, multiline: bool = False, fall_back: bool = True) -> DataFrame:
    """symbol, d, close, adjclose from parallel arrays. Days without a close go; a missing adjclose is the
    close if fall_back, else such days go."""
    r = spark.read.schema(_CHART).json(path, multiLine=multiline).select("symbol", F.get("chart.result", F.lit(0)).alias("r"))
    arrays = F.arrays_zip(F.col("r.timestamp").alias("t"), F.get("r.indicators.quote", F.lit(0))["close"].alias("c"), F.get("r.indicators.adjclose", F.lit(0))["adjclose"].alias("a"))
    rows = r.select("symbol", F.explode(arrays).alias("x")).select("symbol", _day(F.col("x.t")).alias("d"), F.col("x.c").alias("close"), F.col("x.a").alias("adjclose"))
    rows = rows.where("close IS NOT NULL")
    return rows.withColumn("adjclose", F.coalesce("adjclose", "close")) if fall_back else rows.where("adjclose IS NOT NULL")


def read_actions(spark: SparkSession, path: str, kind: str = "dividends", multiline: bool = False) -> DataFrame:
    """Dividends (symbol, d, amount) or splits (symbol, d, numerator, denominator, split_ratio)."""
    r = spark.read.schema(_CHART).json(path, multiLine=multiline).select("symbol", F.get("chart.result", F.lit(0))["events"][kind].alias("m"))
    rows = r.where("m IS NOT NULL").select("symbol", F.explode(F.map_values("m")).alias("x"))
    if kind == "dividends":
        return rows.select("symbol", _day(F.col("x.date")).alias("d"), F.col("x.amount").alias("amount"))
    return rows.select("symbol", _day(F.col("x.date")).alias("d"), "x.numerator", "x.denominator", F.col("x.splitRatio").alias("split_ratio"))


def read_markets(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """market_id, question and days of creation and end: resolution, else close, else creation; 0 counts
    as missing."""
    m = spark.read.schema("id STRING, question STRING, createdTime BIGINT, closeTime BIGINT, resolutionTime BIGINT").json(path, multiLine=multiline)
    end = F.coalesce(F.nullif("resolutionTime", F.lit(0)), F.nullif("closeTime", F.lit(0)), "createdTime")
    day = lambda ms: F.to_date(F.timestamp_millis(ms))
    return m.select(F.col("id").alias("market_id"), "question", day(F.col("createdTime")).alias("start_d"), day(end).alias("end_d"))


def read_bets(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    b = spark.read.schema("contractId STRING, createdTime BIGINT, probBefore DOUBLE, probAfter DOUBLE").json(path, multiLine=multiline)
    return b.select(F.col("contractId").alias("market_id"), F.timestamp_millis("createdTime").alias("ts"), F.col("probBefore").alias("prob_before"), F.col("probAfter").alias("prob_after"))


def read_rates(spark: SparkSession, path: str, value: str = "TB3MS") -> DataFrame:
    """d, annual_rate from percent; '.' and empty values go."""
    r = spark.read.schema(f"DATE STRING, {value} STRING").csv(path, header=True, nullValue=".")
    return r.where(F.col(value).isNotNull()).select(F.to_date("DATE").alias("d"), (F.col(value).cast("double") / 100).alias("annual_rate"))


_FILINGS = ("accessionNumber", "filingDate", "form", "acceptanceDateTime", "primaryDocument", "primaryDocDescription", "reportDate")
_COLUMNS = ", ".join(f"{c}: ARRAY<STRING>" for c in _FILINGS)


def read_filing_index(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Rows of columnar filing lists, whether nested under filings.recent or, as in further pages, bare;
    the first of an accession number stays."""
    f = spark.read.schema(f"cik STRING, filings STRUCT<recent: STRUCT<{_COLUMNS}>>, " + _COLUMNS.replace(":", "")).json(path, multiLine=multiline)
    zipped = F.arrays_zip(*[F.coalesce(F.col(f"filings.recent.{c}"), F.col(c), F.array().cast("array<string>")).alias(c) for c in _FILINGS])
    return _first_filings(f.select("cik", F.posexplode(zipped).alias("seq", "x")), F.col("seq"))


def _there(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    """Paths of those names that exist in a folder; the folder is not listed."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    return [f"{folder}/{n}" for n in names if fs.exists(path(folder, n))]


def read_filing_history(spark: SparkSession, path: str, folder: str, multiline: bool = False) -> DataFrame:
    """Filings of main payloads (cik, filings.recent, filings.files[].name) and of the further pages that these
    name, which lie in `folder` and have no cik of their own; the first of an accession number stays: the main
    payload's, then that of the page named first. Pages that no payload names are not read, those that are named
    but missing are left out. The driver holds the pages' names, as Spark's own index of files does."""
    kind = f"cik STRING, filings STRUCT<recent: STRUCT<{_COLUMNS}>, files: ARRAY<STRUCT<name: STRING>>>"
    main = spark.read.schema(kind).json(path, multiLine=multiline)
    named = main.select("cik", F.posexplode("filings.files.name").alias("page_no", "page")).where("page IS NOT NULL")
    listed = sorted(r["page"] for r in named.select("page").distinct().collect())
    columns = lambda at: F.arrays_zip(*[F.coalesce(F.col(at + c), F.array().cast("array<string>")).alias(c) for c in _FILINGS])
    rows = main.select("cik", F.lit(-1).alias("page_no"), F.posexplode(columns("filings.recent.")).alias("seq", "x"))
    if there := _there(spark, folder, listed):
        # A page is a file, or a folder of files.
        beside = folder.rstrip("/").rpartition("/")[2]
        pages = spark.read.schema(_COLUMNS.replace(":", "")).option("ignoreMissingFiles", "true").json(there, multiLine=multiline)
        page = F.regexp_extract(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), rf"/\Q{beside}\E/([^/]+)", 1)
        more = pages.select(page.alias("page"), F.posexplode(columns("")).alias("seq", "x")).join(named, "page")
        rows = rows.unionByName(more.select("cik", "page_no", "seq", "x"))
    return _first_filings(rows, F.struct("page_no", "seq"))


def _first_filings(rows: DataFrame, order: Column) -> DataFrame:
    first = rows.select("cik", order.alias("place"), "x.*").groupBy("cik", "accessionNumber").agg(F.min_by(F.struct("form", "filingDate", "acceptanceDateTime", "primaryDocument", "primaryDocDescription", "reportDate"), "place").alias("x"))
    return first.select("cik", F.col("accessionNumber").alias("accession_number"), "x.form", F.to_date("x.filingDate").alias("filing_date"), F.to_timestamp("x.acceptanceDateTime").alias("acceptance_ts"), F.col("x.primaryDocument").alias("primary_document"), F.col("x.primaryDocDescription").alias("primary_doc_description"), F.to_date("x.reportDate").alias("report_date"))


def read_facts(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Long facts from maps taxonomy -> tag -> unit -> rows; unit_no is the unit's place in its map, as delivered."""
    kind = "cik STRING, facts MAP<STRING, MAP<STRING, STRUCT<units: MAP<STRING, ARRAY<STRUCT<start: STRING, end: STRING, filed: STRING, val: DOUBLE>>>>>>"
    t = spark.read.schema(kind).json(path, multiLine=multiline).select("cik", F.explode("facts").alias("taxonomy", "tags")).select("cik", "taxonomy", F.explode("tags").alias("tag", "v"))
    rows = t.select("cik", "taxonomy", "tag", F.posexplode("v.units").alias("unit_no", "unit", "rows")).select("cik", "taxonomy", "tag", "unit", "unit_no", F.inline("rows"))
    return rows.select("cik", "taxonomy", "tag", "unit", "unit_no", F.to_date("start").alias("start_d"), F.to_date("end").alias("end_d"), F.to_date("filed").alias("filed"), "val")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole files; bytes that are no UTF-8 are left out."""
    return spark.read.format("binaryFile").load(path).select("path", F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit("")).alias("text"))


def read_seeds(spark: SparkSession, path: str, field: str, row: str, multiline: bool = True) -> DataFrame:
    """Rows of a list `field` of a JSON document; row: their DDL type."""
    return spark.read.schema(f"{field} ARRAY<STRUCT<{row}>>").json(path, multiLine=multiline).select(F.inline(field))


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    """An earlier run's daily curves."""
    return spark.read.schema("symbol STRING, strategy STRING, d DATE, position DOUBLE, daily_return DOUBLE, equity DOUBLE").csv(path, header=True)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """strategy, metric, value of a run's summary, one JSON document {strategy: {metric: number}}; values that
    are no numbers go."""
    t = spark.read.text(path, wholetext=True).select(F.from_json("value", "MAP<STRING, MAP<STRING, STRING>>").alias("m"))
    rows = t.select(F.explode("m").alias("strategy", "metrics")).select("strategy", F.explode("metrics").alias("metric", "v"))
    return rows.select("strategy", "metric", F.col("v").try_cast("double").alias("value")).where("value IS NOT NULL")


def write_summary(summary: DataFrame, path: str) -> None:
    """A run's summary (strategy, metric, value) as one JSON document; it has a number for each strategy and metric."""
    each = summary.groupBy("strategy").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    each.groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("strategy", "m")))).alias("value")).coalesce(1).write.text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays, maps and structs as JSON text."""
    nested = [c for c, k in df.dtypes if k.startswith(("array", "map", "struct"))]
    df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns]).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_results(df: DataFrame, path: str, run_id: str) -> None:
    """One Parquet table for each result, a partition for each run; a repeated run replaces its own."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
