"""Logical tables over the given ones. The SQL runs in Spark and in DuckDB alike, so that queries and
their oracles start from the same rows; every table is used whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut

_DAY = "CAST(o_orderdate AS DATE)"
_ALL = "orders JOIN customer ON o_custkey = c_custkey"
SQL = {
    "px": f"SELECT c_mktsegment AS symbol, {_DAY} AS d, 100 + max_by(o_totalprice, o_orderkey) / CAST(1e5 AS DOUBLE) AS adjclose FROM {_ALL} GROUP BY c_mktsegment, {_DAY}",
    "mkt": f"SELECT {_DAY} AS d, 100 + max_by(o_totalprice, o_orderkey) / CAST(1e5 AS DOUBLE) AS adjclose FROM orders GROUP BY {_DAY}",
    "sector": f"SELECT {_DAY} AS d, 100 + max_by(o_totalprice, o_orderkey) / CAST(1e5 AS DOUBLE) AS adjclose FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY {_DAY}",
    "vix": f"SELECT {_DAY} AS d, 15 + max_by(o_totalprice, o_orderkey) / CAST(5e4 AS DOUBLE) AS adjclose FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY {_DAY}",
    "rates": f"SELECT CAST(date_trunc('month', {_DAY}) AS DATE) AS d, CAST(1 + min(month({_DAY})) % 5 AS DOUBLE) / 100 AS annual_rate FROM orders GROUP BY CAST(date_trunc('month', {_DAY}) AS DATE)",
    "probs": "SELECT l_suppkey % 40 AS event_id, CAST(l_shipdate AS DATE) AS d, l_linestatus AS source, max_by(l_discount, l_orderkey * 10 + l_linenumber) * 10 AS probability, "
    "CAST(CASE WHEN l_linestatus = 'O' THEN 0.21 ELSE 0.25 END AS DOUBLE) AS source_brier, "
    "CASE l_suppkey % 40 % 5 WHEN 0 THEN 'kinetic' WHEN 1 THEN 'sovereign' WHEN 2 THEN 'trade' WHEN 3 THEN 'monetary' ELSE 'other' END AS category, "
    "max(CAST(l_shipdate AS DATE)) OVER (PARTITION BY l_suppkey % 40) AS resolution_date, CASE WHEN l_suppkey % 40 % 3 = 0 THEN 'YES' ELSE 'NO' END AS outcome "
    "FROM lineitem GROUP BY l_suppkey % 40, CAST(l_shipdate AS DATE), l_linestatus",
    "bets": "SELECT user_id AS market_id, event_id AS bet_id, ts, CAST(ts AS DATE) AS d, value / (value + 50) AS prob_after FROM events",
    "ledger": f"SELECT concat(c_mktsegment, '-', CAST(max_by(o_orderkey, o_totalprice) AS VARCHAR(20))) AS event_id, c_mktsegment AS ticker, max_by({_DAY}, o_totalprice) AS announced, max_by(o_orderkey, o_totalprice) * 7 % 24 AS hour, max(o_totalprice) * 10 AS amount "
    f"FROM {_ALL} GROUP BY c_mktsegment, date_trunc('month', {_DAY})",
    "dividends": f"SELECT c_mktsegment AS symbol, CAST(date_trunc('quarter', {_DAY}) AS DATE) AS d, CAST(count(*) % 7 AS DOUBLE) / 10 AS amount FROM {_ALL} GROUP BY c_mktsegment, CAST(date_trunc('quarter', {_DAY}) AS DATE)",
    "facts": f"SELECT c_mktsegment AS symbol, tag, CAST(date_trunc('quarter', {_DAY}) AS DATE) AS start_d, CAST(date_trunc('quarter', {_DAY}) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS end_d, "
    f"CAST(date_trunc('quarter', {_DAY}) + INTERVAL 4 MONTH AS DATE) AS filed, CAST(count(*) * CASE tag WHEN 'revenue' THEN 1000000 WHEN 'operating_income' THEN 100000 WHEN 'capex' THEN 80000 ELSE 50000 END AS DOUBLE) AS val "
    f"FROM {_ALL} CROSS JOIN (SELECT 'revenue' AS tag UNION ALL SELECT 'operating_income' UNION ALL SELECT 'capex' UNION ALL SELECT 'repurchases') t GROUP BY c_mktsegment, tag, date_trunc('quarter', {_DAY})",
    # Facts as they were filed: some firms lack the first tag of a concept, one has it only later; units come in orders of
    # their own; the first quarter of a year is amended.
    "raw_facts": "SELECT c_mktsegment AS symbol, t.taxonomy, t.tag, t.unit, t.unit_no, CAST(q AS DATE) AS start_d, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS end_d, CAST(q + INTERVAL 4 MONTH AS DATE) + a.late AS filed, CAST(n * t.factor * a.times AS DOUBLE) AS val "
    f"FROM (SELECT c_mktsegment, date_trunc('quarter', {_DAY}) AS q, count(*) AS n FROM {_ALL} GROUP BY c_mktsegment, date_trunc('quarter', {_DAY})) o CROSS JOIN (VALUES "
    "('us-gaap', 'RevenueFromContractWithCustomerExcludingAssessedTax', 'USD', 0, 'AB', '1992-01-01', 1000000), ('us-gaap', 'SalesRevenueNet', 'USD', 0, 'ABFMH', '1992-01-01', 900000), ('us-gaap', 'OperatingIncomeLoss', 'USD', 0, 'ABFMH', '1992-01-01', 100000), "
    "('us-gaap', 'PaymentsToAcquirePropertyPlantAndEquipment', 'EUR', 0, 'F', '1992-01-01', 70000), ('us-gaap', 'PaymentsToAcquirePropertyPlantAndEquipment', 'USD', 1, 'F', '1992-01-01', 80000), ('us-gaap', 'PaymentsToAcquirePropertyPlantAndEquipment', 'USD', 0, 'ABMH', '1992-01-01', 80000), "
    "('us-gaap', 'PaymentsForRepurchaseOfCommonStock', 'USD', 0, 'AM', '1992-01-01', 50000), ('us-gaap', 'PaymentsForRepurchaseOfCommonStock', 'EUR', 1, 'AM', '1992-01-01', 45000), ('us-gaap', 'PaymentsForRepurchaseOfCommonStock', 'USD', 0, 'F', '1999-01-01', 50000), "
    "('us-gaap', 'StockRepurchasedAndRetiredDuringPeriodValue', 'USD', 0, 'BF', '1992-01-01', 60000), ('us-gaap', 'TreasuryStockValueAcquiredCostMethod', 'EUR', 0, 'BH', '1992-01-01', 70000), ('us-gaap', 'TreasuryStockValueAcquiredCostMethod', 'USD', 1, 'BH', '1992-01-01', 75000), "
    "('dei', 'EntityCommonStockSharesOutstanding', 'shares', 0, 'AFM', '1992-01-01', 1000000), ('dei', 'EntityCommonStockSharesOutstanding', 'thousands', 1, 'AFM', '1992-01-01', 1000), ('dei', 'EntityCommonStockSharesOutstanding', 'thousands', 0, 'BH', '1992-01-01', 1000), ('dei', 'EntityCommonStockSharesOutstanding', 'shares', 1, 'BH', '1992-01-01', 1000000)"
    ") AS t(taxonomy, tag, unit, unit_no, firms, since, factor) CROSS JOIN (VALUES (0, CAST(1 AS DOUBLE)), (200, CAST(1.25 AS DOUBLE))) AS a(late, times) WHERE instr(t.firms, substr(c_mktsegment, 1, 1)) > 0 AND q >= CAST(t.since AS DATE) AND (a.late = 0 OR month(q) = 1)",
    "filing_docs": "SELECT 4 * CAST(floor(doc_id / CAST(14 AS DOUBLE)) AS BIGINT) + CASE WHEN doc_id % 14 < 6 THEN 0 WHEN doc_id % 14 < 10 THEN 1 WHEN doc_id % 14 < 12 THEN 2 ELSE 3 END AS filing, doc_id, "
    "CASE WHEN doc_id % 14 IN (0, 6, 10, 12) THEN 'main.htm' WHEN doc_id % 14 IN (1, 7, 11, 13) THEN 'ex99-1.htm' WHEN doc_id % 14 IN (2, 8) THEN 'notes.txt' WHEN doc_id % 14 IN (3, 9) THEN 'EX-99_2.html' WHEN doc_id % 14 = 4 THEN '99.1.txt' ELSE 'ex99-3.htm' END AS name, text FROM documents",
    "filings": "SELECT filing, form, filed, CASE WHEN filing % 3 = 0 THEN NULL ELSE CAST(filed AS TIMESTAMP) + INTERVAL 18 HOUR END AS accepted, CASE WHEN filing % 2 = 0 THEN 'current report' ELSE '' END AS description FROM ("
    "SELECT filing, CASE WHEN filing % 4 = 3 THEN '10-Q' ELSE '8-K' END AS form, DATE '1995-01-01' + CAST(filing * 7 % 2400 AS INTEGER) AS filed FROM ("
    "SELECT DISTINCT 4 * CAST(floor(doc_id / CAST(14 AS DOUBLE)) AS BIGINT) + CASE WHEN doc_id % 14 < 6 THEN 0 WHEN doc_id % 14 < 10 THEN 1 WHEN doc_id % 14 < 12 THEN 2 ELSE 3 END AS filing FROM documents) f) g",
    "exclusions": f"SELECT c_mktsegment AS ticker, {_DAY} AS announced, concat('closing_', CAST(month({_DAY}) AS VARCHAR(2))) AS reason FROM {_ALL} WHERE day({_DAY}) >= 28 GROUP BY c_mktsegment, {_DAY}",
    # Statements of four firms each: a release and a primary document; some releases, some periodic reports and some
    # whole statements are empty.
    "statements": "SELECT filing * 4 + j AS filing, CASE (filing + j) % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'MACHINERY' ELSE 'HOUSEHOLD' END AS ticker, CASE WHEN filing % 3 = 2 THEN '10-Q' ELSE '8-K' END AS form, DATE '1994-12-01' + CAST((filing * 74 + 233 * j) % 2400 AS INTEGER) AS filed "
    "FROM (SELECT DISTINCT CAST(floor(doc_id / CAST(2 AS DOUBLE)) AS BIGINT) AS filing FROM documents) f CROSS JOIN (VALUES (0), (1), (2), (3)) AS t(j)",
    "statement_docs": "SELECT filing * 4 + j AS filing, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'main.htm' ELSE 'ex99-1.htm' END AS name, CASE WHEN filing % 11 = 5 OR (filing % 4 = 1 AND doc_id % 2 = 1) OR (filing % 13 = 2 AND doc_id % 2 = 0) THEN ' ' ELSE text END AS text FROM (SELECT CAST(floor(doc_id / CAST(2 AS DOUBLE)) AS BIGINT) AS filing, doc_id, text FROM documents) f CROSS JOIN (VALUES (0), (1), (2), (3)) AS t(j)",
    "firms": "SELECT * FROM (VALUES ('AUTOMOBILE', 'Automobile', 'standard', 30), ('BUILDING', 'Building', 'standard', 40), ('FURNITURE', 'Furniture', 'internal_reallocation', 50), ('MACHINERY', 'Machinery', 'standard', 60), ('HOUSEHOLD', 'Household', 'standard', 100)) AS f(ticker, name, variant, target_count)",
}
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical table as a DataFrame. Given tables are named inside the SQL only for this call."""
    sql = SQL[name]
    given = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}" in sql.replace("(", " ")}
    for t in given:
        sql = _replace(sql, t)
    return spark.sql(sql, **given)


class Views:
    """The logical tables of one run of a query. `once` writes a table that the query mentions more than once, so
    that its lineage runs once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._sf_dir, self._written = spark, sf_dir, {}

    def __call__(self, name: str) -> DataFrame:
        return view(self._spark, self._sf_dir, name)

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._written:
            self._written[name] = cut(make())
        return self._written[name]


def _replace(sql: str, table: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", sql)


def with_views(*names: str) -> str:
    """The WITH clause of an oracle."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 decimals, without a negative zero; dates as text."""
    kinds = {"double": lambda c: (F.round(c, 6) + F.lit(0.0)).alias(c), "date": lambda c: F.col(c).cast("string").alias(c)}
    return df.select(*[kinds.get(k, F.col)(c) for c, k in df.dtypes])


def dates_as_text(sql: str, names: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'CAST({n} AS VARCHAR) AS {n}' for n in names.split())}) FROM ({sql})" if names else sql
