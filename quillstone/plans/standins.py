"""The driver's tables in the roles of the filing domain, as DataFrames and as the same SQL."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.operators.passages import lines


def register(queries: dict, oracles: dict, name: str, sql: str | None):
    """A decorator that registers a query with 64-bit integers, and its SQL if it has one."""

    def keep(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])

        queries[name] = run
        if sql:
            oracles[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as filings of their source: every ninth is an amendment of the one before, every fourth other an annual report."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    d = table(spark, sf_dir, "documents").select("doc_id", "source").withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    amended = F.col("rn") % 9 == 0
    d = d.withColumn("is_amendment", amended).withColumn("k", F.col("rn") - amended.cast("int"))
    form = F.when(F.col("k") % 4 == 0, "10-K").otherwise("10-Q")
    d = d.withColumn("base_form", form).withColumn("form_type", F.concat("base_form", F.when(amended, "/A").otherwise("")))
    d = d.withColumn("period_end", F.date_add(F.lit("2015-03-31").cast("date"), 91 * (F.col("k") - 1)))
    d = d.withColumn("available_at", F.date_add("period_end", (15 + F.col("doc_id") % 45 + F.when(amended, 60).otherwise(0)).cast("int")))
    before = F.lag("doc_id").over(Window.partitionBy("source").orderBy("doc_id"))
    d = d.withColumn("amends_accession", F.when(amended, F.concat(F.lit("acc-"), before.cast("string"))))
    d = d.join(texts, "doc_id")  # numbered without their texts
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("company"), "text", "lang", "n_chars", "is_amendment", "base_form", "form_type", "period_end", "available_at", F.concat(F.lit("acc-"), F.col("doc_id").cast("string")).alias("accession"), "amends_accession")


FILINGS = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS before_id FROM documents),
keyed AS (SELECT *, rn % 9 = 0 AS is_amendment, rn - CASE WHEN rn % 9 = 0 THEN 1 ELSE 0 END AS k FROM numbered),
dated AS (SELECT *, CASE WHEN k % 4 = 0 THEN '10-K' ELSE '10-Q' END AS base_form, DATE '2015-03-31' + CAST(91 * (k - 1) AS INTEGER) AS period_end FROM keyed),
filings AS (SELECT doc_id AS id, source AS company, text, lang, n_chars, is_amendment, base_form, base_form || CASE WHEN is_amendment THEN '/A' ELSE '' END AS form_type, period_end,
  period_end + CAST(15 + doc_id % 45 + CASE WHEN is_amendment THEN 60 ELSE 0 END AS INTEGER) AS available_at, 'acc-' || doc_id::VARCHAR AS accession,
  CASE WHEN is_amendment THEN 'acc-' || before_id::VARCHAR END AS amends_accession FROM dated)"""

COMPARABLE = """
pairs AS (SELECT c.id, p.id AS prior_id, row_number() OVER (PARTITION BY c.id ORDER BY
    CASE WHEN c.base_form = '10-Q' THEN abs(date_diff('day', c.period_end - 365, p.period_end)) END,
    p.period_end DESC, CASE WHEN c.base_form <> '10-Q' THEN p.available_at END DESC, CASE WHEN c.base_form = '10-Q' THEN p.id END, p.id DESC) AS n
  FROM filings c JOIN filings p ON c.company = p.company AND c.base_form = p.base_form AND p.id <> c.id AND NOT p.is_amendment AND p.period_end < c.period_end AND p.available_at <= c.available_at),
comparable AS (SELECT c.id, coalesce(o.id, b.prior_id) AS prior_id, CASE WHEN o.id IS NOT NULL THEN 'amendment_to_original' WHEN b.prior_id IS NULL THEN 'none'
    WHEN c.base_form = '10-Q' THEN 'same_quarter_prior_year' WHEN c.base_form = '10-K' THEN 'prior_annual_period' ELSE 'prior_period' END AS basis
  FROM filings c LEFT JOIN filings o ON c.is_amendment AND o.accession = c.amends_accession AND o.available_at <= c.available_at
  LEFT JOIN (SELECT * FROM pairs WHERE n = 1) b ON b.id = c.id)"""


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, reading_order, section, passage, element_type): lines of documents as elements of filings; every fifth stands for a table."""
    rows = lines(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), "id")
    return rows.select("id", "reading_order", F.concat(F.lit("S"), (F.col("reading_order") % 4).cast("string")).alias("section"), "passage", F.when(F.col("reading_order") % 5 == 4, "table").otherwise("text").alias("element_type"))


PASSAGES = """
split_lines AS (SELECT doc_id AS id, string_split(text, chr(10)) AS parts FROM documents),
passages AS (SELECT id, i - 1 AS reading_order, 'S' || ((i - 1) % 4)::VARCHAR AS section, parts[i] AS passage, CASE WHEN (i - 1) % 5 = 4 THEN 'table' ELSE 'text' END AS element_type
  FROM (SELECT id, parts, unnest(range(1, len(parts) + 1)) AS i FROM split_lines) WHERE trim(parts[i]) <> '')"""

PRINT = "sha256(lower(trim(regexp_replace(passage, '[ \\t\\n\\r\\f]+', ' ', 'g'))))"


def print_of(passage):
    """The fingerprint on white space that both engines agree on."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(passage, r"[ \t\n\r\f]+", " "))).cast("binary"), 256)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean order prices by customer segment as bars, and of all as the benchmark SPY."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    day = F.to_date("o_orderdate")
    mean = F.sum(cents).cast("double") / F.count("*")
    own = o.groupBy(F.col("c_mktsegment").alias("ticker"), day.alias("date")).agg(mean.alias("adjusted_close"))
    return own.unionByName(o.groupBy(F.lit("SPY").alias("ticker"), day.alias("date")).agg(mean.alias("adjusted_close")))


BARS = """
priced AS (SELECT c_mktsegment AS ticker, CAST(o_orderdate AS DATE) AS date, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey),
bars AS (SELECT ticker, date, sum(cents)::DOUBLE / count(*) AS adjusted_close FROM priced GROUP BY ticker, date UNION ALL SELECT 'SPY', date, sum(cents)::DOUBLE / count(*) FROM priced GROUP BY date),
indexed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS session FROM bars)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filing events of their segment; the feature is the order's price."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    at = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 24) * 3600)
    return o.select(F.col("c_mktsegment").alias("ticker"), F.col("o_orderkey").alias("accession"), at.alias("available_at"), at.alias("max_source_available_at"), F.col("o_totalprice").alias("feature_value"))


EVENTS = """
events_ AS (SELECT c_mktsegment AS ticker, o_orderkey AS accession, o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT)) AS available_at, o_totalprice AS feature_value
  FROM orders JOIN customer ON o_custkey = c_custkey),
local AS (SELECT *, (available_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS at_ny FROM events_),
targeted AS (SELECT *, CAST(at_ny AS DATE) + CASE WHEN CAST(at_ny AS TIME) >= TIME '16:00:00' THEN 1 ELSE 0 END AS target FROM local),
placed AS MATERIALIZED (SELECT e.ticker, e.accession, e.available_at, e.feature_value, b.session, b.date AS session_date FROM targeted e ASOF JOIN (SELECT * FROM indexed WHERE ticker <> 'SPY') b ON e.ticker = b.ticker AND e.target <= b.date)"""

RETURNS = """
wins(win, s, e) AS (VALUES ('0:1', 0, 1), ('-1:1', -1, 1), ('0:5', 0, 5)),
legs AS MATERIALIZED (SELECT p.*, w.win, p.session + w.s AS i_s, p.session + w.e AS i_e FROM placed p CROSS JOIN wins w),
beside AS MATERIALIZED (SELECT b.ticker, b.session, b.adjusted_close, s.adjusted_close AS spy FROM indexed b JOIN bars s ON s.ticker = 'SPY' AND s.date = b.date),
returns AS MATERIALIZED (SELECT l.accession, l.ticker, l.win AS "window", l.session, l.session_date, l.feature_value, b.adjusted_close / a.adjusted_close - 1 AS asset_return, b.spy / a.spy - 1 AS benchmark_return,
    (b.adjusted_close / a.adjusted_close - 1) - (b.spy / a.spy - 1) AS abnormal_return
  FROM legs l JOIN beside a ON a.ticker = l.ticker AND a.session = l.i_s JOIN beside b ON b.ticker = l.ticker AND b.session = l.i_e)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as facts: key (part, supplier), filed on the ship date, value the extended price."""
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", F.to_date("l_shipdate").alias("filed_at"), F.col("l_extendedprice").alias("value"))


FACT_KEYS, FACT_TIE = ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber", "l_quantity", "value"]
FACTS = "facts AS (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity, CAST(l_shipdate AS DATE) AS filed_at, l_extendedprice AS value FROM lineitem)"

#: Questions that occur in the invented prose.
QUESTIONS = ((1, "the order of things"), (2, "there is more than this"), (3, "and to the one that is not"))


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUESTIONS), "query_id int, query string")


QUESTIONS_SQL = "questions(query_id, query) AS (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS) + ")"
POSTINGS = """
toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents),
tfs AS (SELECT doc_id, token, count(*) AS tf FROM toks GROUP BY doc_id, token),
wanted AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(query, '[a-z0-9]+'))) AS token, len(list_distinct(regexp_extract_all(query, '[a-z0-9]+'))) AS n FROM questions)"""

