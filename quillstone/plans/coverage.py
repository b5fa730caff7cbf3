"""Spans and what covers them, filters on metadata, and questions answered from the given tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import answering, coverage
from quillstone.operators.asof import SearchFilters
from quillstone.plans import standins as S

Q: dict = {}
O: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    return S.register(Q, O, name, sql)


#: A user's events other than errors are files that span some hours by their value; errors ask for twelve hours.
_SPANS = """files AS (SELECT user_id AS g, epoch(ts)::BIGINT AS a, epoch(ts)::BIGINT + floor(value * 3600)::BIGINT AS b, event_type || event_id::VARCHAR AS file FROM events WHERE event_type <> 'error'),
asks AS (SELECT user_id AS g, epoch(ts)::BIGINT AS a, epoch(ts)::BIGINT + 43200 AS b, event_id AS request FROM events WHERE event_type = 'error'),
starts AS (SELECT request, file, reach, last FROM (SELECT q.request, f.file, f.b AS reach, q.b AS last, row_number() OVER (PARTITION BY q.request ORDER BY f.b DESC, f.a DESC, f.file) AS n FROM asks q JOIN files f ON f.g = q.g AND f.a <= q.a) WHERE n = 1)"""


def _spans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    # to the nearest second, halves to even, as the SQL's cast does
    e = S.table(spark, d, "events").withColumn("a", F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long"))
    files = e.where("event_type <> 'error'").select(F.col("user_id").alias("group"), F.col("a").alias("first"), (F.col("a") + F.floor(F.col("value") * 3600)).alias("last"), F.concat("event_type", F.col("event_id").cast("string")).alias("file"))
    asks = e.where("event_type = 'error'").select(F.col("user_id").alias("group"), F.col("a").alias("first"), (F.col("a") + 43200).alias("last"), F.col("event_id").alias("request"))
    return files, asks


@query("span_containing", f"WITH {_SPANS} SELECT a.request, CASE WHEN s.reach >= a.b THEN s.file END AS file FROM asks a LEFT JOIN starts s USING (request)")
def span_containing(spark: SparkSession, d: str) -> DataFrame:
    """For each error a span of its user that holds the twelve hours from it."""
    return coverage.containing(*_spans(spark, d))


@query("span_cover", f"""WITH RECURSIVE {_SPANS},
hops AS (SELECT file, next, reach FROM (SELECT f.file, h.file AS next, h.b AS reach, f.b, row_number() OVER (PARTITION BY f.file ORDER BY h.b DESC, h.a DESC, h.file) AS n FROM files f JOIN files h ON h.g = f.g AND h.a <= f.b + 1) WHERE n = 1 AND reach > b),
chain AS (SELECT request, file, reach, last, 1 AS nth FROM starts JOIN asks USING (request) WHERE reach >= a
  UNION ALL SELECT c.request, h.next, h.reach, c.last, c.nth + 1 FROM chain c JOIN hops h USING (file) WHERE c.reach < c.last),
whole AS (SELECT request, max(nth) AS n_files FROM chain GROUP BY request HAVING max(reach) >= any_value(last))
SELECT request, n_files::BIGINT AS n_files, nth::BIGINT AS nth, file FROM chain JOIN whole USING (request)""")
def span_cover(spark: SparkSession, d: str) -> DataFrame:
    """The fewest spans of its user that leave no second of the twelve hours from an error uncovered."""
    return coverage.smallest_cover(*_spans(spark, d))


_META = "json_object('ticker', source, 'form_type', lang, 'filing_date', CASE WHEN doc_id % 11 = 0 THEN 'n/a' ELSE (DATE '2020-01-01' + (doc_id % 1500)::INT)::VARCHAR END, 'available_at', CASE WHEN doc_id % 7 <> 0 THEN strftime(DATE '2020-01-01' + (doc_id % 1500)::INT, '%Y-%m-%dT06:00:00Z') END, 'is_amendment', doc_id % 9 = 0)"


@query("metadata_filter", f"""WITH m AS (SELECT doc_id, {_META} AS meta FROM documents)
SELECT doc_id FROM m WHERE meta->>'form_type' IN ('en', 'de') AND try_cast(meta->>'filing_date' AS DATE) >= DATE '2020-06-01' AND try_cast(meta->>'available_at' AS TIMESTAMPTZ) <= TIMESTAMPTZ '2023-01-01 00:00:00+00' AND NOT coalesce((meta->>'is_amendment')::BOOLEAN, false)""")
def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents by what their metadata says as JSON; some dates are missing or no dates."""
    n = F.col("doc_id")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (n % 1500).cast("int")).cast("string")
    meta = F.to_json(F.struct(F.col("source").alias("ticker"), F.col("lang").alias("form_type"), F.when(n % 11 == 0, "n/a").otherwise(day).alias("filing_date"), F.when(n % 7 != 0, F.concat(day, F.lit("T06:00:00Z"))).alias("available_at"), (n % 9 == 0).alias("is_amendment")))
    filters = SearchFilters(forms=("en", "de"), filed_from=datetime.date(2020, 6, 1), as_of=datetime.datetime(2023, 1, 1, tzinfo=datetime.timezone.utc), amendments="exclude")
    return filters.apply_metadata(S.table(spark, d, "documents").select("doc_id", meta.alias("metadata"))).select("doc_id")


@query("answers_plan")
def answers_plan(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item asked of all documents, with lineitem's prices as facts; pytest holds the plan against stated cases."""
    ticker = F.concat(F.lit("SR"), F.translate(F.regexp_replace("source", "[^0-9]", ""), "0123456789", "ABCDEFGHIJ"))
    docs = S.table(spark, d, "documents")
    filed = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1500).cast("int"))
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "text", F.when(F.col("doc_id") % 5 == 4, "table").otherwise("text").alias("element_type"), ticker.alias("ticker"), F.when(F.col("doc_id") % 4 == 0, "10-K").otherwise("10-Q").alias("form_type"), filed.alias("filing_date"), filed.cast("timestamp").alias("available_at"))
    companies = docs.select(ticker.alias("ticker"), F.concat(F.lit("Issuer "), ticker, F.lit(" Inc.")).alias("name")).distinct()
    part = F.translate((F.col("l_suppkey") % 20).cast("string"), "0123456789", "ABCDEFGHIJ")
    facts = S.table(spark, d, "lineitem").select(F.concat(F.lit("SR"), part).alias("ticker"), F.concat(F.lit("Price"), "l_returnflag").alias("concept"), F.col("l_extendedprice").alias("value"), F.to_date("l_shipdate").alias("filed_at"), F.col("l_shipdate").cast("timestamp").alias("available_at"))
    openings = ("What is said about", "Find the table on", "Compare the growth of", "What private facts of", "In the latest 10-K, what of", "Predict the stock price by")
    asked = S.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", F.element_at(F.array(*[F.lit(o) for o in openings]), (F.col("item_id") % len(openings) + 1).cast("int")), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("SR"), F.translate((F.col("item_id") % 20).cast("string"), "0123456789", "ABCDEFGHIJ"))), "text").alias("query"))
    rows = answering.answer(asked, chunks, companies, facts)
    return rows.select("query_id", F.array_join("routes", ",").alias("routes"), F.array_join("tickers", ",").alias("tickers"), "abstained", "reason", "answer", F.array_join(F.col("citations").cast("array<string>"), ",").alias("citations"), "n_evidence", "n_tables", "n_facts", "confidence", F.array_join("errors", ",").alias("errors"))
