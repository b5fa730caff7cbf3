"""Evaluation reports, source payloads, universes and table maintenance as queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.functions.numbers import cut6, parse_vector
from quillstone.operators import evals, quality, retrieval, stats
from quillstone.plans import standins as S
from quillstone.sources import readers

Q: dict = {}
O: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    return S.register(Q, O, name, sql)


_ASKED = """asked AS (SELECT l.doc_id AS question_id, CASE WHEN l.doc_id % 3 = 0 THEN 'table' ELSE 'narrative' END AS category, CASE WHEN l.doc_id % 5 = 0 THEN [] ELSE [d.lang] END AS expected_sections, [d.source] AS expected_tickers,
  ['q' || (l.doc_id % 4)::VARCHAR, 'q' || (l.doc_id % 7)::VARCHAR] AS labels, l.toxic = 1 AS should_abstain, d.lang, d.source, d.n_chars, l.quality FROM labels l JOIN documents d USING (doc_id))"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as questions; toxic ones are to be abstained from."""
    rows = S.table(spark, d, "labels").join(S.table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    q = lambda m: F.concat(F.lit("q"), (F.col("doc_id") % m).cast("string"))
    return rows.select(
        F.col("doc_id").alias("question_id"), F.when(F.col("doc_id") % 3 == 0, "table").otherwise("narrative").alias("category"), F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("lang")).alias("expected_sections"),
        F.array("source").alias("expected_tickers"), F.array(q(4), q(7)).alias("labels"), (F.col("toxic") == 1).alias("should_abstain"), "lang", "source", "n_chars", "quality",
    )


_C = lambda x: f"floor(({x}) * 1e6 + 0.5) / 1e6"
_F1 = lambda t, f, m: f"coalesce(2.0 * {t} / nullif(2 * {t} + {f} + {m}, 0), 0)"


@query("variant_report", f"""WITH {_ASKED}, o AS (SELECT *, (question_id * v % 11) / 10.0::DOUBLE AS recall, (question_id * v % 7) / 8.0::DOUBLE AS precision, CASE WHEN question_id % v = 0 THEN 1.0 ELSE 0.25 END::DOUBLE AS rr, (question_id * v % 5) / 4.0::DOUBLE AS ndcg,
   CASE WHEN v = 1 THEN lang ELSE 'en' END AS section, CASE WHEN v = 1 THEN 'src0' ELSE source END AS ticker, CASE WHEN question_id % 2 = 0 THEN ['q' || (question_id % (3 + v))::VARCHAR, 'q0'] ELSE [] END AS citations, quality = v - 1 AS abstained, n_chars * v AS latency, n_chars * v / 1e6::DOUBLE AS cost
  FROM asked CROSS JOIN (VALUES (1), (2)) x(v)),
j AS (SELECT *, CASE WHEN len(expected_sections) = 0 OR list_contains(expected_sections, section) THEN 1.0 ELSE 0.0 END AS s_hit, CASE WHEN list_contains(expected_tickers, ticker) THEN 1.0 ELSE 0.0 END AS t_hit,
  CASE WHEN len(citations) > 0 THEN len(list_filter(list_distinct(citations), lambda c: list_contains(labels, c)))::DOUBLE / len(list_distinct(citations)) WHEN should_abstain THEN 1.0 ELSE 0.0 END AS precise FROM o),
g AS (SELECT v, avg(recall) AS a, avg(precision) AS b, avg(rr) AS c, avg(ndcg) AS d, avg(s_hit) AS e, avg(t_hit) AS f, avg(recall) FILTER (category = 'table') AS h, avg(precise) AS i, median(latency) AS l50, list_sort(list(latency)) AS ls, avg(cost) AS m, count(*) AS n,
  count(*) FILTER (should_abstain AND abstained) AS tp, count(*) FILTER (NOT should_abstain AND abstained) AS fp, count(*) FILTER (should_abstain AND NOT abstained) AS fn, count(*) FILTER (NOT should_abstain AND NOT abstained) AS tn FROM j GROUP BY v)
SELECT 'v' || v::VARCHAR AS variant, {_C('a')} AS recall, {_C('b')} AS precision, {_C('c')} AS rr, {_C('d')} AS ndcg, {_C('e')} AS section_hit_rate, {_C('f')} AS ticker_accuracy, {_C('coalesce(h, 0)')} AS table_recall, {_C('i')} AS citation_precision, {_C('f')} AS entity_accuracy,
 {_C('l50')} AS latency_p50, {_C('ls[greatest(1, ceil(n * 0.95))::INT]')} AS latency_p95, {_C('m')} AS mean_cost, n AS questions, {_C('coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)')} AS abstention_precision, {_C('coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)')} AS abstention_recall,
 {_C(f"({_F1('tp', 'fp', 'fn')} + {_F1('tn', 'fn', 'fp')}) / 2")} AS abstention_f1 FROM g""")
def variant_report(spark: SparkSession, d: str) -> DataFrame:
    """Two variants of made-up outcomes of every question."""
    rows, v, i = _asked(spark, d).withColumn("v", F.explode(F.array(F.lit(1), F.lit(2)))), F.col("v"), F.col("question_id")
    ticker = F.array(F.when(v == 1, "src0").otherwise(F.col("source")))
    outcomes = rows.select(
        F.concat(F.lit("v"), v.cast("string")).alias("variant"), "question_id", (i * v % 11 / 10.0).alias("recall"), (i * v % 7 / 8.0).alias("precision"), F.when(i % v == 0, 1.0).otherwise(0.25).alias("rr"), (i * v % 5 / 4.0).alias("ndcg"),
        F.array(F.when(v == 1, F.col("lang")).otherwise("en")).alias("sections"), ticker.alias("tickers"), F.when(i % 2 == 0, F.array(F.concat(F.lit("q"), (i % (3 + v)).cast("string")), F.lit("q0"))).otherwise(F.array().cast("array<string>")).alias("citations"),
        (F.col("quality") == v - 1).alias("abstained"), ticker.alias("inferred_tickers"), (F.col("n_chars") * v).alias("latency_ms"), (F.col("n_chars") * v / 1e6).alias("cost"),
    )
    out = evals.variant_report(_asked(spark, d).drop("lang", "source", "n_chars", "quality"), outcomes)
    return out.select("variant", "questions", *[cut6(F.col(c).cast("double")).alias(c) for c in out.columns if c not in ("variant", "questions")])


@query("answer_rates", f"""WITH {_ASKED}, a AS (SELECT question_id, question_id % 6 = 0 AS abstained, CASE WHEN question_id % 4 > 0 THEN [question_id, question_id + question_id % 3] END AS cited, question_id % 10 / 10.0::DOUBLE AS confidence, expected_sections FROM asked),
t AS (SELECT a.*, NOT abstained AND cited IS NOT NULL AS told FROM a),
c AS (SELECT t.question_id, e.question_id IS NOT NULL AS held, coalesce(e.ticker_ok AND (len(t.expected_sections) = 0 OR e.section_ok), false) AS fits FROM (SELECT *, unnest(cited) AS chunk FROM t WHERE told) t
  LEFT JOIN (SELECT question_id, question_id + x.k AS chunk, x.k = 0 AS ticker_ok, question_id % 2 = 0 AS section_ok FROM asked CROSS JOIN (VALUES (0), (1)) x(k)) e ON e.question_id = t.question_id AND e.chunk = t.chunk),
g AS (SELECT question_id, bool_and(held) AS grounded, bool_or(fits) AS fits FROM c GROUP BY question_id)
SELECT {_C('count(*) FILTER (told)::DOUBLE / count(*)')} AS answer_rate, {_C('count(*) FILTER (told AND fits)::DOUBLE / count(*)')} AS on_target, {_C('count(*) FILTER (told AND grounded)::DOUBLE / greatest(count(*) FILTER (told), 1)')} AS grounding,
 {_C('count(*) FILTER (abstained)::DOUBLE / count(*)')} AS abstention_rate, {_C('coalesce(avg(confidence) FILTER (told), 0)')} AS mean_confidence FROM t LEFT JOIN g USING (question_id)""")
def answer_rates(spark: SparkSession, d: str) -> DataFrame:
    """Answers that cite one or two numbers; a question's evidence is its own number and the next."""
    asked, i = _asked(spark, d), F.col("question_id")
    said = asked.select("question_id", (i % 6 == 0).alias("abstained"), F.when(i % 4 > 0, F.array(i, i + i % 3)).alias("cited"), (i % 10 / 10.0).alias("confidence"))
    evidence = asked.select("question_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "lang", "source").select("question_id", (i + F.col("k")).alias("chunk_id"), F.when(i % 2 == 0, F.col("lang")).alias("section"), F.when(F.col("k") == 0, F.col("source")).alias("ticker"))
    out = evals.answer_rates(asked.select("question_id", "expected_sections", "expected_tickers"), said, evidence)
    return out.select(*[cut6(F.col(c)).alias(c) for c in out.columns])


@query("paraphrased_questions", """WITH q AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'dev' ELSE 'holdout' END AS split, ['cross_sectional', 'table', 'filters', 'narrative'][(item_id % 4 + 1)::INT] AS category, CASE WHEN item_id % 5 = 0 THEN NULL ELSE 'T' || item_id::VARCHAR END AS ticker,
  CASE WHEN item_id % 3 = 0 THEN NULL ELSE 'Item 7' END AS section, 'acc-' || item_id::VARCHAR AS accession, array_to_string(regexp_extract_all(text, '[A-Za-z0-9%-]+')[1:12], ' ') AS cut, item_id % 7 = 6 AS hold FROM benchmark),
a AS (SELECT *, CASE WHEN hold THEN 'What risks remain?' ELSE CASE category WHEN 'cross_sectional' THEN 'Which issuers discuss ' || cut WHEN 'table' THEN 'Where does ' || coalesce(ticker, 'the issuer') || ' report figures about ' || cut
   WHEN 'filters' THEN 'In ' || coalesce(section, 'the filing') || ', what does ' || coalesce(ticker, 'the issuer') || ' say about ' || cut ELSE 'What does ' || coalesce(ticker, 'the issuer') || ' disclose about ' || cut END || '?' END AS question FROM q)
SELECT item_id, question, CASE WHEN hold THEN 'old' ELSE split || '-' || sha256(split || '|' || category || '|' || question || '|' || accession)[1:12] END AS question_id FROM a""")
def paraphrased_questions(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    rows = S.table(spark, d, "benchmark").select(
        "item_id", F.when(i % 2 == 0, "dev").otherwise("holdout").alias("split"), F.element_at(F.array(*[F.lit(c) for c in ("cross_sectional", "table", "filters", "narrative")]), (i % 4 + 1).cast("int")).alias("category"),
        F.when(i % 5 != 0, F.concat(F.lit("T"), i.cast("string"))).alias("ticker"), F.when(i % 3 != 0, "Item 7").alias("section"), F.concat(F.lit("acc-"), i.cast("string")).alias("accession"),
        F.col("text").alias("quote"), (i % 7 == 6).alias("should_abstain"), F.lit("What risks remain?").alias("question"), F.lit("old").alias("question_id"),
    )
    return evals.paraphrased(rows, ("What risks", "In Item")).select("item_id", "question", "question_id")


@query("reground", """WITH r AS (SELECT conv_id, lower(text[3:14]) AS quote FROM conversations WHERE turn = 2), j AS (SELECT r.conv_id, c.turn, contains(lower(c.text), r.quote) AS hit FROM r JOIN conversations c USING (conv_id))
SELECT conv_id, coalesce(min(turn) FILTER (hit), min(turn)) AS chunk_id, bool_or(hit) AS found FROM j GROUP BY conv_id""")
def reground(spark: SparkSession, d: str) -> DataFrame:
    """Quotes from third turns, looked for in the turns of their conversation."""
    c = S.table(spark, d, "conversations")
    wanted = c.where("turn = 2").select(F.col("conv_id").alias("question_id"), F.col("conv_id").alias("accession"), F.substring("text", 3, 12).alias("quote"))
    out = evals.reground(wanted, c.select(F.col("conv_id").alias("accession"), F.col("turn").alias("id"), "text"))
    return out.select(F.col("accession").alias("conv_id"), "chunk_id", "found")


@query("cited_first", """WITH e AS (SELECT conv_id AS query_id, turn AS chunk_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, turn % 3 = 1 AS cited FROM conversations)
SELECT query_id, chunk_id, cited, row_number() OVER (PARTITION BY query_id ORDER BY cited DESC, rank, chunk_id) AS shown FROM e""")
def cited_first(spark: SparkSession, d: str) -> DataFrame:
    c = S.table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("chunk_id"))
    return retrieval.cited_first(retrieval.rank(c.withColumn("s", -F.col("chunk_id")), "s", "chunk_id").drop("s"), c.where("chunk_id % 3 = 1"), "chunk_id").select("query_id", "chunk_id", "cited", "shown")


@query("titles", """SELECT DISTINCT o_orderpriority AS industry, array_to_string(list_transform(regexp_extract_all(lower(o_orderpriority), '[a-z]+|[^a-z]+'), lambda x: upper(x[1:1]) || x[2:]), '') AS title FROM orders""")
def titles(spark: SparkSession, d: str) -> DataFrame:
    rows = S.table(spark, d, "orders").select(F.col("o_orderpriority").alias("industry")).distinct()
    return rows.withColumn("title", X.title_case(F.lower("industry")))


def _companies(spark: SparkSession, d: str) -> DataFrame:
    orders = S.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("documents"), F.sum(F.col("o_orderkey") % 9).alias("chunks"))
    c = S.table(spark, d, "customer").select("c_custkey", F.element_at(F.array(*[F.lit(x) for x in ("NYSE", "Nasdaq", "nasdaq gs", "OTC")]), (F.col("c_custkey") % 4 + 1).cast("int")).alias("exchange"))
    return c.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "exchange", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


_COMPANIES = """companies AS (SELECT c_custkey, ['NYSE', 'Nasdaq', 'nasdaq gs', 'OTC'][(c_custkey % 4 + 1)::INT] AS exchange, count(o_orderkey) AS documents, coalesce(sum(o_orderkey % 9), 0)::BIGINT AS chunks FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)"""


@query("exchange_totals", f"WITH {_COMPANIES} SELECT count(*) AS companies, count(*) FILTER (exchange = 'NYSE') AS nyse, count(*) FILTER (exchange IN ('Nasdaq', 'nasdaq gs')) AS nasdaq, sum(documents)::BIGINT AS documents, sum(chunks)::BIGINT AS chunks FROM companies")
def exchange_totals(spark: SparkSession, d: str) -> DataFrame:
    return quality.exchange_totals(_companies(spark, d))


@query("largest_companies", f"WITH {_COMPANIES} SELECT c_custkey, chunks FROM companies ORDER BY chunks DESC, c_custkey LIMIT 5")
def largest_companies(spark: SparkSession, d: str) -> DataFrame:
    return quality.universe(_companies(spark, d), "c_custkey", "chunks", 0, 5).select("c_custkey", "chunks")


@query("market_slice", "SELECT c_name AS ticker FROM customer ORDER BY c_name LIMIT 25 OFFSET 50")
def market_slice(spark: SparkSession, d: str) -> DataFrame:
    return readers.universe_slice(S.table(spark, d, "customer").select(F.col("c_name").alias("ticker")), *readers.parse_slice("50:25"))


#: Endings and beginnings that suppliers' names get by turns: each mark of a fund, and names that come near one.
_NAMES = ("{}", "{} Growth Fund", "{} Mutual Fund", "{} Fund Raising", "{} Etf", "Etf{}", "{} ETN Notes", "{} Exchange-Traded", "{}/Unit", "{}/Rights", "{}/WARRANT", "{}/notes", "ProShares {}", "ProSharesX {}", "iShares {}", "The iShares {}", "{} SPDR Trust", "{} SPDR", "{} Trust")
_KEPT = ", ".join(str(i) for i, n in enumerate(_NAMES) if n in ("{}", "{} Mutual Fund", "{} Fund Raising", "Etf{}", "ProSharesX {}", "The iShares {}", "{} SPDR", "{} Trust"))


@query("listed_companies", f"""WITH e AS (SELECT s_nationkey AS cik, 'S' || s_suppkey::VARCHAR AS ticker, replace(list_extract([{", ".join(f"'{n}'" for n in _NAMES)}], (s_suppkey % {len(_NAMES)} + 1)::INT), '{{}}', s_name) AS name, s_suppkey FROM supplier)
SELECT cik::BIGINT AS cik, min(ticker) AS ticker, array_to_string(list_sort(list(DISTINCT ticker)), ',') AS tickers, min_by(name, ticker) AS name FROM e WHERE s_suppkey % {len(_NAMES)} IN ({_KEPT}) AND s_suppkey % 5 <> 0 GROUP BY cik""")
def listed_companies(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as listings of their nation; every fifth symbol is a test issue or a fund by its flag, others are funds by their names."""
    s = S.table(spark, d, "supplier")
    style = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("s_suppkey") % len(_NAMES) + 1).cast("int"))
    exchange = s.select(F.col("s_nationkey").alias("cik"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("ticker"), F.replace(style, F.lit("{}"), F.col("s_name")).alias("name"))
    symbols = s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), (F.col("s_suppkey") % 10 == 0).alias("is_test"), (F.col("s_suppkey") % 10 == 5).alias("is_etf"))
    return readers.listed_companies(exchange, symbols).withColumn("tickers", F.array_join("tickers", ","))


@query("index_constituents", "SELECT 'B.' || c_custkey::VARCHAR AS symbol, CASE WHEN c_custkey % 3 = 0 THEN 'P' || c_custkey::VARCHAR WHEN c_custkey % 3 = 1 THEN 'D' || c_custkey::VARCHAR END AS ticker FROM customer")
def index_constituents(spark: SparkSession, d: str) -> DataFrame:
    """A third of the symbols is in the catalog as spelled, a third with a hyphen, a third not at all."""
    c = S.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("t"))
    catalog = c.where("k % 3 = 0").select(F.array(F.concat(F.lit("B."), "t")).alias("tickers"), F.concat(F.lit("P"), "t").alias("ticker"))
    catalog = catalog.unionByName(c.where("k % 3 = 1").select(F.array(F.concat(F.lit("B-"), "t"), F.concat(F.lit("X"), "t")).alias("tickers"), F.concat(F.lit("D"), "t").alias("ticker")))
    return readers.index_constituents(c.select(F.concat(F.lit("b."), "t").alias("symbol")), catalog)


@query("price_payloads", "SELECT upper(event_type) || user_id::VARCHAR AS ticker, strftime(ts, '%Y-%m-%d') AS date, value AS adjusted_close FROM events WHERE value > 0 AND event_id % 4 > 0")
def price_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Events as price payloads of both services' shapes, written as JSON and read back; every fourth has no price."""
    e = S.table(spark, d, "events").select(F.concat("event_type", F.col("user_id").cast("string")).alias("ticker"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), F.unix_timestamp("ts").alias("s"), F.when(F.col("event_id") % 4 > 0, F.col("value")).alias("v"), "event_id")
    daily = e.where("event_id % 2 = 0").select("ticker", F.to_json(F.array(F.struct("date", F.col("v").alias("adjClose")))).alias("payload"))
    part = F.struct(F.array("s").alias("timestamp"), F.struct(F.array(F.struct(F.array("v").alias("close"))).alias("quote")).alias("indicators"))
    chart = e.where("event_id % 2 = 1").select("ticker", F.to_json(F.struct(F.struct(F.array(part).alias("result")).alias("chart"))).alias("payload"))
    out = readers.daily_price_bars(daily).unionByName(readers.chart_bars(chart))
    return out.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("delete_cascade", """SELECT 'orders' AS kept, o_orderkey AS id, o_custkey AS link FROM orders WHERE o_custkey % 10 > 0 UNION ALL SELECT 'customers', c_custkey, NULL FROM customer WHERE c_custkey % 10 > 0
UNION ALL SELECT 'history', event_id, CASE WHEN user_id % 10 > 0 OR user_id NOT IN (SELECT c_custkey FROM customer) THEN user_id END FROM events""")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the customers goes, with their orders; history stays, without its links to them."""
    c, o, e = S.table(spark, d, "customer").select("c_custkey"), S.table(spark, d, "orders").select("o_orderkey", "o_custkey"), S.table(spark, d, "events").select("event_id", "user_id")
    parents, children, past = quality.cascade(c, c.where("c_custkey % 10 = 0"), "c_custkey", o, "o_custkey", e, "user_id")
    part = lambda df, name, key, link: df.select(F.lit(name).alias("kept"), F.col(key).alias("id"), link.cast("long").alias("link"))
    return part(children, "orders", "o_orderkey", F.col("o_custkey")).unionByName(part(parents, "customers", "c_custkey", F.lit(None))).unionByName(part(past, "history", "event_id", F.col("user_id")))


@query("availability_backfill", """SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 5 HOUR WHEN o_orderkey % 3 = 1 THEN o_orderdate + INTERVAL 7 HOUR ELSE o_orderdate END, '%Y-%m-%d %H:%M:%S') AS available_at, o_orderstatus = 'F' AS is_amendment FROM orders""")
def availability_backfill(spark: SparkSession, d: str) -> DataFrame:
    """A third of the orders has its acceptance, a third has it in its metadata, a third only a date."""
    o = S.table(spark, d, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    k, later = F.col("o_orderkey") % 3, lambda h: F.col("at") + F.make_dt_interval(hours=F.lit(h))
    rows = o.select("o_orderkey", F.when(k == 0, later(5)).alias("accepted_at"), F.lit(None).cast("timestamp").alias("available_at"), F.to_date("at").alias("filing_date"), F.lit(None).cast("boolean").alias("is_amendment"),
                    F.when(k == 1, F.concat(F.lit('{"acceptanceDateTime": "'), F.date_format(later(7), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"}'))).alias("metadata_json"), F.when(F.col("o_orderstatus") == "F", "10-k/a").otherwise("10-K").alias("form_type"))
    return quality.backfill_availability(rows).select("o_orderkey", F.date_format("available_at", "yyyy-MM-dd HH:mm:ss").alias("available_at"), "is_amendment")


@query("rechunked", """WITH due AS (SELECT d.doc_id, d.text FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)), w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM due)
SELECT doc_id, i AS chunk_index, least(220, len(w) - 220 * i) AS tokens FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 219) // 220)) AS i FROM w)""")
def rechunked(spark: SparkSession, d: str) -> DataFrame:
    """Unlabelled documents stand for documents that were parsed and never cut into chunks."""
    docs = S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("p").alias("local_path"), F.lit("h").alias("sha256_hash"), "text")
    elements = docs.select(F.col("id").alias("document_id"), F.lit(0).alias("reading_order"), "text")
    out = quality.rechunk(docs, elements, S.table(spark, d, "labels").select(F.col("doc_id").alias("document_id")))
    return out.select(F.col("document_id").alias("doc_id"), "chunk_index", F.col("token_count").alias("tokens"))


@query("running_latency", """SELECT user_id, floor(list_reduce(list(value ORDER BY ts, event_id), lambda a, x: 0.4::DOUBLE * a + 0.6::DOUBLE * x) * 1e6 + 0.5) / 1e6 AS ewma FROM events GROUP BY user_id""")
def running_latency(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events").select("user_id", "value", F.struct("ts", "event_id").alias("at"))
    return stats.ewma(e, "value", "at", ["user_id"]).select("user_id", cut6(F.col("ewma")).alias("ewma"))


@query("parsed_vectors", "SELECT vec_id, len(embedding) AS n, floor(list_max(embedding)::DOUBLE * 1e4 + 0.5) / 1e4 AS top FROM embeddings")
def parsed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as text and read back."""
    e = S.table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("["), F.array_join(F.col("embedding").cast("array<string>"), ","), F.lit("]")).alias("s"))
    v = e.select("vec_id", parse_vector(F.col("s")).alias("v"))
    return v.select("vec_id", F.size("v").alias("n"), (F.floor(F.array_max("v") * 1e4 + 0.5) / 1e4).alias("top"))
