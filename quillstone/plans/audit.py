"""Corpus audit, universe, source and maintenance queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.numbers import cut6
from quillstone.operators import quality
from quillstone.plans import standins as S
from quillstone.sources import html, readers, sinks
from quillstone.streaming import incremental

Q: dict = {}
O: dict[str, str] = {}
TODAY = "2018-12-31"


def query(name: str, sql: str | None = None):
    return S.register(Q, O, name, sql)


@query("issuer_summary_left_chain", """SELECT c_custkey, count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS lines FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey""")
def issuer_summary_left_chain(spark: SparkSession, d: str) -> DataFrame:
    orders, lines = S.table(spark, d, "orders"), S.table(spark, d, "lineitem")
    chain = [(orders, "o_orderkey", "o_custkey", "orders"), (lines, "l_partkey", "l_orderkey", "lines")]
    return quality.summary_chain(S.table(spark, d, "customer").select("c_custkey"), "c_custkey", chain)


_LATEST = f"WITH {S.FILINGS}, latest AS (SELECT company, max(available_at) AS latest_available FROM filings GROUP BY company)"


def _latest(spark: SparkSession, d: str) -> DataFrame:
    f = S.filings(spark, d)
    return quality.latest_availability(f.select("company").distinct(), f, "company")


@query("issuer_latest_availability", f"{_LATEST} SELECT company, latest_available::VARCHAR AS latest_available FROM latest")
def issuer_latest_availability(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d).withColumn("latest_available", F.col("latest_available").cast("string"))


@query("stale_issuers", f"{_LATEST} SELECT company FROM latest WHERE latest_available < DATE '{TODAY}' + 3300 - 150")
def stale_issuers(spark: SparkSession, d: str) -> DataFrame:
    return quality.stale(_latest(spark, d), "2028-01-13").select("company")


@query("missing_expected_forms", f"WITH {S.FILINGS} SELECT company, f AS form_type FROM (SELECT DISTINCT company FROM filings) CROSS JOIN (VALUES ('10-K'), ('10-Q'), ('8-K')) x(f) EXCEPT SELECT company, form_type FROM filings")
def missing_expected_forms(spark: SparkSession, d: str) -> DataFrame:
    return quality.missing_forms(S.filings(spark, d), "company", expected=("10-K", "10-Q", "8-K"))


@query("duplicate_accessions", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_accessions(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_groups(S.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("orders_without_lines_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orders_without_lines_anti(spark: SparkSession, d: str) -> DataFrame:
    return quality.childless(S.table(spark, d, "orders").select("o_orderkey"), "o_orderkey", S.table(spark, d, "lineitem"), "l_orderkey")


@query("indexed_semi", "SELECT DISTINCT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey)")
def indexed_semi(spark: SparkSession, d: str) -> DataFrame:
    had = S.table(spark, d, "orders").join(S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    return S.table(spark, d, "customer").select("c_custkey").join(had.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("missing_embeddings", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id AND label % 2 = 0)")
def missing_embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit("local").alias("provider"), F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("model"), F.lit(64).alias("dimensions"))
    return quality.missing_embeddings(S.table(spark, d, "documents").select(F.col("doc_id").alias("id")), e, "local", "even", 64).withColumnRenamed("id", "doc_id")


@query("unindexed_child_counts", "SELECT o_orderkey, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' GROUP BY o_orderkey")
def unindexed_child_counts(spark: SparkSession, d: str) -> DataFrame:
    n = S.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    return S.table(spark, d, "orders").where("o_orderstatus = 'O'").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"))


@query("quality_report", """WITH o AS (SELECT count(*) AS documents, count(*) FILTER (NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS without_chunks FROM orders), l AS (SELECT count(*) AS chunks, count(DISTINCT l_orderkey) AS chunked FROM lineitem),
d AS (SELECT count(*) AS duplicates FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)), r AS (SELECT avg((event_type = 'purchase')::INT::DOUBLE) AS success FROM (SELECT event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20))
SELECT documents, without_chunks, chunks, chunked, duplicates, floor(success * 1e6 + 0.5) / 1e6 AS success, floor((documents - without_chunks)::DOUBLE / documents * 1e6 + 0.5) / 1e6 AS coverage, without_chunks = 0 AND duplicates = 0 AS healthy FROM o, l, d, r""")
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    """One row from several scalar aggregates; each side is one row, hence the broadcasts."""
    orders, lines = S.table(spark, d, "orders"), S.table(spark, d, "lineitem")
    had = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    a = orders.join(had, F.col("o_orderkey") == F.col("l_orderkey"), "left").agg(F.count("*").alias("documents"), F.count_if(F.col("n").isNull()).alias("without_chunks"))
    b = had.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.count("*").alias("chunked"))
    c = quality.duplicate_groups(lines, ["l_orderkey", "l_linenumber"]).agg(F.count("*").alias("duplicates"))
    runs = S.table(spark, d, "events").select(F.col("event_id").alias("run_key"), F.when(F.col("event_type") == "purchase", "completed").otherwise("failed").alias("status"), F.col("ts").alias("started_at"), F.col("ts").alias("completed_at"))
    r = quality.run_health(runs).select(cut6(F.col("success_rate")).alias("success"))
    one = a.join(F.broadcast(b)).join(F.broadcast(c)).join(F.broadcast(r))
    return one.withColumn("coverage", cut6(quality.share(F.col("documents") - F.col("without_chunks"), F.col("documents")))).withColumn("healthy", (F.col("without_chunks") == 0) & (F.col("duplicates") == 0))


@query("coverage_intersection", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def coverage_intersection(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select("doc_id").intersect(S.table(spark, d, "labels").select("doc_id"))


@query("universe_min_docs", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12 ORDER BY n DESC, o_custkey LIMIT 50")
def universe_min_docs(spark: SparkSession, d: str) -> DataFrame:
    return quality.universe(S.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")), "o_custkey", "n", 12, 50)


@query("paged_universe", "SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_name, c_custkey LIMIT 25 OFFSET 50")
def paged_universe(spark: SparkSession, d: str) -> DataFrame:
    return quality.page(S.table(spark, d, "customer").select("c_custkey", "c_name"), [F.asc("c_name"), F.asc("c_custkey")], 50, 25)


@query("universe_search", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '42') OR contains(lower(c_mktsegment), 'mach')")
def universe_search(spark: SparkSession, d: str) -> DataFrame:
    return quality.search_universe(S.table(spark, d, "customer"), "mach", ["c_mktsegment"]).unionByName(quality.search_universe(S.table(spark, d, "customer").where(~F.lower("c_mktsegment").contains("mach")), "42", ["c_name"])).select("c_custkey", "c_name")


@query("token_cost_sum", "SELECT coalesce(sum(n_chars), 0)::BIGINT AS tokens, floor(coalesce(sum(n_chars), 0) * 0.12::DOUBLE / 1e6 * 1e6 + 0.5) / 1e6 AS cost FROM documents")
def token_cost_sum(spark: SparkSession, d: str) -> DataFrame:
    total = S.table(spark, d, "documents").agg(F.coalesce(F.sum("n_chars"), F.lit(0)).alias("tokens"))
    return total.withColumn("cost", cut6(F.col("tokens") * 0.12 / 1e6))


@query("sector_histogram", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def sector_histogram(spark: SparkSession, d: str) -> DataFrame:
    return quality.histogram(S.table(spark, d, "customer"), "c_mktsegment")


@query("merge_actions", "SELECT CASE WHEN l.doc_id IS NULL THEN 'created' ELSE 'updated' END AS action, count(*) AS n FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1")
def merge_actions(spark: SparkSession, d: str) -> DataFrame:
    return quality.merge_counts(S.table(spark, d, "labels").select("doc_id"), S.table(spark, d, "documents").select("doc_id"), ["doc_id"])


@query("fact_deltas", "SELECT count(*) AS all_facts, count(*) FILTER (quality = 1) AS canonical_facts, count(*) FILTER (doc_id % 2 = 1) AS new_facts, count(*) FILTER (quality = 1 AND doc_id % 2 = 1) AS new_canonical FROM labels")
def fact_deltas(spark: SparkSession, d: str) -> DataFrame:
    after = S.table(spark, d, "labels").withColumn("canonical_metric", F.when(F.col("quality") == 1, "quality"))
    return quality.snapshot_deltas(after.where("doc_id % 2 = 0"), after)



def _experiments(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "orders").select(F.col("o_orderkey").alias("experiment_key"), F.col("o_orderpriority").alias("signal"), F.col("o_orderstatus").alias("outcome"), (F.col("o_custkey") % 50).alias("event_count"), F.to_date("o_orderdate").alias("created_at"))


_EXP = "x AS (SELECT o_orderkey AS experiment_key, o_orderpriority AS signal, o_orderstatus AS outcome, o_custkey % 50 AS event_count, CAST(o_orderdate AS DATE) AS created_at FROM orders)"


@query("study_dedupe", f"WITH {_EXP}, p AS (SELECT * FROM x ORDER BY created_at DESC, experiment_key DESC LIMIT 40), b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY signal, outcome ORDER BY event_count DESC, created_at DESC, experiment_key DESC) = 1) SELECT experiment_key, signal, outcome, event_count FROM b ORDER BY created_at DESC, experiment_key DESC LIMIT 10")
def study_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return quality.newest_distinct(_experiments(spark, d), 10, ["signal", "outcome"]).select("experiment_key", "signal", "outcome", "event_count")


@query("study_prune", f"WITH {_EXP} SELECT experiment_key, row_number() OVER (PARTITION BY signal, outcome ORDER BY event_count DESC, created_at DESC, experiment_key DESC) = 1 AS keep FROM x")
def study_prune(spark: SparkSession, d: str) -> DataFrame:
    return quality.prune(_experiments(spark, d), ["signal", "outcome"]).select("experiment_key", "keep")


@query("upsert_by_key", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(l.quality, d.n_chars) AS value FROM documents d FULL JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id")
def upsert_by_key(spark: SparkSession, d: str) -> DataFrame:
    old = S.table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("value"))
    return sinks.upsert(old, S.table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("long").alias("value")), ["doc_id"])


@query("replace_by_key", "SELECT doc_id, n_chars AS value FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) UNION ALL SELECT doc_id, quality FROM labels")
def replace_by_key(spark: SparkSession, d: str) -> DataFrame:
    old = S.table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("value"))
    return sinks.replace_by_keys(old, S.table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("value")), ["doc_id"])


@query("dominant_upsert", "WITH u AS (SELECT o_custkey, o_orderkey, floor(o_totalprice) AS size, CAST(o_orderdate AS DATE) AS day FROM orders) SELECT o_custkey, size::BIGINT AS size FROM u QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY size DESC, day DESC) = 1")
def dominant_upsert(spark: SparkSession, d: str) -> DataFrame:
    u = S.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.floor("o_totalprice").alias("size"), F.to_date("o_orderdate").alias("at"))
    return sinks.upsert_dominant(u.where("o_orderkey % 2 = 0"), u.where("o_orderkey % 2 <> 0"), ["o_custkey"], "size", "at").select("o_custkey", "size")


@query("snapshot_prune", "WITH s AS (SELECT event_type || ':' || event_id::VARCHAR AS metric_key, ts FROM events) SELECT metric_key FROM s QUALIFY row_number() OVER (PARTITION BY split_part(metric_key, ':', 1) ORDER BY ts DESC, metric_key DESC) <= 128")
def snapshot_prune(spark: SparkSession, d: str) -> DataFrame:
    s = S.table(spark, d, "events").select(F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("metric_key"), F.col("ts").alias("refreshed_at"))
    return sinks.prune_snapshots(s).select("metric_key")


@query("fresh_snapshots", "SELECT event_id FROM events WHERE epoch(TIMESTAMP '2024-01-20 00:00:00') - epoch(ts) <= 21600")
def fresh_snapshots(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events").select("event_id", F.col("ts").alias("refreshed_at"))
    return sinks.fresh(e, F.lit("2024-01-20 00:00:00").cast("timestamp"), 21600).select("event_id")


@query("answer_keys", "SELECT conv_id, turn, sha256('v1' || chr(31) || lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))) AS key FROM conversations")
def answer_keys(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "conversations").select("conv_id", "turn", sinks.answer_key("v1", F.col("text")).alias("key"))


@query("json_extract", "SELECT event_type, sum((json_extract_string(props, '$.k'))::BIGINT)::BIGINT AS k FROM events GROUP BY event_type")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@query("array_zip_explode", "SELECT vec_id, i - 1 AS pos, floor(embedding[i]::DOUBLE * 1e6 + 0.5) / 1e6 AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def array_zip_explode(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "embeddings")
    z = F.posexplode(F.arrays_zip(F.col("embedding").alias("v"))).alias("pos", "z")
    return e.select("vec_id", z).select("vec_id", "pos", cut6(F.col("z.v").cast("double")).alias("value"))


@query("first_n_per_form", f"WITH {S.FILINGS} SELECT id FROM filings QUALIFY row_number() OVER (PARTITION BY company, form_type ORDER BY id) <= CASE form_type WHEN '10-K' THEN 2 WHEN '10-Q' THEN 3 ELSE 0 END")
def first_n_per_form(spark: SparkSession, d: str) -> DataFrame:
    """Filings as a struct of parallel arrays, read as the source reader does."""
    f = S.filings(spark, d).groupBy("company").agg(F.array_sort(F.collect_list(F.struct("id", "accession", "form_type"))).alias("r"))
    part = lambda n: F.transform("r", lambda x: x[n])
    blank = F.transform("r", lambda x: F.lit(None).cast("string"))
    recent = F.struct(part("accession").alias("accessionNumber"), blank.alias("filingDate"), blank.alias("reportDate"), blank.alias("acceptanceDateTime"), part("form_type").alias("form"), part("accession").alias("primaryDocument"), F.transform("r", lambda x: F.lit(1)).alias("isXBRL"), F.transform("r", lambda x: F.lit(1)).alias("isInlineXBRL"))
    subs = f.select(F.col("company").alias("cik"), F.struct(recent.alias("recent")).alias("filings"))
    return readers.recent_filings(subs, {"10-K": 2, "10-Q": 3}).select(F.substring("accessionNumber", 5, 20).cast("long").alias("id"))


@query("missing_tickers", "SELECT DISTINCT upper(c_name) AS ticker FROM customer EXCEPT SELECT upper(c_name) FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def missing_tickers(spark: SparkSession, d: str) -> DataFrame:
    c = S.table(spark, d, "customer")
    have = c.join(S.table(spark, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey")).select(F.upper("c_name").alias("ticker"))
    return readers.missing_tickers(c.select(F.col("c_name").alias("ticker")), have)


@query("html_title", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_title(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("html_blocks", None)
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Elements of pages; pytest compares the parser with stated documents."""
    return html.parse_html(S.table(spark, d, "pages"), "page_id").groupBy("page_id", "element_type").agg(F.count("*").alias("n"))


@query("tumbling_window", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, floor(sum(value) * 1e3 + 0.5) / 1e3 AS total FROM events GROUP BY ALL")
def tumbling_window(spark: SparkSession, d: str) -> DataFrame:
    out = incremental.tumbling(S.table(spark, d, "events"), "ts", "1 hour", "event_type")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", (F.floor(F.col("total") * 1e3 + 0.5) / 1e3).alias("total"))


@query("session_window", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_window(spark: SparkSession, d: str) -> DataFrame:
    out = incremental.sessions(S.table(spark, d, "events"), "ts", "2 hours", "user_id")
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")
