"""Point-in-time, panel, fact and study queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.numbers import cut6, delay_days, growth, period_label
from quillstone.operators import asof, facts, passages, stats, studies
from quillstone.plans import standins as S
from quillstone.sources import scratch

Q: dict = {}
O: dict[str, str] = {}
AS_OF = "2018-06-30"
CONFIG = studies.StudyConfig(draws=200)
SPLITS = ["1997-01-01", "1999-01-01"]
WORDS = {"the": ("the", "der"), "of": ("of", "de"), "and": ("and", "und")}


def query(name: str, sql: str | None = None):
    return S.register(Q, O, name, sql)


def six(*names: str) -> list:
    return [cut6(F.col(c)).alias(c) for c in names]


def six_sql(*names: str) -> str:
    return ", ".join(f"floor({c} * 1e6 + 0.5) / 1e6 AS {c}" for c in names)


# --- visibility, amendments, comparables ---

@query("asof_visible_docs", f"WITH {S.FILINGS} SELECT id, company, form_type, available_at::VARCHAR AS available_at FROM filings WHERE available_at <= DATE '{AS_OF}'")
def asof_visible_docs(spark: SparkSession, d: str) -> DataFrame:
    return asof.visible(S.filings(spark, d), AS_OF).select("id", "company", "form_type", F.col("available_at").cast("string").alias("available_at"))


def _policy(policy: str, where: str):
    @query(f"amendment_policy_{policy}", f"WITH {S.FILINGS} SELECT id, form_type FROM filings WHERE {where}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return asof.amendment_policy(S.filings(spark, d), policy).select("id", "form_type")
    return run


for _p, _w in (("include", "true"), ("exclude", "NOT is_amendment"), ("only", "is_amendment")):
    _policy(_p, _w)


@query("latest_filing_per_issuer_form", f"WITH {S.FILINGS} SELECT company, form_type, id FROM (SELECT *, row_number() OVER (PARTITION BY company, form_type ORDER BY available_at DESC, period_end DESC, id DESC) AS n FROM filings) WHERE n = 1")
def latest_filing_per_issuer_form(spark: SparkSession, d: str) -> DataFrame:
    return asof.latest_filing(S.filings(spark, d), ["company", "form_type"], "available_at", ("period_end", "id")).select("company", "form_type", "id")


@query("comparable_filing", f"WITH {S.FILINGS}, {S.COMPARABLE} SELECT id, prior_id, basis FROM comparable")
def comparable_filing(spark: SparkSession, d: str) -> DataFrame:
    f = S.filings(spark, d)
    return asof.comparable_filings(f, f)


@query("amendment_lineage", f"WITH {S.FILINGS} SELECT id, accession, amends_accession FROM filings")
def amendment_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Lineage found from form and period, which the stand-in also states by construction."""
    return asof.amendment_lineage(S.filings(spark, d)).select("id", "accession", "amends_accession")


@query("filing_delay", f"WITH {S.FILINGS} SELECT id, date_diff('day', period_end, available_at) AS delay_days, is_amendment, year(period_end)::VARCHAR || 'Q' || quarter(period_end)::VARCHAR AS period FROM filings")
def filing_delay(spark: SparkSession, d: str) -> DataFrame:
    return S.filings(spark, d).select("id", delay_days(F.col("available_at"), F.col("period_end")).alias("delay_days"), "is_amendment", period_label(F.col("period_end")).alias("period"))


# --- passages and panel ---

@query("chunk_220", r"""WITH """ + S.PASSAGES + r""", w AS (SELECT id, reading_order, list_filter(string_split_regex(passage, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS words FROM passages),
c AS (SELECT id, reading_order, words, unnest(range(0, (len(words) + 219) // 220)) AS chunk_index FROM w)
SELECT id, reading_order, chunk_index, len(words[chunk_index * 220 + 1 : chunk_index * 220 + 220])::BIGINT AS token_count, md5(array_to_string(words[chunk_index * 220 + 1 : chunk_index * 220 + 220], ' ')) AS text_md5 FROM c""")
def chunk_220(spark: SparkSession, d: str) -> DataFrame:
    out = passages.text_chunks(S.passages(spark, d), ["id", "reading_order"], "passage")
    return out.select("id", "reading_order", "chunk_index", F.col("token_count"), F.md5(F.col("chunk_text").cast("binary")).alias("text_md5"))


@query("chunk_dedupe", f"WITH {S.PASSAGES} SELECT id, min(reading_order) AS reading_order, {S.PRINT} AS print FROM passages GROUP BY id, {S.PRINT}")
def chunk_dedupe(spark: SparkSession, d: str) -> DataFrame:
    kept = passages.distinct_chunks(S.passages(spark, d), "id", ["reading_order"], "passage")
    return kept.select("id", "reading_order", S.print_of(F.col("passage")).alias("print"))


@query("fingerprints", f"WITH {S.PASSAGES} SELECT DISTINCT id, section, {S.PRINT} AS print FROM passages")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return S.passages(spark, d).select("id", "section", S.print_of(F.col("passage")).alias("print")).distinct()


_PRINTS = f"{S.PASSAGES}, prints AS (SELECT id, section, list(DISTINCT {S.PRINT}) AS prints FROM passages GROUP BY id, section), doc_prints AS (SELECT id, list(DISTINCT {S.PRINT}) AS prints FROM passages GROUP BY id)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    f = S.filings(spark, d)
    return asof.comparable_filings(f, f)


@query("disclosure_similarity", f"WITH {S.FILINGS}, {S.COMPARABLE}, {_PRINTS} SELECT c.id, c.prior_id, CASE WHEN c.prior_id IS NOT NULL THEN floor(len(list_intersect(a.prints, b.prints))::DOUBLE / len(list_distinct(list_concat(a.prints, b.prints))) * 1e6 + 0.5) / 1e6 END AS similarity FROM comparable c LEFT JOIN doc_prints a ON a.id = c.id LEFT JOIN doc_prints b ON b.id = c.prior_id")
def disclosure_similarity(spark: SparkSession, d: str) -> DataFrame:
    prints = S.passages(spark, d).groupBy("id").agg(F.collect_set(S.print_of(F.col("passage"))).alias("prints"))
    return passages.document_similarity(_pairs(spark, d), prints).select("id", "prior_id", *six("similarity"))


_CHANGES = f"""{_PRINTS}, changes AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.section, b.section) AS section, len(list_filter(coalesce(a.prints, []), lambda x: NOT list_contains(coalesce(b.prints, []), x))) AS added,
 len(list_filter(coalesce(b.prints, []), lambda x: NOT list_contains(coalesce(a.prints, []), x))) AS removed, CASE WHEN a.prints IS NOT NULL THEN 1 - len(list_intersect(a.prints, coalesce(b.prints, [])))::DOUBLE / len(a.prints) END AS novelty
 FROM (SELECT c.id, p.section, p.prints FROM comparable c JOIN prints p ON p.id = c.id WHERE c.prior_id IS NOT NULL) a FULL JOIN (SELECT c.id, p.section, p.prints FROM comparable c JOIN prints p ON p.id = c.prior_id) b ON a.id = b.id AND a.section = b.section)"""


def _section_prints(spark: SparkSession, d: str) -> DataFrame:
    return S.passages(spark, d).groupBy("id", "section").agg(F.collect_set(S.print_of(F.col("passage"))).alias("prints"))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return passages.section_changes(scratch.kept(_pairs(spark, d), "pairs"), _section_prints(spark, d))


@query("section_novelty", f"WITH {S.FILINGS}, {S.COMPARABLE}, {_CHANGES} SELECT id, section, {six_sql('novelty')} FROM changes WHERE novelty IS NOT NULL")
def section_novelty(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).where("novelty is not null").select("id", "section", *six("novelty"))


@query("risk_churn", f"WITH {S.FILINGS}, {S.COMPARABLE}, {_CHANGES} SELECT id, added, removed FROM changes WHERE section = 'S1'")
def risk_churn(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).where("section = 'S1'").select("id", "added", "removed")


_LENGTHS = r"""SELECT id, sum(len(list_filter(string_split_regex(passage, '[ \t\n\r\f\v]+'), lambda x: x <> '')))::BIGINT AS n_tokens, sum(length(passage))::BIGINT AS n_chars, avg((element_type = 'table')::INT::DOUBLE) AS table_density,
 sum(length(regexp_replace(passage, '[^0-9]', '', 'g')))::DOUBLE / greatest(sum(length(passage)), 1) AS numeric_density FROM passages GROUP BY id"""


@query("filing_length", f"WITH {S.PASSAGES}, l AS ({_LENGTHS}) SELECT id, n_tokens, n_chars FROM l")
def filing_length(spark: SparkSession, d: str) -> DataFrame:
    return passages.length_features(S.passages(spark, d), "id", "passage", "element_type").select("id", "n_tokens", "n_chars")


@query("density", f"WITH {S.PASSAGES}, l AS ({_LENGTHS}) SELECT id, {six_sql('table_density', 'numeric_density')} FROM l")
def density(spark: SparkSession, d: str) -> DataFrame:
    return passages.length_features(S.passages(spark, d), "id", "passage", "element_type").select("id", *six("table_density", "numeric_density"))


_SPACED = "'  ' || regexp_replace(lower(text), '[^\\pL\\pN_]', '  ', 'g') || '  '"


@query("topic_mentions", "SELECT doc_id AS id, " + ", ".join(f"len(regexp_extract_all({_SPACED}, ' (?:{'|'.join(w)}) '))::BIGINT AS \"{n}\"" for n, w in WORDS.items()) + " FROM documents")
def topic_mentions(spark: SparkSession, d: str) -> DataFrame:
    from quillstone.functions.text import topic_mentions as count

    return S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), *[c.alias(n) for n, c in count(F.col("text"), WORDS).items()])


_PANEL = f"""{S.FILINGS}, {S.COMPARABLE}, {_CHANGES}, lengths AS ({_LENGTHS}),
alike AS (SELECT c.id, len(list_intersect(a.prints, b.prints))::DOUBLE / len(list_distinct(list_concat(a.prints, b.prints))) AS similarity FROM comparable c JOIN doc_prints a ON a.id = c.id JOIN doc_prints b ON b.id = c.prior_id),
panel AS (SELECT f.id, f.company, f.form_type, f.period_end::VARCHAR AS period_end, f.available_at::VARCHAR AS available_at, c.prior_id, c.basis, l.n_tokens, {six_sql('l.table_density').replace('AS l.', 'AS ')}, floor(s.similarity * 1e6 + 0.5) / 1e6 AS similarity, r.added AS risk_added, r.removed AS risk_removed,
  greatest(f.available_at, coalesce(p.available_at, f.available_at))::VARCHAR AS max_source_available_at
 FROM filings f JOIN comparable c ON c.id = f.id LEFT JOIN filings p ON p.id = c.prior_id LEFT JOIN lengths l ON l.id = f.id LEFT JOIN alike s ON s.id = f.id LEFT JOIN changes r ON r.id = f.id AND r.section = 'S1' WHERE NOT f.is_amendment AND f.available_at <= DATE '{AS_OF}')"""


def _panel(spark: SparkSession, d: str) -> DataFrame:
    f = S.filings(spark, d)
    rows = asof.amendment_policy(asof.visible(f, AS_OF), "exclude").drop("text")
    pairs, sections = scratch.kept(asof.comparable_filings(f, f), "pairs"), scratch.kept(_section_prints(spark, d), "prints")  # each has several readers
    elements = S.passages(spark, d)
    prints = sections.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("prints"))).alias("prints"))
    similar = passages.document_similarity(pairs.select("id", "prior_id"), prints).select("id", "similarity")
    risk = passages.section_changes(pairs, sections).where("section = 'S1'").select("id", F.col("added").alias("risk_added"), F.col("removed").alias("risk_removed"))
    length = passages.length_features(elements, "id", "passage", "element_type").select("id", "n_tokens", "table_density")
    prior = f.select(F.col("id").alias("prior_id"), F.col("available_at").alias("prior_at"))
    out = rows.join(pairs, "id").join(prior, "prior_id", "left").join(length, "id", "left").join(similar, "id", "left").join(risk, "id", "left")
    return asof.guard_leakage(out.withColumn("max_source_available_at", F.greatest("available_at", F.coalesce("prior_at", "available_at"))))


@query("panel_rows", f"WITH {_PANEL} SELECT * FROM panel")
def panel_rows(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string").alias(c)
    return _panel(spark, d).select("id", "company", "form_type", text("period_end"), text("available_at"), "prior_id", "basis", "n_tokens", *six("table_density", "similarity"), "risk_added", "risk_removed", text("max_source_available_at"))


@query("panel_signals", f"WITH {_PANEL} SELECT id, company, similarity AS disclosure_similarity, risk_added - risk_removed AS risk_expansion, date_diff('day', period_end::DATE, available_at::DATE) AS filing_lateness FROM panel")
def panel_signals(spark: SparkSession, d: str) -> DataFrame:
    return _panel(spark, d).select("id", "company", cut6(F.col("similarity")).alias("disclosure_similarity"), (F.col("risk_added") - F.col("risk_removed")).alias("risk_expansion"), delay_days(F.col("available_at"), F.col("period_end")).alias("filing_lateness"))


@query("panel_leakage_check", f"WITH {_PANEL} SELECT count(*) AS n_rows, count(*) FILTER (WHERE max_source_available_at::TIMESTAMP > available_at::TIMESTAMP) AS n_leaks FROM panel")
def panel_leakage_check(spark: SparkSession, d: str) -> DataFrame:
    late = F.col("max_source_available_at") > F.col("available_at")
    return _panel(spark, d).agg(F.count("*").alias("n_rows"), F.count(F.when(late, 1)).alias("n_leaks"))


@query("corpus_snapshot", f"WITH {S.FILINGS}, p AS (SELECT available_at, id, accession || ':' || md5(text) AS entry FROM filings WHERE NOT is_amendment AND available_at <= DATE '{AS_OF}' ORDER BY available_at, id LIMIT 500) SELECT sha256(string_agg(entry, '|' ORDER BY available_at, id))[1:16] AS snapshot_id FROM p")
def corpus_snapshot(spark: SparkSession, d: str) -> DataFrame:
    rows = asof.amendment_policy(asof.visible(S.filings(spark, d), AS_OF), "exclude").orderBy("available_at", "id").limit(500)
    return passages.snapshot_id(rows, ["available_at", "id"], "accession", F.md5(F.col("text").cast("binary")))


@query("corpus_digest", f"""WITH {S.FILINGS}, e AS (SELECT accession || ':' || md5(text) AS entry, sha256(accession) AS h FROM filings),
a AS (SELECT h[1:6] AS six, sha256(string_agg(entry, '|' ORDER BY entry)) AS d FROM e GROUP BY ALL), b AS (SELECT six[1:3] AS three, sha256(string_agg(d, '|' ORDER BY six)) AS d FROM a GROUP BY ALL),
r AS (SELECT sha256(string_agg(d, '|' ORDER BY three)) AS d FROM b) SELECT r.d[1:16] AS snapshot_id, (SELECT count(*) FROM e) AS documents FROM r""")
def corpus_digest(spark: SparkSession, d: str) -> DataFrame:
    """All filings by a tree of digests: no list of the whole corpus."""
    f = S.filings(spark, d)
    digest = passages.snapshot_tree(f, "accession", F.md5(F.col("text").cast("binary")))
    return digest.select(F.substring("snapshot_id", 1, 16).alias("snapshot_id"), "documents")


@query("filing_diff", None)
def filing_diff(spark: SparkSession, d: str) -> DataFrame:
    """Counts of changed passages; difflib's alignment has no SQL form, pytest compares it with stated cases."""
    return passages.diff_counts(passages.filing_diff(_pairs(spark, d), S.passages(spark, d).withColumnRenamed("passage", "text")))


# --- facts ---

_ORDER = "filed_at DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, value DESC"


def _fact_order() -> list:
    return [F.desc(c) for c in ("filed_at", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "value")]


def _restatement(policy: str, order: str):
    seen = f"WITH {S.FACTS}, pool AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS pos FROM facts QUALIFY pos <= 400), seen AS (SELECT *, min(pos) OVER (PARTITION BY l_partkey, l_suppkey) AS key_at, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY {order}) AS n FROM pool)"
    keep = "true" if policy == "all" else "n = 1"

    @query(f"restatement_{policy}", f"{seen}, o AS (SELECT *, row_number() OVER (ORDER BY key_at, pos) AS ordinal FROM seen WHERE {keep}) SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, value, ordinal FROM o WHERE ordinal <= 100")
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = facts.query_facts(S.facts(spark, d), policy, 100, S.FACT_KEYS, _fact_order(), "filed_at", S.FACT_TIE)
        return out.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "value", "ordinal")
    return run


for _p, _w in (("latest", "filed_at DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC, value DESC"), ("as_reported", "filed_at, l_orderkey, l_linenumber, l_quantity, value"), ("all", "pos")):
    _restatement(_p, _w)


@query("latest_fact_by_key", f"WITH {S.FACTS} SELECT l_partkey, l_suppkey, value FROM facts QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY filed_at DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC, value DESC) = 1")
def latest_fact_by_key(spark: SparkSession, d: str) -> DataFrame:
    return facts.restatement_policy(S.facts(spark, d), "latest", S.FACT_KEYS, "filed_at", S.FACT_TIE).select("l_partkey", "l_suppkey", "value")


@query("restatement_flag", f"WITH {S.FACTS} SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, value, coalesce(value <> lag(value) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY filed_at NULLS FIRST, l_orderkey, l_linenumber, l_quantity, value), false) AS is_restatement FROM facts")
def restatement_flag(spark: SparkSession, d: str) -> DataFrame:
    return facts.restatement_flags(S.facts(spark, d), S.FACT_KEYS, "filed_at", S.FACT_TIE, "value").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "value", "is_restatement")


@query("canonical_fact_pick", """SELECT l_orderkey, l_returnflag, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END, l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1""")
def canonical_fact_pick(spark: SparkSession, d: str) -> DataFrame:
    li = S.table(spark, d, "lineitem")
    return facts.canonical_pick(li, "l_orderkey", "l_returnflag", F.when(F.col("l_linestatus") == "F", 0).otherwise(1), ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_returnflag", "l_partkey", "l_extendedprice")


@query("fundamental_growth", f"""WITH {S.FACTS}, one AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY l_partkey, filed_at ORDER BY l_suppkey, l_orderkey, l_linenumber, l_quantity, value) = 1),
nth AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY filed_at DESC) AS p FROM one), two AS (SELECT l_partkey, max(CASE WHEN p = 1 THEN value END) AS latest, max(CASE WHEN p = 2 THEN value END) AS prior FROM nth WHERE p <= 2 GROUP BY l_partkey)
SELECT l_partkey, latest, prior, floor((latest - prior) / abs(prior) * 1e6 + 0.5) / 1e6 AS growth FROM two""")
def fundamental_growth(spark: SparkSession, d: str) -> DataFrame:
    two = facts.latest_two(S.facts(spark, d), ["l_partkey"], "filed_at", "value", ["l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "value"])
    return two.withColumn("growth", cut6(growth(F.col("latest"), F.col("prior"))))


@query("facts_with_narrative", r"""WITH n AS (SELECT doc_id, conv_text FROM (SELECT conv_id AS doc_id, text AS conv_text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM (SELECT DISTINCT conv_id, turn, first(text) OVER (PARTITION BY conv_id, turn ORDER BY text) AS text FROM conversations WHERE len(list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda w: w <> '')) >= 5)) WHERE n = 1)
SELECT l.doc_id, l.quality::BIGINT AS quality, md5(n.conv_text) AS narrative_md5 FROM labels l LEFT JOIN n USING (doc_id)""")
def facts_with_narrative(spark: SparkSession, d: str) -> DataFrame:
    """Labels stand for facts, threads for documents, turns for chunks."""
    c = S.table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min(F.when(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) >= 5, F.col("text"))).alias("text")).where("text is not null")
    first = facts.first_narratives(c, "conv_id", "turn", "text").withColumnRenamed("conv_id", "doc_id")
    return S.table(spark, d, "labels").join(first, "doc_id", "left").select("doc_id", "quality", F.md5(F.col("narrative").cast("binary")).alias("narrative_md5"))


@query("sic_sector", "SELECT p_partkey, CASE " + " ".join(f"WHEN {' OR '.join(f'sic BETWEEN {a} AND {b}' for a, b in ranges)} THEN '{n}'" for n, ranges in studies.SECTORS) + " ELSE 'Unknown' END AS sector FROM (SELECT p_partkey, p_partkey * 37 % 9999 AS sic FROM part)")
def sic_sector(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "part").select("p_partkey", studies.sic_sector(F.col("p_partkey") * 37 % 9999).alias("sector"))


# --- studies ---

_STUDY = f"WITH {S.BARS}, {S.EVENTS}, {S.RETURNS}"


def _returns(spark: SparkSession, d: str) -> DataFrame:
    return studies.event_returns(S.events(spark, d), S.bars(spark, d), CONFIG)


@query("event_session_asof", f"WITH {S.BARS}, {S.EVENTS} SELECT accession, ticker, session, session_date::VARCHAR AS session_date FROM placed")
def event_session_asof(spark: SparkSession, d: str) -> DataFrame:
    out = asof.event_sessions(S.events(spark, d), S.bars(spark, d).where("ticker <> 'SPY'"))
    return out.select("accession", "ticker", "session", F.col("session_date").cast("string").alias("session_date"))


@query("event_window_returns", f"{_STUDY} SELECT accession, \"window\", {six_sql('asset_return', 'benchmark_return', 'abnormal_return')} FROM returns")
def event_window_returns(spark: SparkSession, d: str) -> DataFrame:
    return _returns(spark, d).select("accession", "window", *six("asset_return", "benchmark_return", "abnormal_return"))


@query("event_window_summary", f"{_STUDY} SELECT \"window\", count(*) AS n, floor(avg(abnormal_return) * 1e6 + 0.5) / 1e6 AS mean, floor(median(abnormal_return) * 1e6 + 0.5) / 1e6 AS median, floor(avg((abnormal_return > 0)::INT::DOUBLE) * 1e6 + 0.5) / 1e6 AS positive_share FROM returns GROUP BY \"window\"")
def event_window_summary(spark: SparkSession, d: str) -> DataFrame:
    return studies.window_summary(_returns(spark, d), CONFIG.windows).select("window", "n", *six("mean", "median", "positive_share"))


@query("walk_forward", f"""{_STUDY}, sp(split) AS (VALUES ('1997-01-01'), ('1999-01-01')) SELECT split, "window", count(*) FILTER (session_date < split::DATE) AS n_train, count(*) FILTER (session_date >= split::DATE) AS n_test,
 floor(avg(CASE WHEN session_date >= split::DATE THEN abnormal_return END) * 1e6 + 0.5) / 1e6 AS test_mean FROM returns CROSS JOIN sp GROUP BY split, "window" """)
def walk_forward(spark: SparkSession, d: str) -> DataFrame:
    return studies.walk_forward(_returns(spark, d), SPLITS).select("split", "window", "n_train", "n_test", *six("test_mean"))


@query("daily_returns", f"WITH {S.BARS} SELECT ticker, date::VARCHAR AS date, session, floor((adjusted_close / lag(adjusted_close) OVER (PARTITION BY ticker ORDER BY date) - 1) * 1e6 + 0.5) / 1e6 AS daily_return FROM indexed")
def daily_returns(spark: SparkSession, d: str) -> DataFrame:
    return studies.daily_returns(S.bars(spark, d)).select("ticker", F.col("date").cast("string").alias("date"), "session", *six("daily_return"))


@query("realized_volatility", f"""WITH {S.BARS}, {S.EVENTS}, r AS (SELECT *, adjusted_close / lag(adjusted_close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM indexed)
SELECT p.accession, '0:5' AS "window", floor(sqrt(avg(r.ret * r.ret)) * 1e6 + 0.5) / 1e6 AS volatility FROM placed p JOIN r ON r.ticker = p.ticker AND r.session BETWEEN p.session + 1 AND p.session + 5 GROUP BY p.accession HAVING count(*) = 5""")
def realized_volatility(spark: SparkSession, d: str) -> DataFrame:
    b = S.bars(spark, d).where("ticker <> 'SPY'")
    return studies.realised_volatility(asof.event_sessions(S.events(spark, d), b), b, ((0, 5),)).select("accession", "window", *six("volatility"))


_RANKED = 'rk AS (SELECT "window", rank() OVER (PARTITION BY "window" ORDER BY feature_value) + (count(*) OVER (PARTITION BY "window", feature_value) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY "window" ORDER BY abnormal_return) + (count(*) OVER (PARTITION BY "window", abnormal_return) - 1) / 2.0 AS ry, accession FROM returns)'
_IC = f"""{_STUDY}, {_RANKED}, ic AS (SELECT "window", count(*) AS n, (count(*) * sum(rx * ry) - sum(rx) * sum(ry)) / sqrt((count(*) * sum(rx * rx) - sum(rx) * sum(rx)) * (count(*) * sum(ry * ry) - sum(ry) * sum(ry))) AS ic FROM rk GROUP BY "window")"""


@query("avg_rank", "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY floor(o_totalprice / 1000)) + (count(*) OVER (PARTITION BY o_orderpriority, floor(o_totalprice / 1000)) - 1) / 2.0::DOUBLE AS avg_rank FROM orders")
def avg_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = S.table(spark, d, "orders").withColumn("k", F.floor(F.col("o_totalprice") / 1000))
    return stats.average_ranks(rows.select("o_orderkey", "o_orderpriority", "k"), "k", ["o_orderpriority"]).select("o_orderkey", "avg_rank")


@query("spearman_ic", f'{_IC} SELECT "window", n, {six_sql("ic")} FROM ic')
def spearman_ic(spark: SparkSession, d: str) -> DataFrame:
    return stats.spearman(_returns(spark, d), "feature_value", "abnormal_return", ["window"]).select("window", "n", *six("ic"))


@query("ic_tstat", f'{_IC} SELECT "window", floor(ic * sqrt((n - 2) / (1 - ic * ic)) * 1e4 + 0.5) / 1e4 AS t_stat FROM ic')
def ic_tstat(spark: SparkSession, d: str) -> DataFrame:
    return stats.spearman(_returns(spark, d), "feature_value", "abnormal_return", ["window"]).select("window", (F.floor(F.col("t_stat") * 1e4 + 0.5) / 1e4).alias("t_stat"))


_BUCKETS = f'{_STUDY}, b AS (SELECT *, (row_number() OVER (PARTITION BY "window" ORDER BY feature_value, accession) * 5 - 1) // count(*) OVER (PARTITION BY "window") AS bucket FROM returns)'


@query("quantile_portfolios", f'{_BUCKETS} SELECT "window", bucket, count(*) AS n, floor(avg(abnormal_return) * 1e6 + 0.5) / 1e6 AS mean_outcome FROM b GROUP BY "window", bucket')
def quantile_portfolios(spark: SparkSession, d: str) -> DataFrame:
    return stats.quantile_portfolios(_returns(spark, d), "feature_value", "abnormal_return", 5, ["window"], ["accession"]).select("window", "bucket", "n", *six("mean_outcome"))


@query("long_short", f'{_BUCKETS} SELECT "window", floor((avg(CASE WHEN bucket = 4 THEN abnormal_return END) - avg(CASE WHEN bucket = 0 THEN abnormal_return END)) * 1e6 + 0.5) / 1e6 AS spread FROM b GROUP BY "window"')
def long_short(spark: SparkSession, d: str) -> DataFrame:
    p = stats.quantile_portfolios(_returns(spark, d), "feature_value", "abnormal_return", 5, ["window"], ["accession"])
    return stats.long_short(p, 5, ["window"]).select("window", *six("spread"))


@query("winsorized_outcomes", f"""{_STUDY}, o AS (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY abnormal_return) - 1 AS rn, count(*) OVER (PARTITION BY "window") AS n FROM returns),
b AS (SELECT "window", max(CASE WHEN rn = floor((n - 1) * 0.05::DOUBLE) THEN abnormal_return END) AS low, max(CASE WHEN rn = floor((n - 1) * 0.95::DOUBLE) THEN abnormal_return END) AS high FROM o GROUP BY "window")
SELECT accession, o."window", floor(greatest(low, least(high, abnormal_return)) * 1e6 + 0.5) / 1e6 AS winsorised FROM o JOIN b ON o."window" = b."window" """)
def winsorized_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return stats.winsorise(_returns(spark, d), "abnormal_return", 0.05, ["window"]).select("accession", "window", *six("winsorised"))


@query("bh_adjusted", """WITH p AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey * 7919 % 100003 + 1) / 100004.0::DOUBLE END AS p FROM orders),
r AS (SELECT *, p * count(*) OVER (PARTITION BY o_orderpriority) / row_number() OVER (PARTITION BY o_orderpriority ORDER BY p) AS raw FROM p WHERE p IS NOT NULL),
a AS (SELECT o_orderkey, least(1, min(raw) OVER (PARTITION BY o_orderpriority ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS adj FROM r)
SELECT o.o_orderkey, floor(adj * 1e6 + 0.5) / 1e6 AS p_adjusted FROM orders o LEFT JOIN a ON a.o_orderkey = o.o_orderkey""")
def bh_adjusted(spark: SparkSession, d: str) -> DataFrame:
    rows = S.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") * 7919 % 100003 + 1) / 100004.0).alias("p"))
    return stats.benjamini_hochberg(rows, "p", ["o_orderpriority"]).select("o_orderkey", *six("p_adjusted"))


_SIGNALS = """sig AS (SELECT o_orderkey AS accession, year(o_orderdate)::VARCHAR || 'Q' || quarter(o_orderdate)::VARCHAR AS period, CASE WHEN o_custkey % 6 = 0 THEN 'Unknown' ELSE 'sector' || (o_custkey % 6)::VARCHAR END AS sector, 'price' AS signal, o_totalprice AS value, 1.0::DOUBLE AS sign FROM orders
UNION ALL SELECT o_orderkey, year(o_orderdate)::VARCHAR || 'Q' || quarter(o_orderdate)::VARCHAR, CASE WHEN o_custkey % 6 = 0 THEN 'Unknown' ELSE 'sector' || (o_custkey % 6)::VARCHAR END, 'lines', n::DOUBLE, -1.0::DOUBLE FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""
_ZP = f"{_SIGNALS}, zp AS (SELECT * FROM (SELECT *, count(*) OVER w AS n, sign * (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS z FROM sig WINDOW w AS (PARTITION BY period, signal)) WHERE n >= 2 AND z IS NOT NULL)"
_ZS = f"""{_SIGNALS}, cells AS (SELECT *, CASE WHEN sector <> 'Unknown' AND count(*) OVER (PARTITION BY period, signal, sector) >= 4 THEN sector ELSE '__pool__' END AS cell FROM sig),
zs AS (SELECT * FROM (SELECT *, count(*) OVER w AS n, sign * (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS z FROM cells WINDOW w AS (PARTITION BY period, signal, cell)) WHERE n >= 2 AND z IS NOT NULL)"""


def _signals(spark: SparkSession, d: str) -> DataFrame:
    o = S.table(spark, d, "orders")
    n = S.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    sector = F.when(F.col("o_custkey") % 6 == 0, "Unknown").otherwise(F.concat(F.lit("sector"), (F.col("o_custkey") % 6).cast("string")))
    keys = [F.col("o_orderkey").alias("accession"), period_label(F.col("o_orderdate")).alias("period"), sector.alias("sector")]
    price = o.select(*keys, F.lit("price").alias("signal"), F.col("o_totalprice").alias("value"), F.lit(1.0).alias("sign"))
    return price.unionByName(o.join(n, "o_orderkey").select(*keys, F.lit("lines").alias("signal"), F.col("n").cast("double").alias("value"), F.lit(-1.0).alias("sign")))


def _zp(spark: SparkSession, d: str) -> DataFrame:
    return stats.zscore(_signals(spark, d), "value", ["period", "signal"], F.col("sign"))


@query("period_zscore", f"WITH {_ZP} SELECT accession, signal, {six_sql('z')} FROM zp")
def period_zscore(spark: SparkSession, d: str) -> DataFrame:
    return _zp(spark, d).select("accession", "signal", *six("z"))


@query("sector_neutral_zscore", f"WITH {_ZS} SELECT accession, signal, {six_sql('z')} FROM zs")
def sector_neutral_zscore(spark: SparkSession, d: str) -> DataFrame:
    return stats.sector_neutral_zscore(_signals(spark, d), "value", "period", "signal", "sector", 4, F.col("sign")).select("accession", "signal", *six("z"))


@query("composite_score", f"WITH {_ZP} SELECT accession, floor(avg(z) * 1e6 + 0.5) / 1e6 AS composite, count(*) AS n_signals FROM zp GROUP BY accession")
def composite_score(spark: SparkSession, d: str) -> DataFrame:
    return stats.composite(_zp(spark, d), "accession").select("accession", *six("composite"), "n_signals")


_COMP = f"""{_STUDY}, {_ZP}, both_z AS (SELECT accession, signal, floor(z * 1e9 + 0.5) / 1e9 AS z FROM zp UNION ALL SELECT accession, 'composite', floor(avg(z) * 1e9 + 0.5) / 1e9 FROM zp GROUP BY accession),
j AS (SELECT b.signal, r."window", b.z, r.abnormal_return AS y FROM both_z b JOIN returns r ON r.accession = b.accession),
rk AS (SELECT signal, "window", rank() OVER (PARTITION BY signal, "window" ORDER BY z) + (count(*) OVER (PARTITION BY signal, "window", z) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY signal, "window" ORDER BY y) + (count(*) OVER (PARTITION BY signal, "window", y) - 1) / 2.0 AS ry FROM j)
SELECT signal, "window", count(*) AS n, floor((count(*) * sum(rx * ry) - sum(rx) * sum(ry)) / sqrt((count(*) * sum(rx * rx) - sum(rx) * sum(rx)) * (count(*) * sum(ry * ry) - sum(ry) * sum(ry))) * 1e4 + 0.5) / 1e4 AS ic FROM rk GROUP BY signal, "window" """


@query("component_ic", _COMP)
def component_ic(spark: SparkSession, d: str) -> DataFrame:
    """Scores meet events before these have a row for each window."""
    bars = S.bars(spark, d)
    placed = studies.placed_events(S.events(spark, d), bars, CONFIG).select("accession", "ticker", "session")
    scores = stats.with_composite(_zp(spark, d), "accession", "signal", placed).withColumn("z", F.floor(F.col("z") * 1e9 + 0.5) / 1e9)
    joined = studies.window_returns(scores, bars, CONFIG)
    return stats.spearman(joined, "z", "abnormal_return", ["signal", "window"]).select("signal", "window", "n", (F.floor(F.col("ic") * 1e4 + 0.5) / 1e4).alias("ic"))


@query("signal_correlations", f"""WITH {_ZP}, q AS (SELECT accession, signal, floor(z * 1e9 + 0.5) / 1e9 AS z FROM zp), j AS (SELECT a.z AS x, b.z AS y FROM q a JOIN q b USING (accession) WHERE a.signal = 'price' AND b.signal = 'lines'),
rk AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM j)
SELECT 'price' AS signal_a, 'lines' AS signal_b, count(*) AS n, floor((count(*) * sum(rx * ry) - sum(rx) * sum(ry)) / sqrt((count(*) * sum(rx * rx) - sum(rx) * sum(rx)) * (count(*) * sum(ry * ry) - sum(ry) * sum(ry))) * 1e4 + 0.5) / 1e4 AS ic FROM rk""")
def signal_correlations(spark: SparkSession, d: str) -> DataFrame:
    z = _zp(spark, d).withColumn("z", F.floor(F.col("z") * 1e9 + 0.5) / 1e9)
    return stats.signal_correlations(z, "accession", "signal", ["price", "lines"]).select("signal_a", "signal_b", "n", (F.floor(F.col("ic") * 1e4 + 0.5) / 1e4).alias("ic"))


_DRAWS = 200
_WEIGHT = " + ".join(f"(u >= {t})::BIGINT" for t in stats.poisson_thresholds())


@query("bootstrap_ci", f"""{_STUDY}, draws AS (SELECT "window" AS win, abnormal_return AS x, 4 * b + k AS draw, ('0x' || md5(b::VARCHAR || '|' || accession::VARCHAR)[8 * k + 1:8 * k + 8])::BIGINT AS u FROM returns, range({_DRAWS // 4}) AS r(b), range(4) AS q(k)),
weighed AS (SELECT win, draw, sum({_WEIGHT}) AS w, sum(({_WEIGHT}) * x) AS s FROM draws GROUP BY ALL),
sorted AS (SELECT win, list_sort(list(s / w)) AS m FROM weighed WHERE w > 0 GROUP BY win),
whole AS (SELECT "window" AS win, count(*) AS n, avg(abnormal_return) AS mean FROM returns GROUP BY ALL)
SELECT win AS "window", n, floor(mean * 1e6 + 0.5) / 1e6 AS mean, floor(m[round_even((len(m) - 1) * 0.025, 0)::INT + 1] * 1e6 + 0.5) / 1e6 AS low, floor(m[round_even((len(m) - 1) * 0.975, 0)::INT + 1] * 1e6 + 0.5) / 1e6 AS high,
 floor(least(1.0, 2.0 * least(len(list_filter(m, lambda v: v <= 0)), len(list_filter(m, lambda v: v >= 0))) / len(m)) * 1e6 + 0.5) / 1e6 AS p FROM sorted JOIN whole USING (win)""")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Poisson weights by a hash of draw and event, so that both engines draw alike."""
    return stats.bootstrap_large(_returns(spark, d), "abnormal_return", "window", "accession", _DRAWS).select("window", "n", *six("mean", "low", "high", "p"))


@query("bootstrap_small", None)
def bootstrap_small(spark: SparkSession, d: str) -> DataFrame:
    """The exact form for a study's sample: resampling by Python's generator; pytest compares it with a plain loop."""
    return stats.bootstrap_by(_returns(spark, d), "abnormal_return", "window", "accession", 200)


@query("constituents", f"""WITH {S.FILINGS}, k AS (SELECT company, n_chars, id FROM filings WHERE base_form = '10-K' AND NOT is_amendment QUALIFY row_number() OVER (PARTITION BY company ORDER BY available_at DESC, id DESC) = 1),
r AS (SELECT *, row_number() OVER (ORDER BY n_chars, company) AS low, row_number() OVER (ORDER BY n_chars DESC, company) AS high, least(8, count(*) OVER () // 2) AS n FROM k)
SELECT company, id, CASE WHEN low <= n THEN 'long' ELSE 'short' END AS side FROM r WHERE low <= n OR high <= n""")
def constituents(spark: SparkSession, d: str) -> DataFrame:
    """The filers with the shortest (long) and longest (short) latest annual report."""
    rows = S.filings(spark, d).where("base_form = '10-K' and not is_amendment")
    k = asof.latest_filing(rows, ["company"], "available_at", ("id",)).select("company", "id", "n_chars")
    n = min(8, k.count() // 2)
    end = lambda order, side: k.orderBy(order, "company").limit(n).select("company", "id", F.lit(side).alias("side"))
    return end(F.asc("n_chars"), "long").unionByName(end(F.desc("n_chars"), "short"))
