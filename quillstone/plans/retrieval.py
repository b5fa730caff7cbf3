"""Retrieval, answer and evaluation queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import text as X
from quillstone.functions.numbers import cut6, token_estimate
from quillstone.functions.vectors import hash_slot
from quillstone.operators import answers, evals, retrieval
from quillstone.operators.asof import SearchFilters
from quillstone.plans import standins as S
from quillstone.sources.scratch import kept

Q: dict = {}
O: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    return S.register(Q, O, name, sql)


def _lexical(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.lexical_scores(S.questions(spark), S.table(spark, d, "documents"), "doc_id", "text")


_LEX = f"""WITH {S.QUESTIONS_SQL}, {S.POSTINGS},
lexical AS (SELECT w.query_id, t.doc_id, sum(ln(1 + t.tf)) / any_value(w.n) AS sparse FROM tfs t JOIN wanted w USING (token) GROUP BY w.query_id, t.doc_id)"""


@query("lexical_topk", f"""{_LEX}
SELECT query_id, doc_id, floor(sparse * 1e6 + 0.5) / 1e6 AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(sparse * 1e6 + 0.5) / 1e6 DESC, doc_id) AS rank FROM lexical) WHERE rank <= 10""")
def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    scored = _lexical(spark, d).select("query_id", "doc_id", cut6(F.col("sparse")).alias("score"))
    return retrieval.top_k(scored, "score", "doc_id", 10)


@query("tsquery_tokens", """
WITH t AS (SELECT item_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda x: len(x) >= 2 AND NOT list_contains(string_split('a an and are as at be by for from in is it of on or that the to which with', ' '), x)) AS k,
  regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark),
o AS (SELECT item_id, list_sort(list_transform(k, lambda x: {'p': list_position(w, x), 'x': x})) AS s FROM t)
SELECT item_id, array_to_string(list_transform(s[1:8], lambda e: e.x), ' | ') AS tsquery FROM o""")
def tsquery_tokens(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "benchmark").select("item_id", X.tsquery(F.col("text")).alias("tsquery"))


@query("bm25_topk", f"""WITH {S.QUESTIONS_SQL}, {S.POSTINGS},
lens AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS len FROM documents),
st AS (SELECT count(*) AS n, avg(len) AS avg_len FROM lens),
terms AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(query, '[a-z0-9]+')) AS token FROM questions) GROUP BY ALL),
hit AS (SELECT q.query_id, q.token, q.times, t.doc_id, t.tf, l.len FROM tfs t JOIN terms q USING (token) JOIN lens l USING (doc_id)),
df AS (SELECT query_id, token, count(*) AS df FROM hit GROUP BY ALL),
scored AS (SELECT h.query_id, h.doc_id, floor(sum(h.times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) * 1e6 + 0.5) / 1e6 AS score
  FROM hit h JOIN df USING (query_id, token) CROSS JOIN st GROUP BY h.query_id, h.doc_id)
SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 10""")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    scored = retrieval.bm25_scores(S.questions(spark), S.table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return retrieval.top_k(scored.select("query_id", "doc_id", cut6(F.col("bm25")).alias("score")), "score", "doc_id", 10)


_COS = "list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"
_DENSE = f"dense AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, floor(greatest(-1, least(1, {_COS})) * 1e6 + 0.5) / 1e6 AS score FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id IN (0, 1, 2)) q)"


_ASKED = _DENSE.replace("vec_id IN (0, 1, 2)", "vec_id % 100 = 0")


def _dense(spark: SparkSession, d: str, which: str = "vec_id in (0, 1, 2)") -> DataFrame:
    e = S.table(spark, d, "embeddings")
    asked = e.where(which).select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query_vec"))
    scored = retrieval.dense_scores(asked, e.select("vec_id", "label", "embedding"), "vec_id", "embedding")
    return scored.select("query_id", "vec_id", "label", cut6(F.col("dense")).alias("dense"))


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every hundredth vector as a query, and all vectors."""
    e = S.table(spark, d, "embeddings")
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), e


@query("dense_topk", f"WITH {_ASKED} SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM dense) WHERE rank <= 10")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.dense_top_k(*_asked(spark, d), "vec_id", "embedding", 10).select("query_id", "vec_id", F.col("dense").alias("score"), "rank")


@query("dense_topk_filtered", f"WITH {_ASKED} SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM dense WHERE label IN (1, 3, 5)) WHERE rank <= 10")
def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    asked, rows = _asked(spark, d)
    return retrieval.dense_top_k(asked, rows.where(F.col("label").isin(1, 3, 5)), "vec_id", "embedding", 10).select("query_id", "vec_id", F.col("dense").alias("score"), "rank")


@query("ann_first_postfilter", f"""WITH {_ASKED}, pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS pool_rank FROM dense) WHERE pool_rank <= 30)
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pool WHERE label IN (1, 3, 5)) WHERE rank <= 10""")
def ann_first_postfilter(spark: SparkSession, d: str) -> DataFrame:
    pool = retrieval.dense_top_k(*_asked(spark, d), "vec_id", "embedding", 30, ("label",), out="pool_rank")
    return retrieval.top_k(pool.where(F.col("label").isin(1, 3, 5)), "dense", "vec_id", 10).select("query_id", "vec_id", F.col("dense").alias("score"), "rank")


_POOL = f"""{_LEX}, {_DENSE},
sp AS (SELECT query_id, doc_id, floor(sparse * 1e6 + 0.5) / 1e6 AS sparse FROM lexical), dn AS (SELECT query_id + 1 AS query_id, vec_id AS doc_id, score AS dense FROM dense),
sp10 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sparse DESC, doc_id) AS rank FROM sp) WHERE rank <= 50),
dn10 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, doc_id) AS rank FROM dn) WHERE rank <= 50),
pool AS (SELECT query_id, doc_id, max(dense) AS dense, max(sparse) AS sparse FROM (SELECT query_id, doc_id, NULL AS dense, sparse FROM sp10 UNION ALL SELECT query_id, doc_id, dense, NULL FROM dn10) GROUP BY query_id, doc_id),
fused AS (SELECT *, floor((0.5 * CASE WHEN coalesce(dense, 0) = 0 THEN 0 WHEN max(nullif(dense, 0)) OVER w = min(nullif(dense, 0)) OVER w THEN 1 ELSE (dense - min(nullif(dense, 0)) OVER w) / (max(nullif(dense, 0)) OVER w - min(nullif(dense, 0)) OVER w) END
  + 0.5 * CASE WHEN coalesce(sparse, 0) = 0 THEN 0 WHEN max(nullif(sparse, 0)) OVER w = min(nullif(sparse, 0)) OVER w THEN 1 ELSE (sparse - min(nullif(sparse, 0)) OVER w) / (max(nullif(sparse, 0)) OVER w - min(nullif(sparse, 0)) OVER w) END) * 1e6 + 0.5) / 1e6 AS hybrid
  FROM pool WINDOW w AS (PARTITION BY query_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, doc_id) AS rank FROM fused)"""


def _legs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = retrieval.pool_size(10, True)
    sparse = retrieval.top_k(_lexical(spark, d).withColumn("sparse", cut6(F.col("sparse"))), "sparse", "doc_id", n)
    dense = _dense(spark, d).select((F.col("query_id") + 1).cast("int").alias("query_id"), F.col("vec_id").alias("doc_id"), "dense")
    return sparse, retrieval.top_k(dense, "dense", "doc_id", n)


def _fused(spark: SparkSession, d: str) -> DataFrame:
    pool = retrieval.fuse_weighted(retrieval.merge_candidates(*_legs(spark, d), key="doc_id")).withColumn("hybrid", cut6(F.col("hybrid")))
    return retrieval.rank(pool, "hybrid", "doc_id")


@query("fusion_weighted", f"{_POOL} SELECT query_id, doc_id, hybrid, rank FROM ranked WHERE rank <= 20")
def fusion_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).where("rank <= 20").select("query_id", "doc_id", "hybrid", "rank")


@query("fusion_rrf", f"""{_POOL}, r AS (SELECT query_id, doc_id, floor(sum(1.0 / (60 + rank)) * 1e9 + 0.5) / 1e9 AS hybrid FROM (SELECT query_id, doc_id, rank FROM sp10 UNION ALL SELECT query_id, doc_id, rank FROM dn10) GROUP BY query_id, doc_id)
SELECT query_id, doc_id, hybrid, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, doc_id) AS rank FROM r) WHERE rank <= 20""")
def fusion_rrf(spark: SparkSession, d: str) -> DataFrame:
    legs = [x.select("query_id", "doc_id", "rank", F.lit(1.0).alias("weight")) for x in _legs(spark, d)]
    fused = retrieval.fuse_rrf(legs[0].unionByName(legs[1]), "doc_id").withColumn("hybrid", F.floor(F.col("hybrid") * 1e9 + 0.5) / 1e9)
    return retrieval.top_k(fused, "hybrid", "doc_id", 20)


@query("multi_query_merge", f"""{_LEX} SELECT doc_id, floor(max(sparse) * 1e6 + 0.5) / 1e6 AS sparse, count(*) AS variants FROM lexical GROUP BY doc_id""")
def multi_query_merge(spark: SparkSession, d: str) -> DataFrame:
    scored = _lexical(spark, d).withColumn("variant", F.col("query_id")).withColumn("query_id", F.lit(1))
    merged = retrieval.merge_candidates(*[scored.where(F.col("variant") == i) for i, _ in S.QUESTIONS], key="doc_id")
    counts = scored.groupBy("doc_id").agg(F.count("*").alias("variants"))
    return merged.join(counts, "doc_id").select("doc_id", cut6(F.col("sparse")).alias("sparse"), "variants")


@query("rerank_lexical", f"""{_POOL}, pl AS (SELECT r.*, q.query, len(list_distinct(regexp_extract_all(query, '[a-z0-9]+'))) AS nq, len(list_intersect(list_distinct(regexp_extract_all(query, '[a-z0-9]+')), regexp_extract_all(lower(d.text), '[a-z0-9]+'))) AS hit
  FROM ranked r JOIN questions q USING (query_id) JOIN documents d USING (doc_id) WHERE rank <= 50), rr AS (SELECT *, floor((0.7::DOUBLE * (hit::DOUBLE / greatest(nq, 1)) + 0.3::DOUBLE * hybrid) * 1e6 + 0.5) / 1e6 AS rerank FROM pl)
SELECT query_id, doc_id, rerank, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, doc_id) AS final_rank FROM rr""")
def rerank_lexical(spark: SparkSession, d: str) -> DataFrame:
    rows = _fused(spark, d).join(S.questions(spark), "query_id").join(S.table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    out = retrieval.rerank_lexical(rows, "doc_id", "text", 50).withColumn("rerank", cut6(F.col("rerank")))
    return retrieval.rank(out, "rerank", "doc_id", out="final_rank").select("query_id", "doc_id", "rerank", "final_rank")


@query("score_floor", f"{_POOL} SELECT query_id, doc_id, hybrid AS rerank FROM ranked WHERE rank <= 50 AND hybrid >= 0.4")
def score_floor(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.score_floor(retrieval.rerank_none(_fused(spark, d), 50), 0.4).select("query_id", "doc_id", "rerank")


@query("issuer_diversified", f"""{_LEX}, r AS (SELECT query_id, doc_id, source, row_number() OVER (PARTITION BY query_id ORDER BY floor(sparse * 1e6 + 0.5) / 1e6 DESC, doc_id) AS rank FROM lexical JOIN documents USING (doc_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS nth, min(rank) OVER (PARTITION BY query_id, source) AS first FROM r),
g AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY first) AS issuer_rank FROM f)
SELECT query_id, doc_id, source, rank, issuer_rank FROM g WHERE nth <= 2 AND issuer_rank <= 10""")
def issuer_diversified(spark: SparkSession, d: str) -> DataFrame:
    scored = _lexical(spark, d).withColumn("sparse", cut6(F.col("sparse"))).join(S.table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return retrieval.diversify(retrieval.rank(scored, "sparse", "doc_id"), "source", 10, 2).select("query_id", "doc_id", "source", "rank", "issuer_rank")


@query("rank_delta", f"{_POOL} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(sparse, 0) DESC, doc_id) - row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, doc_id) AS moved FROM ranked")
def rank_delta(spark: SparkSession, d: str) -> DataFrame:
    rows = _fused(spark, d).withColumn("sparse", F.coalesce("sparse", F.lit(0.0)))
    return retrieval.rank_delta(rows, "sparse", "hybrid", "doc_id").select("query_id", "doc_id", F.col("moved").cast("long").alias("moved"))


@query("result_composition", f"{_POOL} SELECT query_id, count(*) AS results, count(DISTINCT source) AS issuers FROM ranked JOIN documents USING (doc_id) WHERE rank <= 20 GROUP BY query_id")
def result_composition(spark: SparkSession, d: str) -> DataFrame:
    rows = _fused(spark, d).where("rank <= 20").join(S.table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id").withColumn("filed", F.lit("2020-01-01"))
    return retrieval.composition(rows, "source", "lang", "filed").select("query_id", "results", "issuers")


_NEAR = """WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations), hits AS (SELECT * FROM n WHERE turn = 3)
SELECT DISTINCT n.conv_id, n.turn, n.position FROM n JOIN hits h ON n.conv_id = h.conv_id AND n.position BETWEEN h.position - 1 AND h.position + 1 WHERE n.turn <> 3"""


@query("neighbor_expansion", _NEAR)
def neighbor_expansion(spark: SparkSession, d: str) -> DataFrame:
    rows = S.table(spark, d, "conversations").select("conv_id", "turn").withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    return retrieval.neighbours(rows.where("turn = 3"), rows, "conv_id", "turn", "key", 1).select("conv_id", "turn", "position").distinct()


@query("hash_embedding", """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents), h AS (SELECT doc_id, sha256(token) AS h FROM t),
s AS (SELECT doc_id, ('0x' || h[1:8])::BIGINT % 64 AS slot, CASE WHEN ('0x' || h[9:10])::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS v FROM h)
SELECT doc_id, slot::INTEGER AS slot, sum(v)::BIGINT AS value FROM s GROUP BY doc_id, slot HAVING sum(v) <> 0""")
def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    """The unnormalised hash embedding in sparse form; each distinct token is hashed once."""
    toks = S.table(spark, d, "documents").select("doc_id", F.explode(X.tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))
    index, sign = hash_slot(F.col("token"), 64)
    return toks.groupBy("doc_id", index.alias("slot")).agg(F.sum(sign * F.col("tf")).cast("long").alias("value")).where("value <> 0")


@query("citation_overlap", """WITH b AS (SELECT d.doc_id, d.lang, list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9]+')) AS l, regexp_extract_all(lower(p.text), '[a-z0-9]+') AS r FROM documents d JOIN documents p ON p.doc_id = d.doc_id + 1)
SELECT doc_id, floor(CASE WHEN len(l) > 0 THEN len(list_intersect(l, r))::DOUBLE / len(l) ELSE 0 END * 1e6 + 0.5) / 1e6 AS overlap FROM b""")
def citation_overlap(spark: SparkSession, d: str) -> DataFrame:
    docs = S.table(spark, d, "documents").select("doc_id", "text")
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("evidence"))
    return docs.join(nxt, "doc_id").select("doc_id", cut6(retrieval.citation_overlap(F.col("text"), F.col("evidence"))).alias("overlap"))


@query("grounding_confidence", f"{_POOL} SELECT query_id, round_even(0.6 * greatest(0, least(1, max(hybrid))) + 0.4 * floor(avg((rank <= 10)::INT::DOUBLE) * 100) / 100, 4) AS confidence FROM ranked GROUP BY query_id")
def grounding_confidence(spark: SparkSession, d: str) -> DataFrame:
    rows = _fused(spark, d).groupBy("query_id").agg(F.max("hybrid").alias("top"), (F.floor(F.avg((F.col("rank") <= 10).cast("double")) * 100) / 100).alias("overlap"))
    return rows.select("query_id", retrieval.grounding_confidence(F.col("top"), F.col("overlap")).alias("confidence"))


# Probes that hit and miss each alternative of the answer layer's patterns; a document's number picks the one that stands before its text.
PROBES = (
    "the table of", "tabular data", "two rows", "a column", "segment revenue", "a chart", "figures and graphs", "the graph", "revenue", "net income", "total assets", "liabilities", "growth", "gross margin", "cash flow", "compare both",
    "earnings call", "eps", "financial result", "quarterly results", "latest filing", "most recent", "at last", "10-k", "annual report", "10-q", "quarterly report", "last quarter", "latest quarter", "8-k filing", "current report", "risk factor",
    "md&a", "management's discussion", "our business", "financial statement", "legal proceedings", "control", "controls and procedures", "private", "non-public", "inside information", "insider", "confidential", "home address",
    "predict the stock", "forecast a market return", "price target of the stock", "will its share price rise", "stock price in the next year", "next week the stock price", "the future share price", "buy the stock", "sell shares", "short the shares", "forecast revenue", "revenue growth", "revenue versus assets", "eps yoy", "comparison of margin", "guidance", "holdings", "nothing",
)
_PROBED = "probed AS (SELECT doc_id, doc_id % 3 + 1 AS pool, concat(list_extract([" + ", ".join("'" + p.replace("'", "''") + "'" for p in PROBES) + f"], (doc_id % {len(PROBES)} + 1)::INT), ' ', text) AS q FROM documents)"


def _probed(spark: SparkSession, d: str) -> DataFrame:
    pick = F.element_at(F.array(*[F.lit(p) for p in PROBES]), (F.col("doc_id") % len(PROBES) + 1).cast("int"))
    return S.table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 3 + 1).alias("pool"), F.concat_ws(" ", pick, "text").alias("q"))


_HAS = lambda p: f"regexp_matches(q, '{p}', 'i')"
_FACTS_SQL, _RESULTS_SQL = _HAS(r"\b(revenue|net income|assets|liabilities|growth|margin|cash flow|compare)\b"), _HAS(r"\b(earnings|eps|financial results?|quarterly results?)\b")


@query("evidence_gate", f"""{_POOL}, {_PROBED}, g AS (SELECT query_id, count(*) AS n, max(hybrid) AS top FROM ranked WHERE rank <= 8 GROUP BY query_id)
SELECT doc_id AS query_id, CASE WHEN {_HAS(r"\b(private|non-public|inside information|insider|confidential)\b")} THEN 'private_information'
 WHEN {_HAS(r"\b(predict|forecast|guarantee|price target)\b[^\n]{{0,40}}\b(stock|share price|investment return|market return)\b")} OR {_HAS(r"\bwill\b[^\n]{{0,40}}\b(stock|share)\s+price\b")} OR {_HAS(r"\b(stock|share)\s+price\b[^\n]{{0,30}}\bnext\s+(quarter|year|month|week|day|few)\b")}
  OR {_HAS(r"\bnext\s+(quarter|year|month|week|day|few)\b[^\n]{{0,30}}\b(stock|share)\s+price\b")} OR {_HAS(r"\bfuture\b[^\n]{{0,25}}\b(stock|share)\s+price\b")} OR {_HAS(r"\b(buy|sell|short)\s+(the\s+)?(stock|shares)\b")} THEN 'forecast'
 WHEN ({_FACTS_SQL} OR {_RESULTS_SQL}) AND {_HAS(r"\b(compare|comparison|growth|versus|vs\.?|year-over-year|yoy)\b")} AND doc_id % 3 <> 1 THEN 'no_structured_fact'
 WHEN coalesce(n, 0) < 2 THEN 'insufficient_evidence' WHEN top < 0.2 THEN 'low_relevance' END AS reason FROM probed LEFT JOIN g ON g.query_id = pool""".replace("{{", "{").replace("}}", "}"))
def evidence_gate(spark: SparkSession, d: str) -> DataFrame:
    """A question from each document, with the evidence of one of the three questions for it; a third of them have a fact."""
    asked = _probed(spark, d)
    found = _fused(spark, d).where("rank <= 8").select(F.col("query_id").alias("pool"), F.col("hybrid").alias("score"), F.lit(False).alias("is_fact"))
    evidence = asked.select(F.col("doc_id").alias("query_id"), "pool").join(F.broadcast(found), "pool").drop("pool")  # 24 rows
    facts = asked.where("doc_id % 3 = 1").select(F.col("doc_id").alias("query_id"), F.lit(None).cast("double").alias("score"), F.lit(True).alias("is_fact"))
    evidence = evidence.unionByName(facts)
    return answers.evidence_gate(asked.select(F.col("doc_id").alias("query_id"), F.col("q").alias("query")), evidence)


@query("route_flags", f"""WITH {_PROBED} SELECT doc_id, array_to_string(list_filter(['text', CASE WHEN {_HAS(r"\b(table|tabular|rows?|columns?|segment revenue)\b")} THEN 'tables' END, CASE WHEN {_FACTS_SQL} THEN 'financial_facts' END,
 CASE WHEN {_RESULTS_SQL} AND NOT {_HAS(r"\b(table|tabular|rows?|columns?|segment revenue)\b")} THEN 'tables' END, CASE WHEN {_RESULTS_SQL} AND NOT {_FACTS_SQL} THEN 'financial_facts' END], lambda x: x IS NOT NULL), ',') AS routes,
 array_to_string(list_filter([CASE WHEN {_HAS(r"\b(chart|figure|graph)\b")} THEN 'figure' END, CASE WHEN {_HAS(r"\b(table|tabular|rows?|columns?|segment revenue)\b")} THEN 'table' END], lambda x: x IS NOT NULL), ',') AS elements,
 array_to_string(list_filter([CASE WHEN {_HAS(r"\b(10-k|annual report)\b")} THEN '10-K' END, CASE WHEN {_HAS(r"\b(10-q|quarterly report|last quarter|latest quarter)\b")} THEN '10-Q' END, CASE WHEN {_HAS(r"\b8-k\b")} THEN '8-K' END], lambda x: x IS NOT NULL), ',') AS forms,
 array_to_string(list_filter([CASE WHEN {_HAS(r"\brisk factors?\b")} THEN 'Risk Factors' END, CASE WHEN {_HAS(r"\b(md&a|management(''s|’s) discussion)\b")} THEN 'MD&A' END, CASE WHEN {_HAS(r"\bbusiness\b")} THEN 'Business' END, CASE WHEN {_HAS(r"\bfinancial statements?\b")} THEN 'Financial Statements' END,
  CASE WHEN {_HAS(r"\blegal proceedings?\b")} THEN 'Legal Proceedings' END, CASE WHEN {_HAS(r"\bcontrols?( and procedures)?\b")} THEN 'Controls and Procedures' END], lambda x: x IS NOT NULL), ',') AS sections FROM probed""")
def route_flags(spark: SparkSession, d: str) -> DataFrame:
    q, said = F.col("q"), lambda c: F.array_join(c, ",")
    return _probed(spark, d).select("doc_id", said(answers.routes(q)).alias("routes"), said(answers.element_types(q)).alias("elements"), said(answers.forms(q)).alias("forms"), said(answers.sections(q)).alias("sections"))


_PRECISION = """rel AS (SELECT doc_id, toxic FROM labels WHERE quality = 1),
rk AS (SELECT toxic AS question_id, l.doc_id, row_number() OVER (PARTITION BY toxic ORDER BY d.n_chars DESC, l.doc_id) AS rank FROM labels l JOIN documents d USING (doc_id)),
h AS (SELECT rk.*, r.doc_id IS NOT NULL AS hit FROM rk LEFT JOIN rel r ON r.doc_id = rk.doc_id AND r.toxic = rk.question_id)"""


@query("retrieval_metrics", f"""WITH {_PRECISION}, n AS (SELECT toxic AS question_id, count(*) AS n FROM rel GROUP BY toxic)
SELECT question_id, floor(count(DISTINCT CASE WHEN hit AND rank <= 10 THEN doc_id END)::DOUBLE / any_value(n) * 1e6 + 0.5) / 1e6 AS recall, floor(count(DISTINCT CASE WHEN hit AND rank <= 10 THEN doc_id END) / 10.0 * 1e6 + 0.5) / 1e6 AS precision,
 floor(1.0 / min(CASE WHEN hit THEN rank END) * 1e6 + 0.5) / 1e6 AS rr,
 floor(sum(CASE WHEN hit AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, least(any_value(n), 10) + 1), lambda i: 1 / log2(i + 1))) * 1e6 + 0.5) / 1e6 AS ndcg
FROM h JOIN n USING (question_id) GROUP BY question_id""")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Longest documents first as a ranking for either toxicity label; those of good quality are relevant."""
    labels = S.table(spark, d, "labels")
    rows = labels.join(S.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    ranked = rows.select(F.col("toxic").alias("question_id"), F.col("doc_id").alias("label"), F.row_number().over(Window.partitionBy("toxic").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    out = evals.retrieval_metrics(ranked, labels.where("quality = 1").select(F.col("toxic").alias("question_id"), F.col("doc_id").alias("label")), 10)
    return out.select("question_id", *[cut6(F.col(c)).alias(c) for c in ("recall", "precision", "rr", "ndcg")])


@query("binary_macro_f1", """WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic = 1) AS fn, count(*) FILTER (quality = 0 AND toxic = 1) AS tn FROM labels)
SELECT floor(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) * 1e6 + 0.5) / 1e6 AS precision, floor(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) * 1e6 + 0.5) / 1e6 AS recall,
 floor((coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2.0 * tn / nullif(2 * tn + fn + fp, 0), 0)) / 2 * 1e6 + 0.5) / 1e6 AS macro_f1 FROM c""")
def binary_macro_f1(spark: SparkSession, d: str) -> DataFrame:
    out = evals.macro_f1(S.table(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 0)
    return out.select(*[cut6(F.col(c)).alias(c) for c in ("precision", "recall", "macro_f1")])


@query("benchmark_contract", """WITH c AS (SELECT count(*) AS n, count(DISTINCT item_id) AS ids, count(*) FILTER (item_id % 3 = 0) AS dev, count(*) FILTER (len(trim(text)) = 0) AS bare FROM benchmark)
SELECT rule, ok, detail FROM (SELECT 'rows' AS rule, n = 40 AS ok, n::VARCHAR AS detail FROM c UNION ALL SELECT 'unique_ids', n = ids, (n - ids)::VARCHAR FROM c UNION ALL SELECT 'categories', true, '' UNION ALL SELECT 'labels', bare = 0, bare::VARCHAR FROM c
 UNION ALL SELECT 'split_development', dev = 14, dev::VARCHAR FROM c UNION ALL SELECT 'split_holdout', n - dev = 26, (n - dev)::VARCHAR FROM c)""")
def benchmark_contract(spark: SparkSession, d: str) -> DataFrame:
    b = S.table(spark, d, "benchmark")
    rows = b.select(F.col("item_id").alias("question_id"), F.when(F.col("item_id") % 3 == 0, "development").otherwise("holdout").alias("split"), F.lit("narrative").alias("category"), F.lit(False).alias("should_abstain"), F.when(F.trim("text") != "", F.array("text")).otherwise(F.array()).alias("labels"))
    return evals.contract(rows, {"development": 14, "holdout": 26}, ("narrative",))


@query("evidence_quotes", "SELECT b.item_id, count(*) AS documents, min(d.doc_id) AS first_doc FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def evidence_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a benchmark text verbatim."""
    hits = evals.holding(S.table(spark, d, "documents"), "doc_id", S.table(spark, d, "benchmark").withColumnRenamed("text", "quote"), "item_id")
    return hits.groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


@query("ann_vs_exact", None)
def ann_vs_exact(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the post-filtered ANN list against the exact filtered one; pytest compares it with sets."""
    return evals.ann_recall(kept(dense_topk_filtered(spark, d), "exact"), kept(ann_first_postfilter(spark, d), "found"), "vec_id", 10)


@query("latency_percentiles", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(CASE WHEN rn = greatest(1, ceil(n * 0.5)) THEN value END) AS p50, max(CASE WHEN rn = greatest(1, ceil(n * 0.95)) THEN value END) AS p95 FROM r GROUP BY event_type""")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events")
    return evals.nearest_rank(e, "value", 0.5, ["event_type"]).withColumnRenamed("at", "p50").join(evals.nearest_rank(e, "value", 0.95, ["event_type"]).withColumnRenamed("at", "p95"), "event_type")


@query("stratified_sample", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('17|' || doc_id::VARCHAR), doc_id) AS n FROM documents) WHERE n <= 5")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return evals.seeded_sample(S.table(spark, d, "documents").select("source", "doc_id"), "doc_id", 5, 17, ["source"])


@query("query_cost", "SELECT source, sum(greatest(1, len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''))))::BIGINT AS tokens FROM documents GROUP BY source")
def query_cost(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").groupBy("source").agg(F.sum(token_estimate(F.col("text"))).cast("long").alias("tokens"))


@query("scan_project_filter", "SELECT doc_id, source, n_chars FROM documents WHERE lang IN ('en', 'de') AND n_chars >= 1000")
def scan_project_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = S.table(spark, d, "documents").withColumnsRenamed({"lang": "section"})
    return SearchFilters(sections=("en", "de")).apply(rows).where("n_chars >= 1000").select("doc_id", "source", "n_chars")
