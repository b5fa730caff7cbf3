"""Stemmed full-text queries and their SQL twins: every benchmark item is asked of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.numbers import cut6
from quillstone.functions.stemming import ENGLISH_STOP_WORDS
from quillstone.operators import cover_density as C
from quillstone.operators import retrieval
from quillstone.plans import standins as S

Q: dict = {}
O: dict[str, str] = {}

_STOP = ", ".join(f"'{w}'" for w in sorted(ENGLISH_STOP_WORDS))

#: Stems by one expression a step over the distinct words.
STEMS = rf"""
placed AS (SELECT doc_id, parts[i] AS token, i - 1 AS p FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS parts FROM documents))),
terms AS (SELECT item_id AS query_id, list_filter(list_distinct(parts), lambda x: len(x) >= 2 AND NOT list_contains(string_split('a an and are as at be by for from in is it of on or that the to which with', ' '), x)) AS kept, parts
  FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS parts FROM benchmark)),
asked AS (SELECT query_id, unnest(list_transform((list_sort(list_transform(kept, lambda x: {{'p': list_position(parts, x), 'x': x}})))[1:8], lambda e: e.x)) AS token FROM terms),
vocabulary AS (SELECT DISTINCT token FROM (SELECT token FROM placed UNION ALL SELECT token FROM asked)),
marked AS (SELECT token, regexp_replace(regexp_replace(token, '^y', 'Y'), '([aeiouy])y', '\1Y', 'g') AS w FROM vocabulary WHERE token NOT IN ({_STOP}) AND len(token) > 2),
one AS (SELECT *, CASE WHEN regexp_matches(w, '^(gener|arsen)') THEN 5 WHEN starts_with(w, 'commun') THEN 6 WHEN regexp_matches(w, '[aeiouy][^aeiouy]') THEN len(regexp_extract(w, '^.*?[aeiouy][^aeiouy]')) ELSE len(w) END AS r1 FROM marked),
two AS (SELECT *, CASE WHEN regexp_matches(substr(w, r1 + 1), '[aeiouy][^aeiouy]') THEN r1 + len(regexp_extract(substr(w, r1 + 1), '^.*?[aeiouy][^aeiouy]')) ELSE len(w) END AS r2 FROM one),
a1 AS (SELECT * REPLACE (CASE WHEN w LIKE '%sses' THEN w[:-3] WHEN regexp_matches(w, '(ied|ies)$') THEN CASE WHEN len(w) > 4 THEN w[:-3] ELSE w[:-2] END
  WHEN regexp_matches(w, '(us|ss)$') THEN w WHEN regexp_matches(w, '[aeiouy].+s$') THEN w[:-2] ELSE w END AS w) FROM two),
b1 AS (SELECT *, CASE WHEN regexp_matches(w, 'eed(ly)?$') THEN NULL WHEN regexp_matches(w, '[aeiouy].*(ing|ed)(ly)?$') THEN regexp_replace(w, '(ing|ed)(ly)?$', '') END AS cut FROM a1),
c1 AS (SELECT token, r1, r2, CASE WHEN w IN ('inning', 'outing', 'canning', 'herring', 'earring', 'proceed', 'exceed', 'succeed') THEN w
  WHEN regexp_matches(w, 'eed(ly)?$') AND len(regexp_replace(w, 'eed(ly)?$', '')) >= r1 THEN regexp_replace(w, 'eed(ly)?$', 'ee')
  WHEN cut IS NULL THEN w WHEN regexp_matches(cut, '(at|bl|iz)$') THEN cut || 'e' WHEN regexp_matches(cut, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN cut[:-2]
  WHEN r1 >= len(cut) AND regexp_matches(cut, '([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$') THEN cut || 'e' ELSE cut END AS w FROM b1),
d1 AS (SELECT * REPLACE (CASE WHEN len(w) > 2 AND regexp_matches(w, '[^aeiouy][yY]$') THEN w[:-2] || 'i' ELSE w END AS w) FROM c1),
e1 AS (SELECT *, regexp_extract(w, '(ization|ational|fulness|ousness|iveness|tional|biliti|lessli|entli|ation|alism|aliti|ousli|iviti|fulli|enci|anci|abli|izer|ator|alli|bli|ogi|li)$') AS s FROM d1),
f1 AS (SELECT token, r1, r2, CASE WHEN s = '' OR len(w) - len(s) < r1 OR s = 'ogi' AND NOT regexp_matches(w, 'logi$') OR s = 'li' AND NOT regexp_matches(w, '[cdeghkmnrt]li$') THEN w
  ELSE w[:len(w) - len(s)] || CASE WHEN s IN ('ization', 'izer') THEN 'ize' WHEN s IN ('ational', 'ation', 'ator') THEN 'ate' WHEN s IN ('fulness', 'fulli') THEN 'ful' WHEN s IN ('ousness', 'ousli') THEN 'ous'
    WHEN s IN ('iveness', 'iviti') THEN 'ive' WHEN s = 'tional' THEN 'tion' WHEN s IN ('biliti', 'bli') THEN 'ble' WHEN s = 'lessli' THEN 'less' WHEN s = 'entli' THEN 'ent' WHEN s IN ('alism', 'aliti', 'alli') THEN 'al'
    WHEN s = 'enci' THEN 'ence' WHEN s = 'anci' THEN 'ance' WHEN s = 'abli' THEN 'able' WHEN s = 'ogi' THEN 'og' ELSE '' END END AS w FROM e1),
g1 AS (SELECT *, regexp_extract(w, '(ational|tional|alize|icate|iciti|ative|ical|ness|ful)$') AS s FROM f1),
h1 AS (SELECT token, r1, r2, CASE WHEN s = '' OR len(w) - len(s) < CASE WHEN s = 'ative' THEN r2 ELSE r1 END THEN w
  ELSE w[:len(w) - len(s)] || CASE s WHEN 'ational' THEN 'ate' WHEN 'tional' THEN 'tion' WHEN 'alize' THEN 'al' WHEN 'icate' THEN 'ic' WHEN 'iciti' THEN 'ic' WHEN 'ical' THEN 'ic' ELSE '' END END AS w FROM g1),
i1 AS (SELECT *, regexp_extract(w, '(ement|ance|ence|able|ible|ment|ant|ent|ism|ate|iti|ous|ive|ize|ion|al|er|ic)$') AS s FROM h1),
j1 AS (SELECT token, r1, r2, CASE WHEN s = '' OR len(w) - len(s) < r2 OR s = 'ion' AND NOT regexp_matches(w, '[st]ion$') THEN w ELSE w[:len(w) - len(s)] END AS w FROM i1),
k1 AS (SELECT token, replace(CASE WHEN w LIKE '%e' AND (len(w) > r2 OR len(w) > r1 AND NOT regexp_matches(w, '([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])e$')) OR w LIKE '%ll' AND len(w) > r2 THEN w[:-2] ELSE w END, 'Y', 'y') AS lexeme FROM j1),
lexemes AS (SELECT token, CASE WHEN token IN ('sky', 'news', 'howe', 'atlas', 'cosmos', 'bias', 'andes') THEN token WHEN token IN ('dying', 'lying', 'tying') THEN token[1:1] || 'ie' WHEN token = 'skis' THEN 'ski' WHEN token = 'skies' THEN 'sky'
  WHEN token = 'idly' THEN 'idl' WHEN token IN ('gently', 'singly') THEN token[:-2] WHEN token IN ('ugly', 'early', 'only') THEN token[:-2] || 'i' ELSE lexeme END AS lexeme FROM k1
  UNION ALL SELECT token, token FROM vocabulary WHERE len(token) <= 2 AND token NOT IN ({_STOP})),
queries AS (SELECT DISTINCT query_id, lexeme FROM asked JOIN lexemes USING (token)),
occurs AS (SELECT query_id, doc_id, p, lexeme FROM placed JOIN lexemes USING (token) JOIN queries USING (lexeme))"""


def query(name: str, sql: str | None = None):
    return S.register(Q, O, name, sql)


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return C.query_lexemes(S.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))


@query("stemmed_queries", f"WITH {STEMS} SELECT query_id, lexeme FROM queries")
def stemmed_queries(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d)


@query("cover_density_topk", f"""WITH {STEMS}, scored AS (SELECT query_id, doc_id, count(*) AS covers FROM occurs GROUP BY ALL)
SELECT query_id, doc_id, covers, floor(0.1::DOUBLE * covers * 1e6 + 0.5) / 1e6 AS density, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY covers DESC, doc_id) AS rank FROM scored) WHERE rank <= 10""")
def cover_density_topk(spark: SparkSession, d: str) -> DataFrame:
    """Any of a query's lexemes: what the database's ranking gives for alternatives."""
    asked = _asked(spark, d)
    index = C.wanted_positions(S.table(spark, d, "documents"), "doc_id", "text", asked)
    return retrieval.top_k(C.cover_density(asked, index, "doc_id").withColumn("density", cut6(F.col("density"))), "density", "doc_id", 10)


@query("cover_density_every", f"""WITH {STEMS}, whole AS (SELECT query_id, count(*) AS n FROM queries GROUP BY ALL),
firsts AS (SELECT o.query_id, o.doc_id, o.p, q.lexeme AS other, max(o2.p) AS last FROM occurs o JOIN queries q USING (query_id) JOIN occurs o2 ON o2.query_id = o.query_id AND o2.doc_id = o.doc_id AND o2.lexeme = q.lexeme AND o2.p <= o.p GROUP BY o.query_id, o.doc_id, o.p, q.lexeme),
opened AS (SELECT query_id, doc_id, p, min(last) AS a FROM firsts JOIN whole USING (query_id) GROUP BY query_id, doc_id, p, n HAVING count(*) = n),
covers AS (SELECT query_id, doc_id, a, min(p) AS b FROM opened GROUP BY ALL),
noise AS (SELECT c.query_id, c.doc_id, c.a, c.b, c.b - c.a - (count(*) - 1) AS alien FROM covers c JOIN occurs o ON o.query_id = c.query_id AND o.doc_id = c.doc_id AND o.p BETWEEN c.a AND c.b GROUP BY c.query_id, c.doc_id, c.a, c.b)
SELECT query_id, doc_id, count(*) AS covers, floor(sum(0.1::DOUBLE / (1 + alien)) * 1e6 + 0.5) / 1e6 AS density FROM noise GROUP BY ALL""")
def cover_density_every(spark: SparkSession, d: str) -> DataFrame:
    """All of a query's lexemes: every document that holds them, by the length of their covers."""
    asked = _asked(spark, d)
    index = C.wanted_positions(S.table(spark, d, "documents"), "doc_id", "text", asked)
    return C.cover_density(asked, index, "doc_id", every=True).withColumn("density", cut6(F.col("density")))
