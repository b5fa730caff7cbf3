"""Question rewriting and routing, the evidence gate, extractive answers and citation checks, for many questions at once."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from quillstone.functions import text as X
from quillstone.operators.retrieval import citation_overlap

MIN_EVIDENCE, MIN_SCORE, MIN_OVERLAP = 2, 0.2, 0.6

# Patterns of what a question asks for.
ASKS = {
    "table": r"(?i)\b(?:table|tabular|rows?|columns?|segment revenue)\b",
    "figure": r"(?i)\b(?:chart|figure|graph)\b",
    "facts": r"(?i)\b(?:revenue|net income|assets|liabilities|growth|margin|cash flow|compare)\b",
    "results": r"(?i)\b(?:earnings|eps|financial results?|quarterly results?)\b",
    "latest": r"(?i)\b(?:latest|most recent|last)\b",
    "comparison": r"(?i)\b(?:compare|comparison|growth|versus|vs\.?|year-over-year|yoy)\b",
}
FORMS = {"10-K": r"(?i)\b(?:10-k|annual report)\b", "10-Q": r"(?i)\b(?:10-q|quarterly report|last quarter|latest quarter)\b", "8-K": r"(?i)\b8-k\b"}
SECTIONS = {
    "Risk Factors": r"(?i)\brisk factors?\b",
    "MD&A": r"(?i)\b(?:md&a|management(?:'s|\u2019s) discussion)\b",
    "Business": r"(?i)\bbusiness\b",
    "Financial Statements": r"(?i)\bfinancial statements?\b",
    "Legal Proceedings": r"(?i)\blegal proceedings?\b",
    "Controls and Procedures": r"(?i)\bcontrols?(?: and procedures)?\b",
}
YEAR = r"(?<!\d)(?:19|20)\d{2}(?!\d)"
PRIVATE = r"(?i)\b(?:private|non-public|inside information|insider|confidential)\b"
FORECAST = (
    r"(?i)\b(?:predict|forecast|guarantee|price target)\b.{0,40}\b(?:stock|share price|investment return|market return)\b"
    r"|\bwill\b.{0,40}\b(?:stock|share)\s+price\b"
    r"|\b(?:stock|share)\s+price\b.{0,30}\bnext\s+(?:quarter|year|month|week|day|few)\b"
    r"|\bnext\s+(?:quarter|year|month|week|day|few)\b.{0,30}\b(?:stock|share)\s+price\b"
    r"|\bfuture\b.{0,25}\b(?:stock|share)\s+price\b"
    r"|\b(?:buy|sell|short)\s+(?:the\s+)?(?:stock|shares)\b"
)
EARNINGS_EVIDENCE = r"(?i)\b(?:net income|earnings per share|diluted eps|revenue)\b.{0,100}(?:\$|%|\d)"
FINANCE_SUFFIX = "SEC filing financial results risks management commentary"
# Legal suffixes of company names, and first words that are no alias.
LEGAL = "co company corp corporation inc incorporated limited ltd plc".split()
AMBIGUOUS = "a all are at best block c day dollar general global international on one target the trade united".split()


def _asked(question: Column, patterns: dict[str, str]) -> Column:
    return F.filter(F.array(*[F.when(question.rlike(p), F.lit(n)) for n, p in patterns.items()]), lambda x: x.isNotNull())


def routes(question: Column) -> Column:
    """Where to look: text always, tables and financial facts as asked for, each once, in the order in which they were asked for."""
    asks = lambda k, route: F.when(question.rlike(ASKS[k]), F.lit(route))
    all_ = F.array(F.lit("text"), asks("table", "tables"), asks("facts", "financial_facts"), asks("results", "tables"), asks("results", "financial_facts"))
    return F.array_distinct(F.filter(all_, lambda x: x.isNotNull()))


def element_types(question: Column) -> Column:
    return F.array_sort(_asked(question, {k: ASKS[k] for k in ("table", "figure")}))


def forms(question: Column) -> Column:
    return _asked(question, FORMS)


def sections(question: Column) -> Column:
    return _asked(question, SECTIONS)


def year_bounds(question: Column) -> tuple[Column, Column]:
    """The first and last day of the years that a question names, also inside a word as in FY2024."""
    years = F.regexp_extract_all(question, F.lit(f"({YEAR})"), F.lit(1))
    year = lambda y: y.cast("int")
    return F.when(F.size(years) > 0, F.make_date(year(F.array_min(years)), F.lit(1), F.lit(1))), F.when(F.size(years) > 0, F.make_date(year(F.array_max(years)), F.lit(12), F.lit(31)))


@F.pandas_udf(StringType())
def company_text(names: pd.Series) -> pd.Series:
    """Runs of a-z and 0-9 of the case-folded compatibility decomposition, which no built-in function makes."""
    return names.map(lambda s: None if s is None else " ".join(re.findall("[a-z0-9]+", unicodedata.normalize("NFKD", s).casefold())))


def company_aliases(companies: DataFrame) -> DataFrame:
    """(alias, ticker): full normalised name, name without legal suffixes, and its first word if long and not ambiguous; only aliases with one owner."""
    rows = companies.select(F.upper("ticker").alias("ticker"), company_text("name").alias("full"))
    rows = rows.withColumn("short", F.regexp_replace("full", rf"(?:(?:^| )(?:{'|'.join(LEGAL)}))+$", ""))
    first = F.element_at(F.split("short", " "), 1)
    word = F.when((F.length(first) >= 3) & ~first.isin(AMBIGUOUS), first)
    rows = rows.select("ticker", F.explode(F.array_distinct(F.filter(F.array("full", "short", word), lambda a: a.isNotNull() & (a != "")))).alias("alias"))
    return rows.groupBy("alias").agg(F.countDistinct("ticker").alias("owners"), F.min("ticker").alias("ticker")).where("owners = 1").select("alias", "ticker")


def resolve_companies(questions: DataFrame, aliases: DataFrame, known: DataFrame) -> DataFrame:
    """(query_id, tickers): upper-case ticker words that are known, and aliases between token boundaries.

    A question's runs of tokens, up to the longest alias's number, are joined to the aliases by equality, so nothing is
    compared pair by pair. One number comes to the driver.
    """
    longest = aliases.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 1
    questions = questions.withColumn("clean_", company_text("query"))
    toks = F.filter(F.split("clean_", " "), lambda t: t != "")
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(toks))), lambda i: i + n - 1 <= F.size(toks)), lambda i: F.array_join(F.slice(toks, i, n), " "))))
    by_name = questions.select("query_id", F.explode(F.array_distinct(grams)).alias("alias")).join(aliases, "alias").select("query_id", "ticker")
    spelled = questions.select("query_id", F.explode(F.regexp_extract_all("query", F.lit(r"\b([A-Z]{1,5})\b"), F.lit(1))).alias("ticker")).join(known.select("ticker").distinct(), "ticker", "left_semi")
    hits = by_name.unionByName(spelled.select("query_id", "ticker")).groupBy("query_id").agg(F.array_sort(F.collect_set("ticker")).alias("tickers"))
    return questions.select("query_id").join(hits, "query_id", "left").withColumn("tickers", F.coalesce("tickers", F.array().cast("array<string>")))


def variants(questions: DataFrame, suffix: str = FINANCE_SUFFIX) -> DataFrame:
    """(query_id, variant_no, query): the clean question, with company names, with sections, and with a finance suffix if it has tickers; distinct in that order."""
    clean = X.collapse(F.col("query"))
    plus = lambda c: F.when(F.size(c) > 0, F.concat_ws(" ", clean, F.array_join(c, " ")))
    all_ = F.array(clean, plus(F.col("names")), plus(F.col("sections")), F.when(F.size("tickers") > 0, F.concat_ws(" ", clean, F.lit(suffix))))
    return questions.select("query_id", F.posexplode(F.array_distinct(F.filter(all_, lambda v: v.isNotNull()))).alias("variant_no", "query"))


def evidence_gate(questions: DataFrame, evidence: DataFrame, min_evidence: int = MIN_EVIDENCE, min_score: float = MIN_SCORE) -> DataFrame:
    """(query_id, reason): the first reason to abstain, or null. evidence has query_id, score and is_fact; facts are neither counted nor scored as passages."""
    got = evidence.groupBy("query_id").agg(F.count_if(~F.col("is_fact")).alias("n"), F.max(F.when(~F.col("is_fact"), F.col("score"))).alias("top"), F.count_if("is_fact").alias("facts"))
    rows = questions.join(got, "query_id", "left")
    n, top = F.coalesce("n", F.lit(0)), F.coalesce("top", F.lit(0.0))
    needs = F.array_contains(routes(F.col("query")), "financial_facts") & F.col("query").rlike(ASKS["comparison"])
    reason = F.when(F.col("query").rlike(PRIVATE), "private_information").when(F.col("query").rlike(FORECAST), "forecast").when(needs & (F.coalesce("facts", F.lit(0)) == 0), "no_structured_fact")
    return rows.select("query_id", reason.when(n < min_evidence, "insufficient_evidence").when(top < min_score, "low_relevance").alias("reason"))


def extractive_claims(evidence: DataFrame, text: str = "text", kind: str = "element_type") -> DataFrame:
    """(query_id, claim_no, chunk_id, claim): the first sentence of the best evidence; two for comparisons.

    Narrative with at least five words is preferred, then anything with five words, then the rest, in rank order. For
    questions about earnings, evidence that gives a figure for one comes first.
    """
    long = F.size(X.words(F.col(text))) >= 5
    tier = F.when(long & ~F.col(kind).isin("title", "section_header", "table"), 0).when(long, 1).otherwise(2)
    figures = F.when(F.col("query").rlike(ASKS["results"]) & ~F.col(text).rlike(EARNINGS_EVIDENCE), 1).otherwise(0)
    rows = evidence.withColumn("tier_", tier).withColumn("figures_", figures)
    rows = rows.withColumn("best_", F.min("tier_").over(Window.partitionBy("query_id"))).where("tier_ = best_")  # one pool answers
    rows = rows.withColumn("claim_no", F.row_number().over(Window.partitionBy("query_id").orderBy("figures_", "rank")))
    wanted = F.when(F.col("query").rlike(ASKS["comparison"]), 2).otherwise(1)
    return rows.where(F.col("claim_no") <= wanted).select("query_id", "claim_no", "chunk_id", X.first_sentence(F.col(text)).alias("claim"))


def verify_citations(claims: DataFrame, evidence: DataFrame, least: float = MIN_OVERLAP) -> DataFrame:
    """(query_id, claim_no, chunk_id, overlap, error): each cited chunk must be in the evidence and share enough of the claim's tokens."""
    cited = claims.select("query_id", "claim_no", "claim", F.explode("chunk_ids").alias("chunk_id"))
    e = evidence.select(F.col("query_id").alias("q_"), F.col("chunk_id").alias("c_"), F.col("text").alias("t_"))
    rows = cited.join(e, (F.col("query_id") == F.col("q_")) & (F.col("chunk_id") == F.col("c_")), "left")
    overlap = citation_overlap(F.col("claim"), F.coalesce("t_", F.lit("")))
    return rows.select("query_id", "claim_no", "chunk_id", overlap.alias("overlap"), F.when(F.col("c_").isNull(), "unknown_chunk").when(overlap < least, "low_overlap").alias("error"))
