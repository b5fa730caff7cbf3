"""Text as column expressions: normalising, tokens, fingerprints, sentences, and the pattern dictionaries of filings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a lexical query leaves out.
STOP_WORDS = "a an and are as at be by for from in is it of on or that the to which with".split()
#: Tokens that an unfiltered query keeps, and the least letters of one.
QUERY_TOKEN_CAP, LEAST_TOKEN = 8, 2

# Topic dictionary, case-insensitive and word-bounded.
TOPICS = {
    "ai": ("artificial intelligence", "generative ai", "machine learning"),
    "climate": ("climate", "carbon", "greenhouse gas", "emissions"),
    "cybersecurity": ("cybersecurity", "cyber attack", "data breach"),
    "supply_chain": ("supply chain", "supplier", "sourcing"),
    "regulation": ("regulation", "regulatory", "compliance"),
    "competition": ("competition", "competitive", "competitor"),
}
# What opens a section, and the headings that open one outside heading tags.
SECTION_HEADINGS = (
    (r"^(?:item\s+1a\b[.:\s-]*)?risk factors?\b", "Risk Factors"),
    (r"^item\s+1\b(?!a)[.:\s-]*business\b", "Business"),
    (r"^business\b", "Business"),
    (r"^(?:item\s+3\b[.:\s-]*)?legal proceedings?\b", "Legal Proceedings"),
    (r"^(?:item\s+(?:2|7)\b[.:\s-]*(?:\|\s*)?)?management(?:'|\u2019)s discussion and analysis\b", "MD&A"),
    (r"^(?:item\s+8\b[.:\s-]*)?financial statements\b", "Financial Statements"),
    (r"^(?:item\s+9a\b[.:\s-]*)?controls and procedures\b", "Controls and Procedures"),
)
NOTE_HEADING = r"^note\s+(\d+[a-z]?)\s*[\u2014\u2013-]\s*(.+)$"
ITEM_HEADING = r"^item\s+\d+[a-z]?\b"
PLAIN_HEADINGS = ("business", "risk factors", "legal proceedings", "management's discussion and analysis", "financial statements", "controls and procedures")
HEADING_LENGTH = 220


def collapse(s: Column) -> Column:
    """White space collapsed to single spaces and trimmed; Unicode white space too."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def normalise(s: Column) -> Column:
    """Collapsed and lower-cased: what identity is judged by."""
    return F.lower(collapse(s))


def title_case(s: Column) -> Column:
    """Each run of letters with a capital first and small letters after, whatever separates them."""
    runs = F.regexp_extract_all(s, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 2**31 - 1)))), "")


def tokens(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9]+"), F.lit(0))


def distinct_tokens(s: Column) -> Column:
    """In order of first occurrence."""
    return F.array_distinct(tokens(s))


def words(s: Column) -> Column:
    """White-space separated words, without empty ones."""
    return F.filter(F.split(s, r"\s+"), lambda w: w != "")


def fingerprint(s: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(normalise(s).cast("binary"), 256), 1, length)


def query_terms(s: Column, cap: int | None = QUERY_TOKEN_CAP) -> Column:
    """Distinct tokens of a query without stop words and single letters, the first `cap` of them."""
    kept = F.filter(distinct_tokens(s), lambda t: ~t.isin(STOP_WORDS) & (F.length(t) >= LEAST_TOKEN))
    return F.slice(kept, 1, cap) if cap else kept


def tsquery(s: Column, cap: int | None = QUERY_TOKEN_CAP) -> Column:
    return F.array_join(query_terms(s, cap), " | ")


def first_sentence(s: Column) -> Column:
    return F.element_at(F.split(F.trim(s), r"(?<=[.!?])\s+", 2), 1)


def topic_mentions(s: Column, topics: dict[str, tuple[str, ...]] = TOPICS) -> dict[str, Column]:
    """Occurrences of each topic's phrases."""
    return {name: F.regexp_count(s, F.lit(r"(?i)\b(?:" + "|".join(phrases) + r")\b")) for name, phrases in topics.items()}


def section_of(heading: Column) -> Column:
    """The section that a heading opens; notes to the statements are sections of their own; null if it is none."""
    clean = collapse(heading)
    note = lambda i: F.regexp_extract(clean, "(?i)" + NOTE_HEADING, i)
    out = F.when(note(1) != "", F.concat(F.lit("Note "), note(1), F.lit(" \u2014 "), F.trim(note(2))))
    for pattern, name in SECTION_HEADINGS:
        out = out.when(clean.rlike("(?i)" + pattern), F.lit(name))
    return out


def base_form(form: Column) -> Column:
    return F.regexp_replace(F.upper(form), "/A$", "")


def cik10(cik: Column) -> Column:
    return F.lpad(F.regexp_replace(cik.cast("string"), r"\D", ""), 10, "0")


def accession_digits(accession: Column) -> Column:
    return F.regexp_replace(accession, "-", "")


def archive_url(base: str, cik: Column, accession: Column, document: Column) -> Column:
    """Where an archive keeps a document: cik without leading zeros, accession without dashes."""
    return F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(cik10(cik), "^0+", ""), F.lit("/"), accession_digits(accession), F.lit("/"), document)


def quote_around(s: Column, keyword: str, before: int = 60, length: int = 200) -> Column:
    """A slice of the text around the first occurrence of the keyword; null without one."""
    at = F.instr(F.lower(s), keyword.lower())
    return F.when(at > 0, F.substring(s, F.greatest(F.lit(1), at - before), F.lit(length)))
