"""Filters on metadata that is JSON text or VARIANT, against a plain reading of it."""

import datetime
import json

from pyspark.sql import functions as F

from quillstone.operators.asof import SearchFilters

UTC = datetime.timezone.utc
ROWS = [
    {"ticker": "AAA", "cik": "1", "form_type": "10-K", "element_type": "text", "filing_date": "2024-03-01", "accepted_at": "2024-03-01T10:00:00Z", "available_at": "2024-03-01T12:00:00+02:00", "is_amendment": False},
    {"ticker": "AAA", "form_type": "10-K/A", "filing_date": "2024-05-01", "accepted_at": "2024-05-01T10:00:00", "available_at": "2024-05-01T00:00:00Z", "is_amendment": True},
    {"ticker": "BBB", "filing_date": 20240301, "accepted_at": 5, "available_at": None},
    {"ticker": "BBB", "filing_date": "junk", "accepted_at": "never", "available_at": "soon"},
    {"ticker": "CCC", "filing_date": "2024-03-01", "accepted_at": "2024-03-01", "available_at": "2024-03-01T10:00:00.000001Z", "is_amendment": None},
    {"ticker": 7, "cik": 1},
    {},
    None,
]


def plain(m, f):
    m = m or {}

    def day(v):
        try:
            return datetime.date.fromisoformat(v) if isinstance(v, str) else None
        except ValueError:
            return None

    def instant(v):
        try:
            at = datetime.datetime.fromisoformat(v.replace("Z", "+00:00")) if isinstance(v, str) else None
        except ValueError:
            return None
        return at.replace(tzinfo=UTC) if at is not None and at.tzinfo is None else at

    for name, wanted in (("ticker", f.tickers), ("cik", f.ciks), ("form_type", f.forms)):
        if wanted and m.get(name) not in wanted:
            return False
    for v, low, high in ((day(m.get("filing_date")), f.filed_from, f.filed_to), (instant(m.get("accepted_at")), f.accepted_from, f.accepted_to), (instant(m.get("available_at")), None, f.as_of)):
        if low is not None and (v is None or v < low) or high is not None and (v is None or v > high):
            return False
    flagged = bool(m.get("is_amendment", False))
    return f.amendments == "include" or flagged == (f.amendments == "only")


def test_metadata_filters_against_plain_code(spark):
    texts = [json.dumps(r) if r is not None else None for r in ROWS] + ["not json {", "[1, 2]", '"text"']
    df = spark.createDataFrame(list(enumerate(texts)), "id long, metadata string")
    at = lambda *a: datetime.datetime(*a, tzinfo=UTC)
    cases = [
        SearchFilters(), SearchFilters(tickers=("AAA", "CCC")), SearchFilters(ciks=("1",)), SearchFilters(forms=("10-K",)), SearchFilters(filed_from=datetime.date(2024, 3, 1)),
        SearchFilters(filed_to=datetime.date(2024, 3, 1)), SearchFilters(accepted_from=at(2024, 3, 1)), SearchFilters(accepted_to=at(2024, 3, 1, 10)), SearchFilters(as_of=at(2024, 3, 1, 10)),
        SearchFilters(as_of=at(2024, 3, 1, 10, 0, 0, 1)), SearchFilters(amendments="exclude"), SearchFilters(amendments="only"), SearchFilters(tickers=("AAA",), as_of=at(2024, 4, 1), amendments="exclude"),
    ]
    for f in cases:
        want = {i for i, t in enumerate(texts) if plain(ROWS[i] if i < len(ROWS) else {}, f)}
        for rows in (df, df.withColumn("metadata", F.try_parse_json("metadata"))):
            assert {r["id"] for r in f.apply_metadata(rows).select("id").collect()} == want, f
