"""Readers, sinks, the HTML parser and streaming on small landed files."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from quillstone.sources import html, readers, sinks
from quillstone.streaming import incremental

PAGE = """<html><head><title>x</title><script>var a = 1;</script></head><body><h1>Annual Report</h1><p>Item 1. Business</p><p>We sell things.<p>We sell things.
<div style="display: none">hidden words</div><div><p>Item 1A. Risk Factors</p></div><table><tr><th>Region</th><th>Shops</th></tr><tr><td>Coast</td><td>31</td></tr><tr><td>Hills</td><td>8 | 9</td></tr></table>
<p>Note 3 - Leases</p><li>Rent | due</li></body></html>"""


def test_html_elements(spark):
    rows = html.parse_html(spark.createDataFrame([(1, PAGE), (2, None)], "id int, html string"), "id").orderBy("reading_order").collect()
    assert [r["reading_order"] for r in rows] == list(range(len(rows)))
    table = next(r for r in rows if r["element_type"] == "table")
    assert table["markdown"] == "| Region | Shops |\n| --- | --- |\n| Coast | 31 |\n| Hills | 8 \\| 9 |" and table["section"] == "Risk Factors" and table["row_count"] == 3 and table["headers"] == ["Region", "Shops"]
    texts = [r["text"] for r in rows]
    assert texts.count("We sell things.") == 1 and not any("hidden" in t or "var a" in t for t in texts)
    assert {r["section"] for r in rows} >= {"Business", "Risk Factors", "Note 3 \u2014 Leases"} and rows[0]["element_type"] == "title"


HEADINGS = {
    "Item 1A: Risk Factors": "Risk Factors", "Risk Factors Summary": "Risk Factors", "ITEM 1. BUSINESS": "Business", "Business Overview": "Business", "Item 3 - Legal Proceeding": "Legal Proceedings",
    "Item 7. | Management\u2019s Discussion and Analysis of results": "MD&A", "Item 2. Management's Discussion and Analysis": "MD&A", "Item 8. Financial Statements and Supplementary Data": "Financial Statements",
    "Controls and Procedures (continued)": "Controls and Procedures", "Item 9A. Controls and Procedures": "Controls and Procedures", "note 12b \u2013 Income taxes": "Note 12b \u2014 Income taxes",
    "Item 8. Exhibits": None, "Item 7A. Market Risk": None, "Item 1. Legal matters": None, "The risk factors": None, "Note 4. Leases": None, "x" * 400: None,
}


def test_headings_open_sections(spark):
    from quillstone.functions import text

    df = spark.createDataFrame([(h,) for h in HEADINGS], "h string").select("h", text.section_of(F.col("h")).alias("s"))
    assert {r["h"]: r["s"] for r in df.collect()} == HEADINGS
    assert {h: html.section_name(h) for h in HEADINGS} == HEADINGS
    assert html.opens_section("p", "Business is slow this year") is None and html.opens_section("h3", "Business is slow this year") == "Business" and html.opens_section("div", "LEGAL PROCEEDINGS") == "Legal Proceedings"


def test_bars_and_events(spark, tmp_path):
    (tmp_path / "b.csv").write_text("ticker,date,adjusted_close\naaa,2026-01-02,100\n")
    assert readers.read_bars(spark, str(tmp_path / "b.csv")).first() == ("AAA", date(2026, 1, 2), 100.0)
    (tmp_path / "bad.csv").write_text("ticker,date,adjusted_close\naaa,2026-01-02,0\n")
    with pytest.raises(Exception, match="positive"):
        readers.read_bars(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "e.json").write_text(json.dumps([{"ticker": "a", "accession_number": "x", "available_at": "2026-01-05T20:00:00Z", "max_source_available_at": "2026-01-05T20:00:00Z", "f": ""}]))
    assert readers.read_events(spark, str(tmp_path / "e.json"), "f").first()["feature_value"] is None
    assert len(readers.dataset_version(spark, str(tmp_path / "e.json")).first()["version"]) == 16
    (tmp_path / "d.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "d.jsonl"), "a int").count() == 2


def test_submissions_keep_first_of_each_form(spark):
    forms = ["10-Q", "10-K", "10-K", "10-Q", "10-Q"]
    recent = {k: [f"{k}{i}" for i in range(5)] for k in ("accessionNumber", "filingDate", "reportDate", "acceptanceDateTime", "primaryDocument")} | {"form": forms, "isXBRL": [1] * 5, "isInlineXBRL": [1] * 5}
    df = spark.createDataFrame([(json.dumps({"cik": "1", "name": "n", "filings": {"recent": recent}}),)], "j string").select(F.from_json("j", readers.SUBMISSIONS).alias("s")).select("s.*")
    assert [r["form"] for r in readers.recent_filings(df, {"10-K": 1, "10-Q": 2}).orderBy("pos").collect()] == ["10-Q", "10-K", "10-Q"]


def test_company_facts(spark):
    fact = lambda v, acc, filed, form: {"start": "2024-01-01", "end": "2024-12-31", "val": v, "accn": acc, "fy": 2024, "fp": "FY", "form": form, "filed": filed}
    payload = {"cik": "1", "entityName": "n", "facts": {"us-gaap": {"Revenues": {"label": "Sales", "description": "", "units": {"USD": [fact(64, "0-25-7", "2025-02-01", "10-K"), fact(59, "0-25-31", "2025-04-01", "10-K/A"), fact("junk", "z", "2025-04-01", "10-K")]}}}, "dei": {"Shares": {"label": "s", "description": "", "units": {"shares": [fact(5, "0-25-7", "2025-02-01", "10-K")]}}}}}
    df = spark.createDataFrame([(json.dumps(payload),)], "j string").select(F.from_json("j", readers.COMPANY_FACTS).alias("s")).select("s.*")
    rows = {(r["concept"], r["accession"]): r for r in readers.company_facts(df).collect()}
    assert len(rows) == 3 and rows["Shares", "0-25-7"]["canonical_metric"] is None and rows["Revenues", "0-25-31"]["is_restatement"] and rows["Revenues", "0-25-31"]["is_amendment"]
    docs = spark.createDataFrame([("0-25-7", 1, None)], "accession string, id int, available_at timestamp")
    matched, skipped = readers.match_facts(readers.company_facts(df), docs)
    assert matched.count() == 2 and skipped.first()["skipped"] == 1


def test_price_payloads(spark):
    chart = {"chart": {"result": [{"timestamp": [1767312000, 1767571200], "indicators": {"quote": [{"close": [1.0, 2.0]}], "adjclose": [{"adjclose": [0.5, None]}]}}]}}
    got = readers.chart_bars(spark.createDataFrame([("a", json.dumps(chart))], "ticker string, payload string")).collect()
    assert [tuple(r) for r in got] == [("A", date(2026, 1, 2), 0.5)]
    rows = [{"date": "2022-01-03T00:00", "adjClose": 100.0}, {"date": "2022-01-04", "adjClose": 0.0}, {"adjClose": 3.0}]
    assert readers.daily_price_bars(spark.createDataFrame([("a", json.dumps(rows))], "ticker string, payload string")).count() == 1
    files = spark.createDataFrame([("x/tiingo_AAA_2022-01-01_2023-01-01.json",), ("x/tiingo_AAA_2022-06-01_2023-01-01.json",)], "path string")
    assert readers.covering_files(files, "aaa", "2022-03-01", "2022-12-31").count() == 1


def test_catalogs(spark):
    exchange = spark.createDataFrame([(1, "BRK-B", "Berkshire", "N"), (1, "BRK-A", "Berkshire", "N"), (2, "SPY", "SPDR S&P 500 ETF", "P")], "cik int, ticker string, name string, exchange string")
    symbols = spark.createDataFrame([("ZTEST", True, False)], "symbol string, is_test boolean, is_etf boolean")
    listed = readers.listed_companies(exchange, symbols)
    assert [(r["ticker"], r["tickers"]) for r in listed.collect()] == [("BRK-A", ["BRK-A", "BRK-B"])]
    got = readers.index_constituents(spark.createDataFrame([("BRK.B",), ("NONE",)], "symbol string"), listed)
    assert {r["symbol"]: r["ticker"] for r in got.collect()} == {"BRK.B": "BRK-A", "NONE": None}


def test_names_of_funds(spark):
    funds = ["Alpha ETF", "x etn y", "A EXCHANGE-TRADED NOTE", "ACME/UNIT", "ACME/RIGHTS", "ACME/WARRANT", "ACME/NOTES 2030", "Big Growth Fund", "SPDR Gold Trust", "Trust of SPDR", "ProShares Short", "ISHARES MSCI"]
    companies = ["FUND RAISING CORP", "MUTUAL RESERVE FUND", "SPDR INC", "ETF", "ALPHA-ETF", "ETNA CORP", "ACME UNIT", "FUND", "Trust Co", "My ProShares", "ISHARESX", "Fundamental", None]
    df = spark.createDataFrame([(n,) for n in funds + companies], "name string")
    assert {r["name"] for r in df.where(readers.fund_like(df.name)).collect()} == set(funds)


def test_sinks(spark, tmp_path):
    panel = spark.createDataFrame([(1, {"b": 1, "a": 2}, ["x"])], "id int, m map<string,int>, l array<string>")
    assert sinks.flat_panel(panel).first() == (1, '{"a":2,"b":1}', '["x"]')
    for kind in ("json", "csv", "parquet"):
        sinks.write_panel(panel, str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 1
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in sinks.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(tuple(r) for r in sinks.replace_by_keys(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    s = spark.createDataFrame([("p:1", 1), ("p:2", 2), ("q:1", 1)], "metric_key string, refreshed_at int")
    assert sorted(r["metric_key"] for r in sinks.prune_snapshots(s, 1).collect()) == ["p:2", "q:1"] and sinks.delete_prefix(s, "p:").count() == 1
    assert sinks.query_key("x:", {"b": 1, "a": 2}) == sinks.query_key("x:", {"a": 2, "b": 1})
    assert "| k | v |" in sinks.report_markdown(old, ["k", "v"])
    sinks.append_runs(old, str(tmp_path / "runs"))
    sinks.append_runs(new, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 4


def test_streaming_index_adds_each_row_once(spark, tmp_path):
    landing, index = str(tmp_path / "in"), str(tmp_path / "index")
    for batch in ([(1, "a"), (2, "b")], [(2, "b"), (3, "c")]):
        spark.createDataFrame(batch, "chunk_id int, text string").coalesce(1).write.mode("append").parquet(landing)
        incremental.index_missing(spark, landing, "chunk_id int, text string", index, str(tmp_path / "ckpt"), lambda df: df.withColumn("n", F.length("text"))).awaitTermination()
    assert sorted(r["chunk_id"] for r in spark.read.parquet(index).collect()) == [1, 2, 3]


def test_plans_have_no_cartesian_product(spark):
    from quillstone.plans import audit

    folder = "/root/testdata/sf0.001"
    for name in ("orders_without_lines_anti", "indexed_semi"):
        plan = audit.Q[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and ("LeftAnti" in plan or "LeftSemi" in plan)
