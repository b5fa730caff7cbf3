"""Stated small cases of the filing-domain operators."""

import math
import random
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from quillstone.functions import numbers, text, vectors
from quillstone.operators import answers, asof, evals, facts, passages, quality, retrieval, stats, studies


def filings(spark, rows):
    schema = "id int, company string, base_form string, form_type string, period_end date, available_at date, is_amendment boolean, accession string, amends_accession string"
    return spark.createDataFrame(rows, schema)


def test_comparable_prefers_same_quarter_of_last_year(spark):
    d = date
    df = filings(spark, [
        (1, "N", "10-Q", "10-Q", d(2025, 4, 27), d(2025, 5, 28), False, "a", None), (2, "N", "10-Q", "10-Q", d(2026, 1, 25), d(2026, 2, 25), False, "b", None),
        (3, "N", "10-Q", "10-Q", d(2026, 4, 26), d(2026, 5, 20), False, "c", None), (4, "N", "10-K", "10-K", d(2024, 9, 28), d(2024, 11, 1), False, "d", None),
        (5, "N", "10-K", "10-K", d(2025, 9, 27), d(2025, 10, 31), False, "e", None), (6, "N", "10-K", "10-K/A", d(2025, 9, 27), d(2025, 12, 1), True, "f", "e"),
        (7, "N", "8-K", "8-K", d(2025, 1, 1), d(2025, 1, 2), False, "g", None), (8, "N", "8-K", "8-K", d(2025, 2, 1), d(2025, 2, 2), False, "h", None)])
    got = {r["id"]: (r["prior_id"], r["basis"]) for r in asof.comparable_filings(df, df).collect()}
    assert got[3] == (1, "same_quarter_prior_year") and got[5] == (4, "prior_annual_period") and got[6] == (5, "amendment_to_original")
    assert got[8] == (7, "prior_period") and got[4] == (None, "none")


def test_filters_and_visibility(spark):
    with pytest.raises(ValueError):
        asof.SearchFilters(as_of=datetime(2026, 7, 1))
    df = spark.createDataFrame([("AAPL", datetime(2026, 8, 1), False), ("MSFT", None, True)], "ticker string, available_at timestamp, is_amendment boolean")
    assert asof.SearchFilters(as_of=datetime(2026, 7, 1, tzinfo=timezone.utc)).apply(df).count() == 0
    assert asof.SearchFilters(as_of=datetime(2026, 9, 1, tzinfo=timezone.utc), tickers=("AAPL",)).apply(df).count() == 1
    assert asof.SearchFilters(amendments="only").apply(df).count() == 1
    with pytest.raises(ValueError):
        asof.amendment_policy(df, "some")


BARS = [(t, date(2026, 1, d), c) for t, cs in (("AAA", (100.0, 110.0, 121.0, 133.1)), ("SPY", (100.0, 101.0, 102.0, 103.0))) for d, c in zip((2, 5, 6, 7), cs, strict=True)]


def test_event_study_sessions_and_returns(spark):
    bars = spark.createDataFrame(BARS, "ticker string, date date, adjusted_close double")
    ev = spark.createDataFrame([("AAA", "x", datetime(2026, 1, 5, 20), 1.0), ("AAA", "y", datetime(2026, 1, 5, 22), 2.0), ("AAA", "z", datetime(2026, 2, 1), 3.0)], "ticker string, accession string, available_at timestamp, feature_value double")
    placed = {r["accession"]: r["session_date"] for r in asof.event_sessions(ev, bars).collect()}
    assert placed == {"x": date(2026, 1, 5), "y": date(2026, 1, 6)}
    config = studies.StudyConfig(windows=((0, 1),), draws=100)
    returns = studies.event_returns(ev, bars, config)
    got = {r["accession"]: r["abnormal_return"] for r in returns.collect()}
    assert got["x"] == pytest.approx(0.1 - (102 / 101 - 1)) and len(got) == 2
    walk = studies.walk_forward(returns, ["2026-01-06"]).first()
    assert (walk["n_train"], walk["n_test"]) == (1, 1)
    empty = studies.window_summary(returns, ((0, 1), (0, 9))).where("window = '0:9'").first()
    assert empty["n"] == 0 and empty["mean"] is None


def test_leakage_fails_the_job(spark):
    df = spark.createDataFrame([(date(2026, 1, 2), date(2026, 1, 1))], "max_source_available_at date, available_at date")
    with pytest.raises(Exception, match="source is later"):
        asof.guard_leakage(df).collect()


def test_signal_study_is_monotone(spark):
    rows = [("0:1", f"{i:03}", (i + 1) / 41, 0.10 * ((i + 1) / 41 - 0.5)) for i in range(40)]
    df = spark.createDataFrame(rows, "window string, accession string, feature_value double, abnormal_return double")
    out = studies.signal_study(df).first()
    assert out["ic"] == pytest.approx(1) and out["t_stat"] is None and out["spread"] > 0
    means = [r["mean_outcome"] for r in stats.quantile_portfolios(df, "feature_value", "abnormal_return", 5, ["window"], ["accession"]).orderBy("bucket").collect()]
    assert means == sorted(means) and len(means) == 5
    thin = studies.signal_study(df.limit(1)).first()
    assert thin["ic"] is None and thin["spread"] is None


def test_quantile_sizes_follow_floor_boundaries(spark):
    df = spark.range(13).withColumn("b", stats.quantile_bucket([F.asc("id")], 5))
    assert [r["count"] for r in df.groupBy("b").count().orderBy("b").collect()] == [2, 3, 2, 3, 3]


def test_sector_neutral_scores(spark):
    rows = [(f"acc-{i}", "2024Q1", "s", sector, float(v)) for i, (sector, v) in enumerate([("A", x) for x in (10, 12, 14, 16)] + [("B", x) for x in (100, 102, 104, 106)])]
    df = spark.createDataFrame(rows, "accession string, period string, signal string, sector string, value double")
    z = {r["accession"]: r["z"] for r in stats.sector_neutral_zscore(df, "value", "period", "signal", "sector").collect()}
    assert z["acc-0"] == pytest.approx(z["acc-4"]) and z["acc-0"] < 0
    p = {r["accession"]: r["z"] for r in stats.zscore(df, "value", ["period", "signal"]).collect()}
    assert p["acc-0"] < 0 < p["acc-4"]


def test_winsorise_and_bh(spark):
    df = spark.createDataFrame([("w", float(i)) for i in range(10)] + [("v", 1.0)], "k string, x double")
    got = sorted(r["winsorised"] for r in stats.winsorise(df, "x", 0.2, ["k"]).where("k = 'w'").collect())
    assert got[0] == 1.0 and got[-1] == 7.0
    p = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,)], "p double")
    adj = {r["p"]: r["p_adjusted"] for r in stats.benjamini_hochberg(p, "p").collect()}
    assert adj[0.01] == pytest.approx(0.03) and adj[0.04] == pytest.approx(0.04) and adj[0.03] == pytest.approx(0.04) and adj[None] is None


def test_bootstrap_repeats(spark):
    values = [0.1, -0.2, 0.3, 0.05]
    low, high, p = stats.bootstrap_mean(values, 200, 0.95, 17)
    rng = random.Random(21)
    means = sorted(sum(rng.choices(values, k=4)) / 4 for _ in range(200))
    assert (low, high) == (means[round(199 * 0.025)], means[round(199 * 0.975)]) and 0 <= p <= 1
    df = spark.createDataFrame([("w", str(i), v) for i, v in enumerate(values)], "window string, accession string, x double")
    assert stats.bootstrap_by(df, "x", "window", "accession", 200).first()["low"] == low
    b = spark.createDataFrame([("w", i // 3 * 4, i, float(i)) for i in range(6)], "window string, bucket int, ordinal int, outcome double")
    assert stats.bootstrap_spreads(b, ["w", "x"], 5, 100).where("window = 'w'").first()["low"] > 0


def test_facts_policies(spark):
    rows = [("r", date(2024, 12, 31), date(2025, 2, 1), 100.0, 1), ("r", date(2024, 12, 31), date(2025, 4, 1), 110.0, 2)]
    df = spark.createDataFrame(rows, "metric string, period_end date, filed_at date, value double, id int")
    order = [F.desc("period_end"), F.desc("filed_at"), F.desc("id")]
    value = lambda p: [r["value"] for r in facts.query_facts(df, p, 10, ["metric", "period_end"], order, "filed_at", ["id"]).orderBy("ordinal").collect()]
    assert value("latest") == [110.0] and value("as_reported") == [100.0] and value("all") == [110.0, 100.0]
    flags = [r["is_restatement"] for r in facts.restatement_flags(df, ["metric"], "filed_at", ["id"], "value").orderBy("id").collect()]
    assert flags == [False, True]
    two = facts.latest_two(df.withColumn("p", F.col("filed_at")), ["metric"], "p", "value", ["id"]).first()
    assert (two["latest"], two["prior"]) == (110.0, 100.0)
    wide = spark.createDataFrame([("a", 10.0, 4.0, 100.0, 80.0, 11.0, 10.0)], "accession string, net_income double, operating_cash_flow double, assets double, prior_assets double, shares double, prior_shares double")
    got = {r["signal"]: r["value"] for r in facts.fundamental_signals(wide).collect()}
    assert got["earnings_quality"] == pytest.approx(-0.06) and got["asset_growth"] == pytest.approx(-0.25) and got["net_share_issuance"] == pytest.approx(-0.1)
    sic = spark.createDataFrame([("3571",), ("2834",), ("1311",), ("6022",), ("4911",), (None,), ("junk",)], "sic string").select(studies.sic_sector(F.col("sic")).alias("s"))
    assert [r["s"] for r in sic.collect()] == ["Information Technology", "Health Care", "Energy", "Financials", "Utilities", "Unknown", "Unknown"]


def test_chunks_and_diffs(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "")], "id int, text string")
    assert [r["token_count"] for r in passages.text_chunks(df, ["id"], "text", 3).orderBy("chunk_index").collect()] == [3, 3, 1]
    t = spark.createDataFrame([(1, "| Year |", ["Year", "Revenue"], 2, 2, None)], "id int, markdown string, headers array<string>, rows int, columns int, section string")
    kinds = passages.table_chunks(t, ["id"], "markdown", "headers", "rows", "columns", "section").orderBy("chunk_index").collect()
    assert [r["chunk_type"] for r in kinds] == ["table_markdown", "table_summary"] and "Columns: Year, Revenue" in kinds[1]["chunk_text"]
    d = spark.createDataFrame([(1, 0, "Risk  one"), (1, 1, "risk one "), (1, 2, "other")], "document int, at int, chunk_text string")
    assert passages.distinct_chunks(d, "document", ["at"]).count() == 2
    p = spark.createDataFrame([(1, "Risk Factors", 0, "same"), (1, "Risk Factors", 1, "old words here"), (2, "Risk Factors", 0, "same"), (2, "Risk Factors", 1, "old words there"), (2, "Risk Factors", 2, "new")], "id int, section string, reading_order int, text string")
    pairs = spark.createDataFrame([(2, 1), (1, None)], "id int, prior_id int")
    assert passages.diff_counts(passages.filing_diff(pairs, p)).first().asDict() == {"id": 2, "added": 1, "removed": 0, "materially_changed": 1}
    prints = passages.section_prints(p, "id", "section", "text")
    change = passages.section_changes(pairs, prints).first()
    assert (change["added"], change["removed"]) == (2, 1) and change["novelty"] == pytest.approx(2 / 3)


def test_retrieval_cases(spark):
    q = spark.createDataFrame([(1, "data center revenue")], "query_id int, query string")
    pool = spark.createDataFrame([(1, 1, "data center revenue increased"), (1, 2, "export controls"), (1, 3, "gaming revenue")], "query_id int, id int, text string")
    ranked = retrieval.rank(retrieval.bm25_scores(q, pool, "id", "text"), "bm25", "id").orderBy("rank").collect()
    assert ranked[0]["id"] == 1 and ranked[-1]["id"] == 2
    rrf = spark.createDataFrame([(1, i, r, w) for w, ids in ((0.1, (1, 3, 4)), (1.0, (2, 1, 5))) for r, i in enumerate(ids, 1)], "query_id int, id int, rank int, weight double")
    got = {r["id"]: r["hybrid"] for r in retrieval.fuse_rrf(rrf, "id").collect()}
    assert got[2] > got[3]
    even = {r["id"]: r["hybrid"] for r in retrieval.fuse_rrf(rrf.withColumn("weight", F.lit(1.0)), "id").collect()}
    assert max(even, key=even.get) == 1
    with pytest.raises(ValueError):
        retrieval.fuse_weighted(pool, -1, 1)
    c = spark.createDataFrame([(1, i, t) for i, t in enumerate(["AAPL", "AAPL", "MSFT", "AAPL", "NVDA", " "], 1)], "query_id int, rank int, ticker string")
    kept = [(r["ticker"], r["rank"]) for r in retrieval.diversify(c, "ticker", 2, 2).orderBy("rank").collect()]
    assert kept == [("AAPL", 1), ("AAPL", 2), ("MSFT", 3)]
    rows = spark.createDataFrame([(i, 1, i) for i in (1, 2, 3)], "id int, doc int, at int")
    assert sorted(r["id"] for r in retrieval.neighbours(rows.where("id = 2"), rows, "doc", "at", "id", 1).collect()) == [1, 3]


def test_text_functions(spark):
    row = spark.range(1).select(
        text.tsquery(F.lit("AI revenue, AI demand")).alias("a"), text.tsquery(F.lit("Which companies discuss data center power constraints")).alias("b"), text.first_sentence(F.lit("Sales rose to $26.77 billion or $10.44 a share. Next.")).alias("c"),
        text.base_form(F.lit("10-k/a")).alias("d"), text.cik10(F.lit("CIK 320193")).alias("e"), text.section_of(F.lit("Item 1A. Risk Factors")).alias("f"), text.section_of(F.lit("Note 4 - Leases")).alias("g"), text.collapse(F.lit(" a  b ")).alias("h"),
        text.topic_mentions(F.lit("Climate and carbon; climates"))["climate"].alias("i"), numbers.period_label(F.lit("2024-02-03").cast("date")).alias("j"), numbers.canonical_json(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2))).alias("k"),
        numbers.parse_vector(F.lit("HalfVector([1,2.5])")).alias("l"), numbers.token_estimate(F.lit("")).alias("m"), vectors.cosine(F.array(F.lit(1.0)), F.array(F.lit(0.0))).alias("n"), text.archive_url("https://x/", F.lit("320193"), F.lit("0000320193-25-1"), F.lit("d.htm")).alias("o"),
    ).first()
    assert row["a"] == "ai | revenue | demand" and row["b"] == "companies | discuss | data | center | power | constraints"
    assert row["c"].endswith("a share.") and row["d"] == "10-K" and row["e"] == "0000320193" and row["f"] == "Risk Factors" and row["g"] == "Note 4 \u2014 Leases" and row["h"] == "a b"
    assert row["i"] == 2 and row["j"] == "2024Q1" and row["k"] == '{"a":2,"b":1}' and row["l"] == [1.0, 2.5] and row["m"] == 1 and row["n"] == 0.0 and row["o"] == "https://x/320193/0000320193251/d.htm"
    h = vectors.hash_slot(F.lit("revenue"), 64)
    assert tuple(spark.range(1).select(h[0].alias("i"), h[1].alias("s")).first())[0] == 2


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, i, str(x)) for i, x in enumerate((3, 1, 2, 4), 1)], "question_id int, rank int, label string")
    want = spark.createDataFrame([(1, "1"), (1, "2")], "question_id int, label string")
    m3, m2 = (evals.retrieval_metrics(ranked, want, k).first() for k in (3, 2))
    assert m3["recall"] == 1.0 and m2["precision"] == 0.5 and m3["rr"] == 0.5 and m3["ndcg"] == pytest.approx(0.6934, abs=1e-4)
    found = evals.ann_recall(spark.createDataFrame([(1, 1), (1, 2)], "query_id int, id int"), spark.createDataFrame([(1, 2), (1, 3)], "query_id int, id int"), "id", 2).first()
    assert found["recall"] == 0.5
    refs = spark.createDataFrame([(1, "a", None, "quoted text", 0, "r0")], "question_id int, accession string, section string, quote string, position int, label string")
    cand = spark.createDataFrame([(1, 1, "a", "S", "the Quoted Text here"), (1, 2, "b", "S", "quoted text")], "question_id int, rank int, accession string, section string, text string")
    assert [r["label"] for r in evals.label_candidates(cand, refs).orderBy("rank").collect()] == ["r0", "unmatched:b:2"]


def test_benchmark_builders(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "xalpha beta gammay"), (3, None)], "id int, text string")
    quotes = spark.createDataFrame([(1, "alpha beta gamma"), (2, "gamma"), (3, "beta gamma"), (4, "absent words here")], "item int, quote string")
    assert sorted((r["id"], r["item"]) for r in evals.holding(docs, "id", quotes, "item").collect()) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3)]
    refs = spark.createDataFrame([(1, "a", "Beta"), (2, "a", "none"), (3, "z", "q")], "question_id int, accession string, quote string")
    chunks = spark.createDataFrame([(5, "a", "c", "T", "alpha"), (6, "a", "c", "T", "the beta"), (7, "b", "c", "U", "other")], "id int, accession string, category string, ticker string, text string")
    assert {r["question_id"]: (r["chunk_id"], r["found"]) for r in evals.reground(refs, chunks).collect()} == {1: (6, True), 2: (5, False), 3: (None, False)}
    made = evals.grounded_questions(chunks, {"c": "What does {ticker} say about {quote}?"}, {"c": 5}).collect()
    assert len(made) == 2 and len({r["question_id"] for r in made}) == 2 and all(len(r["question_id"]) == 12 for r in made)
    series = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0)], "k string, at int, x double")
    assert stats.ewma(series, "x", "at", ["k"]).first()["ewma"] == pytest.approx(16.0)


def test_answers(spark):
    companies = spark.createDataFrame([("NVDA", "NVIDIA Corporation"), ("AAPL", "Apple Inc."), ("APLE", "Apple Hospitality REIT")], "ticker string, name string")
    aliases = answers.company_aliases(companies)
    q = spark.createDataFrame([(1, "What did Nvidia say about AAPL?"), (2, "applesauce")], "query_id int, query string")
    got = {r["query_id"]: r["tickers"] for r in answers.resolve_companies(q, aliases, companies).collect()}
    assert got == {1: ["AAPL", "NVDA"], 2: []}
    claims = spark.createDataFrame([(1, 1, "revenue rose ten percent", [7, 999])], "query_id int, claim_no int, claim string, chunk_ids array<int>")
    ev = spark.createDataFrame([(1, 7, "Revenue rose ten percent in 2025")], "query_id int, chunk_id int, text string")
    assert {r["chunk_id"]: r["error"] for r in answers.verify_citations(claims, ev).collect()} == {7: None, 999: "unknown_chunk"}
    rows = spark.createDataFrame([(1, "compare a and b", 1, 5, "Short", "text"), (1, "compare a and b", 2, 6, "One two three four five. Six.", "text"), (1, "compare a and b", 3, 7, "a b c d e f g", "table")], "query_id int, query string, rank int, chunk_id int, text string, element_type string")
    assert [(r["chunk_id"], r["claim"]) for r in answers.extractive_claims(rows).orderBy("claim_no").collect()] == [(6, "One two three four five.")]
    earned = spark.createDataFrame([(2, "eps growth", i, i, t, "text") for i, t in enumerate(["plain words that say nothing much", "net income was up to $4 million", "diluted eps of 3 in the year"])], rows.schema)
    assert [r["chunk_id"] for r in answers.extractive_claims(earned).orderBy("claim_no").collect()] == [1, 2]
    y = spark.range(1).select(*[c.alias(n) for n, c in zip("ab", answers.year_bounds(F.lit("from FY2023 to 2025, not 120251")), strict=True)]).first()
    assert (y["a"], y["b"]) == (date(2023, 1, 1), date(2025, 12, 31))
    v = spark.createDataFrame([(1, " a  b ", ["N"], [], ["T"])], "query_id int, query string, names array<string>, sections array<string>, tickers array<string>")
    assert [r["query"] for r in answers.variants(v).orderBy("variant_no").collect()] == ["a b", "a b N", "a b " + answers.FINANCE_SUFFIX]


def test_company_names_and_routes(spark):
    companies = spark.createDataFrame([("NES", "Nestlé S.A."), ("GEN", "General Widgets Co. Ltd"), ("BLK", "Block, Inc."), ("HLD", "Acorn Holdings plc"), ("XYZ", "Company Inc")], "ticker string, name string")
    aliases = {(r["alias"], r["ticker"]) for r in answers.company_aliases(companies).collect()}
    assert {a for a, t in aliases if t == "NES"} == {"nestle s a", "nestle"} and {a for a, t in aliases if t == "GEN"} == {"general widgets co ltd", "general widgets"}
    assert {a for a, t in aliases if t == "BLK"} == {"block inc", "block"} and {a for a, t in aliases if t == "HLD"} == {"acorn holdings plc", "acorn holdings", "acorn"} and {a for a, t in aliases if t == "XYZ"} == {"company inc"}
    asked = spark.createDataFrame([(1, "NESTLE\u0301 sales"), (2, "Acorn"), (3, "a blocked road")], "query_id int, query string")
    found = answers.resolve_companies(asked, answers.company_aliases(companies), companies)
    assert {r["query_id"]: r["tickers"] for r in found.collect()} == {1: ["NES"], 2: ["HLD"], 3: []}
    want = {"earnings of the chart": ["text", "tables", "financial_facts"], "segment revenue": ["text", "tables", "financial_facts"], "growth and eps": ["text", "financial_facts", "tables"], "guidance": ["text"]}
    got = spark.createDataFrame([(q,) for q in want], "q string").select("q", answers.routes(F.col("q")).alias("r"), answers.element_types(F.col("q")).alias("e"))
    assert {r["q"]: r["r"] for r in got.collect()} == want and {r["q"]: r["e"] for r in got.collect()}["earnings of the chart"] == ["figure"]


def test_quality(spark):
    runs = spark.createDataFrame([("a", "running", datetime(2024, 1, 1), None, None), ("b", "completed", datetime(2024, 1, 2), datetime(2024, 1, 3), None)], "run_key string, status string, started_at timestamp, completed_at timestamp, failures array<string>")
    marked = {r["run_key"]: (r["status"], r["failures"]) for r in quality.stale_runs(runs, "2024-06-01", "stale").collect()}
    assert marked == {"a": ("failed", ["stale"]), "b": ("completed", None)}
    assert quality.run_health(runs).first()["success_rate"] == 1.0
    docs = spark.createDataFrame([(1, None, None), (2, "p", None)], "id int, local_path string, sha256_hash string")
    none = spark.createDataFrame([], "document_id int")
    assert {r["id"]: r["reason"] for r in quality.unchunked_reasons(docs, none, none).collect()} == {1: "missing_local_path", 2: "not_downloaded"}
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    child = spark.createDataFrame([(10, 1), (20, 2)], "id int, parent int")
    kept, left, past = quality.cascade(parents, parents.where("id = 1"), "id", child, "parent", child, "parent")
    assert kept.count() == 1 and left.count() == 1 and {r["id"]: r["parent"] for r in past.collect()} == {10: None, 20: 2}
    b = spark.createDataFrame([(1, None, None, date(2024, 1, 2), None, "10-K/A", '{"acceptanceDateTime":"2024-01-03T06:01:26Z"}'), (2, None, None, date(2024, 1, 2), None, "10-K", None)], "id int, accepted_at timestamp, available_at timestamp, filing_date date, is_amendment boolean, form_type string, metadata_json string")
    out = {r["id"]: r for r in quality.backfill_availability(b).collect()}
    assert out[1]["is_amendment"] and out[1]["available_at"] == datetime(2024, 1, 3, 6, 1, 26) and out[2]["available_at"] == datetime(2024, 1, 2)
    assert math.isclose(spark.range(1).select(quality.share(F.lit(0), F.lit(0)).alias("s")).first()["s"], 1.0)


def test_counts_of_changes_need_no_character_ratio(spark):
    """Two passages that share no line, of 40,000 characters each: their ratio takes minutes, their count none."""
    import time

    rng = random.Random(3)
    text = lambda: "".join(chr(rng.randrange(0x4E00, 0x4E00 + 200)) for _ in range(40_000))
    p = spark.createDataFrame([(i, "S", 0, text()) for i in range(1, 9)], "id int, section string, reading_order int, text string")
    pairs = spark.createDataFrame([(i, i - 1) for i in range(2, 9)], "id int, prior_id int")
    began = time.monotonic()
    counts = passages.diff_counts(passages.filing_diff(pairs, p)).collect()
    assert len(counts) == 7 and all((r["added"], r["removed"], r["materially_changed"]) == (0, 0, 1) for r in counts)
    assert time.monotonic() - began < 30
    short = spark.createDataFrame([(1, "S", 0, "old words here"), (2, "S", 0, "old words there"), (2, "S", 1, "new")], p.schema)
    rows = {r["change"]: r["similarity"] for r in passages.filing_diff(pairs.where("id = 2"), short).collect()}
    assert rows == {"materially_changed": pytest.approx(28 / 29), "added": None}
