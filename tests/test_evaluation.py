"""Stated small cases of evaluation reports, model hooks and maintenance."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text
from quillstone.operators import evals, quality, retrieval, studies
from quillstone.sources import readers, sinks

QUESTIONS = "question_id int, category string, expected_sections array<string>, expected_tickers array<string>, labels array<string>, should_abstain boolean"
OUTCOMES = "variant string, question_id int, recall double, precision double, rr double, ndcg double, sections array<string>, tickers array<string>, citations array<string>, abstained boolean, inferred_tickers array<string>, latency_ms double, cost double"


def test_variant_report(spark):
    q = spark.createDataFrame([(1, "table", ["MD&A"], ["A"], ["x", "y"], False), (2, "narrative", [], ["B"], ["z"], False), (3, "narrative", [], [], [], True), (4, "narrative", [], [], [], True)], QUESTIONS)
    o = spark.createDataFrame([
        ("v", 1, 0.5, 0.1, 1.0, 0.6, ["MD&A", "Business"], ["C"], ["x", "x", "w"], False, ["A", "A"], 10.0, 0.1), ("v", 2, 1.0, 0.3, 0.5, 0.8, [], ["B"], [], False, ["C"], 30.0, 0.3),
        ("v", 3, 0.0, 0.0, 0.0, 0.0, [], [], [], True, [], 20.0, 0.0), ("v", 4, 0.0, 0.0, 0.0, 0.0, [], [], [], False, [], 40.0, 0.0)], OUTCOMES)
    r = evals.variant_report(q, o).first().asDict()
    assert len(r) == 17 and r["variant"] == "v" and r["questions"] == 4
    want = {"recall": 0.375, "precision": 0.1, "rr": 0.375, "ndcg": 0.35, "section_hit_rate": 1.0, "ticker_accuracy": 0.75, "table_recall": 0.5, "citation_precision": (0.5 + 0 + 1 + 1) / 4, "entity_accuracy": 0.75,
            "latency_p50": 25.0, "latency_p95": 40.0, "mean_cost": 0.1, "abstention_precision": 1.0, "abstention_recall": 0.5, "abstention_f1": (2 / 3 + 0.8) / 2}
    assert {k: r[k] for k in want} == pytest.approx(want)
    assert evals.variant_report(q, o.limit(0)).count() == 0


def test_answer_rates(spark):
    q = spark.createDataFrame([(i, ["Risk"] if i == 2 else [], ["A"]) for i in range(1, 6)], "question_id int, expected_sections array<string>, expected_tickers array<string>")
    a = spark.createDataFrame([(1, False, [1], 0.8), (2, False, [1, 9], 0.4), (3, True, None, 0.0), (4, False, None, 0.9)], "question_id int, abstained boolean, cited array<int>, confidence double")
    e = spark.createDataFrame([(1, 1, "Risk", "A"), (1, 1, "Risk", "A"), (2, 1, "Other", "A")], "question_id int, chunk_id int, section string, ticker string")
    r = evals.answer_rates(q, a, e).first().asDict()
    assert r == pytest.approx({"answer_rate": 0.4, "on_target": 0.2, "grounding": 0.5, "abstention_rate": 0.2, "mean_confidence": 0.6})
    none = evals.answer_rates(q, a.limit(0), e).first()
    assert none["answer_rate"] == 0 and none["grounding"] == 0 and none["mean_confidence"] == 0


def test_short_quotes_come_in_blocks(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "two three")], "id int, text string")
    quotes = spark.createDataFrame([(i, w) for i, w in enumerate(("one", "two", "wo th", "four"))], "item int, quote string")
    got = evals.holding(docs, "id", quotes, "item", most_short=1)
    assert sorted((r["id"], r["item"]) for r in got.collect()) == [(1, 0), (1, 1), (2, 1), (2, 2)]


def test_embedding_provider(spark):
    rows = spark.createDataFrame([(i, None if i == 3 else "x" * i) for i in range(8)], "id int, text string").repartition(2)

    def provider(texts):
        if len(texts) > 2:
            raise ValueError("too many at once")
        return [[len(t), 1] for t in texts]

    got = {r["id"]: r["embedding"] for r in retrieval.embed(rows, "text", provider, 2, batch=2).collect()}
    assert got == {i: None if i == 3 else [float(i), 1.0] for i in range(8)}
    for wrong in (lambda ts: [[1.0]] * len(ts), lambda ts: [[1.0, 2.0]], lambda ts: [[1.0, float("nan")]] * len(ts)):
        with pytest.raises(Exception, match="finite vectors of 2 dimensions"):
            retrieval.embed(rows.coalesce(1), "text", wrong, 2).collect()


def test_model_reranker(spark):
    df = spark.createDataFrame([(1, 1, "ab", "q"), (1, 2, "abcd", "q"), (1, 3, "abc", "q"), (1, 4, "zzzzz", "q")], "query_id int, rank int, text string, query string").withColumn("id", F.col("rank"))
    model = lambda queries, texts: [len(q) * len(t) for q, t in zip(queries, texts, strict=True)]
    got = lambda **more: [r["id"] for r in retrieval.rerank_by(df, "id", "text", model, 3, **more).orderBy("final_rank").collect()]
    assert got() == [2, 3, 1] and got(every=True) == [4, 2, 3]


def test_pools_cited_rows_and_many_queries(spark):
    assert [retrieval.pool_size(*x) for x in ((10, True), (10, False), (3, True), (30, False))] == [50, 20, 20, 30]
    e = spark.createDataFrame([(1, i, i) for i in range(1, 5)], "query_id int, id int, rank int")
    got = retrieval.cited_first(e, e.where("id in (2, 4)").unionByName(e.where("id = 2")), "id").orderBy("shown").collect()
    assert [r["id"] for r in got] == [2, 4, 1, 3] and [r["cited"] for r in got] == [True, True, False, False]
    q = spark.range(300).select(F.col("id").cast("int").alias("query_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("query_vec"))
    chunks = spark.createDataFrame([(7, [1.0, 0.0])], "id int, v array<double>")
    scored = {r["query_id"]: r["dense"] for r in retrieval.dense_scores(q, chunks, "id", "v").collect()}
    assert len(scored) == 300 and scored[0] == pytest.approx(1) and scored[299] == pytest.approx(1 / (1 + 299**2) ** 0.5)
    assert retrieval.dense_scores(q.limit(0), chunks, "id", "v").count() == 0


def test_paraphrases(spark):
    rows = [("o1", "dev", "table", "What risks?", False, None, None, "a", "Net sales, up 5% (FY2024)"), ("o2", "dev", "table", "Other?", False, "T", "S", "a", "Net"), ("o3", "dev", "filters", "What risks?", True, "T", "S", "a", "Net"), ("o4", "dev", "filters", "What risks?", False, "T", "S", "a", None)]
    df = spark.createDataFrame(rows, "question_id string, split string, category string, question string, should_abstain boolean, ticker string, section string, accession string, quote string")
    got = {r["question_id"]: r["question"] for r in evals.paraphrased(df, ("What risks",)).collect()}
    assert "Where does the issuer report figures about Net sales up 5% FY2024?" in got.values() and {k for k in got if not k.startswith("dev-")} == {"o2", "o3", "o4"}


def test_slices_titles_and_reports(spark):
    assert readers.parse_slice("") is None and readers.parse_slice("5:10") == (5, 10)
    for wrong in ("5", "5:0", "-1:3", "a:b", "5:"):
        with pytest.raises(ValueError):
            readers.parse_slice(wrong)
    df = spark.createDataFrame([("crude petro-leum & GAS (no 2b)",), ("",), (None,)], "s string")
    assert [r["t"] for r in df.select(text.title_case(F.col("s")).alias("t")).collect()] == ["Crude Petro-Leum & Gas (No 2B)", "", None]
    with pytest.raises(ValueError):
        sinks.report_markdown(spark.range(1001), ["id"])


def test_rechunking(spark):
    docs = spark.createDataFrame([(1, "p", "h"), (2, "p", "h"), (3, None, "h")], "id int, local_path string, sha256_hash string")
    elements = spark.createDataFrame([(1, 0, "a b c"), (2, 0, "d"), (2, 1, "")], "document_id int, reading_order int, text string")
    chunks = spark.createDataFrame([(2,)], "document_id int")
    assert [(r["document_id"], r["chunk_text"]) for r in quality.rechunk(docs, elements, chunks, size=2).orderBy("chunk_index").collect()] == [(1, "a b"), (1, "c")]
    assert quality.unchunked(elements, chunks).count() == 1 and quality.unchunked(elements, chunks, force=True).count() == 3


def test_bars_without_price_shift_nothing(spark):
    bars = [(t, date(2026, 1, d), c) for t, cs in (("AAA", (0.0, 110.0, 121.0, 133.1)), ("SPY", (100.0, 101.0, 102.0, 103.0))) for d, c in zip((2, 5, 6, 7), cs, strict=True)]
    bars = spark.createDataFrame(bars, "ticker string, date date, adjusted_close double")
    ev = spark.createDataFrame([("AAA", "x", datetime(2026, 1, 5, 20), 1.0)], "ticker string, accession string, available_at timestamp, feature_value double")
    row = studies.event_returns(ev, bars, studies.StudyConfig(windows=((0, 1),))).first()
    assert row["session_date"] == date(2026, 1, 5) and row["asset_return"] == pytest.approx(0.1) and row["benchmark_return"] == pytest.approx(102 / 101 - 1)


def test_ties_have_one_order(spark):
    rows = spark.createDataFrame([("k", 1, 1, "b"), ("k", 1, 1, "a")], "k string, size int, at int, v string")
    assert {sinks.upsert_dominant(df, rows.limit(0), ["k"], "size", "at").first()["v"] for df in (rows, rows.orderBy("v"))} == {"b"}
    assert {sinks.last_writer(df, rows.limit(0), ["k"], "at").first()["v"] for df in (rows, rows.orderBy("v"))} == {"b"}
