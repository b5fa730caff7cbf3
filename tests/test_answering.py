"""The answer plan: what is retrieved, routed, abstained from and cited."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import answering, retrieval

CHUNK = "chunk_id long, text string, element_type string, ticker string, form_type string, filing_date date, available_at timestamp"
D = datetime.date
UTC = datetime.timezone.utc
NEW, OLD = D(2025, 10, 31), D(2024, 11, 1)
QUESTIONS = [
    (1, "What did Orchard say about supply constraints?"),
    (2, "What supply chain risks did Orchard disclose in its latest 10-K?"),
    (3, "Find the table showing Orchard segment revenue"),
    (4, "Compare Orchard revenue growth with management commentary"),
    (5, "What private non-public information does Orchard have?"),
    (6, "Predict Orchard's stock price and tell me whether to buy the stock."),
    (7, "zebra xylophone"),
    (8, "Compare Harbor revenue growth with last year"),
    (9, "What did Orchard say about supply constraints in 2024?"),
    (10, ""),
]


@pytest.fixture(scope="module")
def world(spark):
    at = lambda d: datetime.datetime(d.year, d.month, d.day, 6, tzinfo=UTC)
    rows = [
        (1, "Orchard said supply constraints may limit production this year. More text follows.", "text", "ORCH", "10-K", NEW, at(NEW)),
        (2, "Supply chain risks and uncertainties are disclosed by Orchard in detail here.", "text", "ORCH", "10-K", NEW, at(NEW)),
        (3, "Supply chain changes involve significant risks for Orchard and its partners.", "text", "ORCH", "10-K", OLD, at(OLD)),
        (4, "Orchard segment revenue table: devices 10, services 20, total 30 in all.", "table", "ORCH", "10-Q", NEW, at(NEW)),
        (5, "Harbor revenue growth was compared with last year by Harbor management.", "text", "HARB", "10-K", NEW, at(NEW)),
        (6, "Harbor said that supply constraints are no issue for Harbor at all.", "text", "HARB", "10-Q", NEW, at(NEW)),
        (7, "Orchard revenue growth was discussed in management commentary this quarter.", "text", "ORCH", "10-Q", NEW, at(NEW)),
        (8, None, "text", "ORCH", "10-Q", NEW, at(NEW)),
    ]
    facts = [("ORCH", "Revenues", 5.0, NEW, at(NEW)), ("ORCH", "Revenues", 4.0, OLD, at(OLD)), ("ORCH", "Assets", 9.0, D(2026, 1, 1), at(D(2026, 1, 1)))]
    return (
        spark.createDataFrame(QUESTIONS, "query_id long, query string"), spark.createDataFrame(rows, CHUNK), spark.createDataFrame([("ORCH", "Orchard Inc."), ("HARB", "Harbor Corp")], "ticker string, name string"),
        spark.createDataFrame(facts, "ticker string, concept string, value double, filed_at date, available_at timestamp"),
    )


def test_answers_of_many_questions_at_once(spark, world):
    as_of = F.lit(datetime.datetime(2025, 12, 1, tzinfo=UTC))
    out = {r["query_id"]: r for r in answering.answer(*world, as_of=as_of).collect()}
    assert sorted(out) == [q for q, _ in QUESTIONS]
    assert not out[1]["abstained"] and out[1]["answer"] == "Orchard said supply constraints may limit production this year." and out[1]["citations"] == [1] and out[1]["errors"] == [] and 0 < out[1]["confidence"] <= 1
    assert out[1]["tickers"] == ["ORCH"] and out[1]["routes"] == ["text"]
    assert out[3]["routes"] == ["text", "tables", "financial_facts"] and out[3]["n_tables"] == 1 and not out[3]["abstained"]
    assert out[4]["n_facts"] == 2 and not out[4]["abstained"] and len(out[4]["citations"]) == 2  # comparisons get two claims
    assert (out[5]["reason"], out[6]["reason"], out[7]["reason"], out[8]["reason"]) == ("private_information", "forecast", "insufficient_evidence", "no_structured_fact")
    assert out[10]["reason"] == "insufficient_evidence"
    assert all(r["answer"] is None and r["citations"] == [] and r["confidence"] is None for r in out.values() if r["abstained"])


def test_latest_and_years_bound_the_filings(spark, world):
    questions, chunks, companies, _ = world
    asked = answering.prepared(questions, chunks, companies)
    bounds = {r["query_id"]: (r["filed_from"], r["filed_to"]) for r in asked.collect()}
    assert bounds[2] == (NEW, NEW) and bounds[9] == (D(2024, 1, 1), D(2024, 12, 31)) and bounds[1] == (None, None)
    early = answering.prepared(questions, chunks, companies, F.lit(datetime.datetime(2025, 1, 1, tzinfo=UTC)))
    assert early.where("query_id = 2").first()["filed_from"] == OLD
    hits = answering.candidates(asked, chunks)
    seen = lambda q: {r["chunk_id"] for r in hits.where(F.col("query_id") == q).collect()}
    assert seen(2) == {1, 2} and seen(9) == {3} and seen(1) == {1, 2, 3, 4, 7} and seen(3) == {1, 2, 3, 4, 7}
    legs = {r["chunk_id"]: r["legs"] for r in hits.where("query_id = 3").collect()}
    assert legs[4] == ["table", "text"] and legs[1] == ["text"]


def test_gate_and_citations(spark, world):
    weak = answering.answer(*world, config=answering.AnswerConfig(min_evidence=6))
    assert weak.where("query_id = 1").first()["reason"] == "insufficient_evidence"
    made = spark.createDataFrame([(1, 1, "Orchard said supply constraints may limit production", [1]), (4, 1, "Nothing of the kind was ever written", [7]), (9, 1, "anything", [999])], "query_id long, claim_no int, claim string, chunk_ids array<long>")
    out = {r["query_id"]: r for r in answering.answer(*world, generated=made, config=answering.AnswerConfig(min_evidence=1)).collect()}
    assert not out[1]["abstained"] and out[1]["citations"] == [1]
    assert out[4]["reason"] == "citation_failed" and out[4]["errors"] == ["low_overlap 7"]
    assert out[9]["reason"] == "citation_failed" and out[9]["errors"] == ["unknown_chunk 999"]
    assert out[3]["reason"] == "no_claim"


def test_dense_leg_joins_and_scores_match_a_plain_count(spark, world):
    questions, chunks, companies, _ = world
    asked = answering.prepared(questions, chunks, companies)
    dense = spark.createDataFrame([(7, 5, 0.9), (1, 5, 0.99)], "query_id long, chunk_id long, dense double")
    hits = answering.candidates(asked, chunks, dense=dense)
    assert [r["chunk_id"] for r in hits.where("query_id = 7").collect()] == [5]  # no company asked for
    assert hits.where("query_id = 1 and chunk_id = 5").count() == 0  # of another company
    plain = retrieval.lexical_scores(questions, chunks.select("chunk_id", "text"), "chunk_id", "text").where("query_id = 1 and chunk_id = 1").first()["sparse"]
    assert hits.where("query_id = 1 and chunk_id = 1").first()["sparse"] >= plain


def test_best_chunks_by_parts_are_those_of_all_pairs(spark, monkeypatch):
    """Many small parts and blocks bring what scoring and joining all pairs brings; ties, null texts and filters included."""
    rng = random.Random(11)
    words = "supply risk revenue table growth Orchard Harbor margin of the and 10-k latest 2024".split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, None if i % 37 == 0 else say(rng.randrange(9)), rng.choice(["text", "table", None]), rng.choice(["ORCH", "HARB", None]), rng.choice(["10-K", "10-Q", None]), rng.choice([NEW, OLD, D(2024, 5, 5), None]), None) for i in range(400)]
    chunks = spark.createDataFrame(rows, CHUNK)
    companies = spark.createDataFrame([("ORCH", "Orchard Inc."), ("HARB", "Harbor Corp")], "ticker string, name string")
    asked = answering.prepared(spark.createDataFrame([(i, say(rng.randrange(7))) for i in range(60)], "query_id long, query string"), chunks, companies)
    monkeypatch.setattr(answering, "PART_ROWS", 50)
    monkeypatch.setattr(answering, "PART_QUESTIONS", 20)
    none = spark.createDataFrame([], "query_id long, chunk_id long, dense double")
    config = answering.AnswerConfig(top_k=2)
    every = lambda df: [(r["query_id"], leg, round(r["sparse"], 9), r["chunk_id"]) for r in df.collect() for leg in r["legs"]]
    got, want = every(answering.candidates(asked, chunks, config)), every(answering.candidates(asked, chunks, config, dense=none))
    assert len(got) > 300 and sorted(r[:3] for r in got) == sorted(r[:3] for r in want)  # sums of pairs may break ties otherwise
    last = {}
    for q, leg, s, _ in got:
        last[q, leg] = min(s, last.get((q, leg), s))
    assert {r for r in got if r[2] > last[r[:2]]} == {r for r in want if r[2] > last[r[:2]]}
    assert answering.candidates(asked, chunks.where("false"), config).count() == 0 and answering.candidates(asked.where("false"), chunks, config).count() == 0


def test_a_question_meets_the_newest_facts_of_its_companies_alone(spark):
    asked = spark.createDataFrame([(1, ["A", "B"], ["text", "financial_facts"]), (2, ["B"], ["financial_facts"]), (3, ["A"], ["text"])], "query_id long, tickers array<string>, routes array<string>")
    facts = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("ticker"), F.concat(F.lit("c"), F.col("id") % 5).alias("concept"), (F.col("id") % 7).cast("double").alias("value"), F.date_add(F.lit(NEW), (F.col("id") % 11).cast("int")).alias("filed_at"), F.lit(None).cast("timestamp").alias("available_at"))
    config = answering.AnswerConfig(max_facts=7)
    found = answering.facts_for(asked, facts, config)
    key = lambda r: (-r["filed_at"].toordinal(), r["concept"], r["ticker"], -r["value"])
    every = facts.collect()
    for q, tickers in ((1, "AB"), (2, "B")):
        assert sorted(map(key, found.where(F.col("query_id") == q).collect())) == sorted(key(r) for r in every if r["ticker"] in tickers)[:7]
    assert found.where("query_id = 3").count() == 0
    groups = found._jdf.queryExecution().optimizedPlan().toString()
    assert groups.count("WindowGroupLimit") == 2  # a company's facts are limited before questions are joined
