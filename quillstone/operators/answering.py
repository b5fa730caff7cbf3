"""Answers to many questions as one plan: routing, text, table and fact evidence, the gate, claims, checked citations, abstentions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillstone.functions import text as X
from quillstone.operators import answers, retrieval
from quillstone.sources.scratch import kept

#: Chunks and questions that meet in one task of _best_lexical(), and chunks that are counted at a time.
PART_ROWS, PART_QUESTIONS, SLICE = 4_096, 1_024, 128


@dataclass(frozen=True)
class AnswerConfig:
    """Rows that are reranked, the gate's thresholds, the least rerank score, facts a question gets, element types that are tables."""

    top_k: int = 8
    min_evidence: int = answers.MIN_EVIDENCE
    min_score: float = answers.MIN_SCORE
    min_rerank: float = 0.0
    min_overlap: float = answers.MIN_OVERLAP
    max_facts: int = 20
    tables: tuple[str, ...] = ("table",)


def _known(df: DataFrame, as_of: Column | None) -> DataFrame:
    return df if as_of is None else df.where(F.col("available_at") <= as_of)


def prepared(questions: DataFrame, chunks: DataFrame, companies: DataFrame, as_of: Column | None = None) -> DataFrame:
    """questions (query_id, query) with what they ask for: tickers, names, forms, sections, routes, filed_from, filed_to.

    Years bound the filing date. A question for the latest filing of one company and one form, without a year, is bound to the date
    of the newest such filing that has a chunk and is known at as_of.
    """
    tickers = answers.resolve_companies(questions, answers.company_aliases(companies), companies)
    q = F.col("query")
    low, high = answers.year_bounds(q)
    rows = questions.join(tickers, "query_id").withColumns({"forms": answers.forms(q), "sections": answers.sections(q), "routes": answers.routes(q), "filed_from": low, "filed_to": high})
    named = tickers.select("query_id", F.explode("tickers").alias("ticker")).join(companies.select("ticker", "name"), "ticker").groupBy("query_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    rows = rows.join(named, "query_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    newest = _known(chunks, as_of).groupBy("ticker", "form_type").agg(F.max("filing_date").alias("newest"))
    one = q.rlike(answers.ASKS["latest"]) & (F.size("tickers") == 1) & (F.size("forms") == 1) & F.col("filed_from").isNull()
    rows = rows.withColumns({"ticker_": F.when(one, F.get("tickers", F.lit(0))), "form_": F.when(one, F.get("forms", F.lit(0)))})
    rows = rows.join(newest, (F.col("ticker_") == newest.ticker) & (F.col("form_") == newest.form_type), "left").drop("ticker", "form_type", "ticker_", "form_")
    return rows.withColumns({"filed_from": F.coalesce("newest", "filed_from"), "filed_to": F.coalesce("newest", "filed_to")}).drop("newest")


def _best_lexical(asked: DataFrame, chunks: DataFrame, n: int, tables: list[str]) -> DataFrame:
    """(query_id, chunk_id, leg, sparse): each question's n best chunks that pass its filters, by retrieval.lexical_scores() of its best variant.

    The table leg has those of tables, for questions that are routed to them. Blocks of questions and parts of the chunks meet in tasks of
    bounded size; a task counts the questions' tokens in its chunks and sends on its n best a question and leg, so scores of pairs
    are never shuffled. What is shuffled are the chunks' tokens, once a block. Logarithms are rounded to 2^-40, so that sums are exact
    in any order and ties are ties.
    """
    terms = answers.variants(asked).groupBy("query_id").agg(F.collect_list(X.distinct_tokens(F.col("query"))).alias("terms"))
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    questions = asked.select("query_id", "tickers", "forms", F.array_contains("routes", "tables").alias("tables"), day("filed_from").alias("low"), day("filed_to").alias("high")).join(terms, "query_id")
    rows = chunks.select("chunk_id", "ticker", "form_type", day("filing_date").alias("day"), F.coalesce(F.col("element_type").isin(tables), F.lit(False)).alias("table"), X.tokens(F.col("text")).alias("tokens"))
    parts, blocks = max(1, -(-chunks.count() // PART_ROWS)), max(1, -(-asked.count() // PART_QUESTIONS))
    each = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    left = rows.withColumn("part_", F.pmod(F.xxhash64("chunk_id"), F.lit(parts))).withColumn("block_", each(blocks))
    right = questions.withColumn("block_", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("part_", each(parts))
    schema = T.StructType([asked.schema["query_id"], chunks.schema["chunk_id"], T.StructField("leg", T.StringType()), T.StructField("sparse", T.DoubleType())])

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        column = lambda t, c: t[c].combine_chunks()
        lengths = lambda lists: np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
        rows = rows.sort_by("chunk_id")  # so that ties go to the smaller key
        variants = column(asked, "terms").flatten()
        of_variant, n_terms, words = lengths(column(asked, "terms")), lengths(variants), variants.flatten()
        wanted = pc.unique(words)
        code = np.asarray(pc.index_in(words, value_set=wanted)).astype(np.int64)
        by_code = np.argsort(code, kind="stable")
        holders, starts = np.repeat(np.arange(len(variants)), n_terms)[by_code], np.searchsorted(code[by_code], np.arange(len(wanted) + 1))
        score, tokens = np.zeros((len(rows), len(asked))), column(rows, "tokens")
        for a in range(0, len(rows) if len(wanted) and len(asked) else 0, SLICE):
            some = tokens.slice(a, SLICE)
            found = pc.index_in(some.flatten(), value_set=wanted)
            hit = np.asarray(pc.is_valid(found))
            pairs = np.repeat(np.arange(len(some)), lengths(some))[hit] * len(wanted) + np.asarray(found.drop_null()).astype(np.int64)
            pairs, tf = np.unique(pairs, return_counts=True)
            row, token = pairs // len(wanted), pairs % len(wanted)
            m = starts[token + 1] - starts[token]
            at = np.repeat(starts[token] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            sums = np.bincount(np.repeat(row, m) * len(variants) + holders[at], np.repeat(np.rint(np.log1p(tf) * 2**40) / 2**40, m), len(some) * len(variants))
            score[a : a + SLICE] = np.maximum.reduceat(sums.reshape(len(some), -1) / np.maximum(n_terms, 1), np.cumsum(of_variant) - of_variant, axis=1)
        ticker, form, days = column(rows, "ticker"), column(rows, "form_type"), np.asarray(pc.cast(column(rows, "day"), pa.float64()).fill_null(np.nan))
        table, out = np.asarray(column(rows, "table").cast(pa.int8())).astype(bool), []
        among = lambda c, names: np.asarray(pc.is_in(c, value_set=pa.array(names, c.type)).cast(pa.int8())).astype(bool)
        for i, q in enumerate(asked.select(["tickers", "forms", "tables", "low", "high"]).to_pylist()):
            ok = score[:, i] > 0
            for c, names in ((ticker, q["tickers"]), (form, q["forms"])):
                ok &= among(c, names) if names else True
            ok &= (days >= q["low"]) if q["low"] is not None else True
            ok &= (days <= q["high"]) if q["high"] is not None else True
            for leg, held in (("text", ok), ("table", ok & table if q["tables"] else None)):
                if held is not None:
                    best = np.flatnonzero(held)
                    best = best[np.argsort(-score[best, i], kind="stable")[:n]]
                    out.append((np.full(len(best), i), best, [leg] * len(best), score[best, i]))
        q, r, legs, s = [np.concatenate(c) for c in zip(*out, strict=True)] if out else ([], [], [], [])
        take = lambda t, c, at: t[c].take(pa.array(at, pa.int64()))
        return pa.Table.from_arrays([take(asked, "query_id", q), take(rows, "chunk_id", r), pa.array(list(legs), pa.string()), pa.array(s, pa.float64())], names=schema.names)

    met = left.groupBy("part_", "block_").cogroup(right.groupBy("part_", "block_")).applyInArrow(meet, schema)
    return retrieval.top_k(met, "sparse", "chunk_id", n, ["query_id", "leg"]).drop("rank")


def _best_of_both(asked: DataFrame, chunks: DataFrame, n: int, config: AnswerConfig, as_of: Column | None, dense: DataFrame) -> DataFrame:
    """As _best_lexical(), by the larger of the lexical and the given dense score; lexical scores of all pairs are joined to the dense ones."""
    v = answers.variants(asked).select(F.struct("query_id", "variant_no").alias("query_id"), "query")
    sparse = retrieval.lexical_scores(v, chunks.select("chunk_id", "text"), "chunk_id", "text")
    scored = sparse.groupBy(F.col("query_id.query_id").alias("query_id"), "chunk_id").agg(F.max("sparse").alias("sparse"))
    scored = scored.join(dense.select("query_id", "chunk_id", "dense"), ["query_id", "chunk_id"], "full")
    about = _known(chunks, as_of).select("chunk_id", "ticker", "form_type", "filing_date", "element_type")
    wants = asked.select("query_id", "tickers", "forms", "routes", "filed_from", "filed_to")
    rows = scored.join(about, "chunk_id").join(wants, "query_id")
    within = lambda values, c: (F.size(values) == 0) | F.array_contains(values, F.col(c))
    rows = rows.where(within("tickers", "ticker") & within("forms", "form_type"))
    rows = rows.where((F.col("filed_from").isNull() | (F.col("filing_date") >= F.col("filed_from"))) & (F.col("filed_to").isNull() | (F.col("filing_date") <= F.col("filed_to"))))
    rows = rows.withColumn("score_", F.greatest(F.coalesce("sparse", F.lit(0.0)), F.coalesce("dense", F.lit(0.0))))
    text = retrieval.top_k(rows, "score_", "chunk_id", n).withColumn("leg", F.lit("text"))
    table = rows.where(F.col("element_type").isin(list(config.tables)) & F.array_contains("routes", "tables"))
    return text.unionByName(retrieval.top_k(table, "score_", "chunk_id", n).withColumn("leg", F.lit("table")))


def candidates(asked: DataFrame, chunks: DataFrame, config: AnswerConfig = AnswerConfig(), as_of: Column | None = None, dense: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, dense, sparse, hybrid, rank, legs): what the text leg and, where asked for, the table leg bring, once each.

    Every variant of a question is searched; a chunk's score is the best of them. Filters are the question's own. dense, if
    given, has (query_id, chunk_id, dense) and is filtered alike; legs tell which searches brought a chunk.
    """
    n = retrieval.pool_size(config.top_k, True)
    if dense is None:
        both = _best_lexical(asked, _known(chunks, as_of), n, list(config.tables)).withColumn("dense", F.lit(None).cast("double"))
    else:
        both = _best_of_both(asked, chunks, n, config, as_of, dense)
    pool = both.groupBy("query_id", "chunk_id").agg(F.max("dense").alias("dense"), F.max("sparse").alias("sparse"), F.array_sort(F.collect_set("leg")).alias("legs"))
    return retrieval.rank(retrieval.fuse_weighted(pool), "hybrid", "chunk_id")


def facts_for(asked: DataFrame, facts: DataFrame, config: AnswerConfig = AnswerConfig(), as_of: Column | None = None) -> DataFrame:
    """(query_id, ticker, concept, value, filed_at): the newest facts of the companies of questions that are routed to facts.

    A company's newest facts are taken before questions meet them, so no question meets all of a company's.
    """
    routed = asked.where(F.array_contains("routes", "financial_facts")).select("query_id", F.explode("tickers").alias("ticker"))
    order = [F.desc("filed_at"), F.asc("concept"), F.asc("ticker"), F.desc("value")]
    newest = _known(facts, as_of).select("ticker", "concept", "value", "filed_at").where("ticker is not null")
    newest = newest.withColumn("n_", F.row_number().over(Window.partitionBy("ticker").orderBy(*order))).where(F.col("n_") <= config.max_facts).drop("n_")
    w = Window.partitionBy("query_id").orderBy(*order)
    return routed.join(newest, "ticker").withColumn("n_", F.row_number().over(w)).where(F.col("n_") <= config.max_facts).select("query_id", "ticker", "concept", "value", "filed_at")


def answer(questions: DataFrame, chunks: DataFrame, companies: DataFrame, facts: DataFrame, config: AnswerConfig = AnswerConfig(), as_of: Column | None = None, dense: DataFrame | None = None, generated: DataFrame | None = None) -> DataFrame:
    """One row a question: query_id, routes, tickers, abstained, reason, answer, citations, n_evidence, n_tables, n_facts, confidence, errors.

    chunks: chunk_id, text, element_type, ticker, form_type, filing_date, available_at; companies: ticker, name; facts: ticker, concept, value,
    filed_at, available_at. Claims are sentences of the evidence, or `generated` (query_id, claim_no, claim, chunk_ids). A question
    whose gate fails, that has no claim, or of which a citation isn't in its evidence or doesn't bear out the claim, is abstained from, with no answer.
    """
    asked = kept(prepared(questions, chunks, companies, as_of), "asked")  # each of the kept has several readers
    pool = candidates(asked, chunks, config, as_of, dense).where(F.col("rank") <= config.top_k)
    said = pool.join(chunks.select("chunk_id", "text", "element_type"), "chunk_id").join(questions, "query_id")
    ranked = retrieval.score_floor(retrieval.rerank_lexical(said, "chunk_id", "text", config.top_k), config.min_rerank)
    evidence = kept(ranked.select("query_id", "query", "chunk_id", "text", "element_type", "legs", F.col("final_rank").alias("rank"), "rerank"), "evidence")
    found = kept(facts_for(asked, facts, config, as_of), "facts")
    graded = evidence.select("query_id", F.col("rerank").alias("score"), F.lit(False).alias("is_fact")).unionByName(found.select("query_id", F.lit(None).cast("double").alias("score"), F.lit(True).alias("is_fact")))
    gate = answers.evidence_gate(questions, graded, config.min_evidence, config.min_score)
    passed = gate.where("reason is null").select("query_id")
    held = evidence.join(passed, "query_id", "left_semi")
    if generated is None:
        claims = answers.extractive_claims(held).select("query_id", "claim_no", "claim", F.array("chunk_id").alias("chunk_ids"))
    else:
        claims = generated.join(passed, "query_id", "left_semi")
    checks = answers.verify_citations(claims, held, config.min_overlap)
    checked = checks.groupBy("query_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("error").isNotNull(), F.concat_ws(" ", "error", F.col("chunk_id").cast("string"))))).alias("errors"), F.array_sort(F.collect_set("chunk_id")).alias("citations"), F.avg("overlap").alias("overlap"),
    )
    text = claims.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_no", "claim"))), lambda c: c["claim"]), " ").alias("answer"))
    counts = evidence.groupBy("query_id").agg(F.count("*").alias("n_evidence"), F.count_if(F.array_contains("legs", "table")).alias("n_tables"), F.max("rerank").alias("top"))
    n_facts = found.groupBy("query_id").agg(F.count("*").alias("n_facts"))
    rows = asked.select("query_id", "routes", "tickers")
    for part in (gate, counts, n_facts, checked, text):
        rows = rows.join(part, "query_id", "left")
    failed = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("citations").isNull() | (F.size("citations") == 0), "no_claim").when(F.size("errors") > 0, "citation_failed")
    rows = rows.withColumn("reason", failed).withColumn("abstained", F.col("reason").isNotNull())
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    kind = f"array<{dict(chunks.dtypes)['chunk_id']}>"
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select(
        "query_id", "routes", "tickers", "abstained", "reason", F.when(~F.col("abstained"), F.col("answer")).alias("answer"), F.when(F.col("abstained"), F.array().cast(kind)).otherwise(none("citations", kind)).alias("citations"),
        zero("n_evidence"), zero("n_tables"), zero("n_facts"), F.when(~F.col("abstained"), retrieval.grounding_confidence(F.col("top"), F.col("overlap"))).alias("confidence"), none("errors", "array<string>").alias("errors"),
    )
