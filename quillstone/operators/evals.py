"""Retrieval evaluation: labels of ranked candidates, metrics by question, reports by variant."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

CATEGORIES = ("narrative", "table", "comparison", "temporal", "entity", "risk", "legal", "abstention")


def label_candidates(ranked: DataFrame, references: DataFrame) -> DataFrame:
    """ranked (question_id, rank, accession, section, text) with label: the first reference of its accession whose section
    agrees or is missing and whose quote its text holds; else a label of its own."""
    r = references.select(F.col("question_id").alias("q_"), F.col("accession").alias("a_"), F.col("section").alias("s_"), F.col("quote").alias("quote_"), F.col("position").alias("at_"), F.col("label").alias("label_"))
    fits = (F.col("question_id") == F.col("q_")) & (F.col("accession") == F.col("a_")) & (F.col("section").isNull() | F.col("s_").isNull() | (F.col("section") == F.col("s_"))) & F.contains(F.lower("text"), F.lower("quote_"))
    met = ranked.join(r, fits).groupBy("question_id", "rank").agg(F.min_by("label_", "at_").alias("label"))
    return ranked.join(met, ["question_id", "rank"], "left").withColumn("label", F.coalesce("label", F.concat_ws(":", F.lit("unmatched"), F.col("accession"), F.col("rank").cast("string"))))


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(question_id, recall, precision, rr, ndcg) from ranked (question_id, rank, label) and relevant (question_id, label).

    Recall and precision count distinct labels in the first k; rr looks at the whole list; gains aren't de-duplicated, so
    nDCG may exceed 1. Questions without relevant labels have 0.
    """
    want = relevant.distinct().withColumn("rel_", F.lit(1))
    hits = ranked.join(want, ["question_id", "label"], "left").withColumn("hit_", F.col("rel_").isNotNull())
    top = F.col("hit_") & (F.col("rank") <= k)
    per = hits.groupBy("question_id").agg(F.countDistinct(F.when(top, F.col("label"))).alias("found"), F.min(F.when(F.col("hit_"), F.col("rank"))).alias("first"), F.sum(F.when(top, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"))
    sizes = relevant.distinct().groupBy("question_id").agg(F.count("*").alias("n"))
    best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    rows = per.join(sizes, "question_id", "full")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select("question_id", zero(F.col("found") / F.col("n")).alias("recall"), zero(F.col("found") / F.lit(float(k))).alias("precision"), zero(1.0 / F.col("first")).alias("rr"), zero(F.col("dcg") / best).alias("ndcg"))


def macro_f1(df: DataFrame, truth: Column, guess: Column, keys: list[str] | None = None) -> DataFrame:
    """(keys, precision, recall, macro_f1) of a binary label; the mean of both classes' F1; 0 where undefined."""
    tp, fp, fn, tn = F.count_if(truth & guess), F.count_if(~truth & guess), F.count_if(truth & ~guess), F.count_if(~truth & ~guess)
    rows = df.groupBy(*(keys or [])).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    safe = lambda a, b: F.coalesce(F.try_divide(F.lit(1.0) * a, F.lit(1.0) * b), F.lit(0.0))
    f1 = lambda t, a, b: safe(2 * F.col(t), 2 * F.col(t) + F.col(a) + F.col(b))
    return rows.select(*(keys or []), safe(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), safe(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ((f1("tp", "fp", "fn") + f1("tn", "fn", "fp")) / 2).alias("macro_f1"))


def nearest_rank(df: DataFrame, value: str, share: float, keys: list[str]) -> DataFrame:
    """(keys, at): the value at the rounded-up rank of a share."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("rn_", F.row_number().over(w.orderBy(value))).withColumn("n_", F.count("*").over(w))
    return rows.where(F.col("rn_") == F.greatest(F.lit(1), F.ceil(F.col("n_") * share))).select(*keys, F.col(value).alias("at"))


def _met(got: str, want: str) -> Column:
    """1 if the question expects nothing or one of what it expects was returned, else 0."""
    return ((F.size(want) == 0) | F.arrays_overlap(got, want)).cast("double")


def variant_report(questions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """A row a variant with the 17 fields of an evaluation: name, means over its questions, latencies, mean cost and their number.

    questions: question_id, category, expected_sections, expected_tickers, labels (of the relevant evidence), should_abstain.
    outcomes: variant, question_id, recall, precision, rr, ndcg, sections and tickers (of the first k results), citations
    (labels), abstained, inferred_tickers, latency_ms, cost. Array columns aren't null and hold no nulls.

    Citations are judged as sets; without citations precision is 1 where the question is to be abstained from, else 0.
    """
    rows = outcomes.join(questions, "question_id")
    cited, wanted = F.array_distinct("citations"), F.array_distinct("labels")
    precise = F.when(F.size(cited) > 0, F.size(F.array_intersect(cited, wanted)) / F.size(cited)).otherwise(F.col("should_abstain").cast("double"))
    same = (F.array_sort(F.array_distinct("inferred_tickers")) == F.array_sort(F.array_distinct("expected_tickers"))).cast("double")
    means = rows.groupBy("variant").agg(
        *[F.avg(m).alias(m) for m in ("recall", "precision", "rr", "ndcg")], F.avg(_met("sections", "expected_sections")).alias("section_hit_rate"), F.avg(_met("tickers", "expected_tickers")).alias("ticker_accuracy"),
        F.coalesce(F.avg(F.when(F.col("category") == "table", F.col("recall"))), F.lit(0.0)).alias("table_recall"), F.avg(precise).alias("citation_precision"), F.avg(same).alias("entity_accuracy"),
        F.median("latency_ms").alias("latency_p50"), F.avg("cost").alias("mean_cost"), F.count("*").alias("questions"),
    )
    held = macro_f1(rows, F.col("should_abstain"), F.col("abstained"), ["variant"]).withColumnsRenamed({"precision": "abstention_precision", "recall": "abstention_recall", "macro_f1": "abstention_f1"})
    return means.join(held, "variant").join(nearest_rank(rows, "latency_ms", 0.95, ["variant"]).withColumnRenamed("at", "latency_p95"), "variant")


def answer_rates(questions: DataFrame, answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: answer_rate, on_target, grounding, abstention_rate, mean_confidence.

    questions: question_id, expected_sections, expected_tickers. answers, one a question: question_id, abstained, cited (chunk
    ids; null if there is no claim), confidence. evidence: question_id, chunk_id, section, ticker. An answer is grounded if it
    cites something and nothing outside the evidence, and on target if it cites evidence of an expected ticker and, where
    sections are expected, section. Grounding is a share of the answers, the other rates of all questions.
    """
    told = answers.where(~F.col("abstained") & F.col("cited").isNotNull())
    held = evidence.select("question_id", "chunk_id", "section", "ticker", F.lit(True).alias("in_"))
    cites = told.select("question_id", F.explode("cited").alias("chunk_id")).join(held, ["question_id", "chunk_id"], "left").join(questions, "question_id")
    fits = F.array_contains("expected_tickers", F.col("ticker")) & ((F.size("expected_sections") == 0) | F.array_contains("expected_sections", F.col("section")))
    judged = cites.groupBy("question_id").agg(F.bool_and(F.col("in_").isNotNull()).alias("grounded_"), F.bool_or(F.coalesce(fits, F.lit(False))).alias("fits_"))
    rows = questions.select("question_id").join(answers, "question_id", "left").join(judged, "question_id", "left")
    answered = F.coalesce(~F.col("abstained") & F.col("cited").isNotNull(), F.lit(False))
    n, sure = F.count("*"), F.count_if(answered)
    return rows.agg(
        F.try_divide(sure, n).alias("answer_rate"), F.try_divide(F.count_if(answered & F.col("fits_")), n).alias("on_target"), (F.count_if(answered & F.col("grounded_")) / F.greatest(sure, F.lit(1))).alias("grounding"),
        F.try_divide(F.count_if("abstained"), n).alias("abstention_rate"), F.coalesce(F.avg(F.when(answered, F.col("confidence"))), F.lit(0.0)).alias("mean_confidence"),
    )


def context_recall(evidence: DataFrame, references: DataFrame) -> DataFrame:
    """One row: the share of questions with an evidence text that holds one of their quotes."""
    hit = references.join(evidence, "question_id").where(F.contains(F.lower("text"), F.lower("quote"))).select("question_id").distinct().withColumn("hit_", F.lit(1.0))
    return references.select("question_id").distinct().join(hit, "question_id", "left").agg(F.avg(F.coalesce("hit_", F.lit(0.0))).alias("context_recall"))


def ann_recall(exact: DataFrame, found: DataFrame, key: str, k: int) -> DataFrame:
    """(query_id, recall) of found against exact top k lists."""
    both = exact.select("query_id", key).join(found.select("query_id", key), ["query_id", key], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    return exact.select("query_id").distinct().join(both, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) / F.lit(float(k))).alias("recall"))


def contract(questions: DataFrame, splits: dict[str, int], categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """(rule, ok, detail): size, splits, duplicate ids, categories and labels of a benchmark."""
    n = questions.agg(F.count("*").alias("n"), F.countDistinct("question_id").alias("ids"), *[F.count_if(F.col("split") == s).alias(f"s{i}") for i, s in enumerate(splits)], F.collect_set("category").alias("seen"), F.count_if(~F.col("should_abstain") & (F.size("labels") <= 0)).alias("bare"))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(c) for c in categories]), "seen"))
    rules = [("rows", F.col("n") == sum(splits.values()), F.col("n").cast("string")), ("unique_ids", F.col("n") == F.col("ids"), (F.col("n") - F.col("ids")).cast("string")), ("categories", F.size(missing) == 0, F.array_join(missing, ",")), ("labels", F.col("bare") == 0, F.col("bare").cast("string"))]
    rules += [(f"split_{s}", F.col(f"s{i}") == c, F.col(f"s{i}").cast("string")) for i, (s, c) in enumerate(splits.items())]
    return n.select(F.explode(F.array(*[F.struct(F.lit(a).alias("rule"), b.alias("ok"), c.alias("detail")) for a, b, c in rules])).alias("r")).select("r.*")


def _finder(listed: list[tuple], kind: pa.DataType, names: list[str], at_once: int = 50):
    """A map over batches of (key, text) to (key, item), called `names`, for listed (item of that kind, quote)."""
    groups = [listed[i : i + at_once] for i in range(0, len(listed), at_once)]
    quoted = lambda q: re.sub(r"([^0-9A-Za-z_\x80-\U0010ffff])", lambda m: r"\x00" if m[1] == "\0" else "\\" + m[1], q)
    any_of = ["|".join(quoted(q) for _, q in g) for g in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, pattern in zip(groups, any_of, strict=True):
                some = batch.filter(pc.match_substring_regex(batch.column(1), pattern))
                for item, quote in group if some.num_rows else ():
                    keys = some.column(0).filter(pc.match_substring(some.column(1), quote))
                    if len(keys):
                        yield pa.RecordBatch.from_arrays([keys, pa.array([item] * len(keys), kind)], names=names)

    return run


def holding(docs: DataFrame, key: str, quotes: DataFrame, item: str, text: str = "text", quote: str = "quote", run: int = 5, most_short: int = 1_000) -> DataFrame:
    """(key, item) of documents that hold a quote verbatim.

    Up to `most_short` quotes go along as a list: a text is searched once for each fifty of them, as alternatives of one expression
    in linear time, and what matches is compared with each. Nothing is shuffled. For more quotes:

    Whole words from inside a quote are whole words of a text that holds it. So runs of up to `run` inner words meet by
    equality first, and the substring is verified after. Quotes without an inner word (one or two words) can't be looked up
    that way; they are compared with every text, as literal lists of `most_short` each.
    """
    kind = dict(quotes.dtypes)[item]
    listed = [(r[0], r[1]) for r in quotes.where(F.col(quote).isNotNull()).select(item, quote).limit(most_short + 1).collect()]
    if len(listed) <= most_short:
        rows = docs.where(F.col(text).isNotNull()).select(key, text)
        return rows.mapInArrow(_finder(listed, to_arrow_type(quotes.schema[item].dataType), [key, item]), T.StructType([rows.schema[key], quotes.schema[item]]))
    w = F.filter(F.split(F.col(quote), r"\s+"), lambda x: x != "")
    q = quotes.where(F.col(quote).isNotNull()).select(item, F.col(quote).alias("q_"), w.alias("w_")).withColumn("n_", F.least(F.lit(run), F.size("w_") - 2))
    keyed = q.where("n_ >= 1").select(item, "q_", "n_", F.xxhash64(F.array_join(F.expr("slice(w_, 2, n_)"), " ")).alias("h_"))
    lengths = [r["n_"] for r in keyed.select("n_").distinct().collect()]
    d = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("t_"), F.filter(F.split(text, r"\s+"), lambda x: x != "").alias("tw_"))
    runs = F.array_distinct(F.flatten(F.array(*[F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("tw_"))), lambda i: i + n - 1 <= F.size("tw_")), lambda i: F.struct(F.lit(n).alias("n_"), F.xxhash64(F.array_join(F.slice("tw_", i, n), " ")).alias("h_"))) for n in lengths or [run]])))
    met = d.select(key, F.explode(runs).alias("r_")).select(key, "r_.*").join(keyed, ["n_", "h_"]).select(key, item, "q_").distinct()
    long = met.join(d.select(key, "t_"), key).where(F.contains("t_", "q_")).select(key, item)
    short, out = q.where("n_ < 1").select(item, "q_").collect(), long
    for i in range(0, len(short), most_short):
        listed = F.array(*[F.struct(F.lit(r[item]).cast(kind).alias(item), F.lit(r["q_"]).alias("q_")) for r in short[i : i + most_short]])
        out = out.unionByName(d.select(key, F.explode(F.filter(listed, lambda s: F.contains(F.col("t_"), s["q_"]))).alias("s_")).select(key, f"s_.{item}"))
    return out


def reground(references: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, accession, chunk_id, found): the first chunk by id of the accession that holds the quote, else its first chunk; null without chunks."""
    rows = references.join(chunks.select(F.col("accession").alias("a_"), F.col("id").alias("c_"), F.col("text").alias("t_")), F.col("accession") == F.col("a_"), "left")
    hit = F.contains(F.lower("t_"), F.lower("quote"))
    out = rows.groupBy("question_id", "accession").agg(F.min(F.when(hit, F.col("c_"))).alias("hit_"), F.min("c_").alias("first_"))
    return out.select("question_id", "accession", F.coalesce("hit_", "first_").alias("chunk_id"), F.col("hit_").isNotNull().alias("found"))


def grounded_questions(chunks: DataFrame, templates: dict[str, str], wanted: dict[str, int], seed: int = 17) -> DataFrame:
    """(question_id, category, question, accession, quote): for each category `wanted` questions from different accessions, chosen by a seeded hash.

    chunks has id, accession, category, ticker and text; a template's {ticker} and {quote} are filled in.
    """
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string")).cast("binary"))
    one = chunks.withColumn("n_", F.row_number().over(Window.partitionBy("category", "accession").orderBy(order, "id"))).where("n_ = 1")
    most = F.try_element_at(F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv]), F.col("category"))
    kept = one.withColumn("n_", F.row_number().over(Window.partitionBy("category").orderBy(order, "id"))).where(F.col("n_") <= most)
    quote = F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 200)
    text = F.try_element_at(F.create_map(*[F.lit(x) for kv in templates.items() for x in kv]), F.col("category"))
    asked = F.replace(F.replace(text, F.lit("{ticker}"), F.col("ticker")), F.lit("{quote}"), F.substring(quote, 1, 60))
    return kept.select(question_id(F.col("category"), F.col("accession"), quote).alias("question_id"), "category", asked.alias("question"), "accession", quote.alias("quote"))


def paraphrased(questions: DataFrame, templates: tuple[str, ...]) -> DataFrame:
    """questions with question and question_id rewritten around their quote where the question starts with one of `templates`.

    questions has question_id, split, category, question, should_abstain, ticker, section, accession, quote; those to be
    abstained from and those without a quote stay as they are.
    """
    cut = F.array_join(F.slice(F.regexp_extract_all("quote", F.lit("[A-Za-z0-9%-]+"), F.lit(0)), 1, 12), " ")
    who, where = F.coalesce("ticker", F.lit("the issuer")), F.coalesce("section", F.lit("the filing"))
    asked = (
        F.when(F.col("category") == "cross_sectional", F.concat(F.lit("Which issuers discuss "), cut)).when(F.col("category") == "table", F.concat(F.lit("Where does "), who, F.lit(" report figures about "), cut))
        .when(F.col("category") == "filters", F.concat(F.lit("In "), where, F.lit(", what does "), who, F.lit(" say about "), cut)).otherwise(F.concat(F.lit("What does "), who, F.lit(" disclose about "), cut))
    )
    due = ~F.col("should_abstain") & F.col("quote").isNotNull() & F.exists(F.array(*[F.lit(t) for t in templates]), lambda t: F.startswith("question", t))
    rows = questions.withColumn("asked_", F.when(due, F.concat(asked, F.lit("?"))))
    fresh = F.concat_ws("-", "split", question_id(F.col("split"), F.col("category"), F.col("asked_"), F.col("accession")))
    return rows.withColumns({"question": F.coalesce("asked_", "question"), "question_id": F.when(F.col("asked_").isNotNull(), fresh).otherwise(F.col("question_id"))}).drop("asked_")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int, keys: list[str] | None = None) -> DataFrame:
    """n rows (of each key) in the order of a seeded hash: a random sample that reruns repeat."""
    order = [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), F.col(key)]
    if keys:
        return df.withColumn("n_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("n_") <= n).drop("n_")
    return df.orderBy(*order).limit(n)


def question_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 12)
