"""Chunks, fingerprints, panel features and passage-level differences."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from quillstone.functions import text as X
from quillstone.functions.numbers import groups_of, ratio

CHUNK_WORDS = 220
UNSECTIONED = "Unsectioned"


def text_chunks(elements: DataFrame, keys: list[str], text: str, size: int = CHUNK_WORDS) -> DataFrame:
    """(keys, chunk_index, chunk_text, token_count): each element's words in groups of `size`; chunks never cross elements."""
    parts = F.posexplode(groups_of(X.words(F.col(text)), size)).alias("chunk_index", "words_")
    return elements.select(*keys, parts).select(*keys, "chunk_index", F.array_join("words_", " ").alias("chunk_text"), F.size("words_").alias("token_count"))


def table_chunks(tables: DataFrame, keys: list[str], markdown: str, headers: str, rows: str, columns: str, section: str) -> DataFrame:
    """Two chunks a table: its markdown, and a summary of its shape and headers."""
    summary = F.concat_ws(" ", F.concat(F.lit("Table in "), F.coalesce(section, F.lit(UNSECTIONED)), F.lit(".")), F.concat(F.lit("Rows: "), F.col(rows).cast("string"), F.lit(".")), F.concat(F.lit("Columns: "), F.array_join(F.coalesce(headers, F.array()), ", "), F.lit(".")))
    both = F.posexplode(F.array(F.struct(F.lit("table_markdown").alias("chunk_type"), F.col(markdown).alias("chunk_text")), F.struct(F.lit("table_summary").alias("chunk_type"), summary.alias("chunk_text")))).alias("chunk_index", "c_")
    return tables.where(F.trim(F.coalesce(markdown, F.lit(""))) != "").select(*keys, both).select(*keys, "chunk_index", "c_.chunk_type", "c_.chunk_text")


def distinct_chunks(chunks: DataFrame, document: str, order: list[str], text: str = "chunk_text") -> DataFrame:
    """The first chunk of each normalised text in a document; nulls in `order` last."""
    w = Window.partitionBy(document, X.fingerprint(F.col(text))).orderBy(*[F.asc_nulls_last(c) for c in order])
    return chunks.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, reading_order, passage) of a text's non-blank lines; positions count all lines."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("reading_order", "passage")).where(F.trim("passage") != "")


def section_prints(passages: DataFrame, document: str, section: str, text: str) -> DataFrame:
    """(document, section, prints): the distinct fingerprints of each section; a null section is Unsectioned."""
    return passages.groupBy(F.col(document), F.coalesce(section, F.lit(UNSECTIONED)).alias("section")).agg(F.collect_set(X.fingerprint(F.col(text))).alias("prints"))


def document_similarity(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """pairs (id, prior_id) with similarity: Jaccard of all fingerprints; null without a prior or prints. prints has (id, prints)."""
    a, b = prints.select(F.col("id"), F.col("prints").alias("now_")), prints.select(F.col("id").alias("prior_id"), F.col("prints").alias("old_"))
    joined = pairs.join(a, "id", "left").join(b, "prior_id", "left")
    value = ratio(F.size(F.array_intersect("now_", "old_")), F.size(F.array_union("now_", "old_")))
    return joined.withColumn("similarity", F.when(F.col("prior_id").isNotNull(), value)).drop("now_", "old_")


def section_changes(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """(id, section, added, removed, novelty) for sections of a filing or of its prior; prints by (id, section)."""
    now = pairs.where("prior_id is not null").join(prints, "id").select("id", "section", F.col("prints").alias("now_"))
    old = pairs.join(prints.withColumnRenamed("id", "prior_id"), "prior_id").select("id", "section", F.col("prints").alias("old_"))
    both = now.join(old, ["id", "section"], "full")
    a, b = F.coalesce("now_", F.array().cast("array<string>")), F.coalesce("old_", F.array().cast("array<string>"))
    novelty = 1 - F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)).cast("double")
    return both.select("id", "section", F.size(F.array_except(a, b)).alias("added"), F.size(F.array_except(b, a)).alias("removed"), F.when(F.size(a) > 0, novelty).alias("novelty"))


def length_features(elements: DataFrame, document: str, text: str, kind: str) -> DataFrame:
    """(document, n_tokens, n_chars, table_density, numeric_density): densities are shares of elements and characters."""
    digits = F.regexp_count(F.col(text), F.lit(r"[0-9]"))
    return elements.groupBy(document).agg(
        F.sum(F.size(X.words(F.col(text)))).alias("n_tokens"), F.sum(F.length(text)).alias("n_chars"), F.avg((F.col(kind) == "table").cast("double")).alias("table_density"), (F.sum(digits) / F.greatest(F.sum(F.length(text)), F.lit(1))).alias("numeric_density"),
    )


def snapshot_id(docs: DataFrame, order: list[str], accession: str, digest: Column) -> DataFrame:
    """One row: the first 16 hex digits of the SHA-256 of accession:digest pairs joined by | in order. The list is the query's limited page."""
    entry = F.struct(*order, F.concat_ws(":", accession, digest).alias("entry"))
    return docs.agg(F.substring(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["entry"]), "|").cast("binary"), 256), 1, 16).alias("snapshot_id"))


def snapshot_tree(docs: DataFrame, key: str, digest: Column) -> DataFrame:
    """(snapshot_id, documents): the SHA-256 of a corpus of any size, the same however its rows are dealt.

    Entries key:digest are joined by | in order within ranges of the key's SHA-256 (its first six hex digits, 16 million ranges), the ranges'
    digests within their first three digits, and those 4,096 at last. So a task joins a small share of the corpus, and the last list has 4,096.
    """
    joined = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda e: e["entry"]), "|").cast("binary"), 256)
    rows = docs.select(F.sha2(F.col(key).cast("string").cast("binary"), 256).alias("h"), F.concat_ws(":", key, digest).alias("entry"))
    ranges = rows.groupBy(F.substring("h", 1, 6).alias("at")).agg(joined(F.struct("entry")).alias("entry"), F.count("*").alias("n"))
    upper = ranges.groupBy(F.substring("at", 1, 3).alias("up")).agg(joined(F.struct("at", "entry")).alias("entry"), F.sum("n").alias("n"))
    return upper.agg(joined(F.struct("up", "entry")).alias("snapshot_id"), F.coalesce(F.sum("n"), F.lit(0)).alias("documents"))


def diff_passages(now: list[str], old: list[str]) -> list[tuple[str, str | None, str | None]]:
    """(change, now, old): replaced passages in pairs are materially_changed; the rest is added or removed."""
    out: list[tuple[str, str | None, str | None]] = []
    for op, a0, a1, b0, b1 in difflib.SequenceMatcher(None, old, now, autojunk=False).get_opcodes():
        paired = min(a1 - a0, b1 - b0) if op == "replace" else 0
        out += [("materially_changed", now[b0 + i], old[a0 + i]) for i in range(paired)]
        if op != "equal":
            out += [("removed", None, x) for x in old[a0 + paired : a1]] + [("added", x, None) for x in now[b0 + paired : b1]]
    return out


@F.pandas_udf(DoubleType())
def character_ratio(old: pd.Series, now: pd.Series) -> pd.Series:
    """difflib's ratio of both texts, whose time grows with their product; null where one is missing."""
    return pd.Series([None if a is None or b is None else difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(old, now, strict=True)], dtype=float)


def filing_diff(pairs: DataFrame, passages: DataFrame) -> DataFrame:
    """(id, section, change, now, old, similarity) for each pair (id, prior_id); passages has id, section, reading_order, text.

    Sections whose fingerprints agree in order never reach Python; the others meet their prior one section at a time. similarity, the
    character ratio of a changed passage, is a column of its own, so that who doesn't read it doesn't have it computed.
    """
    p = passages.withColumn("section", F.coalesce("section", F.lit(UNSECTIONED)))
    seq = p.groupBy("id", "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", X.collapse(F.col("text")).alias("t")))), lambda s: s["t"]).alias("texts"))
    known = pairs.where("prior_id is not null")
    now = known.join(seq, "id").select("id", "section", F.col("texts").alias("now_"))
    old = known.join(seq.withColumnRenamed("id", "prior_id"), "prior_id").select("id", "section", F.col("texts").alias("old_"))
    changed = now.join(old, ["id", "section"], "full").where(~F.col("now_").eqNullSafe(F.col("old_")))

    def run(batches):
        for pdf in batches:
            rows = [(i, s, *c) for i, s, a, b in zip(pdf["id"], pdf["section"], pdf["now_"], pdf["old_"], strict=True) for c in diff_passages(list(a) if a is not None else [], list(b) if b is not None else [])]
            yield pd.DataFrame(rows, columns=["id", "section", "change", "now", "old"])

    changes = changed.mapInPandas(run, f"id {dict(pairs.dtypes)['id']}, section string, change string, now string, old string")
    return changes.withColumn("similarity", F.when(F.col("change") == "materially_changed", character_ratio("old", "now")))


def diff_counts(diff: DataFrame) -> DataFrame:
    kinds = ("added", "removed", "materially_changed")
    return diff.groupBy("id").agg(*[F.count_if(F.col("change") == k).alias(k) for k in kinds])
