"""Corpus summaries and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.operators.passages import CHUNK_WORDS, text_chunks

EXPECTED_FORMS = ("10-K", "10-Q")
STALE_DAYS, LAST_RUNS, LISTED = 150, 20, 100
HIDDEN = ("EXMPL",)


def summary_chain(parents: DataFrame, parent: str, children: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """parents with a count for each level of a chain of left joins.

    children: (table, key, link to the level above, name). Each level is counted by its link first, bottom up, so
    that nothing fans out: a level's counts are summed into the one above.
    """
    below: DataFrame | None = None
    names: list[str] = []
    for table, key, link, name in reversed(children):
        rows = table.select(key, link)
        if below is not None:
            rows = rows.join(below, rows[key] == below["link_"], "left").drop("link_")
        below = rows.groupBy(F.col(link).alias("link_")).agg(F.count(key).alias(name), *[F.sum(F.coalesce(n, F.lit(0))).alias(n) for n in names])
        names.append(name)
    out = parents.join(below, parents[parent] == below["link_"], "left").drop("link_")
    return out.withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in names})


def latest_availability(companies: DataFrame, filings: DataFrame, company: str, available: str = "available_at") -> DataFrame:
    return companies.join(filings.groupBy(company).agg(F.max(available).alias("latest_available")), company, "left")


def stale(latest: DataFrame, today: str, days: int = STALE_DAYS, at: str = "latest_available") -> DataFrame:
    return latest.where(F.col(at).isNull() | (F.col(at) < F.date_sub(F.lit(today).cast("date"), days)))


def missing_forms(filings: DataFrame, company: str, form: str = "form_type", expected: tuple[str, ...] = EXPECTED_FORMS) -> DataFrame:
    """(company, form) that a company should have and hasn't: the expected forms are a literal beside each company."""
    wanted = filings.select(company).distinct().select(company, F.explode(F.array(*[F.lit(f) for f in expected])).alias(form))
    return wanted.join(filings.select(company, form).distinct(), [company, form], "left_anti")


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def childless(parents: DataFrame, key: str, children: DataFrame, link: str) -> DataFrame:
    """Parents without a child."""
    return parents.join(children.select(F.col(link).alias(key)), key, "left_anti")


def missing_embeddings(chunks: DataFrame, embeddings: DataFrame, provider: str, model: str, dimensions: int) -> DataFrame:
    """Chunks without a vector of this provider, model and dimension."""
    have = embeddings.where((F.col("provider") == provider) & (F.col("model") == model) & (F.col("dimensions") == dimensions)).select(F.col("chunk_id").alias("id"))
    return chunks.join(have, "id", "left_anti")


def unchunked_reasons(documents: DataFrame, elements: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, n_elements, reason) of documents without chunks."""
    bare = childless(documents, "id", chunks, "document_id").select("id", "local_path", "sha256_hash")
    n = elements.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n_elements"))
    rows = bare.join(n, "id", "left").withColumn("n_elements", F.coalesce("n_elements", F.lit(0)))
    reason = F.when(F.col("n_elements") > 0, "not_chunked").when(F.col("local_path").isNull(), "missing_local_path").when(F.col("sha256_hash").isNull(), "not_downloaded").otherwise("no_elements")
    return rows.select("id", "n_elements", reason.alias("reason"))


def run_health(runs: DataFrame, last: int = LAST_RUNS) -> DataFrame:
    """One row: runs, success_rate of the last runs that ended (null without any)."""
    newest = runs.where("completed_at is not null").orderBy(F.desc("started_at"), F.desc("run_key")).limit(last)
    return newest.agg(F.count("*").alias("runs"), F.avg((F.col("status") == "completed").cast("double")).alias("success_rate"))


def stale_runs(runs: DataFrame, cutoff: str, note: str) -> DataFrame:
    """Runs marked failed, with a note, that began before the cutoff and never ended; others unchanged."""
    old = (F.col("status") == "running") & F.col("completed_at").isNull() & (F.col("started_at") < F.lit(cutoff).cast("timestamp"))
    return runs.withColumns({"failures": F.when(old, F.concat(F.coalesce("failures", F.array().cast("array<string>")), F.array(F.lit(note)))).otherwise(F.col("failures")), "status": F.when(old, "failed").otherwise(F.col("status"))})


def share(part: Column, whole: Column) -> Column:
    """part / whole; one if there is nothing to cover."""
    return F.when(whole == 0, F.lit(1.0)).otherwise(F.try_divide(part.cast("double"), whole.cast("double")))


def universe(summary: DataFrame, key: str, count: str, least: int, limit: int | None = None) -> DataFrame:
    """Keys with at least `least` rows, the largest first."""
    out = summary.where(F.col(count) >= least).orderBy(F.desc(count), F.asc(key))
    return out.limit(limit) if limit else out


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page in a total order, and the number of all rows, counted before paging."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def search_universe(df: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(c).contains(needle.lower())
    return df.where(hit)


def histogram(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(by))


def exchange_totals(companies: DataFrame) -> DataFrame:
    """One row: companies, those of either exchange (whatever the letters' case), documents and chunks."""
    on = lambda name: F.count_if(F.contains(F.upper("exchange"), F.lit(name)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return companies.agg(F.count("*").alias("companies"), F.count_if(F.upper("exchange") == "NYSE").alias("nyse"), on("NASDAQ").alias("nasdaq"), total("documents"), total("chunks"))


def unchunked(elements: DataFrame, chunks: DataFrame, force: bool = False, key: str = "document_id") -> DataFrame:
    """The elements whose documents have no chunks yet, or all of them if forced: what a chunking run has to read."""
    return elements if force else elements.join(chunks.select(key), key, "left_anti")


def rechunk(documents: DataFrame, elements: DataFrame, chunks: DataFrame, reasons: tuple[str, ...] = ("not_chunked",), size: int = CHUNK_WORDS) -> DataFrame:
    """(document_id, reading_order, chunk_index, chunk_text, token_count) for documents that lack chunks for one of the reasons."""
    due = unchunked_reasons(documents, elements, chunks).where(F.col("reason").isin(*reasons)).select(F.col("id").alias("document_id"))
    return text_chunks(elements.join(due, "document_id", "left_semi"), ["document_id", "reading_order"], "text", size)


def snapshot_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(all_facts, canonical_facts) counted after, and how much they grew."""
    counts = lambda df, p: df.agg(F.count("*").alias(f"{p}all"), F.count("canonical_metric").alias(f"{p}canonical"))
    return counts(before, "b_").join(F.broadcast(counts(after, "a_"))).select(F.col("a_all").alias("all_facts"), F.col("a_canonical").alias("canonical_facts"), (F.col("a_all") - F.col("b_all")).alias("new_facts"), (F.col("a_canonical") - F.col("b_canonical")).alias("new_canonical"))


def merge_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(action, n): keys of new that are created or updated."""
    seen = new.select(*keys).distinct().join(old.select(*keys, F.lit(1).alias("had_")).distinct(), keys, "left")
    return seen.groupBy(F.when(F.col("had_").isNull(), "created").otherwise("updated").alias("action")).agg(F.count("*").alias("n"))


def newest_distinct(experiments: DataFrame, limit: int, keys: list[str]) -> DataFrame:
    """Published studies: of the newest 4 limit rows the one with most events of each key (newer on ties), newest first, `limit` of them."""
    pool = experiments.orderBy(F.desc("created_at"), F.desc("experiment_key")).limit(4 * limit)
    w = Window.partitionBy(*keys).orderBy(F.desc("event_count"), F.desc("created_at"), F.desc("experiment_key"))
    return pool.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_").orderBy(F.desc("created_at"), F.desc("experiment_key")).limit(limit)


def prune(experiments: DataFrame, keys: list[str]) -> DataFrame:
    """All rows, with keep: whether it is the key's one with most events, newer on ties."""
    w = Window.partitionBy(*keys).orderBy(F.desc("event_count"), F.desc("created_at"), F.desc("experiment_key"))
    return experiments.withColumn("keep", F.row_number().over(w) == 1)


def cascade(parents: DataFrame, deleted: DataFrame, key: str, children: DataFrame, link: str, history: DataFrame, history_link: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the deleted parents: parents, children without theirs, history with their links set to null."""
    gone = deleted.select(key).distinct()
    kept = parents.join(gone, key, "left_anti")
    child = children.join(gone.withColumnRenamed(key, link), link, "left_anti")
    mark = gone.select(F.col(key).alias("gone_"))
    past = history.join(mark, F.col(history_link) == F.col("gone_"), "left").withColumn(history_link, F.when(F.col("gone_").isNull(), F.col(history_link))).drop("gone_")
    return kept, child, past


def backfill_availability(documents: DataFrame) -> DataFrame:
    """documents with accepted_at, available_at and is_amendment derived where missing: acceptance, else the filing date's midnight UTC."""
    accepted = F.coalesce(F.col("accepted_at"), F.try_to_timestamp(F.get_json_object("metadata_json", "$.acceptanceDateTime")))
    return documents.withColumn("accepted_at", accepted).withColumns({"available_at": F.coalesce(F.col("available_at"), F.col("accepted_at"), F.col("filing_date").cast("timestamp")), "is_amendment": F.coalesce(F.col("is_amendment"), F.endswith(F.upper("form_type"), F.lit("/A")))})
