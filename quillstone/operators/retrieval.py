"""Lexical, dense and hybrid retrieval; every operator takes many queries at once, keyed by query_id."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillstone.functions import text as X
from quillstone.functions.vectors import bounded_cosine

RRF_K, BM25_K1, BM25_B = 60, 1.5, 0.75
#: Distinct query tokens that are literals of a plan.
MOST_TERMS = 1_000
#: Query vectors that are one literal row set; more go in blocks of this many.
QUERY_BLOCK = 256
#: Chunks and queries that meet in one task of dense_top_k(), and how many of each are multiplied at a time.
PART_ROWS, PART_QUERIES, TILE = 16_384, 4_096, 1_024
SCORES = ("dense", "sparse", "hybrid", "rerank")


def postings(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, tf), counted map-side."""
    return chunks.select(key, F.explode(X.tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def rank(df: DataFrame, score: str, key: str, query: str | list[str] = "query_id", out: str = "rank") -> DataFrame:
    """Rank by (-score, key) within the query; Spark limits groups early when the rank is filtered."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), F.asc(key))))


def top_k(df: DataFrame, score: str, key: str, k: int, query: str | list[str] = "query_id", out: str = "rank") -> DataFrame:
    return rank(df, score, key, query, out).where(F.col(out) <= k)


def query_tokens(queries: DataFrame, text: str = "query", stop: bool = False) -> DataFrame:
    """(query_id, token, n_tokens) of each query's distinct tokens, without stop words if asked."""
    terms = X.query_terms(F.col(text)) if stop else X.distinct_tokens(F.col(text))
    return queries.select("query_id", F.explode(terms).alias("token"), F.size(terms).alias("n_tokens"))


def term_counts(chunks: DataFrame, keys: list[str], text: str, tokens: DataFrame) -> DataFrame:
    """(keys, len, token, tf) of each row's tokens that are in `tokens`; len counts all of the row's tokens.

    A row is counted by itself, so nothing is shuffled. Up to MOST_TERMS wanted tokens are literals; more are joined.
    """
    wanted = tokens.select("token").distinct()
    few = [r["token"] for r in wanted.limit(MOST_TERMS + 1).collect()]
    rows = chunks.select(*keys, X.tokens(F.col(text)).alias("tokens_")).withColumn("len", F.size("tokens_"))
    if len(few) <= MOST_TERMS:
        rows = rows.withColumn("tokens_", F.filter("tokens_", lambda t: t.isin(few)))
    rows = rows.select(*keys, "len", "tokens_", F.explode(F.array_distinct("tokens_")).alias("token"))
    if len(few) > MOST_TERMS:
        rows = rows.join(wanted, "token", "left_semi")
    return rows.select(*keys, "len", "token", F.size(F.filter("tokens_", lambda t: t == F.col("token"))).cast("long").alias("tf"))


def lexical_scores(queries: DataFrame, chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(query_id, key, sparse): sum of log(1 + tf) over the query's tokens, divided by their number; only hits."""
    wanted = query_tokens(queries)
    tf = term_counts(chunks, [key], text, wanted)
    return tf.join(wanted, "token").groupBy("query_id", key).agg((F.sum(F.log1p("tf")) / F.first("n_tokens")).alias("sparse"))


def bm25_scores(queries: DataFrame, pool: DataFrame, key: str, text: str, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """(query_id, key, bm25) over a pool (query_id, key, text), or over one pool for all queries (key, text).

    Corpus statistics are the pool's; repeated query words count again. A query's own pool is scored whole, with zeros; of a pool
    for all queries only texts with one of the query's words have rows. A text is read once for its
    length and the queries' tokens; what is shuffled has a row for each of these tokens in each text.
    """
    own = ["query_id"] if "query_id" in pool.columns else []
    terms = queries.select("query_id", F.explode(X.tokens(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    stats = pool.select(*own, F.size(X.tokens(F.col(text))).alias("len")).groupBy(*own).agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    tf = term_counts(pool, [*own, key], text, terms)
    df = tf.groupBy(*own, "token").agg(F.count("*").alias("df"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weights = terms.join(df, [*own, "token"])
    weights = weights.join(stats, "query_id") if own else weights.join(F.broadcast(stats))  # one row
    weights = weights.select("query_id", "token", "times", idf.alias("idf"), "avg_len")
    norm = F.col("tf") + k1 * (1 - b + b * F.try_divide(F.col("len"), F.col("avg_len")))
    scored = tf.join(weights, [*own, "token"]).groupBy("query_id", key).agg(F.sum(F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / norm).alias("bm25"))
    if not own:
        return scored
    return pool.select("query_id", key).join(scored, ["query_id", key], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))


def dense_scores(queries: DataFrame, chunks: DataFrame, key: str, vec: str, query_vec: str = "query_vec") -> DataFrame:
    """(query_id, key, dense): cosine of each query with each chunk.

    The queries of one request are few and go along as one literal row set, more of them as several, each over all chunks.
    """
    kind = dict(queries.dtypes)["query_id"]
    rows = [(r["query_id"], [float(x) for x in r[query_vec]]) for r in queries.select("query_id", query_vec).collect()]
    out = None
    for i in range(0, max(1, len(rows)), QUERY_BLOCK):
        literal = [F.struct(F.lit(q).cast(kind).alias("query_id"), F.lit(v).cast("array<double>").alias("v")) for q, v in rows[i : i + QUERY_BLOCK]]
        asked = F.array(*literal).cast(f"array<struct<query_id: {kind}, v: array<double>>>")
        met = chunks.select("*", F.explode(asked).alias("q_"))
        scored = met.select(F.col("q_.query_id").alias("query_id"), *chunks.columns, bounded_cosine(F.col("q_.v"), F.col(vec)).alias("dense"))
        out = scored if out is None else out.unionByName(scored)
    return out


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors as rows, their norms, which are usable); zeros for those that aren't: null, with a null, of another length."""
    good = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False))
    flat = column.filter(pa.array(good)).flatten().cast(pa.float64())
    rows = flat.to_numpy(zero_copy_only=False).reshape(-1, dims).copy() if dims else np.zeros((good.sum(), 0))
    holes = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, dims).any(1) if flat.null_count else np.zeros(len(rows), bool)
    rows[holes] = 0
    out, usable = np.zeros((len(column), dims)), good.copy()
    out[good], usable[good] = rows, ~holes
    return out, np.sqrt(np.einsum("ij,ij->i", out, out)), usable


def dense_top_k(queries: DataFrame, chunks: DataFrame, key: str, vec: str, k: int, keep: tuple[str, ...] = (), query_vec: str = "query_vec", out: str = "rank") -> DataFrame:
    """(query_id, key, keep, dense, rank): each query's k chunks of the largest cosine, cut to six decimals, ties to the smaller key.

    The cosine is that of dense_scores(). Blocks of queries and parts of the chunks meet in tasks of bounded size, in which tiles are
    multiplied as matrices; a task sends on its k best a query. All pairs are compared, which is the product of both tables.
    """
    chunks = chunks.select(key, *keep, F.col(vec).cast("array<double>").alias("vec_"))
    queries = queries.select("query_id", F.col(query_vec).cast("array<double>").alias("asked_"))
    parts, blocks = max(1, -(-chunks.count() // PART_ROWS)), max(1, -(-queries.count() // PART_QUERIES))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = chunks.withColumn("part_", F.pmod(F.xxhash64(key), F.lit(parts))).withColumn("block_", each(blocks))
    right = queries.withColumn("block_", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("part_", each(parts))
    schema = T.StructType([queries.schema["query_id"], *[chunks.schema[c] for c in (key, *keep)], T.StructField("dense", T.DoubleType())])

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        rows, asked = rows.sort_by(key).combine_chunks(), asked.combine_chunks()
        vectors, wanted = rows["vec_"].combine_chunks(), asked["asked_"].combine_chunks()
        lengths, found = np.asarray(pc.fill_null(pc.list_value_length(wanted), 0)), []
        for dims in np.unique(lengths):
            own = np.flatnonzero(lengths == dims)
            x, x_norm, usable = _matrix(vectors, int(dims))
            q, q_norm, _ = _matrix(wanted.take(pa.array(own)), int(dims))
            for a in range(0, len(own), TILE):
                n = len(own[a : a + TILE])
                floor = np.full(n, -np.inf)  # the k-th best so far: later keys are greater, so ties with it lose
                best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
                for b in range(0, len(x), TILE):
                    norms = q_norm[a : a + TILE, None] * x_norm[None, b : b + TILE]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        score = q[a : a + TILE] @ x[b : b + TILE].T / norms
                    score[np.isnan(score)] = 1.0  # as least() of one and no number
                    score[norms == 0] = 0.0
                    score[:, ~usable[b : b + TILE]] = 0.0
                    score = np.floor(np.clip(score, -1, 1) * 1e6 + 0.5) / 1e6
                    if not b and score.shape[1] > k:
                        at, col = np.nonzero(score >= -np.partition(-score, k - 1, axis=1)[:, k - 1 : k])
                    else:
                        at, col = np.nonzero(score > floor[:, None])
                    best = [np.concatenate(p) for p in zip(best, (at, col + b, score[at, col]), strict=True)]
                    order = np.lexsort((best[1], -best[2], best[0]))
                    nth = np.arange(len(order)) - np.searchsorted(best[0][order], best[0][order])
                    best = [v[order][nth < k] for v in best]
                    last = nth[nth < k] == k - 1
                    floor[best[0][last]] = best[2][last]
                found.append((own[a : a + TILE][best[0]], best[1], best[2]))
        at, row, score = [np.concatenate(f) for f in zip(*found, strict=True)] if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        held = rows.take(pa.array(row))
        return pa.Table.from_arrays([asked["query_id"].take(pa.array(at)), *[held[c] for c in (key, *keep)], pa.array(score)], names=schema.names)

    best = left.groupBy("part_", "block_").cogroup(right.groupBy("part_", "block_")).applyInArrow(meet, schema)
    return top_k(best, "dense", key, k, out=out)


def pool_size(k: int, filtered: bool) -> int:
    """How many candidates each leg brings: five times k if a filter narrows them, else k; 20 at least."""
    return max(5 * k if filtered else k, 20)


def embed(rows: DataFrame, text: str, provider: Callable[[list[str]], list[list[float]]], dims: int, batch: int = 128, out: str = "embedding") -> DataFrame:
    """rows with the provider's vectors, asked for at most `batch` texts at once inside tasks; null texts have null vectors.

    The job fails if a provider returns another number of vectors, another dimension, or a component that isn't finite.
    """

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        said = texts.dropna().tolist()
        got: list[list[float]] = []
        for i in range(0, len(said), batch):
            part = said[i : i + batch]
            answer = [[float(x) for x in v] for v in provider(part)]
            if len(answer) != len(part) or any(len(v) != dims or not np.isfinite(v).all() for v in answer):
                raise ValueError(f"the provider must return {len(part)} finite vectors of {dims} dimensions")
            got += answer
        vectors_, none = iter(got), texts.isna()
        return pd.Series([None if missing else next(vectors_) for missing in none], dtype=object)

    return rows.withColumn(out, vectors(text))


def ann_first(scored: DataFrame, key: str, k: int, keep: Column, oversample: int = 3) -> DataFrame:
    """Top oversample * k first, then the filter, then top k: may return fewer than k."""
    return top_k(top_k(scored, "dense", key, oversample * k, out="pool_rank").where(keep), "dense", key, k)


def merge_candidates(*candidates: DataFrame, key: str) -> DataFrame:
    """Union of candidate lists over variants; each score's maximum by (query_id, key)."""
    out = None
    for c in candidates:
        full = c.select("query_id", key, *[(F.col(s) if s in c.columns else F.lit(None).cast("double")).alias(s) for s in SCORES])
        out = full if out is None else out.unionByName(full)
    return out.groupBy("query_id", key).agg(*[F.max(s).alias(s) for s in SCORES])


def fuse_weighted(pool: DataFrame, dense_weight: float = 1.0, sparse_weight: float = 1.0) -> DataFrame:
    """pool with hybrid: each score min-max scaled over the query's pool and weighted; zeros and nulls stay out and add 0; equal scores are 1."""
    if dense_weight < 0 or sparse_weight < 0 or dense_weight + sparse_weight == 0:
        raise ValueError("weights are not negative and not both zero")
    w, total, hybrid = Window.partitionBy("query_id"), dense_weight + sparse_weight, F.lit(0.0)
    for name, weight in (("dense", dense_weight), ("sparse", sparse_weight)):
        x = F.when(F.col(name) != 0, F.col(name))
        low, high = F.min(x).over(w), F.max(x).over(w)
        scaled = F.when(x.isNull(), 0.0).when(low == high, 1.0).otherwise((x - low) / (high - low))
        hybrid = hybrid + weight / total * scaled
    return pool.withColumn("hybrid", hybrid)


def fuse_rrf(rankings: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    """(query_id, key, hybrid) from (query_id, key, rank, weight): sum of weight / (k + rank)."""
    return rankings.groupBy("query_id", key).agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("hybrid"))


def rerank_none(ranked: DataFrame, top_n: int) -> DataFrame:
    return ranked.where(F.col("rank") <= top_n).withColumn("rerank", F.col("hybrid"))


def rerank_lexical(ranked: DataFrame, key: str, text: str, top_n: int, query: str = "query") -> DataFrame:
    """The first top_n, by 0.7 times the share of query tokens in the text plus 0.3 times hybrid."""
    q = X.distinct_tokens(F.col(query))
    overlap = F.size(F.array_intersect(q, X.tokens(F.col(text)))) / F.greatest(F.size(q), F.lit(1))
    scored = ranked.where(F.col("rank") <= top_n).withColumn("rerank", 0.7 * overlap + 0.3 * F.coalesce("hybrid", F.lit(0.0)))
    return rank(scored, "rerank", key, out="final_rank")


def rerank_by(ranked: DataFrame, key: str, text: str, scorer: Callable[[list[str], list[str]], list[float]], top_n: int, query: str = "query", every: bool = False) -> DataFrame:
    """The first top_n by the scores of a model of (query, text) pairs, which runs on batches inside tasks.

    With `every`, all candidates are scored before top_n of them are kept, else the first top_n alone are.
    """

    @F.pandas_udf("double")
    def scores(queries: pd.Series, texts: pd.Series) -> pd.Series:
        got = [float(x) for x in scorer(queries.fillna("").tolist(), texts.fillna("").tolist())]
        if len(got) != len(queries):
            raise ValueError("the model must return a score for each pair")
        return pd.Series(got)

    pool = ranked if every else ranked.where(F.col("rank") <= top_n)
    out = rank(pool.withColumn("rerank", scores(query, text)), "rerank", key, out="final_rank")
    return out.where(F.col("final_rank") <= top_n)


def cited_first(evidence: DataFrame, cited: DataFrame, key: str, order: str = "rank", out: str = "shown") -> DataFrame:
    """evidence with cited, and its place in a list that puts cited rows first and keeps the order within both parts."""
    marks = cited.select("query_id", key).distinct().withColumn("cited", F.lit(True))
    rows = evidence.join(marks, ["query_id", key], "left").withColumn("cited", F.coalesce("cited", F.lit(False)))
    return rows.withColumn(out, F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cited"), F.asc(order), F.asc(key))))


def score_floor(df: DataFrame, floor: float, score: str = "rerank") -> DataFrame:
    return df.where(F.coalesce(score, F.lit(0.0)) >= floor) if floor > 0 else df


def diversify(ranked: DataFrame, issuer: str, issuers: int, per_issuer: int) -> DataFrame:
    """The first `issuers` distinct issuers in rank order, at most per_issuer rows each; blank issuers go."""
    named = ranked.where(F.trim(F.coalesce(issuer, F.lit(""))) != "")
    rows = named.withColumn("nth_", F.row_number().over(Window.partitionBy("query_id", issuer).orderBy("rank"))).where(F.col("nth_") <= per_issuer)
    first = F.min("rank").over(Window.partitionBy("query_id", issuer))
    rows = rows.withColumn("first_", first)
    rows = rows.withColumn("issuer_rank", F.dense_rank().over(Window.partitionBy("query_id").orderBy("first_")))
    return rows.where(F.col("issuer_rank") <= issuers).drop("nth_", "first_")


def neighbours(hits: DataFrame, rows: DataFrame, group: str, order: str, key: str, width: int) -> DataFrame:
    """rows within `width` positions of a hit in the same group, without the hits, once each.

    The band is turned into an equi-join: each hit asks for 2 width + 1 positions.
    """
    numbered = rows.withColumn("pos_", F.row_number().over(Window.partitionBy(group).orderBy(order, key)))
    at = numbered.join(hits.select(key), key, "left_semi").select(group, F.explode(F.sequence(F.col("pos_") - width, F.col("pos_") + width)).alias("pos_")).distinct()
    return numbered.join(at, [group, "pos_"], "left_semi").join(hits.select(key), key, "left_anti").withColumnRenamed("pos_", "position")


def rank_delta(df: DataFrame, before: str, after: str, key: str) -> DataFrame:
    """df with moved: the rank by `before` less the rank by `after`."""
    r = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c), F.asc(key)))
    return df.withColumn("moved", r(before) - r(after))


def citation_overlap(claim: Column, evidence: Column) -> Column:
    """The share of the claim's distinct tokens that the evidence has; 0 without tokens."""
    left = X.distinct_tokens(claim)
    return F.when(F.size(left) > 0, F.size(F.array_intersect(left, X.tokens(evidence))) / F.size(left)).otherwise(0.0)


def grounding_confidence(top: Column, overlap: Column) -> Column:
    return F.bround(0.6 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), top)) + 0.4 * overlap, 4)


def composition(results: DataFrame, issuer: str, section: str, filed: str) -> DataFrame:
    """(query_id, results, issuers, modal section, first and last date) of a result set."""
    return results.groupBy("query_id").agg(F.count("*").alias("results"), F.countDistinct(issuer).alias("issuers"), F.mode(section, True).alias("modal_section"), F.min(filed).alias("first_filed"), F.max(filed).alias("last_filed"))
