"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is normalised and rotated; the signs of its coordinates are its code, packed to bits, with two correction scalars. A
rotated query is cut into bit planes, so that the inner product with a code is a weighted sum of population counts. From it
the inner product of the vectors is estimated with an error bound; only candidates whose bound reaches the best exact
scores so far are reranked on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillstone.llm.common import cut, free_name

#: Neighbours; bytes of vectors of a block of queries and of candidates; deviations that the error bound allows; seed of the rotation.
K, QUERY_BYTES, CANDIDATE_BYTES, DEVIATIONS, SEED = 20, 16 << 20, 4 << 20, 2.0, 20240101
#: Candidates that are scored first; bits of a query's coordinate; queries that are estimated at a time.
FIRST_RERANK, PLANES, AT_A_TIME = 64, 4, 64


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same for each task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The rows whose key isn't null and whose vector isn't null, empty, zero, and holds no null and no non-finite component."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    some = F.exists(vec, lambda x: x != 0)
    return vectors.where(F.col(key).isNotNull() & F.col(vec).isNotNull()).where(~bad & some)


def encode(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, length, <code, vector> of the unit code and unit vector) of the rows of x."""
    norm = np.linalg.norm(x, axis=1)
    y = (x / norm[:, None]) @ p.T
    return np.packbits(y > 0, axis=1), norm, np.abs(y).sum(1) / math.sqrt(x.shape[1])


def with_codes(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """The index: vectors with code (packed bits, whole 64-bit words), norm and agreement. All rows are indexed, of any dimension."""
    kept = vectors.drop("code", "norm", "agreement")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned: dict[int, np.ndarray] = {}
        for b in batches:
            x = [np.asarray(v, np.float64) for v in b.column(vec).to_pylist()]
            dims = np.array([len(v) for v in x], int)
            code, norm, agree = [b""] * len(x), np.zeros(len(x)), np.ones(len(x))
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                turned.setdefault(d, rotation(d))
                bits, norm[at], agree[at] = encode(np.stack([x[i] for i in at]), turned[d])
                for i, c in zip(at.tolist(), bits, strict=True):
                    code[i] = c.tobytes().ljust(-(-d // 64) * 8, b"\0")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code, pa.binary()), pa.array(norm), pa.array(agree)], names=[*b.schema.names, "code", "norm", "agreement"])

    made = [T.StructField("code", T.BinaryType()), T.StructField("norm", T.DoubleType()), T.StructField("agreement", T.DoubleType())]
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *made]))


def planes(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits, low, step) of each row: coordinate i is near low + step * sum of 2^j over the planes j whose bit i is set."""
    low = rotated.min(1)
    step = np.maximum((rotated.max(1) - low) / ((1 << PLANES) - 1), 1e-300)
    level = np.rint((rotated - low[:, None]) / step[:, None]).astype(np.uint8)
    words = -(-rotated.shape[1] // 64)
    bits = np.stack([np.packbits(np.pad(level >> j & 1, ((0, 0), (0, words * 64 - rotated.shape[1]))), axis=1).view(np.uint64) for j in range(PLANES)], axis=1)
    return bits, low, step


def signed_products(code: np.ndarray, query: tuple[np.ndarray, np.ndarray, np.ndarray], total: np.ndarray) -> np.ndarray:
    """<signs of a code, rotated query> for all queries and codes, from packed bits: twice what the set bits pick, less the query's total."""
    bits, low, step = query
    picked = np.zeros((len(low), len(code)), np.int32)
    for j in range(PLANES):
        for w in range(code.shape[1]):
            picked += np.bitwise_count(bits[:, j, w, None] & code[None, :, w]).astype(np.int32) << j
    ones = np.bitwise_count(code).sum(1, dtype=np.int64)
    return 2 * (low[:, None] * ones + step[:, None] * picked) - total[:, None]


def search_block(qrow: np.ndarray, q: np.ndarray, crow: np.ndarray, cid: np.ndarray, c: np.ndarray, code: np.ndarray, norm: np.ndarray, agree: np.ndarray, k: int, deviations: float = DEVIATIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, place of the candidate, exact score) of the k best of a block of candidates for each of a block of queries.

    The estimate of <o, q> for unit o is <code, q> / <code, o>; its error has the deviation sqrt((1 - a^2) / a^2 / (d - 1)),
    a = <code, o>. The candidates that are estimated best are scored first; the k-th of them is the bar that the bound of
    each other has to reach. A query's own row is no candidate.
    """
    d = q.shape[1]
    words = code.view(np.uint64).reshape(len(c), -1)
    rotated = q @ rotation(d).T
    spread = norm * np.sqrt(np.maximum(0, 1 - agree**2) / agree**2 / max(1, d - 1)) * deviations
    lengths, scale = np.linalg.norm(q, axis=1), norm / agree / math.sqrt(d)
    place = {r: i for i, r in enumerate(crow.tolist())}
    out_q, out_c, out_s = [], [], []
    for at in range(0, len(q), AT_A_TIME):
        part = rotated[at : at + AT_A_TIME]
        estimate = signed_products(words, planes(part), part.sum(1)) * scale
        for row, e in enumerate(estimate):
            i = at + row
            own = place.get(int(qrow[i]))
            if own is not None:
                e[own] = -np.inf
            n = min(max(k, FIRST_RERANK) + 1, len(e))
            first = np.argpartition(-e, n - 1)[:n]
            first = first[np.isfinite(e[first])]
            exact = np.einsum("ij,j->i", c[first], q[i])
            bar = np.partition(exact, -k)[-k] if len(exact) >= k else -np.inf
            reach = e + spread * lengths[i] >= bar
            reach[first] = False
            if own is not None:
                reach[own] = False
            more = np.flatnonzero(reach)
            rows, score = np.concatenate([first, more]), np.concatenate([exact, np.einsum("ij,j->i", c[more], q[i])])
            best = np.lexsort((crow[rows], cid[rows], -score))[:k]
            out_q.append(np.full(len(best), i))
            out_c.append(rows[best])
            out_s.append(score[best])
    cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    return cat(out_q, np.int64), cat(out_c, np.int64), cat(out_s, np.float64)


def nearest(vectors: DataFrame, asked: Column, k: int = K, vec: str = "embedding", key: str = "vec_id", query_bytes: int = QUERY_BYTES, candidate_bytes: int = CANDIDATE_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score, query_row): for each row that `asked` picks its k nearest of all other rows by inner product.

    Every usable row is a vector and, if asked, a query of its own: rows that share a vec_id are neighbours of each other, and
    each has a ranking, told apart by query_row. Vectors of different dimensions are no neighbours. Ties go to the smaller
    vec_id. Rows that usable() drops, nulls in vec_id among them, take no part. Queries and candidates of a dimension are
    dealt to blocks of bounded bytes by hash, and each pair of blocks is one task's work: no table is broadcast, and of a block
    only the best k of each query are shuffled. A candidate is copied once for each block of queries. No rows give no rows.
    """
    row = free_name(vectors, "row_")
    rows = usable(vectors, vec, key).select(F.col(key).alias("id"), F.col(vec).alias("vec"), F.coalesce(asked, F.lit(False)).alias("asked")).withColumn(row, F.monotonically_increasing_id())
    index = cut(with_codes(rows, "vec").withColumnRenamed(row, "row").withColumn("d", F.size("vec")), "codes")
    per = lambda b: F.ceil(F.col("n") * F.col("d") * 8 / b)
    sizes = index.groupBy("d").agg(F.count("*").alias("n"), F.count_if("asked").alias("asked_n"))
    sizes = sizes.select("d", F.greatest(F.lit(1), per(candidate_bytes)).cast("int").alias("n_c"), F.greatest(F.lit(1), F.ceil(F.col("asked_n") * F.col("d") * 8 / query_bytes)).cast("int").alias("n_q"))
    index = index.join(F.broadcast(sizes), "d")  # a row for each dimension; n dimensions take n * n / 2 components at least
    h = F.xxhash64(F.lit(SEED), "row")
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.where("asked").select(F.col("d").alias("qd"), F.col("row").alias("qrow"), F.col("id").alias("qid"), F.col("vec").alias("qvec"), F.pmod(h, F.col("n_q")).alias("qb"), blocks("n_c").alias("cb"))
    right = index.select(F.col("d").alias("cd"), "row", "id", "vec", "code", "norm", "agreement", F.pmod(h, F.col("n_c")).alias("cb"), blocks("n_q").alias("qb"))
    left, right = left.withColumns({"qb": F.col("qb").cast("int")}), right.withColumns({"cb": F.col("cb").cast("int")})

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({n: np.zeros(0, t) for n, t in (("query_row", "i8"), ("query_id", "i8"), ("row", "i8"), ("vec_id", "i8"), ("score", "f8"))})
        q, c = np.stack(a["qvec"].to_list()).astype(np.float64), np.stack(b["vec"].to_list()).astype(np.float64)
        code = np.frombuffer(b"".join(b["code"]), np.uint8).reshape(len(b), -1)
        qrow, qid, crow, cid = (x.to_numpy(np.int64) for x in (a["qrow"], a["qid"], b["row"], b["id"]))
        i, j, s = search_block(qrow, q, crow, cid, c, code, b["norm"].to_numpy(), b["agreement"].to_numpy(), k)
        return pd.DataFrame({"query_row": qrow[i], "query_id": qid[i], "row": crow[j], "vec_id": cid[j], "score": s})

    found = left.groupBy("qd", "qb", "cb").cogroup(right.groupBy("cd", "qb", "cb")).applyInPandas(run, "query_row long, query_id long, row long, vec_id long, score double")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_row")


def op5(vectors: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score, query_row; the queries are the rows whose vec_id is divisible by 20."""
    return nearest(vectors, F.col("vec_id") % 20 == 0)
