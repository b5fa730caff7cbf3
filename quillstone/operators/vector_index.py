"""An inverted-file index of vectors: cells around centroids, one folder of Parquet a cell, of which a search reads some."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.operators.retrieval import top_k

#: Bounds of the sample that centroids and probes are fitted on: rows, and bytes of its vectors.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 64 << 20
#: Fewest and most cells; about the square root of the rows lies between them.
CELLS = (16, 4096)
#: Rows of a cell and queries that meet in one task.
PART_ROWS, BLOCK_QUERIES = 1 << 16, 1 << 12
#: Sample rows that are asked for when probes are fitted, neighbours that they are fitted for, and the share of them to be found.
TRIALS, NEAREST, RECALL = 256, 10, 0.95


@dataclass(frozen=True)
class VectorIndex:
    """Where the cells are, their centroids, and how many a search reads: of all rows, and of few that a filter leaves."""

    path: str
    centroids: np.ndarray
    probes: int
    filtered_probes: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/cells")


def usable(vec: Column) -> Column:
    """Vectors with a norm: not null, no null or non-finite component, not all zero."""
    norm = F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.coalesce(vec.isNotNull() & (norm > 0) & (norm < float("inf")) & ~F.isnan(norm), F.lit(False))


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, float) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _fit_probes(x: np.ndarray, centroids: np.ndarray, nearest: int, recall: float) -> int:
    """The cells that have to be read so that `recall` of the sample's nearest neighbours are found; x has unit rows."""
    home = (x @ centroids.T).argmax(1)
    asked = np.arange(0, len(x), max(1, len(x) // TRIALS))
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -2
    k = min(nearest, len(x) - 1)
    if k < 1:
        return len(centroids)
    found = np.argpartition(-near, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(x[asked] @ centroids.T), axis=1), axis=1)
    ranks = np.sort(np.take_along_axis(place, home[found], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1


def build(vectors: DataFrame, key: str, vec: str, path: str, cells: int | None = None, selectivity: float = 0.1, recall: float = RECALL) -> VectorIndex:
    """Write every usable vector, with its other columns, to the folder of the cell whose centroid is nearest by cosine.

    Centroids come from Spark's k-means on a sample of at most SAMPLE_ROWS rows and SAMPLE_BYTES bytes, chosen by hash; so do the
    numbers of cells to read: as many as find `recall` of the nearest neighbours of sample rows, for a filter that leaves the
    share `selectivity` those of 1 / selectivity times as many neighbours. In a larger table neighbours are nearer, so this is on the safe side.
    A search may find fewer than k rows, if the cells that it reads hold fewer.
    All usable vectors have one dimension, else it fails. Rows of a large cell are dealt to several files.
    """
    spark = vectors.sparkSession
    good = vectors.where(usable(F.col(vec)))
    size = good.agg(F.count("*").alias("n"), F.min(F.size(vec)).alias("least"), F.max(F.size(vec)).alias("d")).first()
    if not size["n"]:
        raise ValueError("no usable vector")
    if size["least"] != size["d"]:
        raise ValueError("vectors of several dimensions need an index each")
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * size["d"])))
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = F.transform(vec, lambda x: x.cast("double") / norm)
    sample = good.select(F.xxhash64(key).alias("h"), unit.alias("x")).orderBy("h", "x").limit(most).toPandas()  # bounded as said
    x = np.stack(sample["x"].to_list())
    n_cells = min(len(x), cells or min(CELLS[1], max(CELLS[0], int(size["n"] ** 0.5) // 2)))
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").coalesce(1).select(array_to_vector("x").alias("features"))
    if len(x) > 1 and n_cells > 1:
        found = KMeans(k=n_cells, distanceMeasure="cosine", seed=11, maxIter=10).fit(rows)
        centroids = np.array([c / max(1e-12, np.linalg.norm(c)) for c in found.clusterCenters()])
    else:
        centroids = x[:1]
    probes = _fit_probes(x, centroids, NEAREST, recall)
    filtered = max(probes, _fit_probes(x, centroids, int(NEAREST / selectivity), recall))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=(_unit(pdf[vec]) @ centroids.T).argmax(1).astype("int32"))

    dealt = good.mapInPandas(place, T.StructType([*good.schema.fields, T.StructField("cell", T.IntegerType())]))
    parts = max(1, round(size["n"] / len(centroids) / (4 * PART_ROWS)))
    dealt.repartition(F.col("cell"), F.pmod(F.xxhash64(key), F.lit(parts))).write.partitionBy("cell").mode("overwrite").parquet(f"{path}/cells")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    spark.createDataFrame([(probes, filtered)], "probes int, filtered_probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/probes")
    return VectorIndex(path, centroids, probes, filtered)


def load(spark: SparkSession, path: str) -> VectorIndex:
    """An index that build() wrote; its centroids are at most CELLS[1] rows."""
    rows = sorted(spark.read.parquet(f"{path}/centroids").collect(), key=lambda r: r["cell"])
    fitted = spark.read.parquet(f"{path}/probes").first()
    return VectorIndex(path, np.array([r["centroid"] for r in rows]), fitted["probes"], fitted["filtered_probes"])


def probed(index: VectorIndex, queries: DataFrame, vec: str = "query_vec", probes: int | None = None) -> DataFrame:
    """(query_id, vec, cell): the cells that each usable query vector reads, the nearest first ones."""
    centroids, p = index.centroids, min(len(index.centroids), probes or index.probes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                near = np.argsort(-(_unit(pdf[vec]) @ centroids.T), axis=1, kind="stable")[:, :p]
                yield pd.DataFrame({"query_id": np.repeat(pdf["query_id"].to_numpy(), p), vec: np.repeat(pdf[vec].to_numpy(), p), "cell": near.ravel().astype("int32")})

    kind = dict(queries.dtypes)["query_id"]
    return queries.where(usable(F.col(vec))).select("query_id", F.col(vec).cast("array<double>").alias(vec)).mapInPandas(run, f"query_id {kind}, {vec} array<double>, cell int")


def search(index: VectorIndex, queries: DataFrame, key: str, vec: str, k: int, where: Column | None = None, query_vec: str = "query_vec", probes: int | None = None) -> DataFrame:
    """(query_id, key, score, rank): the k rows of the probed cells with the largest cosine, ties to the smaller key.

    Other cells' folders aren't read. `where` narrows the rows of the cells before they are ranked, so a filtered search finds k rows
    if the cells have them. Scores are exact. Queries and rows of a cell meet in tasks of bounded size; each sends on its k best a query.
    """
    spark = queries.sparkSession
    asks = probed(index, queries, query_vec, probes or (index.filtered_probes if where is not None else index.probes))
    n_asks = asks.groupBy("cell").agg(F.count("*").alias("asks_"))
    cells = [r["cell"] for r in n_asks.select("cell").collect()]  # cells at most
    rows = index.rows(spark).where(F.col("cell").isin(cells))
    if where is not None:
        rows = rows.where(where)
    rows = rows.select(key, vec, "cell")
    sizes = rows.groupBy("cell").agg(F.count("*").alias("rows_")).join(n_asks, "cell")
    sizes = sizes.select("cell", F.ceil(F.col("rows_") / PART_ROWS).cast("int").alias("parts_"), F.ceil(F.col("asks_") / BLOCK_QUERIES).cast("int").alias("blocks_"))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = rows.join(F.broadcast(sizes), "cell").select("cell", deal(key, "parts_").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks_") - 1)).alias("block"), key, vec)
    right = asks.join(F.broadcast(sizes), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts_") - 1)).alias("part"), deal("query_id", "blocks_").alias("block"), "query_id", query_vec)

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            a = a.sort_values(key, kind="stable")
            x, ids = _unit(a[vec]), a[key].to_numpy()
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                scores = _unit(part[query_vec]) @ x.T
                for q, s in zip(part["query_id"], scores, strict=True):
                    best = np.argsort(-s, kind="stable")[:k]
                    out.append(pd.DataFrame({"query_id": q, key: ids[best], "score": np.clip(s[best], -1, 1)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], key: [], "score": []})

    kinds = f"query_id {dict(queries.dtypes)['query_id']}, {key} {dict(rows.dtypes)[key]}, score double"
    best = left.groupBy("cell", "part", "block").cogroup(right.groupBy("cell", "part", "block")).applyInPandas(meet, kinds)
    return top_k(best, "score", key, k)


def recall_of(found: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """(query_id, recall): the share of each query's exact rows that were found."""
    hit = exact.join(found.select("query_id", key).withColumn("hit", F.lit(1)), ["query_id", key], "left")
    return hit.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
