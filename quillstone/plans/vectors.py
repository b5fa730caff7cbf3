"""Searches of an inverted-file index; the vectors whose ids 100 divides are the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.numbers import cut6
from quillstone.operators import vector_index as V
from quillstone.plans import standins as S
from quillstone.sources import scratch

Q: dict = {}
O: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    return S.register(Q, O, name, sql)


def _built(spark: SparkSession, d: str) -> tuple[V.VectorIndex, DataFrame]:
    rows = S.table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return V.build(rows, "vec_id", "embedding", scratch.folder(spark, "cells"), selectivity=0.3), asked


@query("ivf_topk")
def ivf_topk(spark: SparkSession, d: str) -> DataFrame:
    index, asked = _built(spark, d)
    return V.search(index, asked, "vec_id", "embedding", 10).withColumn("score", cut6(F.col("score")))


@query("ivf_topk_filtered")
def ivf_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The filter narrows the cells' rows before they are ranked."""
    index, asked = _built(spark, d)
    return V.search(index, asked, "vec_id", "embedding", 10, F.col("label").isin(1, 3, 5)).withColumn("score", cut6(F.col("score")))


@query("ivf_cells", """
SELECT count(*) AS vectors, count(*) FILTER (vec_id % 100 = 0) AS queries FROM embeddings
WHERE embedding IS NOT NULL AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0""")
def ivf_cells(spark: SparkSession, d: str) -> DataFrame:
    """Every usable vector stands in one cell of the written index, and every query finds the cells it reads."""
    index, asked = _built(spark, d)
    stored = index.rows(spark).agg(F.count_distinct("vec_id").alias("vectors"))
    return stored.join(V.probed(index, asked).agg(F.count_distinct("query_id").alias("queries")))
