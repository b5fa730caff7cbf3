"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import cut, drop_cut

STAR = "a long, b long"


def min_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        keep = new[a] != new[b]
        same = (new == label).all()
        a, b, label = a[keep], b[keep], new
        if same:
            break
    return label


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as connect what the links a-b connect: (node, smallest node of its group), a > b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = min_labels(at[: len(a)], at[len(a) :], len(nodes))
    out = label != np.arange(len(nodes))
    return nodes[out], nodes[label[out]]


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A forest for each batch's links; its rows are at most the batch's."""
    for pdf in batches:
        a, b = star_forest(pdf["a"].to_numpy("int64"), pdf["b"].to_numpy("int64"))
        yield pd.DataFrame({"a": a, "b": b})


def _step(edges: DataFrame) -> DataFrame:
    """Large star, then small star: link every neighbour to the smallest node seen from it.

    The minimum of each node is aggregated map-side; the join back on the node has one row a key on one side,
    so AQE can split a hot key's other side.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    large = both.join(low, both.a == low.n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
    linked = large.join(low, large.a == low.n)
    small = linked.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return small.select("e.*").where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of edges (a long, b long); component is the smallest node reachable.

    Nodes without an edge to another node don't appear. Null ends are ignored; repeated edges, loops and any
    direction are allowed; no edges give no rows. Links are first contracted to forests within partitions, then
    alternating large-star and small-star rounds run until the links are stars, each round written
    to the shared folder.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    now = cut(edges.mapInPandas(_contract, STAR), "links")
    seen = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.sum((F.col("a") <= F.col("b")).cast("int")).alias("wrong")).first()
        if state["n"] == 0 or (state["n"], state["h"]) == seen:
            break
        seen = (state["n"], state["h"])
        old, now = now, cut(_step(now), "links")
        drop_cut(old)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
