"""Full-text search by stems and by how close a query's words stand: an index of positions, and minimal covers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import text as X
from quillstone.functions.stemming import lexeme

#: What an occurrence weighs; lexemes that go into the index's workers as a list; folders that a written index has.
WEIGHT, MOST_WANTED, FOLDERS = 0.1, 100_000, 256

_TOKEN = re.compile("[a-z0-9]+")


def query_lexemes(queries: DataFrame, text: str = "query", cap: int | None = X.QUERY_TOKEN_CAP) -> DataFrame:
    """(query_id, lexeme): the distinct lexemes of each query's terms (the first `cap` of them); a query of stop words alone has none."""

    @F.pandas_udf("string")
    def stems(tokens: pd.Series) -> pd.Series:
        return tokens.map(lexeme)

    terms = queries.select("query_id", F.explode(X.query_terms(F.col(text), cap)).alias("token"))
    return terms.select("query_id", stems("token").alias("lexeme")).where("lexeme is not null").distinct()


def positions(chunks: DataFrame, key: str, text: str, wanted: list[str] | None = None) -> DataFrame:
    """(key, lexeme, positions): where each lexeme of a text stands, counted in tokens from 0, stop words included.

    One map over whole texts, no shuffle; with `wanted` only these lexemes. Null and empty texts have no rows; repeated rows of a key
    have rows each.
    """
    schema = T.StructType([chunks.schema[key], T.StructField("lexeme", T.StringType(), False), T.StructField("positions", T.ArrayType(T.IntegerType()), False)])
    kept = None if wanted is None else frozenset(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str | None] = {}
        for batch in batches:
            rows, lexemes, places = [], [], []
            for i, text_ in enumerate(batch.column(text)):
                at: dict[str, list[int]] = {}
                for p, token in enumerate(_TOKEN.findall((text_.as_py() or "").lower())):
                    try:
                        own = known[token]
                    except KeyError:
                        own = lexeme(token)
                        own = known[token] = own if kept is None or own in kept else None
                        if len(known) > 1 << 20:
                            known.clear()
                    if own is not None:
                        at.setdefault(own, []).append(p)
                rows += [i] * len(at)
                lexemes += at.keys()
                places += at.values()
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int64())), pa.array(lexemes, pa.string()), pa.array(places, pa.list_(pa.int32()))], names=[key, "lexeme", "positions"])

    return chunks.select(key, text).mapInArrow(run, schema)


def _folder(lexeme_):
    return F.pmod(F.xxhash64(lexeme_), F.lit(FOLDERS)).cast("int")


def write_index(chunks: DataFrame, key: str, text: str, path: str, files: int = 1) -> None:
    """Write the positions of all lexemes as Parquet, in folders by a hash of the lexeme, sorted by it; `files` files a folder share what a common lexeme has."""
    rows = positions(chunks, key, text).withColumn("folder", _folder(F.col("lexeme")))
    spread = F.pmod(F.xxhash64(key), F.lit(files))
    rows.repartition(FOLDERS, "folder", spread).sortWithinPartitions("folder", "lexeme").write.partitionBy("folder").mode("overwrite").parquet(path)


def read_index(spark, path: str, lexemes: DataFrame) -> DataFrame:
    """The written positions of the lexemes alone: other folders aren't read, and lexemes are pushed to the rest's statistics while they are few."""
    few = [r["lexeme"] for r in lexemes.select("lexeme").distinct().limit(MOST_WANTED + 1).collect()]
    index = spark.read.parquet(path)
    if len(few) > MOST_WANTED:
        return index.drop("folder").join(lexemes.select("lexeme").distinct(), "lexeme", "left_semi")
    wanted = spark.createDataFrame([(x,) for x in few], "lexeme string").select(_folder(F.col("lexeme")).alias("folder")).distinct()
    return index.where(F.col("folder").isin([r["folder"] for r in wanted.collect()]) & F.col("lexeme").isin(few)).drop("folder")


def wanted_positions(chunks: DataFrame, key: str, text: str, lexemes: DataFrame) -> DataFrame:
    """The positions of the lexemes in texts that have no index; up to MOST_WANTED lexemes go to the tasks, more are joined."""
    few = [r["lexeme"] for r in lexemes.select("lexeme").distinct().limit(MOST_WANTED + 1).collect()]
    if len(few) <= MOST_WANTED:
        return positions(chunks, key, text, few)
    return positions(chunks, key, text).join(lexemes.select("lexeme").distinct(), "lexeme", "left_semi")


def cover_density(lexemes: DataFrame, index: DataFrame, key: str, every: bool = False, weight: float = WEIGHT) -> DataFrame:
    """(query_id, key, density, covers) of the texts that a query matches.

    A cover is a stretch of tokens that satisfies the query and holds no smaller one that does. A query for any of its lexemes is
    satisfied by each occurrence, so its covers are the occurrences; with `every`, a cover holds all lexemes. A cover adds
    `weight`, divided by one plus the number of tokens inside that aren't the query's. What is shuffled are the positions of
    the queries' lexemes; `key` names one text.
    """
    hits = index.join(lexemes, "lexeme").groupBy("query_id", key)
    if not every:
        found = hits.agg(F.sum(F.size("positions")).cast("long").alias("covers"))
        return found.select("query_id", key, (weight * F.col("covers")).alias("density"), "covers")
    asked = lexemes.groupBy("query_id").agg(F.count("*").alias("asked_"))
    lists = hits.agg(F.collect_list("positions").alias("lists_")).join(asked, "query_id").where(F.size("lists_") == F.col("asked_"))
    # Hits in order, each with its lexeme; going through them, `last` holds the latest hit of each lexeme, the earliest of which opens a cover.
    numbered = F.transform("lists_", lambda ps, j: F.transform(ps, lambda p: F.struct(p.alias("p"), j.alias("j"))))
    at = lists.withColumn("at_", F.array_sort(F.flatten(numbered))).withColumn("at_", F.transform("at_", lambda h, i: F.struct(i.alias("i"), h["p"].alias("p"), h["j"].alias("j"))))
    none = F.struct(F.transform("lists_", lambda _: F.lit(-1)).alias("last"), F.lit(-1).alias("opened"), F.lit(0.0).alias("density"), F.lit(0).cast("long").alias("covers"))

    def step(acc, h):
        last = F.transform(acc["last"], lambda x, j: F.when(j == h["j"], h["i"]).otherwise(x))
        first = F.array_min(last)
        new = first > acc["opened"]
        foreign = (h["p"] - F.get("at_", first)["p"]) - (h["i"] - first)
        return F.struct(
            last.alias("last"), F.greatest(first, acc["opened"]).alias("opened"), (acc["density"] + F.when(new, weight / (1 + foreign)).otherwise(0.0)).alias("density"), (acc["covers"] + new.cast("long")).alias("covers")
        )

    done = at.withColumn("done_", F.aggregate("at_", none, step))
    return done.select("query_id", key, F.col("done_.density").alias("density"), F.col("done_.covers").alias("covers"))
