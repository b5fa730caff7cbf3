"""Which cached files cover a span: one file that holds all of it, or the fewest that do together, for many requests at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.sources.scratch import kept


def _smaller_first(name: Column) -> Column:
    """A key that is greater for smaller names: the complement of the name's bytes in hex, ended by a letter above them all."""
    return F.concat(F.translate(F.hex(name.cast("binary")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))


def _furthest(files: DataFrame, asks: DataFrame) -> DataFrame:
    """asks (group, at, who) with file and reach: of the group's files that begin at `at` or before, the one that ends last.

    One sort of both tables and a running maximum, so no request meets files pair by pair. Of files that end alike the
    one that begins last is taken, then the one with the smallest name. A group is one window, which Spark spills.
    """
    best = F.struct(F.col("last").alias("reach"), "first", _smaller_first(F.col("file")).alias("key"), "file")
    left = files.select("group", F.col("first").alias("at"), F.lit(0).alias("asks"), best.alias("best"), F.lit(None).cast(dict(asks.dtypes)["who"]).alias("who"))
    right = asks.select("group", "at", F.lit(1).alias("asks"), F.lit(None).cast(left.schema["best"].dataType).alias("best"), "who")
    w = Window.partitionBy("group").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    return left.unionByName(right).withColumn("best", F.max("best").over(w)).where("asks = 1").select("group", "at", "who", "best.file", "best.reach")


def _spans(df: DataFrame, name: str) -> DataFrame:
    """(group, first, last, name) with both ends as longs; rows with a null or that end before they begin go."""
    rows = df.select("group", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), name)
    return rows.where("`group` is not null and first is not null and last is not null and first <= last").where(F.col(name).isNotNull())


def containing(files: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, file): a file that holds a request's whole span, or null.

    files: (group, first, last, file), requests: (group, first, last, request), whole numbers, both ends inside. Of several files the
    one that ends last is taken. Requests without a valid span get null.
    """
    spans = _spans(requests, "request")
    found = _furthest(_spans(files, "file"), spans.select("group", F.col("first").alias("at"), F.struct("request", "last").alias("who")))
    held = found.where(F.col("reach") >= F.col("who.last")).select("who.request", "file")
    return requests.select("request").join(held, "request", "left")


def smallest_cover(files: DataFrame, requests: DataFrame, step: int = 1) -> DataFrame:
    """(request, n_files, nth, file): the fewest files of the group that leave no gap in a request's span, in order from 1.

    A file may be followed by one that begins up to `step` after its end (1: days). From the file that reaches furthest over the span's
    first place one goes on to the one that reaches furthest from there; each file's successor, second, fourth and so
    on are tables, so a cover of n files takes log2(n) joins for all requests together. Requests that can't be covered have no rows; an id has one span.
    """
    # A file is known by its span and its name together, so that names may repeat; such ids are ordered as the names are.
    named = F.concat_ws("/", "file", F.hex("group"), F.hex("first"), F.hex("last"))
    held = kept(_spans(files, "file").dropDuplicates().withColumn("id", named), "files")
    spans = _spans(requests, "request")
    furthest = lambda asks: _furthest(held.select("group", "first", "last", F.col("id").alias("file")), asks)
    hop = furthest(held.select("group", (F.col("last") + step).alias("at"), F.struct("id", "last").alias("who")))
    hop = kept(hop.where(F.col("reach") > F.col("who.last")).select(F.col("who.id").alias("file"), F.col("file").alias("next"), "reach"), "hops")
    hops = [hop]
    while True:
        h = hops[-1]
        further = h.join(h.select(F.col("file").alias("next"), F.col("next").alias("next_"), F.col("reach").alias("reach_")), "next").select("file", F.col("next_").alias("next"), F.col("reach_").alias("reach"))
        further = kept(further, "hops")
        if not further.limit(1).count():
            break
        hops.append(further)
    state = furthest(spans.select("group", F.col("first").alias("at"), F.struct("request", "last").alias("who"))).where(F.col("reach") >= F.col("at"))
    state = state.select("who.request", "who.last", F.col("file").alias("begin"), "file", "reach", F.lit(1).cast("long").alias("n"))
    for k in range(len(hops) - 1, -1, -1):
        far = hops[k].select("file", "next", F.col("reach").alias("far"))
        go = F.coalesce(F.col("far") < F.col("last"), F.lit(False))
        state = state.join(far, "file", "left").select("request", "last", "begin", F.when(go, F.col("next")).otherwise(F.col("file")).alias("file"), F.when(go, F.col("far")).otherwise(F.col("reach")).alias("reach"), (F.col("n") + F.when(go, 1 << k).otherwise(0)).alias("n"))
    final = state.join(hop.select("file", F.col("reach").alias("far")), "file", "left")
    enough = F.when(F.col("reach") >= F.col("last"), F.col("n")).when(F.col("far") >= F.col("last"), F.col("n") + 1)
    rows = kept(final.select("request", enough.alias("n_files"), F.col("begin").alias("file")).where("n_files is not null"), "covers")
    rows = rows.select("request", "n_files", "file", F.lit(1).cast("long").alias("nth"), F.col("n_files").alias("n"))
    for k in range(len(hops) - 1, -1, -1):  # a chain of more than 2^k files is one of 2^k and the rest
        rows = rows.join(hops[k].select("file", "next"), "file", "left")
        whole = F.array(F.struct("file", "nth", "n"))
        parts = F.array(F.struct("file", "nth", F.lit(1 << k).cast("long").alias("n")), F.struct(F.col("next").alias("file"), (F.col("nth") + (1 << k)).alias("nth"), (F.col("n") - (1 << k)).alias("n")))
        rows = rows.select("request", "n_files", F.explode(F.when(F.col("n") > 1 << k, parts).otherwise(whole)).alias("p")).select("request", "n_files", "p.*")
    return rows.join(held.select(F.col("id"), F.col("file").alias("name")), rows.file == F.col("id")).select("request", "n_files", "nth", F.col("name").alias("file"))
