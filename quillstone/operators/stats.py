"""Cross-sectional statistics as windows and grouped aggregates."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillstone.sources.scratch import kept

#: Values that a bootstrap draws at a time, and sums of draws that a task holds before it sends them on.
DRAWN, HELD_SUMS = 1 << 18, 1 << 20


def average_rank(value: str, keys: Iterable[str] = ()) -> Column:
    """Rank by value within keys; ties share their mean rank."""
    keys = list(keys)
    peers = Window.partitionBy(*keys, value)
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count("*").over(peers) - 1) / 2.0


def _key(keys: Iterable[str]) -> Column:
    """The keys as one column that is never null; null keys equal each other."""
    return F.struct(*keys, F.lit(0).alias("all_")).alias("key_")


def _below(counts: DataFrame, value: str) -> DataFrame:
    """counts (key_, value, n_), a row for each distinct value, with below_, the sum of n_ over smaller values of the key, total_ and part_.

    Values are dealt to ranges of (key, value) and written with the number of their range; sums of ranges are prefixed, and each window
    holds one range of one key, so that a key of any size is many tasks. Later ranges of a key have greater values.
    """
    placed = kept(counts.repartitionByRange("key_", value).withColumn("part_", F.spark_partition_id()), "ranges")
    sums, of_key = placed.groupBy("part_", "key_").agg(F.sum("n_").alias("in_")), Window.partitionBy("key_")
    before = F.sum("in_").over(of_key.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    side = sums.select("part_", "key_", F.coalesce(before, F.lit(0)).alias("before_"), F.sum("in_").over(of_key).alias("total_"))
    own = F.sum("n_").over(Window.partitionBy("part_", "key_").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    return placed.join(side, ["part_", "key_"]).withColumn("below_", F.col("before_") + F.coalesce(own, F.lit(0))).drop("before_")


def _shared_rank(counts: DataFrame, value: str) -> DataFrame:
    """(key_, value, rank_): the mean rank of a value's rows."""
    return _below(counts, value).select("key_", value, (F.col("below_") + (F.col("n_") + 1) / 2.0).alias("rank_"))


def average_ranks(df: DataFrame, value: str, keys: Iterable[str] = (), out: str = "avg_rank") -> DataFrame:
    """df with average_rank() of its rows, for keys of any size: distinct values are ranked, not rows. Nulls come first and tie."""
    rows = df.withColumn("key_", _key(keys))
    ranks = _shared_rank(rows.groupBy("key_", F.col(value).alias("v_")).agg(F.count("*").alias("n_")), "v_").withColumnRenamed("key_", "k_")
    return rows.join(ranks, (F.col("key_") == F.col("k_")) & F.col(value).eqNullSafe(F.col("v_"))).select(*df.columns, F.col("rank_").alias(out))


def spearman(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """(keys, n, ic, t_stat): Pearson's correlation of average ranks; null under 3 rows or without variance; t null at |ic| = 1.

    Equal pairs are counted first; the distinct values of x and of y are ranked by ranges, and the ranks joined to the pairs.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(_key(keys), F.col(x).alias("x_"), F.col(y).alias("y_"))
    pairs = kept(rows.groupBy("key_", "x_", "y_").agg(F.count("*").alias("n_")), "pairs")
    ranks = lambda v, r: _shared_rank(pairs.groupBy("key_", v).agg(F.sum("n_").alias("n_")), v).withColumnRenamed("rank_", r)
    ranked = pairs.join(ranks("x_", "rx"), ["key_", "x_"]).join(ranks("y_", "ry"), ["key_", "y_"])
    total = lambda *of: F.sum(math.prod(map(F.col, of), start=F.col("n_")))
    sums = ranked.groupBy(*(["key_"] if keys else [])).agg(F.coalesce(total(), F.lit(0)).cast("double").alias("n"), total("rx").alias("sx"), total("ry").alias("sy"), total("rx", "ry").alias("sxy"), total("rx", "rx").alias("sxx"), total("ry", "ry").alias("syy"))
    sums = sums.select(*[F.col("key_")[k].alias(k) for k in keys], "n", "sx", "sy", "sxy", "sxx", "syy")
    top = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    ic = F.when((F.col("n") >= 3) & (vx > 0) & (vy > 0), F.try_divide(top, F.sqrt(vx * vy)))
    out = sums.select(*keys, F.col("n").cast("long").alias("n"), ic.alias("ic"))
    t = F.when(F.abs("ic") < 1, F.col("ic") * F.sqrt(F.try_divide(F.col("n") - 2.0, 1.0 - F.col("ic") * F.col("ic"))))
    return out.withColumn("t_stat", t)


def quantile_bucket(order: list[Column], q: int, keys: Iterable[str] = ()) -> Column:
    """Bucket 0..q-1 by floor boundaries i * n // q of the sorted rows (ntile puts the larger buckets first instead)."""
    keys = list(keys)
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    n = F.count("*").over(Window.partitionBy(*keys))
    return F.floor((rn * q - 1) / n).cast("int")


def quantile_portfolios(df: DataFrame, feature: str, outcome: str, q: int, keys: list[str], tie: list[str]) -> DataFrame:
    """(keys, bucket, n, mean_outcome); groups under 2 q rows have none."""
    rows = df.where(F.col(feature).isNotNull() & F.col(outcome).isNotNull())
    rows = rows.withColumn("bucket", quantile_bucket([F.asc(feature), *[F.asc(t) for t in tie]], q, keys)).withColumn("size_", F.count("*").over(Window.partitionBy(*keys)))
    return rows.where(F.col("size_") >= 2 * q).groupBy(*keys, "bucket").agg(F.count("*").alias("n"), F.avg(outcome).alias("mean_outcome"))


def long_short(portfolios: DataFrame, q: int, keys: list[str]) -> DataFrame:
    """(keys, spread): the top bucket's mean less the bottom's."""
    mean = lambda b: F.avg(F.when(F.col("bucket") == b, F.col("mean_outcome")))
    return portfolios.groupBy(*keys).agg((mean(q - 1) - mean(0)).alias("spread"))


def winsorise(df: DataFrame, value: str, p: float, keys: list[str], out: str = "winsorised") -> DataFrame:
    """Clip to the order statistics at int(p * last) and int((1 - p) * last); groups under 5 stay."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("rn_", F.row_number().over(w.orderBy(value)) - 1).withColumn("n_", F.count(value).over(w))
    at = lambda share: F.floor((F.col("n_") - 1) * F.lit(share))
    low = F.max(F.when(F.col("rn_") == at(p), F.col(value))).over(w)
    high = F.max(F.when(F.col("rn_") == at(1 - p), F.col(value))).over(w)
    rows = rows.withColumn("low_", low).withColumn("high_", high)
    return rows.withColumn(out, F.when(F.col("n_") < 5, F.col(value)).otherwise(F.greatest("low_", F.least("high_", value)))).drop("rn_", "n_", "low_", "high_")


def zscore(df: DataFrame, value: str, cell: list[str], sign: Column | float = 1.0, out: str = "z") -> DataFrame:
    """Sign-aligned population z-scores within cells; rows of cells under 2 or without spread go.

    The cells' sums are written first, so that their size is known when the join is planned and few cells don't gather all rows by cell.
    """
    s = F.lit(sign) if isinstance(sign, float) else sign
    rows = df.where(F.col(value).isNotNull()).withColumn("key_", _key(cell))
    cells = rows.groupBy("key_").agg(F.avg(value).alias("mean_"), F.stddev_pop(value).alias("sd_"), F.count("*").alias("n_")).where("n_ >= 2 and sd_ > 0")
    return rows.join(kept(cells, "cells"), "key_").withColumn(out, s * (F.col(value) - F.col("mean_")) / F.col("sd_")).drop("key_", "mean_", "sd_", "n_")


def sector_neutral_zscore(df: DataFrame, value: str, period: str, signal: str, sector: str, min_group: int = 4, sign: Column | float = 1.0) -> DataFrame:
    """z-scores within (period, signal, sector); unknown and thin sectors are pooled by period and signal."""
    rows = df.where(F.col(value).isNotNull()).withColumn("key_", _key([period, signal, sector]))
    rows = rows.join(rows.groupBy("key_").agg(F.count("*").alias("size_")), "key_")
    own = rows.withColumn("cell_", F.when((F.coalesce(F.col(sector), F.lit("Unknown")) != "Unknown") & (F.col("size_") >= min_group), F.col(sector)).otherwise("__pool__")).drop("key_", "size_")
    return zscore(own, value, [period, signal, "cell_"], sign).drop("cell_")


def composite(zs: DataFrame, entity: str, z: str = "z") -> DataFrame:
    """The mean of the z-scores that an entity has."""
    return zs.groupBy(entity).agg(F.avg(z).alias("composite"), F.count("*").alias("n_signals"))


def with_composite(zs: DataFrame, entity: str, signal: str, beside: DataFrame, z: str = "z", name: str = "composite") -> DataFrame:
    """zs (entity, signal, z) joined to beside by entity, and a row of each entity with the mean of its z-scores as the signal `name`.

    Scores are shuffled and sorted once: the mean stands in an entity's first row through the join, and becomes a row after it.
    """
    own = Window.partitionBy(entity).orderBy(signal)
    mean = F.avg(z).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = zs.select(entity, signal, z, F.row_number().over(own).alias("nth_"), mean.alias("mean_")).join(beside, entity)
    scored = F.struct(F.col(signal).alias(signal), F.col(z).alias(z))
    both = F.array(scored, F.struct(F.lit(name).alias(signal), F.col("mean_").alias(z)))
    rows = rows.withColumn("s_", F.explode(F.when(F.col("nth_") == 1, both).otherwise(F.array(scored))))
    return rows.select(entity, "s_.*", *[c for c in beside.columns if c != entity])


def signal_correlations(zs: DataFrame, entity: str, signal: str, order: list[str], z: str = "z") -> DataFrame:
    """(signal_a, signal_b, n, ic, t_stat) over entities that have both, a before b in `order`."""
    at = F.element_at(F.create_map(*[x for i, s in enumerate(order) for x in (F.lit(s), F.lit(i))]), F.col(signal))
    rows = zs.select(entity, signal, z, at.alias("at")).where("at is not null")
    a = rows.select(F.col(entity), F.col(signal).alias("signal_a"), F.col(z).alias("za"), F.col("at").alias("at_a"))
    b = rows.select(F.col(entity), F.col(signal).alias("signal_b"), F.col(z).alias("zb"), F.col("at").alias("at_b"))
    return spearman(a.join(b, entity).where("at_a < at_b"), "za", "zb", ["signal_a", "signal_b"])


def benjamini_hochberg(df: DataFrame, p: str, keys: Iterable[str] = (), out: str = "p_adjusted") -> DataFrame:
    """Step-up adjusted p-values: the running minimum of p m / rank from the largest; null p stays null.

    Equal p have the rank of their last, whose value is the least. Distinct values are ranked by ranges; the minimum runs from the end of
    a range, and the least of the ranges after it is added.
    """
    rows = df.withColumn("key_", _key(keys))
    counts = rows.where(F.col(p).isNotNull()).groupBy("key_", F.col(p).alias("p_")).agg(F.count("*").alias("n_"))
    raw = _below(counts, "p_").withColumn("raw_", F.col("p_") * F.col("total_") / (F.col("below_") + F.col("n_")))
    least = raw.groupBy("part_", "key_").agg(F.min("raw_").alias("least_"))
    after = F.min("least_").over(Window.partitionBy("key_").orderBy(F.desc("part_")).rowsBetween(Window.unboundedPreceding, -1))
    here = F.min("raw_").over(Window.partitionBy("part_", "key_").orderBy(F.desc("p_")).rowsBetween(Window.unboundedPreceding, 0))
    low = raw.join(least.select("part_", "key_", after.alias("after_")), ["part_", "key_"])
    low = low.select(F.col("key_").alias("k_"), "p_", F.least(F.lit(1.0), here, "after_").alias("low_"))
    return rows.join(low, (F.col("key_") == F.col("k_")) & (F.col(p) == F.col("p_")), "left").select(*[c for c in df.columns if c != out], F.col("low_").alias(out))


def rounded_index(n: int, share: float) -> int:
    """The half-even rounded index of an empirical quantile, within bounds."""
    return max(0, min(n - 1, round((n - 1) * share)))


def bootstrap_mean(values: list[float] | np.ndarray, draws: int, confidence: float, seed: int) -> tuple[float, float, float] | None:
    """(low, high, p) of the mean by resampling with the seed plus the sample's size.

    The draws are those of random.Random(seed + size).choices: NumPy's generator continues from its state, some values at a time. Sums
    are taken in extended precision.
    """
    sample, n = np.asarray(values, float), len(values)
    if not n:
        return None
    *state, at = random.Random(seed + n).getstate()[1]
    rng = np.random.RandomState()
    rng.set_state(("MT19937", np.array(state, np.uint32), at))
    drawn = lambda m: sample[(rng.random_sample(m) * n).astype(np.int64)]
    mean = lambda: float(sum(np.add.reduce(drawn(min(DRAWN, n - i)), dtype=np.longdouble) for i in range(0, n, DRAWN))) / n
    return _interval(sorted(mean() for _ in range(draws)), confidence)


def _interval(stats: list[float], confidence: float) -> tuple[float, float, float]:
    n, tail = len(stats), (1 - confidence) / 2
    p = min(1.0, 2 * min(sum(s <= 0 for s in stats), sum(s >= 0 for s in stats)) / n)
    return stats[rounded_index(n, tail)], stats[rounded_index(n, 1 - tail)], p


def bootstrap_by(df: DataFrame, value: str, key: str, order: str, draws: int = 1000, confidence: float = 0.95, seed: int = 17) -> DataFrame:
    """(key, n, mean, low, high, p): a bootstrap for each key's sample.

    One generator draws from the whole sample by definition, so a sample is one task: Spark sorts it, and the task
    holds its values alone, eight bytes each.
    """
    schema = T.StructType([df.schema[key], T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("mean", "low", "high", "p")]])

    def result(name: pa.Scalar, parts: list[np.ndarray]) -> pa.RecordBatch:
        values = np.concatenate(parts)
        ci = bootstrap_mean(values, draws, confidence, seed) or (None, None, None)
        mean = float(np.add.reduce(values, dtype=np.longdouble)) / len(values) if len(values) else None
        row = [pa.array([name.as_py()], name.type), pa.array([len(values)], pa.int64()), *[pa.array([c], pa.float64()) for c in (mean, *ci)]]
        return pa.RecordBatch.from_arrays(row, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, parts = None, []
        for batch in batches:
            runs = batch.column(0).to_pylist()
            x = batch.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *[i for i in range(1, len(runs)) if runs[i] != runs[i - 1]], len(runs)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if name is not None and runs[a] != name.as_py():
                    yield result(name, parts)
                    parts = []
                name = batch.column(0)[a]
                parts.append(x[a:b][~np.isnan(x[a:b])].copy())
        if name is not None:
            yield result(name, parts)

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by range and as many as asked for, so that few samples aren't joined in one
    rows = df.select(key, F.col(value).cast("double").alias("x_"), order).repartitionByRange(tasks, key).sortWithinPartitions(key, F.asc_nulls_last(order))
    return rows.select(key, "x_").mapInArrow(run, schema)


def poisson_thresholds(bits: int = 32, most: int = 14) -> list[int]:
    """The counts of a hash of `bits` bits from which a Poisson weight of mean 1 is at least 1, 2, and so on."""
    total, out = 0.0, []
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        out.append(math.floor(total * 2**bits))
    return out


def bootstrap_large(df: DataFrame, value: str, key: str, row: str, draws: int = 1000, confidence: float = 0.95) -> DataFrame:
    """(key, n, mean, low, high, p): bootstrap intervals of means of samples of any size.

    In each draw a row counts as often as a Poisson weight of mean 1 says, which a hash of the draw and of `row`, the row's
    name, gives; so a draw is two sums, added up in a task before they are shuffled, and a key's sample never meets in one task. One hash
    serves four draws, and all keys of a row that stand in one batch. Null values don't count; a draw of no rows has no mean. What is sorted are a key's draws.
    """
    if draws % 4:
        raise ValueError("draws is a multiple of four")
    thresholds = np.array([t for t in poisson_thresholds() if t < 2**32], np.uint32)
    blocks = [str(b).encode() for b in range(draws // 4)]
    sums = [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("weights_", "sums_")]
    schema = T.StructType([df.schema[key], T.StructField("n_", T.LongType()), T.StructField("x_", T.DoubleType()), *sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            got = list(held.values())
            lists = [pa.array([h[i].tolist() for h in got], pa.list_(pa.float64())) for i in (2, 3)]
            out = pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array([h[0] for h in got], pa.int64()), pa.array([h[1] for h in got], pa.float64()), *lists], names=schema.names)
            held.clear()
            return out

        kind = None
        for whole in batches:
            kind = whole.column(0).type
            for batch in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)):
                rows = batch.column(2).dictionary_encode("encode")  # a row of several keys is hashed once
                tails = [b"" if r is None else b"|" + r.encode() for r in rows.dictionary.to_pylist()]
                hashes = b"".join([hashlib.md5(b + t, usedforsecurity=False).digest() for t in tails for b in blocks])
                weights = np.searchsorted(thresholds, np.frombuffer(hashes, ">u4").astype(np.uint32), "right").reshape(len(tails), draws).astype(float)
                at, names = rows.indices.to_numpy(), batch.column(0).dictionary_encode("encode")
                x, of = batch.column(1).to_numpy(), names.indices.to_numpy()
                for i, name in enumerate(names.dictionary.to_pylist()):
                    mine = np.flatnonzero(of == i)
                    w, h = weights[at[mine]], held.setdefault(name, [0, 0.0, np.zeros(draws), np.zeros(draws)])
                    h[0], h[1] = h[0] + len(mine), h[1] + float(x[mine].sum())
                    h[2] += w.sum(0)
                    h[3] += x[mine] @ w
                if len(held) * draws > HELD_SUMS:
                    yield flush(kind)
        if held:
            yield flush(kind)

    by_task = df.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("x_"), F.col(row).cast("string").alias("row_")).mapInArrow(run, schema)
    whole = F.struct(F.col("n_").cast("double").alias("w"), F.col("x_").alias("s"))  # the first sum is that of the sample itself
    each = F.posexplode(F.concat(F.array(whole), F.zip_with("weights_", "sums_", lambda w, s: F.struct(w.alias("w"), s.alias("s"))))).alias("draw_", "d_")
    by_draw = by_task.select(key, each).groupBy(key, "draw_").agg(F.sum("d_.w").alias("w_"), F.sum("d_.s").alias("s_"))
    means = F.array_sort(F.collect_list(F.when((F.col("draw_") > 0) & (F.col("w_") > 0), F.col("s_") / F.col("w_"))))
    sample = lambda c: F.max(F.when(F.col("draw_") == 0, F.col(c)))
    found = by_draw.groupBy(key).agg(sample("w_").cast("long").alias("n"), sample("s_").alias("whole_"), means.alias("m_"))
    size, tail = F.size("m_"), (1 - confidence) / 2
    at = lambda share: F.try_element_at("m_", F.bround((size - 1) * F.lit(share)).cast("int") + 1)
    under, over = F.size(F.filter("m_", lambda m: m <= 0)), F.size(F.filter("m_", lambda m: m >= 0))
    p = F.least(F.lit(1.0), 2 * F.least(under, over) / size)
    return found.select(key, "n", (F.col("whole_") / F.col("n")).alias("mean"), at(tail).alias("low"), at(1 - tail).alias("high"), p.alias("p"))


def bootstrap_difference(high: list[float], low: list[float], draws: int, confidence: float, rng: random.Random) -> tuple[float, float, float] | None:
    """The interval and p of mean(high) - mean(low); each draw samples high first. The generator is the caller's, shared over windows."""
    if not high or not low:
        return None
    return _interval(sorted(sum(rng.choices(high, k=len(high))) / len(high) - sum(rng.choices(low, k=len(low))) / len(low) for _ in range(draws)), confidence)


def bootstrap_spreads(buckets: DataFrame, windows: list[str], q: int, draws: int = 2000, confidence: float = 0.95, seed: int = 17) -> DataFrame:
    """(window, low, high, p) of top less bottom bucket; one generator runs over the windows in their order.

    buckets has window, bucket, ordinal, outcome. The shared generator makes this one group by definition; its rows are the
    two extreme buckets of one study.
    """
    ends = buckets.where(F.col("bucket").isin(0, q - 1)).withColumn("all_", F.lit(1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng, rows = random.Random(seed), []
        pdf = pdf.sort_values("ordinal")
        for w in windows:
            part = pdf[pdf["window"] == w]
            ci = bootstrap_difference(part[part["bucket"] == q - 1]["outcome"].tolist(), part[part["bucket"] == 0]["outcome"].tolist(), draws, confidence, rng)
            rows.append((w, *(ci or (None, None, None))))
        return pd.DataFrame(rows, columns=["window", "low", "high", "p"])

    return ends.groupBy("all_").applyInPandas(run, "window string, low double, high double, p double")


def ewma(df: DataFrame, value: str, order: str, keys: list[str], weight: float = 0.6) -> DataFrame:
    """(keys, ewma): the running mean that gives each new value `weight`, in order; a series of one key is short."""
    series = F.array_sort(F.collect_list(F.struct(order, value)))
    start = F.element_at(F.col("s_"), 1)[value].cast("double")
    return df.groupBy(*keys).agg(series.alias("s_")).select(*keys, F.aggregate(F.slice("s_", 2, F.greatest(F.size("s_"), F.lit(1))), start, lambda a, x: (1 - weight) * a + weight * x[value]).alias("ewma"))
