"""Helpers that several operators share: tables, lineage cuts and distributed prefix sums."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a temporary one in local mode, as in tests; on a cluster, whose machines share no such folder, an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quillstone-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark._jsc.hadoopConfiguration())


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it again, so that a lost executor costs no recomputation of what came before.

    What nobody removed before with drop_cut() is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(made)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of files that nothing reads any more."""
    made, fs = _hadoop_path(spark, path)
    fs.delete(made, True)


def drop_cut(df: DataFrame) -> None:
    """Remove the files of a DataFrame that cut() returned, once nothing reads it any more."""
    for file in df.inputFiles()[:1]:
        remove(df.sparkSession, file.rsplit("/", 1)[0])


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def file_ranks(df: DataFrame, out: str) -> tuple[DataFrame, int]:
    """(df with `out`, number of rows): `out` is the number of rows before this one, in the order of files and of rows in them.

    Files that Spark wrote are ordered by the number of their part, so that a table that was written sorted is ranked as it was
    sorted. Nothing is shuffled: rows are counted by file, which is one row a file for the driver, as in its own file listing.
    A df that isn't read from Parquet files is written first. Columns that df has keep their names; `out` is replaced.
    """
    df = df.drop(out)
    try:
        hidden = df.metadataColumn("_metadata")
        df.select(hidden["file_path"], hidden["row_index"])
    except AnalysisException:
        df = cut(df, "ranked")
        hidden = df.metadataColumn("_metadata")
    path, row, key, before = (free_name(df, x) for x in ("path_", "row_", "file_", "before_"))
    files = df.select(hidden["file_path"].alias(path)).groupBy(path).count().collect()
    part = re.compile(r"part-(\d+)[^/]*$")
    files.sort(key=lambda r: (int(m[1]) if (m := part.search(r[0])) else -1, r[0]))
    offsets, total = [], 0
    for r in files:
        offsets.append((r[0], total))
        total += r[1]
    side = df.sparkSession.createDataFrame(offsets, f"{key} string, {before} long")
    rows = df.select("*", hidden["file_path"].alias(path), hidden["row_index"].alias(row)).join(F.broadcast(side), F.col(path) == F.col(key))
    return rows.withColumn(out, F.col(before) + F.col(row)).drop(path, row, key, before), total


def ordering_hash(*cols: Column) -> Column:
    """A hash for reproducible pseudo-random order: 64 bits of MD5, so that another SQL engine computes the same."""
    joined = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in cols])
    return F.md5(joined.cast("binary"))


def prefix_sums(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, value: Column, out: str, per_key: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Add `out`: the sum of `value` over the rows of the same keys that stand before this one by (bucket, *order).

    A key may hold any share of all rows: sums per (key, bucket) are aggregated map-side, prefixed over the few
    buckets, and joined back, so that each window holds one bucket of one key only. `bucket` must be a
    non-null prefix of the order (e.g. the leading hex digits of an ordering hash). per_key, given (keys, total),
    returns a table by keys whose other columns are added too; it rides on the same join.
    """
    b, v, before = (free_name(df, x) for x in ("bucket_", "value_", "before_"))
    # Keys as non-null pairs, so that the join and the windows share one partitioning and rows are shuffled once.
    kinds = dict(df.dtypes)
    parts = [c for i in range(len(keys)) for c in (free_name(df, f"key{i}_"), free_name(df, f"null{i}_"))]
    made = [x for k in keys for x in (F.coalesce(F.col(k), F.lit("" if kinds[k] == "string" else 0).cast(kinds[k])), F.col(k).isNull())]
    rows = df.withColumns({b: bucket, v: value} | dict(zip(parts, made, strict=True)))
    sums = rows.groupBy(*parts, b).agg(F.sum(v).alias(v), *[F.first(k).alias(k) for k in keys])
    w = Window.partitionBy(*parts).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    side = sums.select(*parts, b, F.coalesce(F.sum(v).over(w), F.lit(0)).alias(before))
    if per_key:
        more = per_key(sums.groupBy(*keys).agg(F.sum(v).alias("total")))
        more = more.withColumns(dict(zip(parts, made, strict=True))).drop(*keys)
        side = side.join(more, parts)
    joined = rows.join(side, [*parts, b])
    local = Window.partitionBy(*parts, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(out, F.col(before) + F.coalesce(F.sum(v).over(local), F.lit(0))).drop(b, v, before, *parts)


def crc32_sql(text: str) -> str:
    """DuckDB's CRC-32 of a short ASCII string, from the rule of the polynomial."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    step = f"xor(c >> 8, ([{', '.join(map(str, table))}]::BIGINT[])[(xor(c, x) & 255) + 1])"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT), lambda c, x: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"
