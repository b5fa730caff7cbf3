"""Sinks and table maintenance: panels, merges by key, snapshots and caches, as rewrites of Parquet tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillstone.functions.numbers import canonical_json


def flat_panel(panel: DataFrame) -> DataFrame:
    """Maps as JSON with sorted keys, arrays and structs as JSON; other columns stay."""
    def one(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.MapType):
            return canonical_json(F.col(f.name)).alias(f.name)
        return F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType)) else F.col(f.name)
    return panel.select(*[one(f) for f in panel.schema.fields])


def write_panel(panel: DataFrame, path: str, kind: str = "parquet") -> None:
    if kind not in ("json", "csv", "parquet"):
        raise ValueError(f"unknown format {kind!r}")
    out = flat_panel(panel).write.mode("overwrite")
    {"json": out.json, "csv": out.option("header", True).csv, "parquet": out.parquet}[kind](path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new's columns win where they aren't null; keys of either side stay."""
    a, b = old.withColumn("old_", F.lit(True)), new.withColumn("new_", F.lit(True))
    joined = a.alias("a").join(b.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full")
    return joined.select(*[F.coalesce(f"b.{c}", f"a.{c}").alias(c) if c in new.columns else F.col(f"a.{c}") for c in old.columns])


def replace_by_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without new's keys, and new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def _whole(df: DataFrame) -> Column:
    """A row as text: the last key of a total order."""
    return F.to_json(F.struct(*sorted(df.columns)))


def upsert_dominant(old: DataFrame, new: DataFrame, keys: list[str], size: str, at: str) -> DataFrame:
    """One row a key: that with the largest size, the newer on ties, then the last by its columns as JSON."""
    w = Window.partitionBy(*keys).orderBy(F.desc(size), F.desc(at), F.desc(_whole(old)))
    return old.unionByName(new).withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def last_writer(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row a key: the newest, then the last by its columns as JSON."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(_whole(old)))
    return old.unionByName(new).withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def append_runs(df: DataFrame, path: str) -> None:
    """Append trace rows of retrievals, answers or ingestions."""
    df.write.mode("append").parquet(path)


def latest_manifest(runs: DataFrame, key: str = "run_key", at: str = "recorded_at") -> DataFrame:
    """The last state of each run in an append-only manifest."""
    return runs.withColumn("n_", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).where("n_ = 1").drop("n_")


def fresh(snapshots: DataFrame, now: Column, seconds: int, at: str = "refreshed_at") -> DataFrame:
    """Snapshots that are at most `seconds` old, to the microsecond."""
    return snapshots.where(F.unix_micros(now) - F.unix_micros(F.col(at).cast("timestamp")) <= seconds * 1_000_000)


def prune_snapshots(snapshots: DataFrame, keep: int = 128, key: str = "metric_key", at: str = "refreshed_at") -> DataFrame:
    """The newest `keep` of each key prefix (up to the first colon)."""
    w = Window.partitionBy(F.substring_index(key, ":", 1)).orderBy(F.desc(at), F.desc(key))
    return snapshots.withColumn("n_", F.row_number().over(w)).where(F.col("n_") <= keep).drop("n_")


def delete_prefix(snapshots: DataFrame, prefix: str, key: str = "metric_key") -> DataFrame:
    return snapshots.where(~F.col(key).startswith(prefix))


def answer_key(version: str, question: Column) -> Column:
    """SHA-256 of a configuration version and a normalised question."""
    from quillstone.functions.text import normalise

    return F.sha2(F.concat_ws("\u001f", F.lit(version), normalise(question)).cast("binary"), 256)


def cacheable(answers: DataFrame) -> DataFrame:
    """Abstentions are never cached."""
    return answers.where(~F.col("abstained"))


def query_key(prefix: str, query: dict) -> str:
    """prefix and the first 32 hex digits of the SHA-256 of canonical JSON."""
    return prefix + hashlib.sha256(json.dumps(query, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:32]


def report_markdown(report: DataFrame, columns: list[str]) -> str:
    """A Markdown table of a report of few rows (one a variant or window); more than 1,000 are refused."""
    rows = report.select(*columns).limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("a report has at most 1,000 rows; write more as a table")
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *[line(["" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r]) for r in rows]])
