"""Incremental ingestion with Structured Streaming: missing-only indexing, late amendments by policy, events beside a calendar."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstone.operators.asof import event_target_date
from quillstone.operators.facts import restatement_policy


def index_missing(spark: SparkSession, landing: str, schema: str, index: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame], key: str = "chunk_id", files: int = 100) -> StreamingQuery:
    """Index the landed rows that the index hasn't, batch by batch; a batch that is run again adds nothing.

    Each batch is one append of rows by an anti-join on the index's keys.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.dropDuplicates([key])
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(index)
        if at.getFileSystem(conf).exists(at):
            rows = rows.join(spark.read.parquet(index).select(key), key, "left_anti")
        embed(rows).write.mode("append").parquet(index)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(landing)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def restated_view(facts: DataFrame, policy: str, keys: list[str], filed: str, tie: list[str]) -> DataFrame:
    """Late restatements are resolved by policy over all that has arrived; a watermark would drop them instead."""
    return restatement_policy(facts, policy, keys, filed, tie)


def stream_targets(events: DataFrame, zone: str = "America/New_York", close: str = "16:00:00") -> DataFrame:
    """Streaming events with the date from which their session is sought."""
    return events.withColumn("target_date", event_target_date(F.col("available_at"), zone, close))


def tumbling(events: DataFrame, at: str, width: str, key: str, late: str | None = None) -> DataFrame:
    """(window_start, key, n, total) by tumbling windows; with `late`, a watermark for streams."""
    rows = events.withColumn("at_", F.col(at).cast("timestamp"))
    if late:
        rows = rows.withWatermark("at_", late)
    out = rows.groupBy(F.window("at_", width), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, at: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    """(key, session_start, n) of runs of events closer than the gap."""
    rows = events.withColumn("at_", F.col(at).cast("timestamp"))
    if late:
        rows = rows.withWatermark("at_", late)
    out = rows.groupBy(F.session_window("at_", gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("session_start"), "n")
