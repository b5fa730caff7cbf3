"""Ingestion from landed pages to vectors: three streams in a chain, each of which may be stopped and run again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quillstone.operators import passages
from quillstone.sources import html, landing
from quillstone.sources.scratch import path_of

Transform = Callable[[DataFrame], DataFrame]


def stage(rows: DataFrame, target: str, checkpoint: str, keys: list[str], transform: Transform) -> StreamingQuery:
    """Add transform(batch) to `target`, without keys that it has; all that has arrived is worked off, in batches.

    Each batch has a folder of its own, which a batch that is run again writes anew; keys in other folders count as there. So a
    stage that was stopped anywhere and is started with its checkpoint ends as one that wasn't.
    """
    spark = rows.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        made = transform(batch).dropDuplicates(keys)
        at, fs = path_of(spark, target)
        if fs.exists(at) and any(x.getPath().getName() != f"batch={batch_id}" for x in fs.listStatus(at) if x.isDirectory()):
            there = spark.read.schema(T.StructType([*made.schema.fields, T.StructField("batch", T.LongType())])).parquet(target).where(F.col("batch") != batch_id)
            made = made.join(there.select(*keys), keys, "left_anti")
        made.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parse(pages: DataFrame) -> DataFrame:
    """Landed payloads (name, sha256, content) as elements, keyed by document (the content's hash, so unchanged pages are parsed once) and reading order."""
    return html.parse_html(pages.dropDuplicates(["sha256"]).select(F.col("sha256").alias("document"), F.decode("content", "UTF-8").alias("html")), "document")


def chunk(elements: DataFrame) -> DataFrame:
    """Elements as chunks of text and of tables, keyed by their place and numbered chunk_id."""
    keys = ["document", "reading_order"]
    kind = F.col("element_type")
    text = passages.text_chunks(elements.where(kind != "table"), keys, "text").select(*keys, "chunk_index", F.lit("text").alias("chunk_type"), "chunk_text")
    tables = passages.table_chunks(elements.where(kind == "table"), keys, "markdown", "headers", "row_count", "column_count", "section").select(*keys, "chunk_index", "chunk_type", "chunk_text")
    return text.unionByName(tables).withColumn("chunk_id", F.sha2(F.concat_ws("/", *keys, "chunk_index").cast("binary"), 256))


def ingest(spark: SparkSession, pages: str, root: str, embed: Transform, files: int = 100) -> None:
    """Bring everything in the landing folder `pages` up to vectors: root/elements, root/chunks, root/vectors.

    Three streams run one after another, each reading what the one before added; what is up to date isn't touched. `embed` adds vectors to
    chunks. A failing stage fails the call; calling again goes on from there.
    """
    spark.dataSource.register(landing.Landing)
    landed = spark.readStream.format("landing").option("path", pages).load()
    steps: list[tuple[str, list[str], Transform]] = [("elements", ["document", "reading_order"], parse), ("chunks", ["chunk_id"], chunk), ("vectors", ["chunk_id"], embed)]
    before = None
    for name, keys, transform in steps:
        if before is None:
            source = landed
        else:
            folder, fs = path_of(spark, f"{root}/{before}")
            if not fs.exists(folder):
                return  # nothing has landed yet
            schema = spark.read.parquet(f"{root}/{before}").drop("batch").schema
            source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{root}/{before}/batch=*")
        query = stage(source, f"{root}/{name}", f"{root}/checkpoints/{name}", keys, transform)
        query.awaitTermination()
        before = name
