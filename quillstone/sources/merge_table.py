"""A Parquet table that merges rows by key: a merge rewrites the buckets it touches and is published by one rename."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.scratch import path_of
from quillstone.sources.sinks import last_writer, replace_by_keys, upsert, upsert_dominant

Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class MergeTable:
    """Rows by hash of `keys` in `buckets` folders. Each published version is a file that names, for every bucket, the folder that holds it.

    Readers see the last published version. A writer that stops before it publishes leaves files that nobody reads, which vacuum()
    removes. Of two writers that publish the same version the second fails, as its file is there already.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    buckets: int = 64

    def _versions(self) -> list[str]:
        made, fs = path_of(self.spark, f"{self.path}/versions")
        return sorted(x.getPath().getName() for x in fs.listStatus(made) if x.getPath().getName().endswith(".json")) if fs.exists(made) else []

    def manifest(self) -> dict:
        """The last published version: {version, schema, folders by bucket}."""
        names = self._versions()
        if not names:
            return {"version": 0, "schema": None, "folders": {}}
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/versions/{names[-1]}").collect()))

    def _read(self, state: dict, buckets: set[int] | None = None) -> DataFrame:
        folders = sorted({f"{self.path}/data/{f}/bucket={b}" for b, f in state["folders"].items() if buckets is None or int(b) in buckets})
        schema = self.spark.createDataFrame([], state["schema"]).schema
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The rows of the last published version; fails before the first."""
        state = self.manifest()
        if state["schema"] is None:
            raise FileNotFoundError(f"nothing was published in {self.path}")
        return self._read(state)

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def merge(self, new: DataFrame, how: Merge) -> int:
        """Replace the buckets of new's keys by how(their old rows, new), publish, and return the version.

        `new` is written first, so it is computed once. Buckets without a new key are neither read nor written.
        """
        state = self.manifest()
        if state["schema"] is None:
            state["schema"] = new.schema.simpleString()[len("struct<") : -1]
        folder = f"{state['version'] + 1:08d}-{uuid.uuid4().hex}"
        staged = f"{self.path}/staged/{folder}"
        new.withColumn("bucket", self._bucket()).write.parquet(staged)
        fresh = self.spark.read.parquet(staged)
        touched = {r["bucket"] for r in fresh.select("bucket").distinct().collect()}  # buckets at most
        rows = how(self._read(state, touched), fresh.drop("bucket")).withColumn("bucket", self._bucket())
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        made, fs = path_of(self.spark, f"{self.path}/data/{folder}")
        written = {int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(made) if x.getPath().getName().startswith("bucket=")}
        folders = {b: f for b, f in state["folders"].items() if int(b) not in touched} | {str(b): folder for b in written}
        self._publish({"version": state["version"] + 1, "schema": state["schema"], "folders": folders})
        fs.delete(path_of(self.spark, staged)[0], True)
        return state["version"] + 1

    def _publish(self, state: dict) -> None:
        made, fs = path_of(self.spark, f"{self.path}/versions/{state['version']:08d}.json")
        draft, _ = path_of(self.spark, f"{self.path}/versions/draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()
        if fs.exists(made) or not fs.rename(draft, made):
            fs.delete(draft, False)
            raise RuntimeError(f"version {state['version']} of {self.path} was published by another writer")

    def upsert(self, new: DataFrame) -> int:
        """Rows by key; new values win where they aren't null."""
        return self.merge(new, lambda old, fresh: upsert(old, fresh, list(self.keys)))

    def replace(self, new: DataFrame) -> int:
        """All rows of new's keys are replaced by new's."""
        return self.merge(new, lambda old, fresh: replace_by_keys(old, fresh, list(self.keys)))

    def upsert_dominant(self, new: DataFrame, size: str, at: str) -> int:
        """One row a key: the largest, then the newest."""
        return self.merge(new, lambda old, fresh: upsert_dominant(old, fresh, list(self.keys), size, at))

    def last_writer(self, new: DataFrame, at: str) -> int:
        """One row a key: the newest."""
        return self.merge(new, lambda old, fresh: last_writer(old, fresh, list(self.keys), at))

    def delete(self, keys: DataFrame) -> int:
        """Rows of these keys go."""
        return self.merge(keys.select(*self.keys), lambda old, gone: old.join(gone.distinct(), list(self.keys), "left_anti"))

    def vacuum(self) -> int:
        """Remove folders that the last version doesn't name; returns how many. Not to be run beside a writer or a reader of an older version."""
        used, gone = set(self.manifest()["folders"].values()), 0
        for kind in ("data", "staged"):
            made, fs = path_of(self.spark, f"{self.path}/{kind}")
            for x in fs.listStatus(made) if fs.exists(made) else []:
                if kind == "staged" or x.getPath().getName() not in used:
                    fs.delete(x.getPath(), True)
                    gone += 1
        return gone
