"""The landing source: batches, filters that prune, streams with offsets, contents that are read once."""

import os

from pyspark.sql import functions as F

from quillstone.sources import landing


def test_batches_streams_and_unchanged_payloads(spark, tmp_path, monkeypatch):
    spark.dataSource.register(landing.Landing)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    path = str(tmp_path / "landing")
    read = lambda **o: spark.read.format("landing").options(path=path, **o).load()
    assert read().count() == 0
    assert landing.land(path, [("a", b"one"), ("b", b"two"), ("c", b"")]) == 0
    assert landing.land(path, [("a", b"one"), ("b", b"TWO"), ("d", b"one")]) == 1
    assert len(os.listdir(f"{path}/contents")) == 4
    got = {(r["name"], bytes(r["content"]), r["delivery"]) for r in read().collect()}
    assert got == {("a", b"one", 0), ("b", b"TWO", 1), ("c", b"", 0), ("d", b"one", 1)}
    assert read(history="true").count() == 5 and read(contents="false").where("content is null").count() == 4
    # What a filter leaves out isn't opened: its content may be missing.
    os.remove(f"{path}/contents/{read(contents='false').where(F.col('name') == 'b').first()['sha256']}")
    assert [bytes(r["content"]) for r in read().where("name in ('a', 'd')").collect()] == [b"one", b"one"]
    landing.land(path, [("b", b"TWO")])  # unchanged: not listed as changed, though its content is stored again
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def stream():
        rows = spark.readStream.format("landing").option("path", path).load()
        query = rows.select("delivery", "name", F.length("content").alias("n")).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
        return sorted(tuple(r) for r in spark.read.parquet(out).collect())

    first = [(0, "a", 3), (0, "b", 3), (0, "c", 0), (1, "b", 3), (1, "d", 3)]
    assert stream() == first
    assert stream() == first  # nothing new
    landing.land(path, [("a", b"three"), ("c", b"")])
    os.remove(f"{path}/contents/{landing.hashlib.sha256(b'').hexdigest()}")  # unchanged: never opened again
    assert stream() == [*first, (3, "a", 5)]


def test_tasks_by_size(monkeypatch):
    monkeypatch.setattr(landing, "TASK_BYTES", 10)
    entries = [(0, {"name": str(i), "sha256": "", "size": 4, "changed": True}) for i in range(5)] + [(1, {"name": "x", "sha256": "", "size": 100, "changed": True})]
    assert [len(p.rows) for p in landing._pieces(entries, True)] == [2, 2, 1, 1] and len(landing._pieces(entries, False)) == 1
