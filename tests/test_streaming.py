"""Streams over landed files: stateful alignment of events, and what a restart does."""

import datetime
import random

from pyspark.sql import functions as F

from quillstone.operators import asof
from quillstone.streaming import alignment

UTC = datetime.timezone.utc
DAY = datetime.date(2024, 1, 1)


def made(seed):
    rng = random.Random(seed)
    bars = [(t, DAY + datetime.timedelta(i)) for t in "abc" for i in range(90) if rng.random() < 0.6]
    events = [(rng.choice("abcd"), f"e{i}", datetime.datetime(2024, 1, 1, tzinfo=UTC) + datetime.timedelta(rng.randrange(95), rng.randrange(86400))) for i in range(60)]
    amended = [(t, e, at + datetime.timedelta(rng.randrange(-3, 20))) for t, e, at in rng.sample(events, 15)]
    return bars, events, amended


def expected(spark, events, bars):
    """The batch alignment of each event's last availability."""
    last = {}
    for t, e, at in events:
        last[t, e] = max(last.get((t, e), at), at)
    e = spark.createDataFrame([(t, a, at) for (t, a), at in last.items()], "ticker string, accession string, available_at timestamp")
    b = spark.createDataFrame(bars, "ticker string, date date")
    return {(r["ticker"], r["accession"]): r["session_date"] for r in asof.event_sessions(e, b).collect()}


def test_alignment_with_bars_out_of_order_and_a_restart(spark, tmp_path):
    bars, events, amended = made(3)
    late = bars[:]
    random.Random(4).shuffle(late)
    folders = [str(tmp_path / x) for x in ("events", "bars", "out", "checkpoint")]

    def land(kind, rows, schema, n):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folders[kind])

    def run():
        query = alignment.align_files(spark, *folders, files=1)
        assert query.awaitTermination(180) and query.exception() is None
        got = alignment.sessions_of(spark.read.parquet(folders[2])).collect()
        return {(r["ticker"], r["accession"]): r["session_date"] for r in got}

    event, bar = "ticker string, accession string, available_at timestamp", "ticker string, date date"
    half = len(late) // 2
    land(0, events[:40], event, 0)
    land(1, late[:half], bar, 0)
    assert run() == expected(spark, events[:40], late[:half])
    land(1, late[half:] + late[:9], bar, 1)  # bars again, and earlier ones than before
    land(0, events[40:], event, 1)
    land(0, amended, event, 2)
    want = expected(spark, events + amended, late)
    assert run() == want  # restarted from its checkpoint
    before = spark.read.parquet(folders[2]).count()
    assert run() == want and spark.read.parquet(folders[2]).count() == before  # nothing new, nothing added
    revisions = spark.read.parquet(folders[2]).groupBy("accession", "revision").agg(F.count("*").alias("n"))
    assert revisions.where("n > 1").count() == 0
