"""Events that wait for their trading session: a stateful stream of bars and events, late bars and amended events included."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quillstone.operators.asof import event_target_date

ALIGNED = "ticker string, accession string, target_date date, session_date date, revision long"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SessionAligner(StatefulProcessor):
    """Per ticker: the dates of its bars, and of each event its availability, target date, session date and revision.

    An event's session is the first bar on or after its target date. A bar that comes late may be an earlier session, and an
    event that comes again with a later availability replaces itself; both give a row with the next revision. An
    event without a bar yet waits and gives none, or a row without a session if it had one before. What a micro-batch brings of a
    ticker is merged by sorting, not pair by pair.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bars = handle.getMapState("bars", "day long", "known boolean")
        self.events = handle.getMapState("events", "accession string", "available long, target long, session long, revision long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        days, arrived = set(), {}
        for pdf in rows:
            bars = pdf[pdf["is_bar"]]
            days.update(bars["day"].tolist())
            for accession, available, day in pdf.loc[~pdf["is_bar"], ["accession", "available", "day"]].itertuples(index=False, name=None):
                seen = (int(available), int(day))  # pandas holds a column with nulls as floats, exact for these
                arrived[accession] = max(arrived.get(accession, seen), seen)
        new_days = sorted(d for d in days if not self.bars.containsKey((d,)))
        for d in new_days:
            self.bars.updateValue((d,), (True,))
        out = []

        def first(days_: list[int], target: int) -> int | None:
            i = bisect_left(days_, target)
            return days_[i] if i < len(days_) else None

        def keep(accession: str, available: int, target: int, session: int | None, revision: int, changed: bool) -> None:
            self.events.updateValue((accession,), (available, target, session, revision + changed))
            if changed:
                out.append((key[0], accession, target, session, revision + 1))

        if new_days:  # events that wait, or whose session is later than one of the new bars
            for (accession,), (available, target, session, revision) in list(self.events.iterator()):
                found = first(new_days, target)
                if accession not in arrived and found is not None and (session is None or found < session):
                    keep(accession, available, target, found, revision, True)
        if arrived:
            every = sorted(d for (d,) in self.bars.keys())
            for accession, (available, target) in sorted(arrived.items()):
                old = self.events.getValue((accession,)) if self.events.containsKey((accession,)) else None
                if old is not None and old[0] > available:
                    available, target = old[0], old[1]
                found = first(every, target)
                before = (old[1], old[2]) if old else (target, None)
                keep(accession, available, target, found, old[3] if old else 0, (target, found) != before and (found is not None or before[1] is not None))
        if out:
            yield pd.DataFrame(
                [(t, a, pd.Timestamp(target, unit="D").date(), None if session is None else pd.Timestamp(session, unit="D").date(), r) for t, a, target, session, r in out],
                columns=["ticker", "accession", "target_date", "session_date", "revision"],
            )

    def close(self) -> None:
        pass


def merged(events: DataFrame, bars: DataFrame, zone: str = "America/New_York", close: str = "16:00:00") -> DataFrame:
    """Events (ticker, accession, available_at) and bars (ticker, date) as one stream of (ticker, is_bar, accession, available, day)."""
    at = F.unix_micros(F.col("available_at"))
    left = events.select("ticker", F.lit(False).alias("is_bar"), "accession", at.alias("available"), F.unix_date(event_target_date(F.col("available_at"), zone, close)).cast("long").alias("day"))
    right = bars.select("ticker", F.lit(True).alias("is_bar"), F.lit(None).cast("string").alias("accession"), F.lit(None).cast("long").alias("available"), F.unix_date("date").cast("long").alias("day"))
    return left.where("ticker is not null and accession is not null and available is not null").unionByName(right.where("ticker is not null and day is not null"))


def aligned(events: DataFrame, bars: DataFrame, zone: str = "America/New_York", close: str = "16:00:00") -> DataFrame:
    """Revisions (ticker, accession, target_date, session_date, revision) of a streaming alignment; the last revision of an event counts."""
    rows = merged(events, bars, zone, close)
    return rows.groupBy("ticker").transformWithStateInPandas(SessionAligner(), ALIGNED, "Update", "None")


def align_files(spark: SparkSession, events_dir: str, bars_dir: str, out: str, checkpoint: str, files: int = 1000) -> StreamingQuery:
    """Read landed Parquet files of events and bars, align what is new, and add revisions to `out`; a batch that is run again adds nothing.

    Started again with the same checkpoint it goes on where it stopped.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    events = spark.readStream.schema("ticker string, accession string, available_at timestamp").option("maxFilesPerTrigger", files).parquet(events_dir)
    bars = spark.readStream.schema("ticker string, date date").option("maxFilesPerTrigger", files).parquet(bars_dir)

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return aligned(events, bars).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions_of(revisions: DataFrame) -> DataFrame:
    """(ticker, accession, target_date, session_date): each event's last revision, if it has a session."""
    last = revisions.groupBy("ticker", "accession").agg(F.max_by(F.struct("target_date", "session_date"), "revision").alias("s"))
    return last.select("ticker", "accession", "s.target_date", "s.session_date").where("session_date is not null")
