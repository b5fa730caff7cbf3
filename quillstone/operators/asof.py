"""Point-in-time operators: visibility, amendments, comparable filings, lineage, sessions and leakage guards."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def visible(df: DataFrame, as_of: Column | str, available: str = "available_at") -> DataFrame:
    """Rows that are known at as_of; a null availability is never known."""
    at = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    return df.where(F.col(available) <= at)


def amendment_policy(df: DataFrame, policy: str = "exclude", flag: str = "is_amendment") -> DataFrame:
    """include: all; exclude: originals; only: amendments."""
    if policy not in ("include", "exclude", "only"):
        raise ValueError(f"unknown amendment policy {policy!r}")
    return df if policy == "include" else df.where(F.col(flag) == (policy == "only"))


@dataclass(frozen=True)
class SearchFilters:
    """Predicates of a search; an empty list is no predicate; ranges are closed; time stamps carry a zone."""

    tickers: tuple[str, ...] = ()
    ciks: tuple[str, ...] = ()
    forms: tuple[str, ...] = ()
    sections: tuple[str, ...] = ()
    element_types: tuple[str, ...] = ()
    chunk_types: tuple[str, ...] = ()
    filed_from: date | None = None
    filed_to: date | None = None
    accepted_from: datetime | None = None
    accepted_to: datetime | None = None
    as_of: datetime | None = None
    amendments: str = "include"

    def __post_init__(self):
        for name in ("accepted_from", "accepted_to", "as_of"):
            at = getattr(self, name)
            if at is not None and at.tzinfo is None:
                raise ValueError(f"{name} needs a time zone")

    def apply(self, df: DataFrame) -> DataFrame:
        """The conjunction, pushed to the scan by Catalyst; rows without a value fail a range."""
        lists = {"ticker": self.tickers, "cik": self.ciks, "form_type": self.forms, "section": self.sections, "element_type": self.element_types, "chunk_type": self.chunk_types}
        for column, wanted in lists.items():
            if wanted:
                df = df.where(F.col(column).isin(list(wanted)))
        for column, low, high in (("filing_date", self.filed_from, self.filed_to), ("accepted_at", self.accepted_from, self.accepted_to)):
            if low is not None:
                df = df.where(F.col(column) >= F.lit(low))
            if high is not None:
                df = df.where(F.col(column) <= F.lit(high))
        if self.as_of is not None:
            df = df.where(F.col("available_at") <= F.lit(self.as_of))
        return amendment_policy(df, self.amendments)


    def apply_metadata(self, df: DataFrame, metadata: str = "metadata") -> DataFrame:
        """The same conjunction on a column of JSON text, or of VARIANT, that holds ticker, cik, form_type, element_type, filing_date, accepted_at, available_at
        and is_amendment; section and chunk_type are columns of df.

        A value that is missing or isn't a string of a date or instant (offset or Z, else UTC) fails a range; text that isn't JSON is as an empty object.
        """
        tree = F.col(metadata) if dict(df.dtypes)[metadata] == "variant" else F.try_parse_json(metadata)
        said = lambda name: F.when(F.schema_of_variant(F.try_variant_get(tree, f"$.{name}", "variant")) == "STRING", F.try_variant_get(tree, f"$.{name}", "string"))
        zoned = lambda c: F.when(c.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), c).otherwise(F.concat(c, F.lit("Z")))
        instant = lambda name: F.try_to_timestamp(F.when(said(name).rlike("T| .*:"), zoned(said(name))).otherwise(F.concat(said(name), F.lit("T00:00:00Z"))))
        day = F.when(said("filing_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_variant_get(tree, "$.filing_date", "date"))
        for name, wanted in {"ticker": self.tickers, "cik": self.ciks, "form_type": self.forms, "element_type": self.element_types}.items():
            if wanted:
                df = df.where(said(name).isin(list(wanted)))
        for name, wanted in {"section": self.sections, "chunk_type": self.chunk_types}.items():
            if wanted:
                df = df.where(F.col(name).isin(list(wanted)))
        for value, low, high in ((day, self.filed_from, self.filed_to), (instant("accepted_at"), self.accepted_from, self.accepted_to), (instant("available_at"), None, self.as_of)):
            if low is not None:
                df = df.where(value >= F.lit(low))
            if high is not None:
                df = df.where(value <= F.lit(high))
        if self.amendments == "include":
            return df
        flagged = F.coalesce(F.try_variant_get(tree, "$.is_amendment", "boolean"), F.lit(False))
        return df.where(flagged == (self.amendments == "only"))


def latest_filing(df: DataFrame, keys: list[str], filed: str = "filing_date", tie: tuple[str, ...] = ("accepted_at", "id")) -> DataFrame:
    """The newest row of each key, by filing date and then `tie`, nulls oldest."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(filed), *[F.desc_nulls_last(t) for t in tie])
    return df.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def latest_filing_bounds(query: str, filters: SearchFilters, filings: DataFrame, chunks: DataFrame) -> SearchFilters:
    """A question for the latest filing of one ticker and one form gets that filing's date as both bounds.

    Only filings with a chunk count, under the filters' as_of and amendment policy. One date comes to the driver.
    """
    import re
    from dataclasses import replace

    if not re.search(r"\b(latest|most recent|last)\b", query, re.I) or len(filters.tickers) != 1 or len(filters.forms) != 1 or filters.filed_from or filters.filed_to:
        return filters
    known = filters.apply(filings).join(chunks.select(F.col("document_id").alias("id")), "id", "left_semi")
    newest = known.agg(F.max("filing_date").alias("d")).first()["d"]
    return replace(filters, filed_from=newest, filed_to=newest) if newest else filters


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Answer each question with the last candidate before it whose availability is within the question's.

    Rows are sorted by group and place. A candidate that comes later and is known no later makes those before it useless, so the
    candidates that are kept rise in availability and the answer is found by bisection. Kept are three numbers a candidate of one group.
    """
    group, known, ids, periods = None, [], [], []
    for pdf in batches:
        out = []
        columns = (pdf[c].tolist() for c in ("company", "base_form", "way", "asks", "id", "seen", "period"))
        for company, form, way, asks, id_, seen, period in zip(*columns, strict=True):
            if (company, form, way) != group:
                group, known, ids, periods = (company, form, way), [], [], []
            if asks:
                i = bisect_right(known, seen)
                if i:
                    out.append((id_, form, period, ids[i - 1], periods[i - 1]))
            else:
                while known and known[-1] >= seen:
                    known.pop()
                    ids.pop()
                    periods.pop()
                known.append(seen)
                ids.append(id_)
                periods.append(period)
        yield pd.DataFrame(out, columns=["id", "base_form", "period", "prior_id", "prior_period"])


def comparable_filings(current: DataFrame, candidates: DataFrame, as_of: str = "available_at") -> DataFrame:
    """For each current filing the one it is to be compared with: (id, prior_id, basis).

    An amendment is compared with its original if that is visible. Otherwise with an earlier period of the same company and
    base form that isn't an amendment and is visible at the current row's `as_of` (null: everything is): for
    10-Q the one nearest to a year before, the later and the smaller id on ties; for others the latest period, then availability, then id.
    Both tables have id, company, base_form, period_end, available_at, is_amendment, accession, amends_accession; an id has one period.

    Period and availability are merged by one sort of both tables within (company, base form) and a sweep, so a company's work
    is in proportion to its filings. The filing nearest to a year before is the last one up to that day or, in a sweep the other way, the first after it.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    always, quarter, day = F.lit((1 << 63) - 1), F.col("base_form") == "10-Q", F.unix_date(F.col("period_end").cast("date")).cast("long")
    seen = F.col("at").isNull() | (F.col("p_available") <= F.col("at"))
    c = current.select("id", "company", "base_form", "period_end", "is_amendment", "amends_accession", F.col(as_of).alias("at"))
    p = candidates.select(F.col("id").alias("prior_id"), F.col("company").alias("p_company"), F.col("available_at").alias("p_available"), F.col("accession").alias("p_accession"))
    originals = c.where("is_amendment and amends_accession is not null").join(p, (c.amends_accession == p.p_accession) & (c.company == p.p_company) & seen)
    originals = originals.groupBy("id").agg(F.min("prior_id").alias("original_id"))
    # A day is an odd place, so that questions stand between days. Of one day the candidate that is to be preferred comes last.
    ways = F.when(quarter, F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1)))
    whole = "company is not null and base_form is not null and period_end is not null"
    held = candidates.where(whole).where(~F.col("is_amendment")).select("company", "base_form", F.explode(ways).alias("way"), F.lit(False).alias("asks"), "id", F.coalesce(micros("available_at"), always).alias("seen"), day.alias("period"), (2 * day + 1).alias("place"),
        F.when(quarter, 0).otherwise(F.coalesce(micros("available_at"), -always)).alias("first"), F.when(quarter, -F.col("id")).otherwise(F.col("id")).alias("second"))
    asked = current.where(whole).select("company", "base_form", F.explode(ways).alias("way"), F.lit(True).alias("asks"), "id", F.coalesce(micros(as_of), always).alias("seen"), day.alias("period"),
        F.when(quarter, 2 * (day - 365) + 2).otherwise(2 * day).alias("place"), F.lit(0).cast("long").alias("first"), F.col("id").alias("second"))
    rows = held.unionByName(asked).withColumn("place", F.col("place") * F.col("way"))
    rows = rows.repartition("company", "base_form", "way").sortWithinPartitions("company", "base_form", "way", "place", "first", "second")
    id_type = dict(current.dtypes)["id"]
    found = rows.select("company", "base_form", "way", "asks", "id", "seen", "period").mapInPandas(_sweep, f"id {id_type}, base_form string, period long, prior_id {dict(candidates.dtypes)['id']}, prior_period long")
    near = F.when(quarter, -F.abs(F.col("prior_period") - F.col("period") + 365)).otherwise(0)
    best = found.where("prior_period < period and prior_id <> id").groupBy("id").agg(F.max_by("prior_id", F.struct(near, "prior_period")).alias("best_id"))
    out = c.join(originals, "id", "left").join(best, "id", "left")
    label = F.when(F.col("original_id").isNotNull(), "amendment_to_original").when(F.col("best_id").isNull(), "none").when(quarter, "same_quarter_prior_year").when(F.col("base_form") == "10-K", "prior_annual_period").otherwise("prior_period")
    return out.select("id", F.coalesce("original_id", "best_id").alias("prior_id"), label.alias("basis"))


def amendment_lineage(filings: DataFrame) -> DataFrame:
    """filings with amends_accession: an amendment's original has its base form and period; the last by acceptance and id wins. Others get null."""
    originals = filings.where("not is_amendment").groupBy(F.col("company").alias("o_company"), F.col("form_type").alias("o_form"), F.col("period_end").alias("o_period"))
    originals = originals.agg(F.max_by("accession", F.struct("available_at", "id")).alias("o_accession"))
    joined = filings.drop("amends_accession").join(originals, F.col("is_amendment") & (F.col("company") == F.col("o_company")) & (F.col("base_form") == F.col("o_form")) & (F.col("period_end") == F.col("o_period")), "left")
    return joined.withColumn("amends_accession", F.col("o_accession")).drop("o_company", "o_form", "o_period", "o_accession")


def event_target_date(at: Column, zone: str = "America/New_York", close: str = "16:00:00") -> Column:
    """The local date of an instant, or the next one from the close on."""
    local = F.from_utc_timestamp(at, zone)
    return F.date_add(F.to_date(local), F.when(F.date_format(local, "HH:mm:ss") >= close, 1).otherwise(0))


def session_index(bars: DataFrame, ticker: str = "ticker", day: str = "date") -> DataFrame:
    """bars with session: the position of each bar in its ticker's dates, from 0."""
    return bars.withColumn("session", F.row_number().over(Window.partitionBy(ticker).orderBy(day)) - 1)


def event_sessions(events: DataFrame, bars: DataFrame, zone: str = "America/New_York", close: str = "16:00:00") -> DataFrame:
    """events with session and session_date: the first bar of their ticker on or after the event's target date; events without one go.

    A forward as-of join by one sort of bars and of the distinct target dates: in descending order of date, each date takes the last bar
    seen. So a ticker's window has its days, not its events, which meet their date's bar by equality. There is no bound on the gap.
    """
    e = events.withColumn("target_", event_target_date(F.col("available_at"), zone, close))
    left = e.select("ticker", F.col("target_").alias("d_"), F.lit(0).alias("is_bar"), F.lit(None).cast("struct<session:int,session_date:date>").alias("b_")).distinct()
    right = session_index(bars).select("ticker", F.col("date").alias("d_"), F.lit(1).alias("is_bar"), F.struct("session", F.col("date").alias("session_date")).alias("b_"))
    w = Window.partitionBy("ticker").orderBy(F.desc("d_"), F.desc("is_bar")).rowsBetween(Window.unboundedPreceding, 0)
    days = left.unionByName(right).withColumn("found", F.last("b_", ignorenulls=True).over(w)).where("is_bar = 0 and found is not null")
    days = days.select(F.col("ticker").alias("t_"), F.col("d_"), "found.*")
    return e.join(days, F.col("ticker").eqNullSafe(F.col("t_")) & F.col("target_").eqNullSafe(F.col("d_"))).select(*events.columns, "session", "session_date")


def guard_leakage(df: DataFrame, source: str = "max_source_available_at", available: str = "available_at") -> DataFrame:
    """df itself; the job fails on a row whose sources became known after the row."""
    late = F.col(source) > F.col(available)
    return df.where(F.when(late, F.raise_error(F.lit("a source is later than its row"))).otherwise(F.lit(True)).cast("boolean"))
