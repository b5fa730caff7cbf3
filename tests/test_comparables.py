"""The sweep of comparable filings against all pairs."""

import datetime
import random
import time

from pyspark.sql import functions as F

from quillstone.operators import asof

ROW = "id long, company string, base_form string, period_end date, available_at date, is_amendment boolean, accession string, amends_accession string, at timestamp"
DAY = datetime.date(2015, 1, 1)


def rows_of(seed, n, companies, days):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        amended = rng.random() < 0.2
        out.append((
            i, rng.choice(companies), rng.choice(["10-Q", "10-K", "8-K", None]), None if rng.random() < 0.05 else DAY + datetime.timedelta(rng.randrange(days)),
            None if rng.random() < 0.05 else DAY + datetime.timedelta(rng.randrange(days + 60)), amended, f"a{i}", f"a{rng.randrange(n)}" if amended else None,
            None if rng.random() < 0.1 else datetime.datetime(2015, 1, 1) + datetime.timedelta(rng.randrange(days + 60), rng.randrange(2) * 3600),
        ))
    return out


def brute(rows):
    instant = lambda d: datetime.datetime(d.year, d.month, d.day) if d is not None else None
    out = {}
    for i, company, form, period, _, amended, _, original, at in rows:
        seen = lambda r: at is None or r[4] is not None and instant(r[4]) <= at  # noqa: B023, E731
        held = [r[0] for r in rows if amended and original is not None and r[6] == original and r[1] == company and company is not None and seen(r)]
        earlier = [r for r in rows if r[1] == company and r[2] == form and None not in (company, form, period, r[3]) and r[0] != i and not r[5] and r[3] < period and seen(r)]
        if form == "10-Q":
            key = lambda r: (-abs((r[3] - period).days + 365), r[3], -r[0])  # noqa: B023, E731
        else:
            key = lambda r: (r[3], r[4] or datetime.date.min, r[0])
        best = max(earlier, key=key)[0] if earlier else None
        basis = "amendment_to_original" if held else "none" if best is None else {"10-Q": "same_quarter_prior_year", "10-K": "prior_annual_period"}.get(form, "prior_period")
        out[i] = (min(held) if held else best, basis)
    return out


def test_sweep_against_all_pairs(spark):
    for seed, n, companies, days in ((1, 250, ["a", "b", None], 900), (2, 120, ["a"], 40), (3, 60, ["a", "b"], 3)):
        rows = rows_of(seed, n, companies, days)
        df = spark.createDataFrame(rows, ROW).repartition(5)
        got = {r["id"]: (r["prior_id"], r["basis"]) for r in asof.comparable_filings(df, df, "at").collect()}
        assert got == brute(rows)
    none = spark.createDataFrame([], ROW)
    assert asof.comparable_filings(none, none).count() == 0
    assert {r["basis"] for r in asof.comparable_filings(df, none, "at").collect()} == {"none"}


def test_a_large_company_is_work_in_proportion(spark):
    def seconds(n):
        i = F.col("id")
        day = F.date_add(F.lit("1990-01-01").cast("date"), (F.xxhash64(i) % 9000).cast("int"))
        df = spark.range(n).select(i, F.lit("a").alias("company"), F.when(i % 3 == 0, "10-K").otherwise("10-Q").alias("base_form"), day.alias("period_end"), F.date_add(day, (i % 90).cast("int")).alias("available_at"), F.lit(False).alias("is_amendment"), i.cast("string").alias("accession"), F.lit(None).cast("string").alias("amends_accession"))
        start = time.perf_counter()
        assert asof.comparable_filings(df, df).where("prior_id is not null").count() > 0.9 * n
        return time.perf_counter() - start

    seconds(1000)
    small, large = seconds(50_000), seconds(400_000)
    assert large < 12 * small  # eight times the rows; all pairs would be 64 times the work
