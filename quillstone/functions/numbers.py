"""Numeric, date, map and JSON expressions with the guards that the studies rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cut6(x: Column) -> Column:
    """To six decimals by floor(x + half), the same in any engine with IEEE doubles."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def ratio(a: Column, b: Column) -> Column:
    """a / b in double; null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def growth(now: Column, before: Column) -> Column:
    return F.try_divide(now.cast("double") - before.cast("double"), F.abs(before.cast("double")))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def canonical_json(m: Column) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def parse_instant(s: Column) -> Column:
    """ISO date-times with Z or an offset; null for junk."""
    return F.try_to_timestamp(F.regexp_replace(s, "Z$", "+00:00"))


def period_label(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def parse_vector(s: Column) -> Column:
    """'[1,2]' or 'Name([1,2])' as an array of doubles."""
    return F.from_json(F.regexp_extract(s, r"(\[[^\]]*\])", 1), "array<double>")


def token_estimate(s: Column) -> Column:
    """White-space words, at least one."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(F.coalesce(s, F.lit("")), r"\s+"), lambda w: w != "")))


def delay_days(available_at: Column, period_end: Column) -> Column:
    return F.datediff(available_at, period_end)


def groups_of(values: Column, n: int) -> Column:
    """An array cut into arrays of n; the last may be shorter; an empty array gives none."""
    size = F.size(values)
    return F.when(size > 0, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1)), F.lit(n)), lambda i: F.slice(values, i, n))).otherwise(F.array())
