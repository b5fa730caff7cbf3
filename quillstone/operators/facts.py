"""Typed financial facts: canonical metrics, restatements, picks and growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Concepts of each metric in order of priority, and other names of units.
CONCEPTS = {
    "revenue": ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet"),
    "operating_income": ("OperatingIncomeLoss",),
    "net_income": ("NetIncomeLoss", "ProfitLoss"),
    "eps": ("EarningsPerShareDiluted", "EarningsPerShareBasic"),
    "cash": ("CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"),
    "debt": ("LongTermDebtAndFinanceLeaseObligationsCurrent", "LongTermDebtCurrent", "LongTermDebtNoncurrent"),
    "shares": ("WeightedAverageNumberOfDilutedSharesOutstanding",),
    "capex": ("PaymentsToAcquirePropertyPlantAndEquipment",),
    "operating_cash_flow": ("NetCashProvidedByUsedInOperatingActivities",),
}
UNITS = {"USD/shares": "USD/share", "pure": "ratio"}


def canonical_metric(taxonomy: Column, concept: Column) -> Column:
    """The metric of a us-gaap concept; null for others."""
    names = F.create_map(*[F.lit(x) for metric, cs in CONCEPTS.items() for c in cs for x in (c, metric)])
    return F.when(taxonomy == "us-gaap", F.try_element_at(names, concept))


def concept_priority(concept: Column) -> Column:
    at = F.create_map(*[F.lit(x) for cs in CONCEPTS.values() for i, c in enumerate(cs) for x in (c, i)])
    return F.coalesce(F.try_element_at(at, concept), F.lit(99))


def canonical_unit(unit: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), unit), unit)


def restatement_flags(facts: DataFrame, keys: list[str], filed: str, tie: list[str], value: str) -> DataFrame:
    """facts with is_restatement: the value differs from that filed before for the same keys; null dates first."""
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_first(filed), *[F.asc(t) for t in tie])
    return facts.withColumn("is_restatement", F.coalesce(F.col(value) != F.lag(value).over(w), F.lit(False)))


def restatement_policy(facts: DataFrame, policy: str, keys: list[str], filed: str, tie: list[str]) -> DataFrame:
    """latest: the newest filing of each key; as_reported: the first; all: everything."""
    if policy == "all":
        return facts
    if policy not in ("latest", "as_reported"):
        raise ValueError(f"unknown restatement policy {policy!r}")
    order = [F.desc_nulls_last(filed), *[F.desc(t) for t in tie]] if policy == "latest" else [F.asc_nulls_first(filed), *[F.asc(t) for t in tie]]
    return facts.withColumn("n_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("n_ = 1").drop("n_")


def query_facts(facts: DataFrame, policy: str, limit: int, keys: list[str], order: list[Column], filed: str, tie: list[str]) -> DataFrame:
    """The first 4 limit rows in `order`, then the policy, then the first `limit` by first-seen key, with ordinal.

    The limit before the policy is part of the result's meaning; the rows after it are at most 4 limit.
    """
    first = facts.orderBy(*order).limit(4 * limit)
    seen = first.withColumn("at_", F.row_number().over(Window.orderBy(*order)))
    kept = restatement_policy(seen.withColumn("key_at_", F.min("at_").over(Window.partitionBy(*keys))), policy, keys, filed, tie)
    place = F.row_number().over(Window.orderBy("key_at_", "at_"))
    return kept.withColumn("ordinal", place).where(F.col("ordinal") <= limit).drop("at_", "key_at_")


def canonical_pick(facts: DataFrame, document: str, metric: str, priority: Column, tie: list[str]) -> DataFrame:
    """One fact a document and metric: lowest priority, then tie."""
    w = Window.partitionBy(document, metric).orderBy(priority, *[F.asc(t) for t in tie])
    return facts.where(F.col(metric).isNotNull()).withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def latest_two(facts: DataFrame, keys: list[str], period: str, value: str, tie: list[str]) -> DataFrame:
    """(keys, latest, prior): values of the two newest distinct periods; of equal periods the first by tie."""
    one = facts.withColumn("n_", F.row_number().over(Window.partitionBy(*keys, period).orderBy(*[F.asc(t) for t in tie]))).where("n_ = 1")
    nth = one.withColumn("p_", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(period)))).where("p_ <= 2")
    return nth.groupBy(*keys).agg(F.max(F.when(F.col("p_") == 1, F.col(value))).alias("latest"), F.max(F.when(F.col("p_") == 2, F.col(value))).alias("prior"))


def first_narratives(chunks: DataFrame, document: str, key: str, text: str, least_words: int = 5) -> DataFrame:
    """(document, narrative): each document's first chunk with enough words."""
    enough = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) >= least_words
    return chunks.where(enough).groupBy(document).agg(F.min_by(text, key).alias("narrative"))


def fundamental_signals(wide: DataFrame) -> DataFrame:
    """(accession, signal, value): from latest and prior values of a filing's metrics; nulls where undefined.

    earnings quality (net income - operating cash flow) / assets, asset growth, net share issuance; a signal is the metric's negative.
    """
    d = lambda c: F.col(c).cast("double")
    quality = F.try_divide(d("net_income") - d("operating_cash_flow"), F.when(d("assets") > 0, d("assets")))
    grow = lambda now, old: F.when(d(old) > 0, F.try_divide(d(now), d(old)) - 1)
    pairs = (("earnings_quality", quality), ("asset_growth", grow("assets", "prior_assets")), ("net_share_issuance", grow("shares", "prior_shares")))
    return wide.select("accession", F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), (-v).alias("value")) for n, v in pairs])).alias("s")).select("accession", "s.*")
