"""Event, signal, volatility and composite studies over bars and filing events."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.operators import stats
from quillstone.operators.asof import event_sessions, guard_leakage, session_index


@dataclass(frozen=True)
class StudyConfig:
    benchmark: str = "SPY"
    windows: tuple[tuple[int, int], ...] = ((0, 1), (-1, 1), (0, 5))
    draws: int = 1000
    confidence: float = 0.95
    seed: int = 17
    zone: str = "America/New_York"
    close: str = "16:00:00"
    splits: tuple[str, ...] = ()


def config_key(kind: str, config: StudyConfig, **more: object) -> str:
    """SHA-256 of the canonical JSON of what a study depends on."""
    text = json.dumps({"kind": kind, "config": asdict(config), **more}, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def window_name(w: tuple[int, int]) -> str:
    return f"{w[0]}:{w[1]}"


def event_returns(events: DataFrame, bars: DataFrame, config: StudyConfig = StudyConfig(), key: str = "accession") -> DataFrame:
    """A row for each event and window whose bars exist: key, ticker, window, session, session_date, asset, benchmark and abnormal return, feature_value.

    Windows are positions in the asset's own bars; the benchmark needs bars on exactly the two dates. Windows are exploded
    and joined by position, so each leg is an equi-join. Fails on leakage if events have max_source_available_at.
    """
    rows = window_returns(placed_events(events, bars, config), bars, config)
    return rows.select(key, "ticker", "window", "session", "session_date", "feature_value", "asset_return", "benchmark_return", "abnormal_return")


def placed_events(events: DataFrame, bars: DataFrame, config: StudyConfig = StudyConfig()) -> DataFrame:
    """events with session and session_date among the positive bars of their ticker; fails on leakage if they have max_source_available_at."""
    if "max_source_available_at" in events.columns:
        events = guard_leakage(events)
    return event_sessions(events, bars.where((F.col("adjusted_close") > 0) & (F.col("ticker") != config.benchmark)), config.zone, config.close)


def window_returns(placed: DataFrame, bars: DataFrame, config: StudyConfig = StudyConfig()) -> DataFrame:
    """placed_events() or some columns of it (ticker and session at least), a row for each window whose bars exist: window, asset, benchmark and abnormal return."""
    bars = bars.where(F.col("adjusted_close") > 0)  # sessions and prices are numbered over the same bars
    indexed = session_index(bars)
    wins = F.explode(F.array(*[F.struct(F.lit(window_name(w)).alias("window"), F.lit(w[0]).alias("s"), F.lit(w[1]).alias("e")) for w in config.windows]))
    rows = placed.withColumn("w_", wins).select("*", "w_.*").drop("w_")
    leg = lambda n: indexed.select(F.col("ticker").alias(f"t_{n}"), F.col("session").alias(f"i_{n}"), F.col("date").alias(f"date_{n}"), F.col("adjusted_close").alias(f"close_{n}"))
    rows = rows.join(leg("s"), (F.col("ticker") == F.col("t_s")) & (F.col("session") + F.col("s") == F.col("i_s")))
    rows = rows.join(leg("e"), (F.col("ticker") == F.col("t_e")) & (F.col("session") + F.col("e") == F.col("i_e")))
    bench = lambda n: bars.where(F.col("ticker") == config.benchmark).select(F.col("date").alias(f"b_date_{n}"), F.col("adjusted_close").alias(f"b_close_{n}"))
    rows = rows.join(bench("s"), F.col("date_s") == F.col("b_date_s")).join(bench("e"), F.col("date_e") == F.col("b_date_e"))
    asset, market = F.col("close_e") / F.col("close_s") - 1, F.col("b_close_e") / F.col("b_close_s") - 1
    return rows.select(*placed.columns, "window", asset.alias("asset_return"), market.alias("benchmark_return"), (asset - market).alias("abnormal_return"))


def window_summary(returns: DataFrame, windows: tuple[tuple[int, int], ...]) -> DataFrame:
    """(window, n, mean, median, positive_share); windows without returns have n 0 and nulls."""
    spark = returns.sparkSession
    named = spark.createDataFrame([(window_name(w),) for w in windows], "window string")
    sums = returns.groupBy("window").agg(F.count("*").alias("n"), F.avg("abnormal_return").alias("mean"), F.median("abnormal_return").alias("median"), F.avg((F.col("abnormal_return") > 0).cast("double")).alias("positive_share"))
    return named.join(sums, "window", "left").select("window", F.coalesce("n", F.lit(0)).alias("n"), "mean", "median", "positive_share")


def walk_forward(returns: DataFrame, splits: list[str]) -> DataFrame:
    """(split, window, n_train, n_test, test_mean): before and from each split date on."""
    rows = returns.withColumn("split", F.explode(F.array(*[F.lit(s) for s in splits])))
    test = F.col("session_date") >= F.to_date("split")
    return rows.groupBy("split", "window").agg(F.count_if(~test).alias("n_train"), F.count_if(test).alias("n_test"), F.avg(F.when(test, F.col("abnormal_return"))).alias("test_mean"))


def event_study(events: DataFrame, bars: DataFrame, config: StudyConfig = StudyConfig(), key: str = "accession") -> DataFrame:
    """window_summary with bootstrap intervals and adjusted p-values."""
    returns = event_returns(events, bars, config, key)
    boot = stats.bootstrap_by(returns, "abnormal_return", "window", key, config.draws, config.confidence, config.seed).select("window", "low", "high", "p")
    return stats.benjamini_hochberg(window_summary(returns, config.windows).join(boot, "window", "left"), "p")


def signal_study(returns: DataFrame, q: int = 5, winsorise: float | None = None, key: str = "accession", value: str = "abnormal_return") -> DataFrame:
    """(window, n, ic, t_stat, spread) of feature against return; thin windows have nulls."""
    rows = returns.where("feature_value is not null")
    if winsorise:
        rows = stats.winsorise(rows, value, winsorise, ["window"], "outcome")
    else:
        rows = rows.withColumn("outcome", F.col(value))
    spread = stats.long_short(stats.quantile_portfolios(rows, "feature_value", "outcome", q, ["window"], [key]), q, ["window"])
    return stats.spearman(rows, "feature_value", "outcome", ["window"]).join(spread, "window", "left")


def daily_returns(bars: DataFrame) -> DataFrame:
    """bars with session and daily_return, null on a ticker's first day."""
    before = F.lag("adjusted_close").over(Window.partitionBy("ticker").orderBy("date"))
    return session_index(bars).withColumn("daily_return", F.col("adjusted_close") / before - 1)


def realised_volatility(placed: DataFrame, bars: DataFrame, windows: tuple[tuple[int, int], ...], key: str = "accession") -> DataFrame:
    """(key, ticker, window, feature_value, volatility): root mean square of the daily returns of sessions s+1..e after the event's; whole windows only.

    Sums of squares run along each ticker once; a window is the difference of two, so events never meet their days.
    """
    run = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    cum = daily_returns(bars).withColumn("sq", F.sum(F.coalesce(F.col("daily_return") * F.col("daily_return"), F.lit(0.0))).over(run))
    leg = lambda n: cum.select(F.col("ticker").alias(f"t_{n}"), F.col("session").alias(f"i_{n}"), F.col("sq").alias(f"sq_{n}"))
    wins = F.explode(F.array(*[F.struct(F.lit(window_name(w)).alias("window"), F.lit(w[0]).alias("s"), F.lit(w[1]).alias("e")) for w in windows]))
    rows = placed.withColumn("w_", wins).select("*", "w_.*").drop("w_")
    rows = rows.join(leg("s"), (F.col("ticker") == F.col("t_s")) & (F.col("session") + F.col("s") == F.col("i_s"))).join(leg("e"), (F.col("ticker") == F.col("t_e")) & (F.col("session") + F.col("e") == F.col("i_e")))
    mean = F.try_divide(F.greatest(F.lit(0.0), F.col("sq_e") - F.col("sq_s")), (F.col("e") - F.col("s")).cast("double"))
    return rows.select(key, "ticker", "window", "feature_value", F.sqrt(mean).alias("volatility"))


def composite_study(signals: DataFrame, returns: DataFrame, order: list[str], sector: str | None = None, min_group: int = 4) -> DataFrame:
    """(signal, window, n, ic, t_stat) of every component's z-score and of their mean, named composite.

    signals has accession, period, signal, value, sign and, if given, sector; returns has accession, window, abnormal_return.
    """
    z = stats.sector_neutral_zscore(signals, "value", "period", "signal", sector, min_group, F.col("sign")) if sector else stats.zscore(signals, "value", ["period", "signal"], F.col("sign"))
    mean = stats.composite(z, "accession").select("accession", F.lit("composite").alias("signal"), F.col("composite").alias("z"))
    both = z.select("accession", "signal", "z").where(F.col("signal").isin(order)).unionByName(mean)
    return stats.spearman(both.join(returns.select("accession", "window", "abnormal_return"), "accession"), "z", "abnormal_return", ["signal", "window"])


# Sector by SIC code, first match wins; ranges are closed.
SECTORS = (
    ("Health Care", ((2833, 2836), (3826, 3851), (8000, 8099))),
    ("Information Technology", ((7370, 7374), (7389, 7389), (3571, 3572), (3576, 3577), (3674, 3674))),
    ("Consumer Discretionary", ((3711, 3711), (3713, 3715))),
    ("Real Estate", ((6500, 6599), (6798, 6798))),
    ("Materials", ((100, 999), (1000, 1099), (1400, 1499))),
    ("Energy", ((1300, 1399), (2911, 2911))),
    ("Industrials", ((1500, 1799),)),
    ("Consumer Staples", ((2000, 2199),)),
    ("Consumer Discretionary", ((2200, 2399), (3000, 3199))),
    ("Materials", ((2400, 2999), (3200, 3399))),
    ("Industrials", ((3400, 3999), (4000, 4799))),
    ("Communication Services", ((4800, 4899), (7800, 7999))),
    ("Utilities", ((4900, 4999),)),
    ("Industrials", ((5000, 5199),)),
    ("Consumer Discretionary", ((5200, 5999), (7000, 7299))),
    ("Financials", ((6000, 6499), (6700, 6799))),
    ("Industrials", ((7300, 7399), (8100, 8999))),
)


def sic_sector(sic: Column) -> Column:
    """The sector of a SIC code given as number or text; Unknown for null, junk and gaps."""
    code = F.try_to_number(F.trim(sic.cast("string")), F.lit("999999")).cast("int")
    out = None
    for name, ranges in SECTORS:
        hit = F.lit(False)
        for low, high in ranges:
            hit = hit | code.between(low, high)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Unknown")


def study_verdict(studies: DataFrame) -> DataFrame:
    """(signal, outcome, n_windows, n_significant, peak_ic, best_window, stable_sign, state) of published windows (signal, outcome, window, ic, p_adjusted)."""
    known = studies.where("ic is not null")
    g = known.groupBy("signal", "outcome").agg(
        F.count("*").alias("n_windows"), F.count_if(F.col("p_adjusted") < 0.05).alias("n_significant"), F.max(F.abs("ic")).alias("peak_ic"),
        F.max_by("window", F.struct(F.abs("ic"), F.col("window"))).alias("best_window"), (F.min(F.signum("ic")) == F.max(F.signum("ic"))).alias("stable_sign"),
    )
    state = F.when((F.col("n_significant") > 0) & F.col("stable_sign"), "supported").when(F.col("n_significant") > 0, "mixed").otherwise("inconclusive")
    return g.withColumn("state", state)
