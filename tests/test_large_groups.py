"""Statistics of few, large groups: many tasks, no quadratic window, the same values as plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import stats


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_adjusted_p_without_a_quadratic_window(spark):
    rng = random.Random(5)
    ps = [(k, rng.choice([None, round(rng.random(), 2)])) for k in ("a", "b", None) for _ in range(300)]
    got = stats.benjamini_hochberg(spark.createDataFrame(ps, "k string, p double"), "p", ["k"])
    assert "currentrow$(), unboundedfollowing" not in plan(got).lower()
    want = []
    for k in ("a", "b", None):
        own = sorted(p for q, p in ps if q == k and p is not None)
        adjusted, low = {}, 1.0
        for i in range(len(own), 0, -1):
            low = min(low, own[i - 1] * len(own) / i)
            adjusted[own[i - 1]] = low
        want += [(k, p, None if p is None else adjusted[p]) for q, p in ps if q == k]
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


def test_a_key_is_ranked_by_many_tasks(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(rng.choice(["a", None]), rng.choice([None, float(rng.randint(0, 400))])) for _ in range(3000)], "k string, x double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counts = df.groupBy(stats._key(["k"]), "x").agg(F.count("*").alias("n_"))
        assert stats._below(counts, "x").select("part_").distinct().count() == 4
        got = stats.average_ranks(df, "x", ["k"]).groupBy("k", "x", "avg_rank").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(map(str, got)) == sorted(map(str, df.select("k", "x", stats.average_rank("x", ["k"]).alias("avg_rank")).groupBy("k", "x", "avg_rank").count().collect()))


def test_correlation_windows_hold_no_whole_key(spark):
    rng = random.Random(9)
    rows = [("w" if i % 3 else None, float(rng.randint(0, 30)), rng.random()) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r["k"]: r for r in stats.spearman(df, "x", "y", ["k"]).collect()}
    for k in ("w", None):
        x, y = [r[1] for r in rows if r[0] == k], [r[2] for r in rows if r[0] == k]
        rank = lambda v: [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]
        rx, ry, mean = rank(x), rank(y), (len(x) + 1) / 2
        top, vx, vy = (sum((a - mean) * (b - mean) for a, b in zip(p, q, strict=True)) for p, q in ((rx, ry), (rx, rx), (ry, ry)))
        assert got[k]["n"] == len(x) and got[k]["ic"] == pytest.approx(top / (vx * vy) ** 0.5)
    windows = [line for line in plan(stats.spearman(df, "x", "y", ["k"])).split("\n") if "Window [" in line]
    assert windows and all("part_" in w for w in windows)


def test_scores_without_windows(spark):
    df = spark.createDataFrame([("p", "s", None if i == 3 else "t", float(i)) for i in range(12)], "period string, signal string, sector string, x double")
    got = stats.zscore(df, "x", ["period", "signal"])
    assert "Window" not in plan(got) and got.agg(F.sum("z")).first()[0] == pytest.approx(0)
    assert "Window" not in plan(stats.sector_neutral_zscore(df, "x", "period", "signal", "sector"))


def test_rows_are_not_gathered_by_their_cell(spark):
    df = spark.createDataFrame([(f"p{i % 3}", "s", float(i)) for i in range(30)], "period string, signal string, x double")
    got = stats.zscore(df, "x", ["period", "signal"])
    joins = got._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in joins and "SortMergeJoin" not in joins and got.count() == 30


def test_means_of_scores_beside_events(spark):
    zs = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.5), (2, "b", 4.0), (3, "a", 9.0), (None, "a", 9.0)], "id int, signal string, z double")
    events = spark.createDataFrame([(1, "T"), (2, "U"), (2, "V"), (4, "W")], "id int, ticker string")
    got = stats.with_composite(zs, "id", "signal", events)
    want = [(1, "a", 1.0, "T"), (1, "b", 2.5, "T"), (1, "composite", 1.75, "T")] + [(2, s, 4.0, t) for s in ("b", "composite") for t in "UV"]
    assert got.columns == ["id", "signal", "z", "ticker"] and sorted(map(tuple, got.collect())) == sorted(want)
    assert "Union" not in plan(got)


def test_events_meet_days_not_each_other(spark):
    from quillstone.operators import asof

    events = spark.createDataFrame([("T", i, f"2024-01-0{1 + i % 3} 12:00:00") for i in range(60)] + [("T", 60, "2024-02-01 12:00:00")], "ticker string, id int, at string").select("ticker", "id", F.col("at").cast("timestamp").alias("available_at"))
    bars = spark.createDataFrame([("T", "2024-01-02"), ("T", "2024-01-05")], "ticker string, date string").withColumn("date", F.to_date("date"))
    got = asof.event_sessions(events, bars)
    assert {r["id"]: r["session"] for r in got.collect()} == {i: int(i % 3 == 2) for i in range(60)}
    assert all(" id#" not in line for line in plan(got).split("\n") if "Window [" in line)


def test_small_bootstrap_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(stats, "DRAWN", 7)
    values = [random.Random(1).gauss(0, 1) for _ in range(50)]
    rng = random.Random(17 + 50)
    means = sorted(sum(rng.choices(values, k=50)) / 50 for _ in range(40))
    assert stats.bootstrap_mean(values, 40, 0.95, 17)[:2] == (means[1], means[38])


def test_small_bootstrap_by_key(spark):
    rows = [(k, i, None if i % 5 == 0 else float(i)) for k in ("a", None, "b") for i in range(40)] + [("none", 1, None)]
    df = spark.createDataFrame(rows, "k string, at int, x double").repartition(3)
    got = {r["k"]: tuple(r)[1:] for r in stats.bootstrap_by(df, "x", "k", "at", 20).collect()}
    own = [float(i) for i in range(40) if i % 5]
    assert got.pop("none") == (0, None, None, None, None) and set(got) == {"a", "b", None}
    assert set(got.values()) == {(32, sum(own) / 32, *stats.bootstrap_mean(own, 20, 0.95, 17))}


def test_large_bootstrap_of_rows_of_several_keys(spark):
    import hashlib

    rows = [(k, str(i) if i else None, float(i % 9) - 3) for i in range(200) for k in ("a", None)]
    df = spark.createDataFrame(rows, "k string, id string, x double")
    got = {r["k"]: r for r in stats.bootstrap_large(df, "x", "k", "id", 8).collect()}
    means, limits = [], stats.poisson_thresholds()
    for draw in range(8):
        w = {i: sum(int(hashlib.md5((f"{draw // 4}|{i}" if i else f"{draw // 4}").encode()).hexdigest()[draw % 4 * 8 :][:8], 16) >= t for t in limits) for i in range(200)}
        means.append(sum(w[i] * (i % 9 - 3) for i in w) / sum(w.values()))
    for k in ("a", None):
        assert got[k]["n"] == 200 and got[k]["low"] == pytest.approx(sorted(means)[0]) and got[k]["high"] == pytest.approx(sorted(means)[-1])
    assert "explode" not in plan(stats.bootstrap_large(df, "x", "k", "id", 8)).lower().split("mapinarrow")[-1]


def test_listed_quotes_are_not_shuffled(spark):
    from quillstone.operators import evals

    docs = spark.createDataFrame([(1, "a b. c\nd"), (1, "a b. c\nd"), (2, "a bx c"), (3, None), (4, "é (x) \\ $ | é")], "id int, text string")
    quotes = spark.createDataFrame([(10, "b. c\nd"), (11, "a b"), (12, "(x) \\ $ |"), (13, "é"), (14, ""), (15, None), (16, "zz")], "item long, quote string")
    got = evals.holding(docs, "id", quotes, "item")
    assert "Join" not in plan(got) and "xplode" not in plan(got)
    assert sorted((r["id"], r["item"]) for r in got.collect()) == sorted([(1, 10)] * 2 + [(1, 11)] * 2 + [(2, 11), (4, 12), (4, 13)] + [(i, 14) for i in (1, 1, 2, 4)])


def test_dense_top_k_against_all_scores(spark, monkeypatch):
    from quillstone.functions.numbers import cut6
    from quillstone.operators import retrieval

    monkeypatch.setattr(retrieval, "PART_ROWS", 40)
    monkeypatch.setattr(retrieval, "PART_QUERIES", 9)
    rng = random.Random(3)
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [1.0, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0]]
    vectors = odd + [[float(rng.randint(-2, 2)) for _ in range(3)] for _ in range(200)]
    chunks = spark.createDataFrame(list(enumerate(vectors)), "id int, v array<double>").withColumn("label", F.col("id") % 5)
    asked = chunks.where("id < 30").select(F.col("id").alias("query_id"), F.col("v").alias("query_vec"))
    got = retrieval.dense_top_k(asked.where("query_vec is not null and query_id <> 3"), chunks, "id", "v", 6, ("label",))
    scored = retrieval.dense_scores(asked.where("query_vec is not null and query_id <> 3"), chunks, "id", "v").withColumn("dense", cut6(F.col("dense")))
    want = retrieval.top_k(scored, "dense", "id", 6)
    row = lambda r: (r["query_id"], r["rank"], r["id"], r["label"], r["dense"])
    assert sorted(map(row, got.collect())) == sorted(map(row, want.collect()))
